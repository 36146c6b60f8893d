"""Quality rules: counts of a text's own shape, and a log-likelihood ratio against trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from broadsheet.llm.arrays import RangeHashes, Texts, distinct_ranges, fold, is_space, per_text, slices, text_of, words
from broadsheet.llm.columns import free_names, small_side

#: Word one- and two-grams are counted in so many hashed classes.
BUCKETS = 1 << 20
#: Every class is taken to have been met so many times more, by trusted and raw text at their overall rates. Rare
#: classes then say little, so that neither a small corpus nor a fine table makes unlabelled text look untrusted.
PRIOR = 8.0
#: Texts whose mean log ratio is below this are rejected.
THRESHOLD = -0.25
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Grams:
    """Words of a slice and the classes of their one- and two-grams."""

    def __init__(self, texts: Texts):
        self.texts, self.n = texts, len(texts.at) - 1
        self.starts, self.ends = words(texts)
        self.text = text_of(self.starts, texts.at)
        self.ranges = RangeHashes(texts.data)
        self.hashes = self.ranges(self.starts, self.ends)

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Class of every gram, and the text it is in."""
        pair = np.flatnonzero(self.text[1:] == self.text[:-1])
        both = fold([self.hashes[pair], self.hashes[pair + 1]])
        grams = np.concatenate((self.hashes, both))
        return (grams % np.uint64(BUCKETS)).astype(np.int64), np.concatenate((self.text, self.text[pair]))


def shape(grams: Grams) -> dict[str, np.ndarray]:
    """The counts of each text: words, their code points, symbols, repeated lines, words in repeated windows."""
    texts, n, text, hashes = grams.texts, grams.n, grams.text, grams.hashes
    data, at = texts.data, texts.at
    leads = ((data & 0xC0) != 0x80) & ~is_space(data)

    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate((at[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    line_text = text_of(starts, at)
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
    ends = np.minimum(next_break, at[line_text + 1])
    full = np.searchsorted(grams.starts, ends) > np.searchsorted(grams.starts, starts)
    starts, ends, line_text = starts[full], ends[full], line_text[full]
    _, line = distinct_ranges(data, starts, ends, grams.ranges(starts, ends))
    again = np.ones(len(line), bool)
    again[np.unique(line * n + line_text, return_index=True)[1]] = False

    marked = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= WINDOW:
        first = np.flatnonzero(text[: -WINDOW + 1] == text[WINDOW - 1 :])
        _, word = distinct_ranges(data, grams.starts, grams.ends, hashes)
        window = text[first]
        for k in range(WINDOW):
            # numbered anew after each word, so that numbers stay below the square of the slice's words
            window = np.unique(window * (int(word.max()) + 1) + word[first + k], return_inverse=True)[1]
        times = np.bincount(window)
        repeated = first[times[window] > 1]
        np.add.at(marked, repeated, 1)
        np.add.at(marked, repeated + WINDOW, -1)
    inside = np.cumsum(marked)[:-1] > 0

    return {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": per_text(leads, at),
        "n_symbols": per_text(_IS_SYMBOL[data], at),
        "n_dup_lines": np.bincount(line_text[again], minlength=n),
        "n_repeat_words": np.bincount(text[inside], minlength=n),
    }


def gram_counts(docs: DataFrame, trusted: DataFrame, *, text: str = "text") -> DataFrame:
    """Counts of each class over all rows (raw) and over the rows whose doc_id is in ``trusted``.

    Every task adds up its rows and sends one row per class it met. ``trusted`` is broadcast only if
    it is counted to be small.
    """
    (flag,) = free_names(docs, "is_trusted")
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn(flag, F.lit(True))
    marked = docs.select("doc_id", text).join(small_side(ids), "doc_id", "left").select(text, flag)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            marks = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(0)):
                grams, text = Grams(part).classes()
                raw += np.bincount(grams, minlength=BUCKETS)
                good += np.bincount(grams[marks[part.rows][text]], minlength=BUCKETS)
        met = np.flatnonzero(raw)
        columns = [pa.array(met), pa.array(raw[met]), pa.array(good[met])]
        yield pa.RecordBatch.from_arrays(columns, ["gram", "raw", "trusted"])

    partial = marked.mapInArrow(count, "gram long, raw long, trusted long")
    return partial.groupBy("gram").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log of trusted over raw probability of each class, from ``gram_counts``; BUCKETS values at most.

    Classes that were not met have the ratio 0, and all have it if no gram is trusted.
    """
    found = counts.toArrow()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[found["gram"].to_numpy()], good[found["gram"].to_numpy()] = found["raw"].to_numpy(), found["trusted"].to_numpy()
    if not good.any():
        return good
    rate = good.sum() / raw.sum()
    return np.log((good + PRIOR * rate) / ((raw + PRIOR) * rate))


def score_quality(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    text: str = "text",
    keep: list[str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Columns ``keep`` (None: all) of ``docs`` with the counts of ``shape``, base_failed, log_ratio and kept.

    Two multinomials over hashed word grams are estimated from all rows and from the trusted ones, the latter drawn
    to the former by PRIOR. A text's log_ratio is the mean log of their ratio over its grams (0 without grams). Texts fail the
    base rules with fewer than 10 words, or with more than a fifth of their words in five-word windows
    that occur twice; kept are the others whose log_ratio is at least ``threshold``.

    A null text has no words and fails. Rows are scored one by one, so repeated rows get equal values.
    If no row is trusted all ratios are 0 and the base rules decide. Columns of ``docs`` with
    the name of a result give way to it. An empty table gives no rows.
    """
    ratios = log_ratios(gram_counts(docs, trusted, text=text))
    results = [*_COUNTS, "base_failed", "log_ratio", "kept"]
    taken = {name.lower() for name in results}
    others = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    schema = StructType([docs.schema[c] for c in others] + [StructField(c, LongType()) for c in _COUNTS])
    schema = schema.add("base_failed", "boolean").add("log_ratio", "double").add("kept", "boolean")
    source = [*others, text].index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(source)):
                grams = Grams(part)
                found = shape(grams)
                classes, owner = grams.classes()
                sums = np.bincount(owner, ratios[classes], minlength=grams.n)
                ratio = sums / np.maximum(np.bincount(owner, minlength=grams.n), 1)
                failed = (found["n_words"] < 10) | (100 * found["n_repeat_words"] > 20 * found["n_words"])
                new = [*(found[c] for c in _COUNTS), failed, ratio, ~failed & (ratio >= threshold)]
                old = [batch.column(i)[part.rows] for i in range(len(others))]
                yield pa.RecordBatch.from_arrays(old + [pa.array(x) for x in new], others + results)

    return docs.select(*others, *([] if text in others else [text])).mapInArrow(score, schema)


def of_good_shape(docs: DataFrame, trusted: DataFrame, *, text: str = "text") -> DataFrame:
    """Rows that ``score_quality`` keeps; columns stay as they are, whatever their names.

    Null and empty texts have no words and go, repeated rows share their fate, null ids count as untrusted, and an
    empty table stays empty.
    """
    inner = [c if c in ("doc_id", text) else f"column_{i}" for i, c in enumerate(docs.columns)]
    scored = score_quality(docs.toDF(*inner), trusted, text=text).where("kept")
    return scored.select([F.col(i).alias(c) for i, c in zip(inner, docs.columns)])
