"""Frequent phrases and how tightly their words belong together, from an index of word ids per shard."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.ranking import first_rows
from broadsheet.llm.arrays import Texts, slices
from broadsheet.runtime import stage, staging

#: Words in a shard. Its index and all work on it take some 250 bytes a word.
SHARD_WORDS = 1 << 19

#: Language of rows without one.
UNKNOWN = "und"

_INDEX = (
    "shard long, size long, left_words binary, right_words binary, weights binary, "
    "groups array<string>, totals array<long>, words array<string>, group_of array<int>"
)
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def collocations(
    docs: DataFrame,
    *,
    text: str = "text",
    group: str = "lang",
    least: int = 100,
    longest: int = 5,
    top: int = 2000,
    absorbed: int = 100,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The first ``top`` phrases of each language by how much likelier they are than their parts.

    Texts, lower-cased in A-Z, are split into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and
    tabs. A candidate has 2 to ``longest`` words and a >= ``least`` occurrences inside pieces of its language. Of its cuts
    into a first part with l and a rest with r occurrences the one with the least floor(1000 a n / (l r)) counts, n
    being the language's words; equal ones give way to the shortest first part. A candidate goes if a longer one that
    holds it has ``absorbed`` per cent of its occurrences; one that is longer by a word shows that already, as one
    that is longer still has no more occurrences than what it holds.

    Each shard of at most ``shard_words`` words gets an FM-index in both directions over word ids, ordered to the
    depth of the longest phrase. Intervals of all its phrases of one length are extended at once, to the right
    in one transform and to the left in the other, with counts. Counts of words and word pairs are summed
    across shards first; shards then go on only through pairs that are frequent everywhere taken together, which every
    frequent longer phrase is made of. No count is estimated and nothing is cut off by a cap.

    A shard sends each word and pair once, so the rows of one are no more than shards, however often it occurs. Of longer
    phrases it sends runs: where one of three words begins, the longest phrase there, equal ones together with their number.
    A phrase occurs where a run begins with it. So these rows are at most one per word, and no more than those of pairs.
    Texts longer than a shard are cut between words; the words behind a cut that phrases before it need are
    counted with both neighbours and subtracted once.

    Null texts are empty, a null language is ``und``; repeated rows count as often as they are there, ids are not
    read and other columns neither, so their names cannot clash. Ties go by phrase in byte order. An empty table, or
    one without frequent phrases, gives no rows. Columns: ``group``, rank, phrase, a, l, r, n, score.
    Exact up to 10^17 words a language.
    """
    if not 0 < shard_words < _PLACES // 4:
        raise ValueError(f"shard_words must be below {_PLACES // 4}")
    spark = docs.sparkSession
    chosen = docs.select(F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN)), F.col(text))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for words in _shards(batches, shard_words, longest):
            yield _index_row(number, words, longest)
            number += _PLACES

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                index = _Index(batch.slice(at, 1))
                for place, phrases in ((False, index.words()), (True, index.pairs())):
                    yield from index.rows(phrases, at=place)

    def longer(indexes: pa.Table, places: pa.Table) -> pa.Table:
        found: list[pa.RecordBatch] = []
        if indexes.num_rows and places.num_rows:
            found += _Index(indexes).runs(places.column("place").to_numpy(), longest)
        return pa.Table.from_batches(found, _RUNS)

    with staging(spark, keep_shuffles=False) as put:
        indexes = put(chosen.mapInArrow(build, _INDEX), "phrase-index")
        counted = indexes.select(*_INDEX_COLUMNS).mapInArrow(pairs, _ROWS_DDL)
        same = Window.partitionBy("phrase")
        counted = counted.select("*", F.sum("count").over(same).alias("f"), F.min("at").over(same).alias("first"))
        short = put(counted.where(F.col("f") >= least).drop("count"), "phrase-pairs")
        totals = short.where("at = first").select("phrase", "f")
        if longest > 2:
            place = F.col("at") % _PLACES
            marks = short.where(place < _PLACES - 1).select((F.col("at") - place).alias("shard"), place.alias("place"))
            grown = indexes.select(*_INDEX_COLUMNS).groupBy("shard").cogroup(marks.groupBy("shard"))
            runs = grown.applyInArrow(longer, _RUNS_DDL)
            # a phrase is no more frequent than its first three words, so only runs behind frequent ones are taken apart
            runs = runs.withColumn("f", F.sum("count").over(same)).where(F.col("f") >= least)
            runs = _without_rare_ends(runs, least, longest).select(F.explode(_beginnings()).alias("phrase"), "count")
            totals = totals.union(runs.groupBy("phrase").agg(F.sum("count").alias("f")).where(F.col("f") >= least))
        words = F.substring_index("phrase", "\n", 1)
        lang = F.substr("phrase", F.length(words) + 2)
        totals = put(totals.select(lang.alias("lang"), words.alias("phrase"), "f"), "phrase-totals")
        sizes = indexes.select(F.explode(F.arrays_zip("groups", "totals")).alias("s")).groupBy(F.col("s.groups").alias("lang"))
        sizes = sizes.agg(F.sum("s.totals").alias("n"))
        scored = _scored(totals, sizes)
        scored = _not_absorbed(scored, totals, absorbed)
        order = scored.withColumns({"_score": -F.col("score"), "_a": -F.col("a")})
        ranked = first_rows(order, ["lang"], ["_score", "_a", "phrase"], top, number="rank")
        out = [F.col("lang").alias(group), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"]
        return stage(ranked.select(*out), "collocations")


def _without_rare_ends(runs: DataFrame, least: int, longest: int) -> DataFrame:
    """Runs up to the last word with which they still begin ``least`` times, equal ones in one row. Stays dealt by ``phrase``."""

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("phrase", "more").agg(F.sum("count").alias("count"))

    more = F.when(F.col("more") != "", F.split("more", " ", -1)).otherwise(F.array().cast("array<string>"))
    runs = summed(runs.select("phrase", more.alias("more"), "count"))
    for k in range(1, longest - 2):
        f = F.sum("count").over(Window.partitionBy("phrase", F.slice("more", 1, k)))
        rare = (F.size("more") >= k) & (F.col("f") < least)
        runs = runs.withColumn("f", f).withColumn("more", F.when(rare, F.slice("more", 1, k - 1)).otherwise(F.col("more")))
    return summed(runs)


def _beginnings() -> Column:
    """What a run begins with, from three words on."""
    words = F.substring_index("phrase", "\n", 1)
    lang = F.substr("phrase", F.length(words) + 1)
    first = lambda k: F.array_join(F.concat(F.array(words), F.slice("more", F.lit(1), k)), " ")
    return F.transform(F.sequence(F.lit(0), F.size("more")), lambda k: F.concat(first(k), lang))


def _words() -> Column:
    return F.split("phrase", " ", -1)


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice(_words(), first, length), " ")


def _scored(totals: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each phrase of several words with its lowest cut."""
    length = F.size(_words())
    cuts = totals.where(F.instr("phrase", " ") > 0).select("*", F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", F.col("f").alias("a"), "k",
        _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, length - F.col("k")).alias("rest"),
    )
    parts = totals.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = totals.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(parts, ["lang", "first"]).join(rests, ["lang", "rest"]).join(sizes, "lang")
    # integers of up to 38 digits; `div` leaves the fraction off
    score = F.expr("cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = both.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = best.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")


def _not_absorbed(scored: DataFrame, totals: DataFrame, per_cent: int) -> DataFrame:
    """Without phrases that a phrase one word longer nearly always holds."""
    length = F.size(_words())
    ends = F.array(_part(F.lit(1), length - 1), _part(F.lit(2), length - 1))
    inside = totals.where(length > 2).select("lang", F.explode(ends).alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    kept = F.col("within").isNull() | (100 * F.col("within") < per_cent * F.col("a"))
    return scored.join(inside, ["lang", "phrase"], "left").where(kept).drop("within")


class _Words(NamedTuple):
    """Words of a task's texts in order: bytes, ends in them, whether a piece starts, and the language's number."""

    data: np.ndarray
    ends: np.ndarray
    starts_piece: np.ndarray
    group: np.ndarray


def _split(part: Texts, group: np.ndarray) -> _Words:
    kept = ~(_BREAKS | _BLANKS)[part.data]
    edge = np.zeros(len(kept) + 1, bool)
    edge[part.at] = True
    starts = np.flatnonzero(kept & (edge[:-1] | ~np.concatenate(([False], kept[:-1]))))
    ends = np.flatnonzero(kept & (edge[1:] | ~np.concatenate((kept[1:], [False])))) + 1
    breaks = np.cumsum(_BREAKS[part.data])[starts]
    of_text = np.searchsorted(part.at, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (of_text[1:] != of_text[:-1])
    return _Words(_LOWER[part.data][kept], np.cumsum(ends - starts), new, group[of_text])


class _Shard(NamedTuple):
    words: _Words
    groups: list[str]
    weights: np.ndarray


def _shards(batches: Iterator[pa.RecordBatch], limit: int, longest: int) -> Iterator[_Shard]:
    """Runs of ``limit`` words. What phrases over a cut need from behind it is added to the run before, and subtracted."""
    groups: dict[str, int] = {}
    waiting: list[_Words] = []
    count = 0
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        codes = np.array([groups.setdefault(name, len(groups)) for name in names.dictionary.to_pylist()], np.int64)
        of_row = codes[names.indices.to_numpy()] if len(codes) else codes
        for part in slices(batch.column(1)):
            waiting.append(_split(part, of_row[part.rows]))
            count += len(waiting[-1].ends)
            if count >= limit + longest:
                whole, at = _joined(waiting), 0
                while count - at >= limit + longest:
                    yield _cut(whole, at, at + limit, longest, list(groups))
                    at += limit
                waiting, count = [_taken(whole, at, count)], count - at
    if count:
        yield _cut(_joined(waiting), 0, count, longest, list(groups))


def _joined(parts: list[_Words]) -> _Words:
    if len(parts) == 1:
        return parts[0]
    before = np.cumsum([0, *(len(p.data) for p in parts[:-1])])
    ends = np.concatenate([p.ends + b for p, b in zip(parts, before)])
    data, starts_piece, group = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
    return _Words(data, ends, starts_piece, group)


def _taken(words: _Words, first: int, last: int) -> _Words:
    begin = int(words.ends[first - 1]) if first else 0
    stop = int(words.ends[last - 1]) if last else 0
    return _Words(words.data[begin:stop].copy(), words.ends[first:last] - begin, words.starts_piece[first:last].copy(), words.group[first:last].copy())


def _cut(words: _Words, first: int, last: int, longest: int, groups: list[str]) -> _Shard:
    own = _taken(words, first, last)
    own.starts_piece[:1] = True
    behind = words.starts_piece[last : last + longest - 1]
    more = int(np.argmax(behind)) if behind.any() else len(behind)
    if not more:
        return _Shard(own, groups, np.ones(last - first, np.int8))
    over, again = _taken(words, last, last + more), _taken(words, last, last + more)
    again.starts_piece[0] = True
    weights = np.ones(last - first + 2 * more, np.int8)
    weights[-more:] = -1
    return _Shard(_joined([own, over, again]), groups, weights)


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type, size: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).reshape(size)


def _suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the ``depth`` ids from there on, equal ones in order."""
    ranks, known = ids.astype(np.int64), 1
    order = np.argsort(ranks, kind="stable")
    while known < depth:
        step = min(known, depth - known)
        ahead = np.zeros(len(ids), np.int64)
        ahead[: len(ids) - step] = ranks[step:]
        keys = ranks * (int(ranks.max()) + 1) + ahead
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        ranks = np.empty(len(ids), np.int64)
        ranks[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        known += step
    return order


def _index_row(number: int, shard: _Shard, depth: int) -> pa.RecordBatch:
    """Both transforms of a shard. Id 0 stands around pieces."""
    words, groups, weights = shard
    offsets = np.concatenate(([0], words.ends)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), len(words.ends), [None, pa.py_buffer(offsets), pa.py_buffer(words.data)])
    column = column.dictionary_encode()
    names = column.dictionary
    codes, ids = np.unique(words.group * len(names) + column.indices.to_numpy(), return_inverse=True)
    at = np.arange(len(ids)) + np.cumsum(words.starts_piece)
    whole, weight = np.zeros(len(ids) + int(words.starts_piece.sum()) + 1, np.int32), np.zeros(0, np.int8)
    whole[at] = ids + 1
    order = _suffix_order(whole, depth)
    if (weights < 0).any():
        weight = np.zeros(len(whole), np.int8)
        weight[at] = weights
        weight = weight[order]
    back = whole[::-1]
    totals = np.bincount(words.group, weights=weights, minlength=len(groups)).astype(np.int64)
    here = np.flatnonzero(totals)
    columns = [
        [number], [len(whole)], [_packed(whole[order - 1])], [_packed(back[_suffix_order(back, depth) - 1])],
        [_packed(weight) if len(weight) else None], [[groups[g] for g in here]], [totals[here]],
        [names.take(pa.array(codes % len(names))).cast(pa.string())],
        [np.searchsorted(here, codes // len(names)).astype(np.int32)],
    ]
    return pa.RecordBatch.from_arrays([_column(c, t) for c, t in zip(columns, _INDEX_SCHEMA.types)], schema=_INDEX_SCHEMA)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind) and isinstance(values[0], pa.Array):
        return pa.ListArray.from_arrays(pa.array([0, len(values[0])], pa.int32()), values[0])
    return pa.array(values, kind)


_INDEX_SCHEMA = pa.schema(
    [
        ("shard", pa.int64()), ("size", pa.int64()), ("left_words", pa.binary()), ("right_words", pa.binary()), ("weights", pa.binary()),
        ("groups", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("group_of", pa.list_(pa.int32())),
    ]
)
_INDEX_COLUMNS = ["shard", "size", "left_words", "right_words", "weights", "groups", "words", "group_of"]
#: A phrase and, after a line end, its language; the shard's number plus the place among its pairs, or the last place for words.
_ROWS = pa.schema([("phrase", pa.string()), ("at", pa.int64()), ("count", pa.int64())])
_ROWS_DDL = "phrase string, at long, count long"
#: The first three words of a run and the language, the other words, and how often the run is there.
_RUNS = pa.schema([("phrase", pa.string()), ("more", pa.string()), ("count", pa.int64())])
_RUNS_DDL = "phrase string, more string, count long"
_PLACES = 1 << 24
#: Rows of a batch, and rows of a transform that are looked at together.
_BATCH = 1 << 17


class _Phrases(NamedTuple):
    """Phrases of one length: their word ids, and their intervals in both transforms, which are equally long."""

    ids: list[np.ndarray]
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray


class _Index:
    """An FM-index over word ids that extends phrases on both sides."""

    def __init__(self, row):
        one = {name: row.column(name)[0].as_py() for name in ("shard", "size", "left_words", "right_words", "weights")}
        self.shard, size = one["shard"], one["size"]
        self._texts = {side: _unpacked(one[f"{side}_words"], np.int32, size) for side in ("left", "right")}
        #: Rows by the id before them: where each id before a row stands as a row itself.
        self._steps = {side: _places(ids) for side, ids in self._texts.items()}
        self._first = np.concatenate(([0], np.cumsum(np.bincount(self._texts["left"])))).astype(np.int32)
        weights = _unpacked(one["weights"], np.int8, size) if one["weights"] else None
        self._weights = None if weights is None else np.concatenate(([0], np.cumsum(weights, dtype=np.int64)))
        self._words, self._groups, self._group_of = (_values(row.column(name)) for name in ("words", "groups", "group_of"))

    def words(self) -> _Phrases:
        ids = np.arange(1, len(self._first) - 1, dtype=np.int32)
        return _Phrases([ids], self._first[ids], self._first[ids], self._first[ids + 1] - self._first[ids])

    def pairs(self) -> _Phrases:
        return self.extended(self.words(), "right")

    def grown(self, places: np.ndarray, longest: int) -> Iterator[_Phrases]:
        """Phrases of three and more words all of whose neighbouring words are among the pairs at ``places``."""
        pairs = self.pairs()
        pairs = _Phrases([i[places] for i in pairs.ids], *(c[places] for c in pairs[1:]))
        among = {}
        for side, starts in (("left", pairs.left), ("right", pairs.right)):
            step = np.zeros(len(self._texts[side]) + 1, np.int32)
            step[starts] += 1
            step[starts + pairs.size] -= 1  # intervals of one length are apart, so no place is met twice
            among[side] = np.cumsum(step) > 0
        phrases = pairs
        for length in range(3, longest + 1):
            side = "left" if length % 2 else "right"
            phrases = self.extended(phrases, side)
            allowed = among[side][phrases.left if side == "left" else phrases.right]
            phrases = _Phrases([i[allowed] for i in phrases.ids], *(c[allowed] for c in phrases[1:]))
            yield phrases

    def runs(self, places: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
        """The longest of the ``grown`` phrases at each place where one begins, equal ones in one row."""
        phrases = None
        for longer in self.grown(places, longest):
            if phrases:
                yield from self._ended(phrases, longer)
            phrases = longer
        if phrases:
            yield from self._ended(phrases, None)

    def _ended(self, phrases: _Phrases, longer: _Phrases | None) -> Iterator[pa.RecordBatch]:
        """The phrases by how often none of the ``longer`` ones, whose intervals are inside theirs, begins with them."""
        counts = self._counts(phrases)
        if longer:
            begun = np.zeros(len(self._texts["left"]) + 1, np.int64)
            begun[longer.left + 1] = self._counts(longer)
            begun = np.cumsum(begun)
            counts = counts - (begun[phrases.left + phrases.size] - begun[phrases.left])
        ended = np.flatnonzero(counts)
        for first in range(0, len(ended), _BATCH):
            there = ended[first : first + _BATCH]
            text = self._text(phrases.ids[:3], there)
            more = [self._words.take(pa.array(i[there] - 1)) for i in phrases.ids[3:]]
            more = pc.binary_join_element_wise(*more, " ") if more else pa.array([""] * len(there), pa.string())
            yield pa.RecordBatch.from_arrays([text, more, pa.array(counts[there], pa.int64())], schema=_RUNS)

    def _counts(self, phrases: _Phrases) -> np.ndarray:
        if self._weights is None:
            return phrases.size
        return self._weights[phrases.left + phrases.size] - self._weights[phrases.left]

    def _text(self, ids: list[np.ndarray], there: np.ndarray) -> pa.Array:
        """Words and language of some phrases."""
        words = [self._words.take(pa.array(i[there] - 1)) for i in ids]
        lang = self._groups.take(self._group_of.take(pa.array(ids[0][there] - 1)))
        text = pc.binary_join_element_wise(*words, " ") if len(words) > 1 else words[0]
        return pc.binary_join_element_wise(text, lang, "\n")

    def extended(self, phrases: _Phrases, side: str) -> _Phrases:
        """All phrases one word longer on one side.

        The rows of an interval, by the word before them, are the new intervals there; in the other transform
        they part the old interval in the order of that word.
        """
        if not len(phrases.size):
            return _Phrases([*phrases.ids, phrases.ids[0]], *phrases[1:])
        parts = np.cumsum(phrases.size) // _BATCH
        cuts = np.flatnonzero(np.diff(parts)) + 1
        found = [
            self._extended(_Phrases([i[a:b] for i in phrases.ids], *(c[a:b] for c in phrases[1:])), side)
            for a, b in zip([0, *cuts], [*cuts, len(parts)])
        ]
        ids = [np.concatenate(i) for i in zip(*(f.ids for f in found))]
        return _Phrases(ids, *(np.concatenate(c) for c in zip(*(f[1:] for f in found))))

    def _extended(self, phrases: _Phrases, side: str) -> _Phrases:
        here, there = (phrases.left, phrases.right) if side == "left" else (phrases.right, phrases.left)
        begin = np.cumsum(phrases.size) - phrases.size
        of = np.repeat(np.arange(len(here)), phrases.size)
        rows = np.arange(len(of)) - begin[of] + here[of]
        kinds = len(self._first)
        keys = of * kinds + self._texts[side][rows]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(heads, len(keys)))
        parent, word = np.divmod(keys[heads], kinds)
        new_here = self._steps[side][rows[order[heads]]]
        new_there = there[parent] + heads - begin[parent]
        real = word > 0
        ids = [i[parent[real]] for i in phrases.ids]
        ids = [word[real].astype(np.int32), *ids] if side == "left" else [*ids, word[real].astype(np.int32)]
        both = (new_here, new_there) if side == "left" else (new_there, new_here)
        return _Phrases(ids, *(c[real].astype(np.int32) for c in (*both, sizes)))

    def rows(self, phrases: _Phrases, at: bool) -> Iterator[pa.RecordBatch]:
        counts = self._counts(phrases)
        for first in range(0, len(counts), _BATCH):
            # a pair that counts nothing here may still stand in a longer phrase over a cut, so its place is sent
            there = np.arange(first, min(first + _BATCH, len(counts)))
            there = there if at else there[counts[there] != 0]
            place = self.shard + (there if at else np.full(len(there), _PLACES - 1))
            columns = [self._text(phrases.ids, there), pa.array(place, pa.int64()), pa.array(counts[there], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)


def _places(ids: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), np.int32)
    out[np.argsort(ids, kind="stable")] = np.arange(len(ids), dtype=np.int32)
    return out


def _values(column) -> pa.Array:
    """What the list in the only row of a column holds."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten()
