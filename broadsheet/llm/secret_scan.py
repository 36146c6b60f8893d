"""Secrets in texts: fixed shapes, and values in credential contexts that would be hard to guess."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.runtime import stage, staging

#: Kinds in the order of equal starts, their patterns, the group that is measured, its least length.
SHAPES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]

#: Kind of the spans that the guess cost adds.
VALUE = "value"

#: Words after which a value may be a credential, what may stand between, and the value itself.
CONTEXT = (
    r"(?:password|passwd|passphrase|passcode|pwd|pin|secret|token|bearer|credentials?|login|api[_-]?key|access[_-]?key|private[_-]?key)"
    r"""["']?[ \t]*(?::=|=>|[:=]|\bis\b)[ \t]*["'“]?([^\s"'“”<>,;]{4,})"""
)

#: A value counts as a secret from so many bits of guessing on.
LEAST_BITS = 40.0

#: Lengths of words that are looked up.
WORD_LENGTHS = (3, 24)

#: Rows of a keyboard, of which the second to fourth stand a half, three quarters and one and a quarter keys further right; and the alphabet.
KEY_ROWS = [(0.0, "1234567890-="), (0.5, "qwertyuiop[]"), (0.75, "asdfghjkl;'"), (1.25, "zxcvbnm,./")]
ALPHABET = "abcdefghijklmnopqrstuvwxyz"

#: Signs that stand for letters.
SIGNS, LETTERS = "@4301!5$7", "aaeoiisst"

#: Bits to say of which sort a segment is.
_SORT = math.log2(5)


def scan_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_bits: float = LEAST_BITS) -> DataFrame:
    """Spans of secrets in every whole text, a row per document.

    Base spans are the whole matches of SHAPES, found from the left without overlap, kind by kind; a match whose
    measured group is too short is passed over and not tried anew inside. Values behind the words of CONTEXT,
    and those that ``assign`` finds, are given a guess cost: the least sum of bits over all ways to cut the
    value into words, dates, repeats, keyboard walks and characters that have to be tried one by one. A value of
    ``least_bits`` or more that touches no base span adds a span of the kind ``value``.

    A word costs log2(all words / its occurrences) over all documents, where occurrences inside the values themselves
    don't count, so that a secret that was copied doesn't become a word. The counts stay in Spark: only strings
    that occur in values are joined to them. Nothing is broadcast by hand, and no list of words is cut.

    Positions are code points, ends are exclusive. A null text is empty and has none; null and repeated keys give a
    row each, empty tables none. Other columns are not read. Columns: ``key``, n_assign, n_access, n_hex, base_sha256 (of
    the base spans joined as in ``spans``; of the empty string without any), spans (kind:start:end by start, then kind,
    joined by commas), n_value, guess_bits (the greatest cost of the text's values, null without any).
    """
    schema = docs.schema[key].dataType.simpleString()
    span = "struct<start: long, turn: int, kind: string, end: long>"
    found_as = f"id {schema}, base array<{span}>, candidates array<struct<start: long, end: long, guess: string>>"
    with staging(docs.sparkSession) as put:
        chosen = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        found = put(chosen.mapInArrow(_scanned, found_as).withColumn("row", F.monotonically_increasing_id()), "secret-spans")
        candidates = found.select("row", "base", F.explode("candidates").alias("c")).select("row", "base", "c.*")
        bits = put(_bits(candidates, chosen, put), "guess-bits")
        rated = candidates.join(bits, "guess")
        apart = ~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
        added = F.struct("start", F.lit(len(SHAPES)).alias("turn"), F.lit(VALUE).alias("kind"), "end")
        rated = rated.groupBy("row").agg(
            F.collect_list(F.when(apart & (F.col("bits") >= least_bits), added)).alias("added"),
            F.max("bits").alias("guess_bits"),
        )
        both = found.join(rated, "row", "left")
        more = F.coalesce("added", F.array().cast(f"array<{span}>"))
        out = both.select(
            F.col("id").alias(key),
            *(_count(kind).alias(f"n_{kind}") for kind, *_ in SHAPES),
            F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
            _joined(F.concat("base", more)).alias("spans"),
            F.size(more).cast("long").alias(f"n_{VALUE}"),
            "guess_bits",
        )
        return stage(out, "secrets")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


_PATTERNS = [(kind, re.compile(shape, re.ASCII | (re.IGNORECASE if group else 0)), group, least) for kind, shape, group, least in SHAPES]
_CONTEXT = re.compile(CONTEXT, re.ASCII | re.IGNORECASE)


def spans_of(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans of a text, and the values to guess with their own spans."""
    base, values = [], {}
    for turn, (kind, pattern, group, least) in enumerate(_PATTERNS):
        for match in pattern.finditer(text):
            if len(match[group]) >= least:
                base.append({"start": match.start(), "turn": turn, "kind": kind, "end": match.end()})
                if group:
                    values[match.span(group)] = match[group]
    for match in _CONTEXT.finditer(text):
        values.setdefault(match.span(1), match[1])
    base.sort(key=lambda b: (b["start"], b["turn"]))
    return base, [{"start": s, "end": e, "guess": v} for (s, e), v in sorted(values.items())]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("turn", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])
    value = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("guess", pa.string())])
    for batch in batches:
        found = [spans_of(text.as_py()) for text in batch.column(1)]
        columns = [batch.column(0), pa.array([b for b, _ in found], pa.list_(span)), pa.array([v for _, v in found], pa.list_(value))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "base", "candidates"])


def _bits(candidates: DataFrame, docs: DataFrame, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Columns guess and bits, a row for each different value."""
    values = put(candidates.select("guess").distinct().withColumn("value", F.monotonically_increasing_id()), "values")
    parts = values.mapInArrow(_parts, "value long, word string")

    def words(of: str, weight: int) -> list[Column]:
        return [F.explode(F.split(F.lower(of), "[^a-z]+")).alias("word"), F.lit(weight).alias("weight")]

    counts = docs.select(*words("text", 1)).union(candidates.select(*words("guess", -1)))
    counts = counts.where(F.length("word").between(*WORD_LENGTHS)).groupBy("word").agg(F.sum("weight").alias("f"))
    counts = put(counts.where("f > 0"), "word-counts")
    # one number; at least one, so that its logarithm exists
    total = max(counts.agg(F.sum("f")).first()[0] or 0, 1)
    known = parts.join(counts, "word").select("value", "word", F.log2(F.lit(float(total)) / F.col("f")).alias("cost"))
    known = known.groupBy("value").agg(F.collect_list(F.struct("word", "cost")).alias("known"))
    return values.join(known, "value", "left").select("guess", "known").mapInArrow(_rated, "guess string, bits double")


def _letters(value: str) -> tuple[str, str]:
    """A value in lower case, and the same with letters for the signs that stand for them; no character more or less."""
    plain = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return plain, plain.translate(_TO_PLAIN)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different string of letters in a value that could be a word, a batch per value."""
    shortest, longest = WORD_LENGTHS
    for batch in batches:
        for value, guess in zip(batch.column("value"), batch.column("guess")):
            words = set()
            for run in re.findall(f"[a-z]{{{shortest},}}", _letters(guess.as_py())[1]):
                for n in range(shortest, min(longest, len(run)) + 1):
                    words.update(run[i : i + n] for i in range(len(run) - n + 1))
            columns = [pa.array([value.as_py()] * len(words), pa.int64()), pa.array(sorted(words), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["value", "word"])


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = [{w["word"]: w["cost"] for w in words or ()} for words in batch.column("known").to_pylist()]
        bits = [guess_bits(value, words) for value, words in zip(batch.column("guess").to_pylist(), known)]
        yield pa.RecordBatch.from_arrays([batch.column("guess"), pa.array(bits, pa.float64())], ["guess", "bits"])


def _keys() -> dict[str, tuple[float, float]]:
    return {key: (row, x + at) for row, (x, keys) in enumerate(KEY_ROWS) for at, key in enumerate(keys)}


_KEYS = _keys()
_TO_PLAIN = str.maketrans(SIGNS, LETTERS)
_DATES = [
    (re.compile(r"(?:19|20)\d\d"), math.log2(200)),
    (re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"), math.log2(200 * 366 * 4)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"), math.log2(200 * 366 * 4)),
    (re.compile(r"(?:0[1-9]|1[0-2])([-/.]?)(?:0[1-9]|[12]\d|3[01])\1(?:19|20)\d\d"), math.log2(200 * 366 * 4)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\1\d\d"), math.log2(100 * 366 * 4)),
]


def _one_by_one(sign: str) -> float:
    if not sign.isascii():
        return math.log2(1000)
    return math.log2(10 if sign.isdigit() else 26 if sign.isalpha() else 33)


def _step(a: str, b: str) -> tuple | None:
    """Direction of a move between neighbouring keys or letters; None for any other."""
    if a.isascii() and b.isascii() and a.isalpha() and b.isalpha() and abs(ord(b) - ord(a)) == 1:
        return ("alphabet", ord(b) - ord(a))
    if a in _KEYS and b in _KEYS and a != b:
        (row, x), (to_row, to_x) = _KEYS[a], _KEYS[b]
        if abs(to_row - row) <= 1 and abs(to_x - x) <= 1:
            return (to_row - row, to_x > x)
    return None


def _case_bits(part: str) -> float:
    upper = sum(c.isupper() for c in part)
    if not upper:
        return 0.0
    if upper == len(part) or (upper == 1 and part[0].isupper()):
        return 1.0
    return math.log2(math.comb(len(part), upper) + 1) + 1


def guess_bits(value: str, words: dict[str, float]) -> float:
    """Least bits to guess a value, over all ways to cut it; time grows with its length alone.

    ``words`` has the bits of each word that occurs in the value in lower case with letters for signs. Walks and
    repeats run as far as they go from where they begin; a repeated part of up to 16 characters is itself a word, a
    date, or tried one by one.
    """
    n = len(value)
    plain, letters = _letters(value)
    single = [_one_by_one(c) for c in value]
    before = [0.0]
    for bits in single:
        before.append(before[-1] + bits)
    moves = [_step(plain[i], plain[i + 1]) for i in range(n - 1)]
    ends, turns = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if i + 1 < n and moves[i]:
            ends[i] = ends[i + 1]
            turns[i] = turns[i + 1] + (i + 2 < n and moves[i + 1] is not None and moves[i + 1] != moves[i])
        else:
            ends[i] = i + 1
    #: same[p][i]: how far value[i:] goes on repeating with period p
    periods = range(1, min(16, n // 2) + 1)
    same = {p: [0] * (n + 1) for p in periods}
    for p in periods:
        for i in range(n - p - 1, -1, -1):
            same[p][i] = same[p][i + 1] + 1 if value[i] == value[i + p] else 0

    def whole(i: int, j: int) -> float:
        """One segment, no walk and no repeat."""
        bits = before[j] - before[i]
        word = words.get(letters[i:j])
        if word is not None and any(c.isalpha() for c in value[i:j]):
            signs = sum(a != b for a, b in zip(plain[i:j], letters[i:j]))
            bits = min(bits, word + signs + _case_bits(value[i:j]))
        for pattern, cost in _DATES:
            if pattern.fullmatch(value, i, j):
                bits = min(bits, cost)
        return bits

    shortest, longest = WORD_LENGTHS
    best = [0.0] + [math.inf] * n
    #: least bits of a way that ends here inside a stretch that is tried one by one
    open_stretch = math.inf
    for i in range(n):
        start = best[i] + _SORT
        open_stretch = min(start, open_stretch) + single[i]
        best[i + 1] = min(best[i + 1], open_stretch)
        for j in range(i + shortest, min(n, i + longest) + 1):
            best[j] = min(best[j], start + whole(i, j))
        if ends[i] - i >= 3:
            walk = math.log2(len(_KEYS)) + math.log2(ends[i] - i) + 2 * (turns[i] + 1) + _case_bits(value[i : ends[i]])
            best[ends[i]] = min(best[ends[i]], start + walk)
        for p in periods:
            times = (same[p][i] // p if i + p <= n else 0) + 1
            if times * p >= 3 and times >= 2:
                best[i + times * p] = min(best[i + times * p], start + whole(i, i + p) + math.log2(times) + _SORT)
    return best[n]
