"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.columns import free_names, is_small, small_side
from broadsheet.runtime import stage

#: Fixed seeds over seven words at most: a hash takes the words at 1 and ignores those at 0. Together they meet
#: every choice of replaced words that SHARE allows in a passage of seven words or more; three cannot, four can.
SEEDS = ("11111", "1011011", "1001111", "1010111")
_WIDEST = max(map(len, SEEDS))
#: Passages shorter than this are no evidence; below the widest seed they must occur word for word.
LEAST_WORDS = 5
#: A passage counts as found if this share of the words of one stretch of it stands in a text, in step.
SHARE = 0.8
#: The stretch: so many consecutive words of the passage, or all of a shorter one.
STRETCH = 20
_BREAKS = r"[^\p{L}\p{N}]+"
#: The filter of a large benchmark: some 32 bits per seed, of which it sets three, in up to 65,536 blocks (32 MB).
_BLOCK_BITS, _SEED_BITS, _MOST_BLOCKS = 4096, 32, 1 << 16


def _word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits of a text."""
    words = F.filter(F.split(F.lower(text), _BREAKS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed_hashes(hashes: Column, at: Column, exact: list[int]) -> Column:
    """Hashes of every seed, and of every short length that passages have, laid at position ``at``."""
    shapes = [*SEEDS, *("1" * n for n in exact)]
    found = []
    for number, shape in enumerate(shapes):
        chosen = [F.get(hashes, at + i) for i, mark in enumerate(shape) if mark == "1"]
        fits = at + len(shape) <= F.size(hashes)
        found.append(F.when(fits, F.xxhash64(F.lit(number), *chosen)))
    return F.array(*found)


def _seeded(df: DataFrame, exact: list[int]) -> DataFrame:
    """One row per position and seed of the word hashes in column ``h``: columns of df, ``at`` and ``key``.

    The sequence is made of the sizes alone, and outer, so that the words are split only once.
    """
    last = F.size("h") - LEAST_WORDS
    positions = F.when(last >= 0, F.sequence(F.lit(0), last))
    placed = df.select("*", F.explode_outer(positions).alias("at"))
    keyed = placed.select("*", F.explode(_seed_hashes(F.col("h"), F.col("at"), exact)).alias("key"))
    return keyed.where("key is not null")


def _passages(benchmark: DataFrame, text: str) -> DataFrame:
    """Distinct word sequences of the benchmark, named by the smallest item_id that has them, null if none has one."""
    words = benchmark.select("item_id", _word_hashes(F.col(text)).alias("h"))
    distinct = words.where(F.size("h") >= LEAST_WORDS).groupBy("h").agg(F.min("item_id").alias("item_id"))
    return distinct.withColumn("passage", F.xxhash64("h"))


def _block(key: Column, blocks: int) -> Column:
    """The block of the filter that a seed hash falls into, by its lowest bits."""
    return key.bitwiseAND(F.lit(blocks - 1).cast("long"))


def _places(key: Column) -> list[Column]:
    """The three bits of its block that a seed hash sets, by the bits above those of the largest block number."""
    return [F.shiftrightunsigned(key, 16 + 12 * i).bitwiseAND(F.lit(_BLOCK_BITS - 1).cast("long")).cast("int") for i in range(3)]


def _seed_filter(seeds: DataFrame, blocks: int) -> DataFrame:
    """One row per block that has a seed: its number and its bits as 64 longs."""
    bits = seeds.select(_block(F.col("key"), blocks).alias("block"), F.explode(F.array(*_places(F.col("key")))).alias("bit"))
    mask = F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask")
    masks = bits.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(mask)
    held = masks.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("held"))
    every = F.sequence(F.lit(0), F.lit(_BLOCK_BITS // 64 - 1))
    return held.select("block", F.transform(every, lambda w: F.coalesce(F.col("held")[w], F.lit(0).cast("long"))).alias("masks"))


def _likely(keyed: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose hash may be that of a seed: all that are, and few others, so that few rows are shuffled."""
    wanted, blocks = seeds.count() * _SEED_BITS // _BLOCK_BITS, 1
    while blocks < min(wanted, _MOST_BLOCKS):
        blocks *= 2
    near = keyed.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(_seed_filter(seeds, blocks)), "block")
    for place in _places(F.col("key")):
        mask = F.get("masks", F.shiftright(place, 6))
        near = near.where(F.getbit(mask, place.bitwiseAND(F.lit(63))) == 1)
    return near.select(keyed.columns)


def _hits(texts: DataFrame, seeds: DataFrame, exact: list[int]) -> DataFrame:
    """Where seeds meet texts: one row per ``digest`` with ``hits``, the distinct (passage, position, n).

    Spark keeps all rows that one text gives in memory until they are joined or shuffled, so they hold numbers alone.
    """
    keyed = _seeded(texts, exact).select("digest", "at", "key")
    met = keyed.join(F.broadcast(seeds), "key") if is_small(seeds) else _likely(keyed, seeds).join(seeds, "key")
    merged = met.select("digest", "passage", (F.col("at") - F.col("item_at")).alias("position"), "n").distinct()
    return merged.groupBy("digest").agg(F.collect_list(F.struct("passage", "position", "n")).alias("hits"))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", benchmark_text: str = "text"
) -> DataFrame:
    """Benchmark passages found in texts: one row per ``key`` value and passage.

    Test and training texts are hashed at every position with the same spaced seeds and joined on the
    hashes. Each hit fixes how passage and text lie against each other; there all words of the passage
    are compared. It is found if at least SHARE of some STRETCH consecutive words of it (all words, if
    it has fewer) agree, so replaced words do not hide it. Passages with equal words are one, named by
    their smallest item_id. Columns: key, item_id, position (word of the text at which the passage
    starts, negative if its beginning is cut off), item_words, matched (agreeing words), overlap
    (matched / item_words); of several places the one with most matches, then the first.

    The narrow seeds are broadcast if they are counted to be few; else a filter of their bits is, at most 32 MB, and
    only hashes that pass it are shuffled. Hits hold a hash of the text and not its words. They are merged, written
    once and joined to the texts that have some, for which the texts are read again; texts that share a hash are each
    compared at the places of both. Passages are written once, so that Spark joins them by their measured size. A null
    text has no words; rows with equal keys are merged; null keys and null item_ids are kept; an empty table on either
    side gives no rows; other columns are not read.
    """
    passages = stage(_passages(benchmark, benchmark_text), "passages")
    short = passages.where(F.size("h") < _WIDEST).select(F.size("h").alias("n")).distinct()
    exact = sorted(row.n for row in short.collect())  # two lengths at most
    sides = passages.select("passage", "h").withColumn("n", F.size("h"))
    seeds = _seeded(sides, exact).select("key", "passage", F.col("at").alias("item_at"), "n")
    seeds = stage(seeds.distinct(), "seeds")

    digest = F.xxhash64(F.col(text)).alias("digest")
    hits = stage(_hits(docs.select(digest, _word_hashes(F.col(text)).alias("h")), seeds, exact), "hits")
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), digest)
    texts = texts.join(small_side(hits.select("digest")), "digest", "left_semi").join(hits, "digest")
    hashed = texts.select("doc", _word_hashes(F.col("text")).alias("h"), "hits")
    words = lambda hit: F.transform(F.sequence(F.lit(0), hit["n"] - 1), lambda i: F.get("h", hit["position"] + i))
    cut = F.transform("hits", lambda hit: F.struct(hit["passage"].alias("passage"), hit["position"].alias("position"), words(hit).alias("words")))
    placed = hashed.select("doc", F.explode_outer(cut).alias("hit")).select("doc", "hit.*").distinct()

    compared = placed.join(passages, "passage")
    same = F.zip_with("words", "h", lambda a, b: F.when(a == b, 1).otherwise(0))
    compared = compared.select("doc", "passage", "item_id", "position", same.alias("same"), F.size("h").alias("n"))
    width = F.least(F.lit(STRETCH), F.col("n"))
    needed = F.ceil(F.when(F.col("n") < _WIDEST, F.col("n")).otherwise(width * SHARE))
    total = lambda flags: F.aggregate(flags, F.lit(0), lambda s, x: s + x)
    stretches = F.sequence(F.lit(1), F.col("n") - width + 1)
    best = F.array_max(F.transform(stretches, lambda i: total(F.slice("same", i, width))))
    found = compared.where(best >= needed).withColumn("matched", total(F.col("same")))
    order = F.struct("matched", (-F.col("position")).alias("back"))
    one = found.groupBy("doc", "passage").agg(
        F.max(order).alias("top"), F.max("n").alias("item_words"), F.max("item_id").alias("item_id")
    )
    return one.select(
        F.col("doc").alias(key),
        "item_id",
        (-F.col("top.back")).cast("long").alias("position"),
        F.col("item_words").cast("long").alias("item_words"),
        F.col("top.matched").cast("long").alias("matched"),
        (F.col("top.matched") / F.col("item_words")).alias("overlap"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """Rows whose text holds no benchmark passage; columns stay as they are. Equal texts share their fate.

    Null and empty texts hold none, null ids stay, and an empty table on either side changes nothing.
    """
    (mark,) = free_names(docs, "text_md5")
    marked = docs.withColumn(mark, F.md5(F.coalesce(F.col(text), F.lit(""))))
    leaked = stage(overlaps(marked, benchmark, key=mark, text=text).select(mark).distinct(), "leaked")
    return marked.join(small_side(leaked), mark, "left_anti").select(docs.columns)
