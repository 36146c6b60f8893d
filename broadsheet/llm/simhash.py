"""Near-duplicates by SimHash: fingerprints that meet at a variant half way between them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.arrays import slices
from broadsheet.llm.columns import free_names
from broadsheet.llm.components import components
from broadsheet.runtime import stage

BITS = 64
SHINGLE = 4
RADIUS = 4
#: Runs of up to so many fingerprints at one variant are compared directly; longer ones take the full ball.
RUN = 1024
_SEED = 42
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes) -> int:
    """SimHash of one UTF-8 text: per bit, whether over half of its shingles' XXH64 have it set."""
    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < SHINGLE:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: -SHINGLE + 1], ends[SHINGLE - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), _HASHES_AT_ONCE):
        bounds = zip(starts[i : i + _HASHES_AT_ONCE].tolist(), ends[i : i + _HASHES_AT_ONCE].tolist())
        hashes = np.fromiter((digest(joined[s:e], _SEED) for s, e in bounds), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, *, text: str = "text", name: str = "simhash") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a long; a null text counts as empty."""

    @F.arrow_udf("long")
    def fingerprints(column: pa.Array) -> pa.Array:
        out: list[int] = []
        for part in slices(column):
            raw, at = part.data.tobytes(), part.at.tolist()
            out += [fingerprint(raw[b:e]) for b, e in zip(at[:-1], at[1:])]
        return pa.array(np.array(out, np.uint64).view(np.int64))

    return docs.withColumn(name, fingerprints(F.col(text)))


def _long(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _ball(bits: list[int], radius: int) -> list[int]:
    """All masks that flip up to ``radius`` of these bits."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(bits, r)]


def variants(fingerprint_: Column, parts: int) -> Column:
    """Array of the keys at which a fingerprint waits for others.

    With ``parts`` = 1 these are all fingerprints within half the radius: two that differ in up to
    four bits share one that differs from both in two. With more parts the bits are cut into so many
    blocks. Of four differing bits some choice of all blocks but one holds no more than its share,
    so the ball is taken on each such choice, with half of that share as radius.
    """
    if parts == 1:
        masks = F.array(*[F.lit(_long(m)) for m in _ball(list(range(BITS)), RADIUS // 2)])
        return F.transform(masks, lambda m: fingerprint_.bitwiseXOR(m))
    edges = [BITS * p // parts for p in range(parts + 1)]
    share = RADIUS * (parts - 1) // parts
    keys = []
    for p in range(parts):
        kept = [b for b in range(BITS) if not edges[p] <= b < edges[p + 1]]
        keep = F.lit(_long(sum(1 << b for b in kept)))
        apart = (0x9E3779B97F4A7C15 * (p + 1)) % (1 << BITS)  # keys of different choices do not mix
        masks = F.array(*[F.lit(_long(m ^ apart)) for m in _ball(kept, -(-share // 2))])
        kept_bits = fingerprint_.bitwiseAND(keep)
        keys.append(F.transform(masks, kept_bits.bitwiseXOR))
    return F.concat(*keys)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)], schema=_LINK)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows that come grouped by key, cut at key changes.

    Yields keys, fingerprints and whether they are part of a single run longer than RUN; every part of
    such a run starts with the run's first fingerprint.
    """
    keys = prints = np.zeros(0, np.uint64)
    long_run: tuple[np.ndarray, np.ndarray] | None = None  # key and first fingerprint
    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        prints = np.concatenate((prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if long_run:
            other = np.flatnonzero(keys != long_run[0])
            same = int(other[0]) if len(other) else len(keys)
            yield np.concatenate((long_run[0], keys[:same])), np.concatenate((long_run[1], prints[:same])), True
            keys, prints = keys[same:], prints[same:]
        if not len(keys):
            continue
        long_run = None
        other = np.flatnonzero(keys != keys[-1])
        tail = int(other[-1]) + 1 if len(other) else 0
        if tail:
            yield keys[:tail], prints[:tail], False
            keys, prints = keys[tail:], prints[tail:]
        if len(keys) > RUN:
            yield keys, prints, True
            long_run = keys[:1], prints[:1]
            keys, prints = keys[:0], prints[:0]
    if len(keys):
        yield keys, prints, False


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected within RADIUS among these fingerprints."""
    rest, hubs, members = prints, [], []
    while len(rest) > 1:
        hub, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= RADIUS
            if near.any():
                found, rest = rest[near], rest[~near]
                members.append(found)
                hubs.append(np.full(len(found), hub))
                frontier += list(found)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *hubs]), np.concatenate([empty, *members])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints that meet at a key; a null b marks one in a run too long for that."""
    dense: set[int] = set()
    for keys, prints, long_run in _runs(batches):
        if long_run:  # whatever the size of this piece
            dense.update(prints.tolist())
            keys, prints = keys[:0], prints[:0]
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
        sizes = np.diff(edge)
        a, b = [], []
        small = np.repeat((sizes > 1) & (sizes <= 8), sizes)
        for step in range(1, 8) if len(keys) else ():
            i = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:]))
            i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= RADIUS]
            a.append(prints[i])
            b.append(prints[i + step])
        for j in np.flatnonzero(sizes > 8):
            run = prints[edge[j] : edge[j + 1]]
            if len(run) > RUN:
                dense.update(run.tolist())
            else:
                hubs, members = _forest(run)
                a.append(hubs)
                b.append(members)
        if a:
            yield _links(np.concatenate(a), np.concatenate(b))
        if len(dense) > 100_000:
            yield _marked(dense)
            dense = set()
    yield _marked(dense)


def _marked(dense: set[int]) -> pa.RecordBatch:
    prints = pa.array(np.array(sorted(dense), np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([prints, pa.nulls(len(prints), pa.int64())], schema=_LINK)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints at one full variant are all within the radius of each other: link them to the first."""
    for keys, prints, _ in _runs(batches):
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        hubs = prints[np.flatnonzero(first)][np.cumsum(first) - 1]
        yield _links(hubs[~first], prints[~first])


def links(prints: DataFrame, *, parts: int = 3) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints, a column ``simhash``, at up to RADIUS differing bits.

    Connected fingerprints come out connected, not as all their pairs. Every fingerprint is sent to its
    variants and those that meet are verified. Where more than RUN meet at one variant, their whole
    64-bit balls are taken instead; all that meet there are within the radius of each other, so that
    a star without any comparison is exact, however many they are.
    """

    def met(df: DataFrame, parts_: int) -> DataFrame:
        sent = df.select(F.explode(variants(F.col("simhash"), parts_)).alias("key"), "simhash")
        return sent.repartition("key").sortWithinPartitions("key", "simhash")

    if parts == 1:
        return met(prints, 1).mapInArrow(_stars, "a long, b long")
    found = stage(met(prints, parts).mapInArrow(_verified, "a long, b long"), "met")
    dense = stage(found.where("b is null").select(F.col("a").alias("simhash")).distinct(), "dense")
    direct = found.where("b is not null")
    if dense.isEmpty():
        return direct
    return direct.union(met(dense, 1).mapInArrow(_stars, "a long, b long"))


def grouped(rows: DataFrame) -> DataFrame:
    """Each distinct fingerprint of ``rows`` (doc_id, simhash) with its component_id.

    The component_id is the smallest doc_id that can be reached, null if no doc_id of the component is
    known. Copies are merged before anything is sent.
    """
    prints = stage(rows.groupBy("simhash").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints.select("simhash"))).withColumnRenamed("node", "simhash")
    placed = prints.join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    placed = stage(placed, "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(least, "root").select("simhash", "component_id")


def simhash_components(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    Texts without a word have fingerprint zero and are linked like any other; null texts count as
    empty. Repeated rows and equal texts meet before the search. An empty table gives no rows; other
    columns are not read.
    """
    rows = stage(with_fingerprints(docs.select("doc_id", text), text=text).select("doc_id", "simhash"), "simhash")
    written = F.lpad(F.lower(F.hex("simhash")), BITS // 4, "0").alias("fingerprint")
    return rows.join(grouped(rows), "simhash").select("doc_id", written, "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component: that of its smallest doc_id; the columns stay as they are.

    Of several rows with that doc_id one stays. Rows without doc_id stay only where no row of their
    component has one, one for each fingerprint.
    """
    print_, known, id_, nth = free_names(docs, "simhash", "known", "id", "nth")
    rows = with_fingerprints(docs, name=print_)
    rows = rows.withColumn(known, F.col("doc_id").isNotNull()).withColumn(id_, F.coalesce("doc_id", F.lit(0)))
    rows = stage(rows, "simhash")
    slim = rows.select("doc_id", F.col(print_).alias("simhash"))
    holders = slim.distinct().join(stage(grouped(slim), "groups"), "simhash").where("doc_id <=> component_id")
    named = holders.where("doc_id is not null").groupBy("doc_id").agg(F.min("simhash").alias("simhash"))
    kept = named.unionByName(holders.where("doc_id is null").select("doc_id", "simhash")).select(
        F.col("simhash").alias(print_), F.col("doc_id").isNotNull().alias(known), F.coalesce("doc_id", F.lit(0)).alias(id_)
    )
    keys = [print_, known, id_]  # the window needs no shuffle beyond the join's
    first = Window.partitionBy(*keys).orderBy(print_)
    return rows.join(kept, keys).withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(docs.columns)
