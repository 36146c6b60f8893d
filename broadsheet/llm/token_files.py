"""Token ids in training order: a keyed permutation of all sequences, written as fixed-stride shards."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.arrays import mix, slices
from broadsheet.llm.pretokens import BytePairs, opened

ROUNDS = 4


class Layout(NamedTuple):
    """What a reader needs: record ``slot`` is at byte ``slot % per_shard * stride`` of shard ``slot // per_shard``.

    A record is a header (doc_id int64, number of the sequence in its document uint32, tokens uint16, whether
    doc_id is null uint16), ``length`` ids as uint16, all little-endian, padded with zeros, and a line feed.
    """

    sequences: int
    length: int
    per_shard: int
    key: int

    @property
    def stride(self) -> int:
        return 16 + 2 * self.length + 1

    @property
    def shards(self) -> int:
        return -(-self.sequences // self.per_shard)


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed bijection of [0, size): a balanced Feistel network, walked until it lands inside.

    The network permutes a power of four that is at least ``size`` and less than four times it, so a
    walk takes below four steps on average; it ends because the cycle comes back to its start.
    """
    half = max(1, -(-max(size - 1, 1).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [mix(np.array([key * ROUNDS + r], np.uint64))[0] for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(size))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def write_token_shards(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    *,
    text: str = "text",
    length: int = 256,
    per_shard: int = 8192,
    end_id: int = 50256,
    key: int = 1,
) -> Layout:
    """Write the ids of all documents below ``path`` in a random order that ``key`` fixes; returns the layout.

    A document's ids and ``end_id`` are cut into sequences of ``length`` ids, the last one padded. A first
    pass counts sequences per input partition (a few numbers each reach the driver); so the second knows
    the global number of each sequence, permutes it to its slot and sends it to the task of the slot's
    range, which writes its shards in order, one file each. Ids are shuffled once and never staged. The
    partitions of both passes must be the same; a task whose counts differ fails. A reader can go on at any
    slot with one seek. ``path`` also gets the layout as JSON.

    Ids must be below 65,536. A null text is the end id alone; null doc_ids are marked; repeated rows are
    written each; an empty table gives no shard; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    whole = BytePairs(tokenizer).whole_tokens()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, encoder = 0, opened(tokenizer)
        for batch in batches:
            for part in slices(batch.column(1)):
                total += int((-(-(encoder.counts(part, whole) + 1) // length)).sum())
        columns = [pa.array([TaskContext.get().partitionId()]), pa.array([total])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "n"])

    counted = {r.part: r.n for r in rows.mapInArrow(count, "part long, n long").collect()}
    first, total = {}, 0
    for part in sorted(counted):
        first[part] = total
        total += counted[part]
    layout = Layout(total, length, per_shard, key)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, own = opened(tokenizer), TaskContext.get().partitionId()
        at = first[own]
        for batch in batches:
            for part in slices(batch.column(1)):
                table = _records(encoder.encode(part), batch.column(0)[part.rows], length, end_id)
                slots = permuted(np.arange(at, at + len(table)), total, key)
                at += len(table)
                bounds = np.arange(len(table) + 1) * table.shape[1]
                raw = pa.BinaryArray.from_buffers(
                    pa.binary(), len(table), [None, pa.py_buffer(bounds.astype("<i4")), pa.py_buffer(table)]
                )
                yield pa.RecordBatch.from_arrays([pa.array(slots), raw], ["slot", "record"])
        if at - first[own] != counted[own]:
            raise RuntimeError(f"partition {own} has {at - first[own]} sequences, {counted[own]} were counted")

    made = rows.mapInArrow(records, "slot long, record binary")
    shard = F.floor(F.col("slot") / per_shard).cast("int")
    spark = docs.sparkSession
    tasks = max(1, min(layout.shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    share = -(-layout.shards // tasks) or 1
    ranged = made.withColumn("shard", shard).repartitionById(tasks, F.floor(F.col("shard") / share).cast("int"))
    lines = ranged.sortWithinPartitions("slot").select("shard", F.col("record").cast("string").alias("value"))
    lines.write.partitionBy("shard").option("lineSep", "\n").text(path)
    meta = spark.createDataFrame([(json.dumps(layout._asdict()),)], "value string")
    meta.coalesce(1).write.text(f"{path}/_layout")
    return layout


def _records(encoded: tuple[np.ndarray, np.ndarray], ids: pa.Array, length: int, end_id: int) -> np.ndarray:
    """One row of bytes per sequence, without the line feed that the writer adds."""
    tokens, at = encoded
    sizes = np.diff(at) + 1
    pieces = -(-sizes // length)
    before = np.cumsum(pieces) - pieces
    flat = np.zeros((int(pieces.sum()), length), "<u2")
    cells = flat.reshape(-1)
    cells[np.arange(len(tokens)) + np.repeat(before * length - at[:-1], sizes - 1)] = tokens
    cells[before * length + sizes - 1] = end_id
    head = np.zeros(len(flat), np.dtype([("doc", "<i8"), ("number", "<u4"), ("tokens", "<u2"), ("null", "<u2")]))
    owner = np.repeat(np.arange(len(sizes)), pieces)
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    head["doc"], head["null"] = ids.fill_null(0).to_numpy()[owner], missing[owner]
    head["number"] = np.arange(len(flat)) - before[owner]
    head["tokens"] = np.minimum(sizes[owner] - head["number"] * np.int64(length), length)
    return np.concatenate((head.view(np.uint8).reshape(-1, 16), flat.view(np.uint8)), axis=1)


def read_token_shards(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """One row per record of the shards: slot, shard, byte_offset, doc_id, sequence, n_tokens, ids_crc32.

    Whole shards are read as bytes, a bounded number at a time; the slot follows from the place alone.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, layout.stride)
                docs, number = raw[:, :8].copy().view("<i8")[:, 0], raw[:, 8:12].copy().view("<u4")[:, 0]
                tokens, null = raw[:, 12:14].copy().view("<u2")[:, 0], raw[:, 14:16].copy().view("<u2")[:, 0]
                sums = [zlib.crc32(r[16 : 16 + 2 * int(n)]) for r, n in zip(raw, tokens)]
                place = np.arange(len(raw), dtype=np.int64)
                columns = [
                    pa.array(place + shard * layout.per_shard),
                    pa.array(np.full(len(raw), shard, np.int32)),
                    pa.array(place * layout.stride),
                    pa.array(docs, mask=null.astype(bool)),
                    pa.array(number.astype(np.int64)),
                    pa.array(tokens.astype(np.int64)),
                    pa.array(np.array(sums, np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["slot", "shard", "byte_offset", "doc_id", "sequence", "n_tokens", "ids_crc32"]
    schema = "slot long, shard int, byte_offset long, doc_id long, sequence long, n_tokens long, ids_crc32 long"
    if not layout.sequences:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true")
    shard = F.regexp_extract("path", r"/shard=(\d+)/", 1)
    found = files.load(path).where(shard != "").select(shard.cast("int").alias("shard"), "content")
    return found.mapInArrow(digest, schema)
