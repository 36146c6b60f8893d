"""Harmonic packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.arrays import slices
from broadsheet.llm.pretokens import opened
from broadsheet.runtime import stage

#: The finest class: pieces of up to capacity / CLASSES tokens share its bins.
CLASSES = 64
#: Share of a class's slot that a piece may leave empty before it is cut.
SLACK = 1 / 32

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED = f"{_PIECE}, class int, sequence_id long, `offset` long, open boolean"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "sequence_id", "offset", "open"]


def class_of(length: int, capacity: int) -> int:
    """Reciprocal class: so many pieces of this length fill one bin."""
    return min(capacity // length, CLASSES)


@lru_cache(maxsize=1 << 16)
def cuts(length: int, capacity: int) -> tuple[int, ...]:
    """Lengths of the pieces of a document: whole bins, then pieces that nearly fill a class's slot.

    A rest stays in one piece if it leaves no more than ``SLACK`` of its slot empty. Else the slot of
    the next finer class is cut from it, which fills that slot whole, and the remainder goes on.
    """
    pieces = []
    while length >= capacity:
        pieces.append(capacity)
        length -= capacity
    while length:
        k = class_of(length, capacity)
        slot = capacity // k
        if k == CLASSES or slot - length <= SLACK * slot:
            pieces.append(length)
            break
        piece = capacity // (k + 1)
        pieces.append(piece)
        length -= piece
    return tuple(pieces)


class Bins:
    """Open bins of one worker, one per class; a bin is let go when its class's count is reached."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.waiting: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> list[tuple]:
        k = class_of(piece[2], self.capacity)
        bin_ = self.waiting.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) < k:
            return []
        del self.waiting[k]
        return self.close(bin_)

    def close(self, pieces: list[tuple]) -> list[tuple]:
        """A sequence of these pieces, laid end to end."""
        out, offset = [], 0
        for piece in pieces:
            out.append((*piece, class_of(piece[2], self.capacity), self.next_id, offset, False))
            offset += piece[2]
        self.next_id += 1
        return out

    def rest(self) -> list[tuple]:
        """Pieces of bins that were not filled, fewer than their class's count each."""
        return [(*p, k, None, None, True) for k, bin_ in sorted(self.waiting.items()) for p in bin_]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], _NAMES)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _first_id(round_: int) -> int:
    """Sequence ids of a worker: round, task and number within the task."""
    return (round_ << 60) | (_partition_id() << 30)


def pack(docs: DataFrame, tokenizer: str, *, text: str = "text", capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Pack the ids of all documents into sequences of at most ``capacity`` ids.

    A document is the ids of its text and ``end_id``. Full sequences are cut from it first; the rest
    falls into the class of its reciprocal length, capacity / k, whose bins take exactly k pieces.
    Every task fills its bins alone and writes them; only pieces of bins it could not fill, fewer
    than k of each class, go on. They meet by class in a second round of the same kind, and what is
    left then, below 2,016 pieces in all, is packed by first fit over decreasing lengths. Results of
    a round are written to the shared folder, so tokenizing runs once and a lost executor costs its
    own tasks.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    class (pieces per bin). Sequence ids are unique, not consecutive. A null text is the end id
    alone; repeated rows are packed each; an empty table gives no rows; other columns are not read.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = opened(tokenizer), Bins(capacity, _first_id(0))
        for batch in batches:
            for part in slices(batch.column(1)):
                ids, at = encoder.encode(part)
                raw, out = ids.astype("<u4"), []
                keys = batch.column(0)[part.rows].to_pylist()
                for key, begin, end in zip(keys, at[:-1].tolist(), at[1:].tolist()):
                    own = memoryview(np.append(raw[begin:end], np.uint32(end_id)).astype("<u4").tobytes())
                    total, start = end - begin + 1, 0
                    for length in cuts(total, capacity):
                        crc = zlib.crc32(own[4 * start : 4 * (start + length)])
                        out += bins.add((key, start, length, crc, total))
                        start += length
                yield _batch(out)
        yield _batch(bins.rest())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, out = Bins(capacity, _first_id(1)), []
        for row in _rows(batches):
            out += bins.add(row[:5])
            if len(out) > 50_000:
                yield _batch(out)
                out = []
        yield _batch(out + bins.rest())

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sorted((row[:5] for row in _rows(batches)), key=lambda p: (-p[2], p[0] is None, p[0], p[1]))
        bins, groups, room = Bins(capacity, _first_id(2)), [], []
        for piece in pieces:
            i = next((i for i, free in enumerate(room) if free >= piece[2]), len(room))
            if i == len(room):
                groups.append([])
                room.append(capacity)
            groups[i].append(piece)
            room[i] -= piece[2]
        yield _batch([row for group in groups for row in bins.close(group)])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    one = stage(keyed.mapInArrow(first, _PLACED), "pack", ["open"])
    two = stage(one.filter("open").repartition("class").mapInArrow(again, _PLACED), "pack-again", ["open"])
    three = two.filter("open").coalesce(1).mapInArrow(last, _PLACED)
    filled = one.filter("not open").unionByName(two.filter("not open")).unionByName(three)
    return filled.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class")
