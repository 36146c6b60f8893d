"""Texts of an Arrow batch as one byte array, and vectorised work on it.

Every function here works on a bounded slice of a batch inside a task. A slice holds whole texts
only: texts are never cut. Memory is some forty bytes for each byte of the slice, so a slice is a
few megabytes or, if a single text is longer, that one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: list[np.ndarray] = []


class Texts(NamedTuple):
    """Whole texts laid end to end: text ``i`` is ``data[at[i]:at[i + 1]]``; a null is empty."""

    data: np.ndarray
    at: np.ndarray
    rows: slice


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[Texts]:
    """Cut a text column into runs of about ``limit`` bytes and at most ``rows`` rows, at least one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, first + rows, len(column))
        yield Texts(whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], slice(first, last))
        first = last


def per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    before = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return before[at[1:]] - before[at[:-1]]


def text_of(positions: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the text that holds each byte position; positions ascend."""
    return np.searchsorted(at, positions, "right") - 1


#: ASCII white space: tab to carriage return, and the blank.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that are no ASCII white space, inside one text each."""
    inside = ~_SPACE[texts.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[texts.at] = True
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(length: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < length:
        n = max(length, 2 * SLICE_BYTES)
        with np.errstate(over="ignore"):
            _powers.clear()
            for base in (_PRIME, _INVERSE):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                _powers.append(np.cumprod(factors))
    return _powers


class RangeHashes:
    """64-bit hashes of any byte ranges of one array, from a running sum of byte times power.

    Equal bytes give equal hashes wherever they stand; the length is mixed in. Different bytes may have one hash, and
    such pairs are easily written, so where equality counts ``distinct_ranges`` compares the bytes too.
    """

    def __init__(self, data: np.ndarray):
        powers, self._inverses = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._inverses[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_PRIME))


#: Longer ranges are compared one by one.
_BY_EIGHTS = 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; the last eight of ``padded`` are no position."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def unlike(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each range of ``data`` has other bytes than the equally long one of ``other``."""
    spare = np.zeros(8, np.uint8)
    ours = np.concatenate((data, spare))
    return unlike_padded(ours, starts, ours if other is data else np.concatenate((other, spare)), others, sizes)


def unlike_padded(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``unlike`` for arrays that have eight bytes more than ranges reach to."""
    ours, theirs = eights(data), eights(other)
    out, check, mine, beside, left = np.zeros(len(starts), bool), np.arange(len(starts)), starts, others, sizes
    for step in range(0, _BY_EIGHTS, 8):
        differ = (ours[mine + step] ^ theirs[beside + step]) & _FIRST_BYTES[np.minimum(left - step, 8)]
        out[check[differ != 0]] = True
        more = left > step + 8
        check, mine, beside, left = check[more], mine[more], beside[more], left[more]
        if not len(check):
            break
    for i, a, b, n in zip(check.tolist(), mine.tolist(), beside.tolist(), left.tolist()):
        out[i] = out[i] or not np.array_equal(data[a : a + n], other[b : b + n])
    return out


def first_eights(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first eight bytes of each range of a padded array, zeros beyond its end."""
    return eights(data)[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]


def sparse_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of a padded array with their first eight bytes; only the ranges' bytes are looked at.

    Equal bytes give equal hashes in one process. Different ones may share a hash, so compare the bytes.
    """
    out = mix(heads + sizes.astype(np.uint64) * np.uint64(_PRIME))
    more = np.flatnonzero(sizes > 8)
    for step in range(8, _BY_EIGHTS, 8):
        if not len(more):
            return out
        rest = first_eights(data, starts[more] + step, sizes[more] - step)
        out[more] = mix(out[more] * np.uint64(_PRIME) + rest)
        more = more[sizes[more] > step + 8]
    for i in more.tolist():
        out[i] = hash(data[starts[i] : starts[i] + sizes[i]].tobytes()) & 0xFFFFFFFFFFFFFFFF
    return out


def distinct_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of byte ranges, and for each range the number of its kind; equal bytes are one kind.

    Hashes only bring candidates together. Every range is compared byte by byte with the first one of its
    hash; the few that differ are told apart by their bytes.
    """
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    model, sizes = first[kind], ends - starts
    apart = sizes != sizes[model]
    check = np.flatnonzero(~apart & (model != np.arange(len(model))))
    apart[check] = unlike(data, starts[check], data, starts[model[check]], sizes[check])
    if apart.any():
        numbers: dict[bytes, int] = {}
        added = []
        for i in np.flatnonzero(apart).tolist():
            raw = data[starts[i] : ends[i]].tobytes()
            if raw not in numbers:
                numbers[raw] = len(first) + len(added)
                added.append(i)
            kind[i] = numbers[raw]
        first = np.append(first, added)
    return first, kind


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of each row of several hash columns, order included."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mix(out * np.uint64(_PRIME) + h)
    return out
