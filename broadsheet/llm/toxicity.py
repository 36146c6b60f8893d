"""Toxicity from the nearest labelled examples by TF-IDF cosine, found with a block-max inverted index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.arrays import RangeHashes, Texts, fold, slices, text_of
from broadsheet.llm.folds import held_out, labelled_sample

#: Learning rows per class at most; all of them, with all their terms, are in the index.
SAMPLE = 2000
#: A term weighs idf * (PLAIN + r**2): r, zero or more, is the log of how much more of its examples are toxic than of
#: all, counted as if SHRINK more examples had it at the overall share. Plain idf finds topics and not tone.
PLAIN, SHRINK = 0.1, 15.0
#: Word beginnings of so many bytes are terms beside the words themselves.
STEMS = (4, 5, 6)
NEIGHBOURS = 7
#: Examples per block, blocks scored before any is left out, and steps towards the main direction of examples.
BLOCK, FIRST, STEPS = 64, 4, 8
#: Terms of at least this share of the examples have a weight for every example of a block, most of them not zero.
FULL = 1 / 32
#: Texts searched together at most, and their postings outside frequent terms, unless one text alone has more.
TOGETHER, POSTINGS = 512, 1 << 21
#: Leading bits by which terms are looked up; with a few hundred thousand terms about one has the same.
LEAD = 18
#: Votes are cosines to this power; a vote of this weight for the share of toxic rows is added.
SHARPNESS, PRIOR = 2.0, 0.1
THRESHOLD = 0.5

#: Bounds and scores are sums in single precision.
_SLACK = 1e-5

_unpacked: dict[str, Index] = {}

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def occurrences(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text and term hash of every term that occurs. Texts are lower-cased before.

    Words are runs of letters a-z and bytes beyond ASCII; terms are words and their beginnings.
    """
    inside = np.concatenate(([False], _LETTER[texts.data], [False]))
    edge = np.zeros(len(texts.data) + 1, bool)
    edge[texts.at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    ranges, owner = RangeHashes(texts.data), text_of(starts, texts.at)
    whole = ranges(starts, ends)
    hashes, owners = [whole], [owner]
    for n in STEMS:
        longer = np.flatnonzero(ends - starts > n)
        stem = ranges(starts[longer], starts[longer] + n)
        hashes.append(fold([stem]))  # a stem is another term than the word of the same letters
        owners.append(owner[longer])
    return np.concatenate(owners), np.concatenate(hashes)


def counted(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs in order of text, and how often each occurs."""
    order = np.lexsort((term, text))
    term, text = term[order], text[order]
    first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (text[1:] != text[:-1]))) if len(term) else [])
    return text[first], term[first], np.diff(np.append(first, len(term)))


class Index(NamedTuple):
    """Postings of unit-length example vectors, cut into cells: the postings of one term in one block of BLOCK examples.

    Cells of frequent terms are full, so that they are added up as rows; the others list their examples.
    """

    vocabulary: np.ndarray  # term hashes, ascending
    opens: np.ndarray  # where the hashes with each leading LEAD bits start
    idf: np.ndarray  # weight of each term
    cells: np.ndarray  # (terms + 1): where the cells of a term lie
    block: np.ndarray  # of each cell
    most: np.ndarray  # greatest weight in each cell
    at: np.ndarray  # (cells + 1): where the postings of a cell lie
    example: np.ndarray  # of each posting
    weight: np.ndarray
    row: np.ndarray  # of each term among the frequent ones, or -1
    full: np.ndarray  # (frequent terms, blocks, BLOCK): weights
    full_most: np.ndarray  # (frequent terms, blocks): greatest weight in each cell
    ids: np.ndarray  # doc_id of each example
    toxic: np.ndarray
    vote: np.ndarray  # weight of an example's vote, so that classes count as in all labelled rows
    prior: float


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def vectors(index: Index, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term number and weight of each known term of each text, in order; a text's weights have length one."""
    size = len(index.vocabulary)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    text, term = occurrences(texts)
    spot = np.minimum(index.opens[(term >> np.uint64(64 - LEAD)).astype(np.int64)].astype(np.int64), size - 1)
    left = np.flatnonzero((index.vocabulary[spot] < term) & (spot < size - 1))
    while len(left):
        spot[left] += 1
        left = left[(index.vocabulary[spot[left]] < term[left]) & (spot[left] < size - 1)]
    known = index.vocabulary[spot] == term
    pairs, count = np.unique(text[known] * size + spot[known], return_counts=True)
    text, number = pairs // size, pairs % size
    weight = np.log1p(count) * index.idf[number]
    return text, number, weight / np.sqrt(np.bincount(text, weight**2))[text]


def known_terms(index: Index, texts: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Text, term numbers and weights of each text that has a term of the vocabulary."""
    text, number, weight = vectors(index, texts)
    for rows in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1) if len(text) else []:
        yield int(text[rows[0]]), number[rows], weight[rows]


def nearest_of_all(index: Index, text: np.ndarray, found: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """``nearest`` for every text of some ``vectors``, a bounded number of texts and postings at a time."""
    if not len(text):
        return
    begins = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text))
    postings = np.append(0, np.cumsum(index.at[index.cells[found + 1]] - index.at[index.cells[found]]))[begins]
    i = 0
    while i < len(begins) - 1:
        j = max(i + 1, min(i + TOGETHER, int(np.searchsorted(postings, postings[i] + POSTINGS, "right")) - 1))
        rows = slice(begins[i], begins[j])
        each = np.diff(begins[i : j + 1])
        for k, result in enumerate(_nearest(index, np.repeat(np.arange(j - i), each), found[rows], weights[rows], j - i)):
            yield int(text[begins[i + k]]), *result
        i = j


def nearest(index: Index, found: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The NEIGHBOURS examples of greatest cosine above zero, exactly, and the number of blocks scored.

    The bound of a block is the sum of its cells' greatest weights. Blocks are scored by falling bound, in growing
    groups, until no other's bound reaches the last of the examples found; the postings of those are not read. Equal
    cosines count by place in the index.
    """
    return next(_nearest(index, np.zeros(len(found), np.int64), found, weights, 1))


def _nearest(index: Index, text: np.ndarray, found: np.ndarray, weights: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``nearest`` of texts 0 to n - 1: each has its own bounds and stops by itself, one product scores a block for all that need it."""
    blocks = index.full.shape[1]
    starts, ends = index.cells[found], index.cells[found + 1]
    cells, share, owner = _ranges(starts, ends), np.repeat(weights, ends - starts), np.repeat(text, ends - starts)
    place = owner * blocks + index.block[cells]
    row = index.row[found]
    often = np.zeros((n, len(index.full)), np.float32)
    often[text[row >= 0], row[row >= 0]] = weights[row >= 0]
    rare = np.bincount(place, share * index.most[cells], minlength=n * blocks).reshape(n, blocks)
    bound = rare + often @ index.full_most
    rank = np.empty((n, blocks), np.int64)
    np.put_along_axis(rank, np.argsort(-bound, axis=1, kind="stable"), np.arange(blocks)[None, :], axis=1)
    scores, scored = np.zeros((n, blocks, BLOCK), np.float32), np.zeros(n, np.int64)
    done, group, last = 0, FIRST, np.zeros(n)
    while done < blocks:
        chosen = (rank >= done) & (rank < done + group) & (bound > 0) & (bound >= last[:, None] - _SLACK)
        if not chosen.any():
            break
        scored += chosen.sum(axis=1)
        for b in np.flatnonzero(chosen.any(axis=0)):
            some = np.flatnonzero(chosen[:, b])
            part = often[some] @ index.full[:, b]
            scores[some, b] = part
            # with the frequent terms known, the others' postings are read only where they can still make a neighbour
            chosen[some, b] = part.max(axis=1) + rare[some, b] >= last[some] - _SLACK
        done += group
        group *= 2
        going = np.flatnonzero(chosen.any(axis=1))
        if not len(going):
            continue
        mine = np.flatnonzero(chosen.reshape(-1)[place])
        a, z = index.at[cells[mine]], index.at[cells[mine] + 1]
        postings = _ranges(a, z)
        spot = np.repeat(owner[mine] * (blocks * BLOCK), z - a) + index.example[postings]
        scores += np.bincount(spot, np.repeat(share[mine], z - a) * index.weight[postings], minlength=scores.size).reshape(scores.shape)
        # greatest scores of sets of eight examples: as many other examples reach the last of them at least
        going = np.flatnonzero(chosen.any(axis=1))
        greatest = scores[going].reshape(len(going), 8, -1).max(axis=1)
        if greatest.shape[1] >= NEIGHBOURS:
            last[going] = np.partition(greatest, -NEIGHBOURS, axis=1)[:, -NEIGHBOURS]
    flat = scores.reshape(n, -1)
    own, places = np.nonzero((flat > 0) & (flat >= (last - _SLACK).astype(np.float32)[:, None]))
    cosines = flat[own, places].astype(float)
    order, begins = np.lexsort((places, -np.round(cosines, 6), own)), np.searchsorted(own, np.arange(n + 1))
    for begin, end, used in zip(begins[:-1], begins[1:], scored):
        top = order[begin:end][:NEIGHBOURS]
        yield places[top], cosines[top], int(used)


def vote(index: Index, places: np.ndarray, cosines: np.ndarray) -> float:
    """Share of toxic votes among the neighbours, nearer ones counting more, drawn to the prior."""
    weights = cosines**SHARPNESS * index.vote[places]
    return float((weights @ index.toxic[places] + PRIOR * index.prior) / (weights.sum() + PRIOR))


def _toxic_weight(bad: np.ndarray, good: np.ndarray, share: float) -> np.ndarray:
    """PLAIN + r**2 of terms, from the weighted numbers of toxic and other examples that have them."""
    if not 0 < share < 1:
        return np.full(len(bad), PLAIN)
    ratio = (bad + SHRINK * share) / ((bad + good + SHRINK) * share)
    return PLAIN + np.maximum(0, np.log(ratio)) ** 2


def _in_kind(rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """An order in which like examples of a class stand together, so that a block has few terms and tight bounds.

    Examples are sorted by their part in the main direction in which they differ and halved, and so on down to a block.
    """
    left, done = [np.flatnonzero(toxic == 1), np.flatnonzero(toxic != 1)], []
    while left:
        some = left.pop()
        if len(some) <= BLOCK:
            done.append(some)
            continue
        apart = rows[some] - rows[some].mean(axis=0)
        direction = apart[np.argmax((apart**2).sum(axis=1))]
        for _ in range(STEPS):
            direction = (apart @ direction) @ apart
            direction = direction / max(float(np.sqrt(direction @ direction)), 1e-9)
        some = some[np.argsort(apart @ direction, kind="stable")]
        half = -(-len(some) // BLOCK) // 2 * BLOCK
        left += [some[half:], some[:half]]
    return np.concatenate(done)


def build(ids: np.ndarray, texts: pa.Array, toxic: np.ndarray, shares: tuple[float, float]) -> Index:
    """Index every term of every example; ``shares`` are the classes' shares of all labelled rows."""
    at, owners, hashes, counts = 0, [], [], []
    for part in slices(pc.utf8_lower(texts)):
        text, term, count = counted(*occurrences(part))
        owners.append(text + at)
        hashes.append(term)
        counts.append(count)
        at += len(part.at) - 1
    owner, term, count = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (owners, hashes, counts))
    vocabulary, number, df = np.unique(term, return_inverse=True, return_counts=True)
    owner, n = owner.astype(np.int64), len(toxic)
    sizes = max(1, n - int(toxic.sum())), max(1, int(toxic.sum()))
    votes = np.where(toxic == 1, shares[1] * n / sizes[1], shares[0] * n / sizes[0])
    votes = votes / max(votes.sum() / max(n, 1), 1e-9)
    bad, good = (np.bincount(number, votes[owner] * (toxic[owner] == c), minlength=len(vocabulary)) for c in (1, 0))
    idf = (np.log((1 + n) / (1 + df)) + 1) * _toxic_weight(bad, good, shares[1])

    weight = np.log1p(count) * idf[number]
    weight = (weight / np.sqrt(np.bincount(owner, weight**2, minlength=n))[owner]).astype(np.float32)
    frequent = np.flatnonzero(df >= max(2, FULL * n))
    row = np.full(len(vocabulary), -1)
    row[frequent] = np.arange(len(frequent))
    often = row[number] >= 0
    rows = np.zeros((n, len(frequent)), np.float32)
    rows[owner[often], row[number[often]]] = weight[often]
    order = _in_kind(rows, toxic)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ids, toxic, votes, owner = ids[order], toxic[order], votes[order], place[owner]

    order = np.lexsort((owner, number))
    number, owner, weight = number[order], owner[order], weight[order]
    blocks, often = -(-max(n, 1) // BLOCK), row[number] >= 0
    full = np.zeros((len(frequent), blocks * BLOCK), np.float32)
    full[row[number[often]], owner[often]] = weight[often]
    full = full.reshape(len(frequent), blocks, BLOCK)
    number, owner, weight = number[~often], owner[~often], weight[~often]
    cell = number * blocks + owner // BLOCK
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    most = np.maximum.reduceat(weight, first) if len(first) else weight
    return Index(
        vocabulary, np.searchsorted(vocabulary, np.arange(1 << LEAD, dtype=np.uint64) << np.uint64(64 - LEAD)).astype(np.int32),
        idf, np.searchsorted(number[first], np.arange(len(vocabulary) + 1)),
        (cell[first] % blocks).astype(np.int32), most, np.append(first, len(cell)), owner.astype(np.int32), weight,
        row, full, full.max(2) if len(frequent) else np.zeros((0, blocks), np.float32),
        ids, toxic.astype(float), votes, shares[1],
    )


def pack(index: Index) -> list[np.ndarray]:
    """The arrays of an index to be sent: of the rows of frequent terms the weights above zero and their spots."""
    spots = np.flatnonzero(index.full)
    sent = index._replace(full=np.array(index.full.shape), full_most=spots.astype(np.int32))
    return [*(np.ascontiguousarray(np.asarray(x)) for x in sent), index.full.reshape(-1)[spots]]


def unpack(parts: list[np.ndarray]) -> Index:
    sent, weights = Index(*parts[:-1]), parts[-1]
    full = np.zeros(tuple(sent.full), np.float32)
    full.reshape(-1)[sent.full_most] = weights
    most = full.max(2) if len(full) else np.zeros(full.shape[:2], np.float32)
    return sent._replace(full=full, full_most=most, prior=float(sent.prior.reshape(())))


def _opened(key: str, parts: list[np.ndarray]) -> Index:
    """The index of a run, unpacked once per worker process."""
    if key not in _unpacked:
        _unpacked.clear()
        _unpacked[key] = unpack(parts)
    return _unpacked[key]


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text") -> list[np.ndarray]:
    """Packed index of up to SAMPLE labelled rows per class that are not held out, built in one task; ``folds`` bounds their bytes."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out())
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = max(1, sum(counts.values()))
    sample = labelled_sample(docs, labels, "toxic", SAMPLE, text=text)
    rows = sample.select("toxic", "doc_id", F.col(text).alias("text"), F.lit(1).alias("one"))

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        shares = (counts.get(0, 0) / total, counts.get(1, 0) / total)
        toxic = table["toxic"].to_numpy().astype(np.int64)
        index = build(table["doc_id"].to_numpy(), table["text"].combine_chunks(), toxic, shares)
        values = pack(index)
        return pa.table(
            {
                "i": list(range(len(values))),
                "kind": [x.dtype.str for x in values],
                "shape": pa.array([list(x.shape) for x in values], pa.list_(pa.int64())),
                "raw": pa.array([x.tobytes() for x in values], pa.binary()),
            }
        )

    found = rows.groupBy("one").applyInArrow(gather, "i long, kind string, shape array<long>, raw binary").collect()
    if not found:
        return pack(build(np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), (1.0, 0.0)))
    if len(found) != len(Index._fields) + 1:  # a driver out of memory ends the transfer without an error
        raise RuntimeError(f"{len(found)} of {len(Index._fields) + 1} parts of the index arrived")
    return [np.frombuffer(r.raw, r.kind).reshape(r.shape) for r in sorted(found, key=lambda r: r.i)]


def score_toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and the evidence: doc_ids of the nearest examples and their cosines.

    Cosines and norms are over all terms that any example has, weighted by idf and by what the learning rows say of
    a term, see PLAIN. Texts without any such term have no neighbours and the prior share as score; null and
    empty texts are among them. Null ids, repeated rows and several labels of one id (the greatest
    counts) are allowed; with no labelled row every score is 0; an empty table gives no rows.
    """
    parts, key = fit(docs, labels, text=text), uuid.uuid4().hex

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened(key, parts)
        for batch in batches:
            for part in slices(pc.utf8_lower(batch.column(2))):
                n = len(part.at) - 1
                scores, near, cosines = np.full(n, index.prior), [[]] * n, [[]] * n
                for i, places, similar, _ in nearest_of_all(index, *vectors(index, part)):
                    scores[i] = vote(index, places, similar)
                    near[i], cosines[i] = index.ids[places].tolist(), similar.tolist()
                columns = [batch.column(0)[part.rows], batch.column(1)[part.rows], pa.array(scores)]
                columns += [pa.array((scores >= THRESHOLD).astype(np.int32))]
                columns += [pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "held_out", "score", "predicted", "neighbours", "cosines"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int, neighbours array<long>, cosines array<double>"
    return docs.select("doc_id", held_out().alias("held_out"), text).mapInArrow(predict, schema)
