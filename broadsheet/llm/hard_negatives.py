"""Hard negatives: for an anchor and a positive, rows of other labels that score close below the positive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.ranking import first_rows
from broadsheet.runtime import stage, staging

#: Rows of a block, which has one inverted index, and anchors that are looked up in it by one task.
BLOCK_ROWS = 1 << 13
BLOCK_ANCHORS = 1 << 10

#: Neighbouring dimensions that share one list of the index.
RUN = 8

#: Share of the threshold that is left after each lowering.
LOWERING = 0.85

#: Norms of scaled vectors reach this at most, so that every score and partial score fits into a long.
LARGEST_NORM = 2.0**31

#: Slack for the rounding of norms. Bounds may only be too wide, scores are exact.
_SLACK = 1 + 1e-9

_BLOCK = "r int, a int"
_FOUND = "anchor long, other long, other_id long, score long"
_KEPT = "anchor long, positive long, other long, other_id long, score long"


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    block_rows: int = BLOCK_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """Negatives of each anchor for each of its positives.

    A component x counts as floor(``scale`` * x); a score is the integer inner product with the anchor. Higher scores
    come first, ties by smaller key. An anchor's positives are its first ``positives`` other rows of the same label.
    For each of them the first ``negatives`` rows of other labels are given whose score is ``low`` to ``high`` per
    cent of the positive's; all, if there are fewer, which includes none.

    Rows are dealt into blocks of some ``block_rows``, and each task looks some ``block_anchors`` up in one block.
    A block has an inverted index by runs of dimensions. A list holds only rows whose remaining norm from its first
    dimension on, times the anchor's, reaches the threshold: what is left out can't lift a score to it. Partial scores are added
    up from the lists, rows that their remaining norms can't lift to the threshold are dropped, the rest is scored in
    whole. The threshold falls until each window has its rows or its lower end is reached; the lists are in
    order of those norms, so a lower threshold reads on where the last one stopped. First rows of blocks are merged by
    Spark. Every anchor meets every block: the results are exact, no neighbour is estimated.

    Rows with a null label or vector or with a null or non-finite component take no part. Repeated rows are rows of
    their own, also as others of the same key; those come in any order of theirs. A null key is last among ties. Of
    vectors of different lengths the shorter one ends in zeros. A scaled vector with a norm above 2^31 is an error, as
    its scores need not fit into a long. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = _scaled(vectors, is_anchor, key, label, vector, scale)
    with staging(spark) as put:
        rows = put(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
        count, anchors = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor")).first()
        r, a = (max(1, -(-n // size)) for n, size in ((count, block_rows), (anchors, block_anchors)))
        some = _dealt(rows, "r", r, "a", a)
        asking = _dealt(rows.where("is_anchor"), "a", a, "r", r)
        # under new identities: Spark confuses columns that both sides of a cogroup have from one table
        asking = asking.select(*(F.col(c).alias(c) for c in asking.columns))

        def nearest(block: pa.Table, asked: pa.Table) -> pa.Table:
            return _answers(block, asked, _same_label, positives, _FOUND)

        def in_windows(block: pa.Table, asked: pa.Table) -> pa.Table:
            return _answers(block, asked, _other_labels(low, high), negatives, _KEPT)

        found = some.groupBy("r", "a").cogroup(asking.groupBy("r", "a")).applyInArrow(nearest, _FOUND)
        found = put(_first(found, ["anchor"], positives), "positives")
        windows = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("score", "other"))).alias("windows"))
        asking = asking.join(windows.withColumnRenamed("anchor", "row"), "row")
        kept = some.groupBy("r", "a").cogroup(asking.groupBy("r", "a")).applyInArrow(in_windows, _KEPT)
        kept = _first(kept, ["anchor", "positive"], negatives)
        ids = rows.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        known = found.select(
            "anchor", F.col("other").alias("positive"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")
        )
        out = kept.join(known, ["anchor", "positive"]).join(ids, "anchor")
        out = out.select(
            "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
        return stage(out, "hard-negatives")


def _scaled(vectors: DataFrame, is_anchor: Column, key: str, label: str, vector: str, scale: int) -> DataFrame:
    # NaN is above infinity
    whole = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    chosen = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & whole)
    parts = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    norm = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    parts = F.when(norm <= LARGEST_NORM**2, parts).otherwise(F.raise_error(F.lit("a scaled vector has a norm above 2^31")))
    return chosen.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
        parts.alias("parts"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )


def _dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Rows in blocks by their number, once for every block of the other side."""
    mine = F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int").alias(own)
    return rows.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))


def _first(found: DataFrame, group: list[str], n: int) -> DataFrame:
    down = found.withColumns({"_down": -F.col("score"), "_null": F.col("other_id").isNull()})
    return first_rows(down, group, ["_down", "_null", "other_id", "other"], n, slices=1, number="place").drop("_down", "_null")


def _same_label(block: _Block, asked: pa.Table) -> Iterator[tuple]:
    """What each anchor looks for: itself, its vector, allowed rows, windows as (name, lowest, highest)."""
    for row, label, vector in zip(asked.column("row").to_pylist(), asked.column("label").to_pylist(), _matrix(asked)):
        yield (row,), vector, (block.labels == block.number.get(label, -1)) & (block.rows != row), [((), None, None)]


def _other_labels(low: int, high: int) -> Callable[[_Block, pa.Table], Iterator[tuple]]:
    def asked_for(block: _Block, asked: pa.Table) -> Iterator[tuple]:
        lists = asked.column("windows").to_pylist()
        for row, label, vector, pairs in zip(asked.column("row").to_pylist(), asked.column("label").to_pylist(), _matrix(asked), lists):
            windows = [((p["other"],), -(-low * p["score"] // 100), high * p["score"] // 100) for p in pairs]
            yield (row,), vector, block.labels != block.number.get(label, -1), [w for w in windows if w[1] <= w[2]]

    return asked_for


def _answers(block: pa.Table, asked: pa.Table, looked_for: Callable, n: int, schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    out: list[tuple] = []
    if block.num_rows and asked.num_rows:
        index = _Block(block)
        for who, vector, allowed, windows in looked_for(index, asked):
            for name, chosen, scores in index.filled(vector, allowed, windows, n):
                ids = index.ids.take(pa.array(chosen, pa.int64())).to_pylist()
                out += [(*who, *name, *rest) for rest in zip(index.rows[chosen].tolist(), ids, scores.tolist())]
    columns = zip(*out) if out else [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a table, shorter ones ended with zeros."""
    lists = _one(table.column("parts"))
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


class _Block:
    """Inverted index over the dimensions of some vectors, strongest dimension first."""

    def __init__(self, table: pa.Table):
        vectors = _matrix(table)
        self.rows = table.column("row").to_numpy()
        self.ids = _one(table.column("id"))
        names = _one(table.column("label")).dictionary_encode()
        self.labels = names.indices.to_numpy()
        self.number = {name: i for i, name in enumerate(names.dictionary.to_pylist())}
        # Among equal scores the smaller key is first, a null one last, then the row's number.
        unknown = self.ids.is_null().to_numpy(zero_copy_only=False)
        self._turn = np.empty(len(self.rows), np.int64)
        self._turn[np.lexsort((self.rows, self.ids.fill_null(0).to_numpy(), unknown))] = np.arange(len(self.rows))
        self._dims = np.argsort(-(vectors.astype(float) ** 2).sum(0), kind="stable")
        vectors = vectors[:, self._dims]
        #: Lists are of runs of dimensions; a last run of zeros counts nothing.
        self.runs = [slice(d, d + RUN) for d in range(0, vectors.shape[1], RUN)]
        self.norms = _remaining(vectors)
        #: For each run the rows by their norm from there on, greatest first, and those norms with their signs turned.
        self.lists = np.argsort(-self.norms[:-1], axis=1, kind="stable")
        self.bounds = -np.take_along_axis(self.norms[:-1], self.lists, 1)
        # Products and sums of whole numbers below 2^53 are exact in floating point, which is faster.
        self.kind = np.dtype(float if self.norms[0].max(initial=0) < 2.0**26 else np.int64)
        self._by_row = [np.ascontiguousarray(vectors[:, run], self.kind) for run in self.runs]
        self._by_dim = [np.ascontiguousarray(part.T) for part in self._by_row]
        self._last_limit = np.inf

    def product(self, run: int, rows: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Scores of some rows over one run of dimensions, of the type of ``part``."""
        if part.dtype != self.kind:
            return self._by_row[run][rows].astype(part.dtype) @ part
        if 4 * len(rows) > len(self.rows):
            return (part @ self._by_dim[run])[rows]
        return self._by_row[run][rows] @ part

    def filled(self, vector: np.ndarray, allowed: np.ndarray, windows: list, n: int) -> Iterator[tuple]:
        """The first ``n`` allowed rows in each window of scores; ends may be open."""
        query = np.zeros(max(len(vector), len(self._dims)), np.int64)
        query[: len(vector)] = vector
        search = _Search(self, query[self._dims], allowed)
        lowest = min((w[1] for w in windows if w[1] is not None), default=None)
        top = max((float(w[2]) for w in windows if w[2] is not None), default=search.most)
        # any limit to start from is right; the one that filled the last windows saves steps
        limit, waiting = min(search.most, top, self._last_limit / LOWERING**1.5), list(windows)
        while waiting:
            limit = limit * LOWERING if limit >= 1 else -np.inf
            if lowest is not None and limit <= lowest:
                limit = float(lowest) if lowest > 0 else -np.inf
            done = limit == -np.inf or limit == lowest
            rows, scores = search.at_least(limit)
            for window in list(waiting):
                name, least, most = window
                inside = scores >= (limit if least is None else max(limit, least))
                if most is not None:
                    inside &= scores <= most
                if done or np.count_nonzero(inside) >= n:
                    some, own = rows[inside], scores[inside]
                    first = np.lexsort((self._turn[some], -own))[:n]
                    yield name, some[first], own[first]
                    waiting.remove(window)
            self._last_limit = max(limit, 1.0)


class _Search:
    """Partial scores of a block's rows with one vector, carried on as the limit falls."""

    def __init__(self, block: _Block, query: np.ndarray, allowed: np.ndarray):
        self._block, self._allowed = block, np.flatnonzero(allowed)
        self._own = _remaining(query[None])[:, 0] * _SLACK
        self.most = float(block.norms[0].max(initial=0) * self._own[0])
        kind = block.kind if self._own[0] < 2.0**26 else np.dtype(np.int64)
        self._query = [query[run].astype(kind) for run in block.runs]
        size = len(block.rows)
        #: Scores over the first runs of each row, and how many those are.
        self.partial, self.added = np.zeros(size, kind), np.zeros(size, np.int64)
        self._open = np.zeros(size, bool)

    def _may_reach(self, rows: np.ndarray, limit: float) -> np.ndarray:
        """Of ``rows`` those that their remaining norms can lift to the limit."""
        at = self.added[rows]
        return rows[self.partial[rows] + self._block.norms[at, rows] * self._own[at] >= limit]

    def _in_list(self, run: int, rows: np.ndarray, limit: float) -> np.ndarray:
        """Of ``rows`` those in the list of a run whose turn it is; found from the shorter side."""
        block, stop = self._block, len(self._block.rows)
        if limit > 0:
            stop = int(np.searchsorted(block.bounds[run], -limit / self._own[run], "right")) if self._own[run] else 0
        if stop < len(rows):
            here = block.lists[run, :stop]
            return here[self._open[here] & (self.added[here] == run)]
        here = rows[self.added[rows] == run]
        if stop < len(block.rows):
            here = here[-block.norms[run, here] <= block.bounds[run, stop - 1]]
        return here

    def at_least(self, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """All allowed rows that score ``limit`` or more, and their scores."""
        block = self._block
        rows = self._may_reach(self._allowed, limit)
        for run in range(int(self.added[rows].min(initial=len(block.runs))), len(block.runs)):
            self._open[rows] = True
            here = self._in_list(run, rows, limit)
            self._open[rows] = False
            if not len(here):
                break
            self.partial[here] += block.product(run, here, self._query[run])
            self.added[here] = run + 1
            rows = self._may_reach(rows, limit)
        scores = self.partial[rows]
        for run in range(int(self.added[rows].min(initial=len(block.runs))), len(block.runs)):
            behind = self.added[rows] <= run
            scores[behind] += block.product(run, rows[behind], self._query[run])
        enough = scores >= limit
        return rows[enough], scores[enough].astype(np.int64)


def _one(column: pa.ChunkedArray) -> pa.Array:
    chunk = column.combine_chunks()
    return chunk.chunk(0) if isinstance(chunk, pa.ChunkedArray) else chunk


def _remaining(vectors: np.ndarray) -> np.ndarray:
    """Norms of each vector from each run on; the last one is zero."""
    starts = np.arange(0, vectors.shape[1], RUN)
    out = np.zeros((len(starts) + 1, len(vectors)))
    if len(starts):
        squares = np.add.reduceat(vectors.astype(float) ** 2, starts, axis=1)
        out[:-1] = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]).T
    return out
