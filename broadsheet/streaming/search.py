"""Search over a stream of corpus files."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from broadsheet.functions.dates import day_range
from broadsheet.functions.ranking import first_rows
from broadsheet.operators.search import article_columns, is_match, matching
from broadsheet.runtime import local_table
from broadsheet.schemas import ARTICLE_COLUMNS
from broadsheet.sources.corpus import read_corpus, stream_corpus, stream_files


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _searched(start: str, end: str) -> range:
    lo, hi = day_range(start, end)
    return range(int(lo[:4]), int(hi[:4]) + 1)


def _by_year(name: str, years: Iterable[int], counted: Column | None = None) -> list[Column]:
    of_year = (F.col("year") == year if counted is None else (F.col("year") == year) & counted for year in years)
    return [F.count_if(hit).alias(f"{name}_{year}") for year, hit in zip(years, of_year)]


def _year_rows(metrics: dict, years: Iterable[int]) -> list[tuple[int, int, int]]:
    return [(year, int(metrics.get(f"read_{year}", 0)), int(metrics.get(f"matched_{year}", 0))) for year in years]


class ProgressTable(StreamingQueryListener):
    """Keeps what each batch of one search has read and matched per year, in a folder per batch.

    Spark holds the progress of the last hundred batches in memory. Here every batch leaves ``year, read, matched``
    under ``batch=<number>``; a batch that is run again overwrites its own rows. Rows are counted by the
    stream itself while it runs, so no article is read for it.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, years: range):
        self._spark, self.path, self._name, self._years = spark, path, name, years
        self._last = -1

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        step = event.progress
        seen = step.observedMetrics.get("search") if step.name == self._name else None
        if seen is not None:
            table = local_table(
                self._spark, _year_rows(seen.asDict(), self._years), year=pa.int32(), read=pa.int64(), matched=pa.int64()
            )
            table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={step.batchId}")
            self._last = step.batchId

    def finish(self, query: StreamingQuery, timeout: float = 60) -> None:
        """Wait for the end of ``query`` and for its last rows, then stop listening."""
        query.awaitTermination()
        last = (query.lastProgress or {}).get("batchId", -1)
        until = time.monotonic() + timeout
        while self._last < last and time.monotonic() < until:
            time.sleep(0.05)
        self._spark.streams.removeListener(self)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Columns batch, year, read, matched of all batches."""
    return spark.read.schema("year int, read bigint, matched bigint, batch bigint").parquet(path).select(
        "batch", "year", "read", "matched"
    )


def stream_search(
    spark: SparkSession,
    corpus: str,
    out: str,
    checkpoint: str,
    term: str,
    start: str,
    end: str,
    *,
    files_per_batch: int | None = None,
    once: bool = True,
    progress: str | None = None,
) -> StreamingQuery:
    """Append matches to ``out``, one folder per year.

    Stateless: every batch is filtered by itself, and the file sink commits each batch once. Files whose folder or
    name says another year are not opened. With ``progress``, a folder, each batch leaves there what it read and
    matched per year (see ``read_progress``); the query then has its ``ProgressTable`` as the attribute ``progress_table``.
    """
    years = _searched(start, end)
    name = f"search-{uuid.uuid4().hex}"
    rows = stream_corpus(spark, corpus, files_per_batch, years[0], years[-1])
    if progress:
        rows = rows.observe("search", *_by_year("read", years), *_by_year("matched", years, is_match(term, start, end)))
    found = article_columns(matching(rows, term, start, end))
    writer = found.writeStream.queryName(name).format("parquet").option("path", out).partitionBy("year")
    if not progress:
        return _start(writer, checkpoint, once)
    table = ProgressTable(spark, progress, name, years)
    spark.streams.addListener(table)
    query = _start(writer, checkpoint, once)
    query.progress_table = table
    return query


class YearlyCap:
    """Batch writer that keeps the first ``cap`` matches of each year over all batches.

    Each batch leaves its rows under ``rows/batch=<id>`` and the running counts per year under
    ``counts/batch=<id>``. A replayed batch reads the counts of the batch before it and
    overwrites its own folders, so it ends the same whatever failed.
    """

    def __init__(self, out: str, cap: int):
        self.out, self.cap = out, int(cap)

    def rows_path(self, batch: int | str) -> str:
        return f"{self.out}/rows/batch={batch}"

    def counts_path(self, batch: int) -> str:
        return f"{self.out}/counts/batch={batch}"

    def _taken(self, spark: SparkSession, batch: int) -> DataFrame:
        if batch == 0:
            return local_table(spark, [], year=pa.int32(), taken=pa.int64())
        return spark.read.schema("year int, taken bigint").parquet(self.counts_path(batch - 1))

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        taken = self._taken(spark, number)
        # At most cap rows per year survive the first step, so what is ranked again stays small.
        firsts = first_rows(batch, ["year"], ["date", "article_id"], self.cap, number="place")
        room = F.lit(self.cap) - F.coalesce("taken", F.lit(0))
        kept = (
            firsts.join(taken, "year", "left").where(F.col("place") <= room).drop("taken", "place")
        )
        kept.write.mode("overwrite").partitionBy("year").parquet(self.rows_path(number))
        written = (
            spark.read.schema(kept.schema)
            .parquet(self.rows_path(number))
            .groupBy("year")
            .agg(F.count("*").alias("n"))
        )
        (
            taken.join(written, "year", "full_outer")
            .select("year", (F.coalesce("taken", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("taken"))
            .coalesce(1)
            .write.mode("overwrite")
            .parquet(self.counts_path(number))
        )


class CappedSearch(YearlyCap):
    """The cap over a stream of file names.

    A batch is a list of new files. Those of full years and of years outside the search are not opened, and once every
    searched year is full no file is. The counts of a batch have, per searched year, the matches taken so far
    and the rows that it read and matched itself.
    """

    def __init__(self, corpus: str, out: str, cap: int, term: str, start: str, end: str):
        super().__init__(out, cap)
        self.corpus, self.search = corpus, (term, start, end)
        self.years = _searched(start, end)
        #: Number of the batch after which no year was open.
        self.full_at: int | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # one number per searched year
        taken = dict.fromkeys(self.years, 0) | {row.year: row.taken for row in self._taken(spark, number).collect()}
        still_open = [year for year, n in taken.items() if n < self.cap]
        metrics: dict = {}
        if still_open:
            # the driver lists a batch's files in any case; only their paths are taken
            files = batch.where(F.col("year").isNull() | F.col("year").isin(still_open)).select("path")
            paths = [row.path for row in files.collect()]
            kept, seen = self._kept(spark, paths, taken, still_open)
            kept.write.mode("overwrite").partitionBy("year").parquet(self.rows_path(number))
            # without files Spark leaves out the plan that would be observed
            metrics = seen.get if paths else {}
            rows = spark.read.schema(kept.schema).parquet(self.rows_path(number))
            for row in rows.groupBy("year").agg(F.count("*").alias("n")).collect():
                taken[row.year] += row.n
        counts = [(*row, taken[row[0]]) for row in _year_rows(metrics, self.years)]
        counts = local_table(spark, counts, year=pa.int32(), read=pa.int64(), matched=pa.int64(), taken=pa.int64())
        counts.coalesce(1).write.mode("overwrite").parquet(self.counts_path(number))
        if self.full_at is None and all(n >= self.cap for n in taken.values()):
            self.full_at = number

    def _kept(
        self, spark: SparkSession, files: list[str], taken: dict[int, int], still_open: list[int]
    ) -> tuple[DataFrame, Observation]:
        rows, said = read_corpus(spark, self.corpus, files=files), F.substring("date", 1, 4).try_cast("int")
        rows = rows.withColumn("year", F.coalesce("year", said)).where(F.col("year").isin(still_open))
        seen = Observation()
        rows = rows.observe(seen, *_by_year("read", still_open), *_by_year("matched", still_open, is_match(*self.search)))
        found = article_columns(matching(rows, *self.search))
        # At most cap rows per year survive the first step, so what is ranked again stays small.
        firsts = first_rows(found, ["year"], ["date", "article_id"], self.cap, number="place")
        room = local_table(spark, [(y, self.cap - taken[y]) for y in still_open], year=pa.int32(), room=pa.int64())
        return firsts.join(room, "year").where("place <= room").drop("place", "room"), seen


def _stop_when_full(query: StreamingQuery, writer: CappedSearch) -> None:
    """End the stream when the batch that filled the last year is committed."""
    while query.isActive:
        done = (query.lastProgress or {}).get("batchId", -1)
        if writer.full_at is not None and done >= writer.full_at:
            query.stop()
            return
        time.sleep(0.2)


def stream_search_capped(
    spark: SparkSession,
    corpus: str,
    out: str,
    checkpoint: str,
    term: str,
    start: str,
    end: str,
    cap: int,
    *,
    files_per_batch: int | None = None,
    once: bool = True,
) -> StreamingQuery:
    """As ``stream_search``, with at most ``cap`` matches per year in order of arrival.

    Inside a batch, matches count by date, then id. The stream is one of file names. It ends by itself once every
    searched year is full; files that arrive in a batch after that are not opened, nor are files of years that
    are full or not searched.
    """
    writer = CappedSearch(corpus, out, cap, term, start, end)
    files = stream_files(spark, corpus, files_per_batch)
    query = _start(files.writeStream.foreachBatch(writer), checkpoint, once)
    threading.Thread(target=_stop_when_full, args=(query, writer), daemon=True).start()
    return query


def read_capped(spark: SparkSession, out: str) -> DataFrame:
    """Everything the capped search has kept so far."""
    columns = ", ".join(f"{c} string" for c in ARTICLE_COLUMNS)
    return (
        spark.read.schema(f"{columns}, batch bigint, year int")
        .parquet(f"{out}/rows")
        .drop("batch")
    )


def progress(query: StreamingQuery) -> list[dict]:
    """Rows read per finished batch, as Spark reports them; for the last hundred batches only."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"]} for p in query.recentProgress]
