"""Calendar bins and collocates over time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.dates import as_day, bin_edges
from broadsheet.functions.ranking import rank_by_frequency
from broadsheet.operators.collocation import Options, context_terms
from broadsheet.runtime import local_table, stage


def day_spans(spark: SparkSession, spans: list[tuple], **types: pa.DataType) -> DataFrame:
    """Calendar rows ``day, ...`` for spans ``(first_day, last_day, ...)``.

    A range condition between dates and bins thus becomes an equality on the day, which Spark can
    hash-join; the table grows with the calendar, never with the articles. Its rows are made on the
    driver, one per day, so that Spark knows its size and broadcasts it or not by its own bound.
    """
    one = dt.timedelta(days=1)
    rows = [(lo + i * one, *rest) for lo, hi, *rest in spans for i in range((hi - lo).days + 1)]
    return local_table(spark, rows, day=pa.date32(), **types)


def bin_calendar(spark: SparkSession, edges: list[dt.date]) -> DataFrame:
    """``day, bin_no, time_bin``: half-open bins labelled by their left edge."""
    one = dt.timedelta(days=1)
    spans = [
        (lo, hi - one, i, lo.isoformat()) for i, (lo, hi) in enumerate(zip(edges, edges[1:]), 1)
    ]
    return day_spans(spark, spans, bin_no=pa.int32(), time_bin=pa.string())


def date_bounds(df: DataFrame, column: str) -> tuple[dt.date | None, dt.date | None]:
    """First and last date: one aggregate whose single row comes to the driver."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    return row.lo, row.hi


def assign_bins(articles: DataFrame, edges: list[dt.date], date: str = "date") -> DataFrame:
    """Add ``bin_no`` and ``time_bin``; dates outside all bins get nulls."""
    calendar = bin_calendar(articles.sparkSession, edges)
    return articles.join(calendar, F.col(date) == F.col("day"), "left").drop("day")


def edges_for(
    articles: DataFrame, size: int, unit: str, start: str | None = None, end: str | None = None
) -> list[dt.date]:
    lo = as_day(start) if start else None
    hi = as_day(end) if end else None
    if lo is None or hi is None:
        first, last = date_bounds(articles, "date")
        lo, hi = lo or first, hi or last
    return bin_edges(lo, hi, unit, size) if lo and hi else []


def collocates_by_time(
    articles: DataFrame,
    term: str,
    size: int,
    unit: str,
    options: Options = Options(),
    *,
    start: str | None = None,
    end: str | None = None,
    put: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """``time_bin, collocate_term, frequency, ordinal_rank``; empty bins do not appear.

    Bins start at ``start``, or at the first date. ``date`` must be a date (see
    ``filter_articles``). Articles meet the calendar before they are exploded.
    """
    edges = edges_for(articles, size, unit, start, end)
    calendar = bin_calendar(articles.sparkSession, edges)
    binned = articles.join(calendar, F.col("date") == F.col("day")).select("time_bin", "article")
    plain = Options(
        drop_stopwords=options.drop_stopwords, window=options.window, stopwords=options.stopwords
    )
    counts = (
        context_terms(binned, term, plain, ["time_bin"])
        .groupBy("time_bin", "collocate_term")
        .agg(F.count("*").alias("frequency"))
    )
    ranked = rank_by_frequency(counts, ["time_bin"], "frequency", "collocate_term", "ordinal_rank", put=put)
    return ranked.select("time_bin", "collocate_term", "frequency", "ordinal_rank")
