"""Writing search results and the manifest of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.dates import day_range
from broadsheet.schemas import RUNS


def run_id(**params: Column | str | None) -> Column:
    """Eight hex digits that depend on all parameters, whatever their order."""
    fields = [
        (value if isinstance(value, Column) else F.lit(value).cast("string")).alias(name)
        for name, value in sorted(params.items())
    ]
    return F.substring(F.sha1(F.to_json(F.struct(*fields))), 1, 8)


def manifest(matches: DataFrame, term: str, start: str, end: str) -> DataFrame:
    """One ``RUNS`` row for a whole search."""
    return matches.agg(F.count("*").alias("match_count")).select(
        run_id(search_term=term, start_date=start, end_date=end).alias("run_id"),
        F.lit(term).alias("search_term"),
        F.lit(start).alias("start_date"),
        F.lit(end).alias("end_date"),
        F.lit(None).cast("int").alias("year"),
        "match_count",
    )


def yearly_manifest(matches: DataFrame, term: str, start: str, end: str) -> DataFrame:
    """One ``RUNS`` row per searched year, zero counts included."""
    lo, hi = day_range(start, end)
    years = matches.sparkSession.range(int(lo[:4]), int(hi[:4]) + 1).select(
        F.col("id").cast("int").alias("year")
    )
    counts = matches.groupBy(F.col("year").cast("int").alias("year")).agg(
        F.count("*").alias("match_count")
    )
    return years.join(counts, "year", "left").select(
        run_id(search_term=term, start_date=lo, end_date=hi, year=F.col("year")).alias("run_id"),
        F.lit(term).alias("search_term"),
        F.lit(lo).alias("start_date"),
        F.lit(hi).alias("end_date"),
        "year",
        F.coalesce("match_count", F.lit(0)).cast("long").alias("match_count"),
    )


def write_results(matches: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Article rows as JSON lines, one folder per year where the year is known."""
    writer = matches.write.mode(mode)
    if "year" in matches.columns:
        writer = writer.partitionBy("year")
    writer.json(path)


def write_manifest(runs: DataFrame, path: str, mode: str = "append") -> None:
    runs.select(*[f.name for f in RUNS]).coalesce(1).write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; an empty table still leaves its header line."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
