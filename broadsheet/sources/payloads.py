"""Reading search results: article rows, result envelopes and what a run was about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions.text import blank_to_null
from broadsheet.schemas import ARTICLE_COLUMNS, RESULTS, ensure_columns

_ENVELOPE = T.StructType(
    [
        T.StructField("search_term", T.StringType()),
        T.StructField("start_date", T.StringType()),
        T.StructField("end_date", T.StringType()),
        T.StructField("year", T.StringType()),
        T.StructField("match_count", T.LongType()),
        T.StructField("articles", T.StringType()),
        T.StructField("records", T.StringType()),
    ]
)
# Heads of derived files, put before the term, and the date shape at the end.
DERIVED_PREFIX = r"^(merged|occurrences|metrics|by_time|collocates_metrics|collocates_by_time|collocates)_"
NAME_WITH_DATES = r"^(.*)_([^_]+)_([^_]+)$"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Article rows written by ``write_results``: one JSON object per line, split freely."""
    df = spark.read.schema(RESULTS).json(path)
    return ensure_columns(df, (*ARTICLE_COLUMNS, "newspaper_name"))


def _glob(text: str) -> str:
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in text)


def read_envelopes(
    spark: SparkSession, path: str, term: str | None = None, year: str | int | None = None
) -> DataFrame:
    """Result envelopes, one JSON document per file, with their file name.

    All files of a run are read by one job. ``term`` keeps files named ``<term>_...``, ``year``
    those that end with ``_<year>.json``.
    """
    head = f"{_glob(term)}_*" if term else "*"
    if year is not None:
        # "<term>_<year>.json" has no second underscore, so the year may follow at once.
        tail = f"_{year}.json"
        pattern = f"{{{_glob(term)}{tail},{head}{tail}}}" if term else f"*{tail}"
    else:
        pattern = f"{head}.json"
    return (
        spark.read.schema(_ENVELOPE)
        .option("multiLine", True)
        .option("pathGlobFilter", pattern)
        .json(path)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )


def envelope_articles(envelopes: DataFrame, empty_falls_back: bool = True) -> DataFrame:
    """One row per article of each envelope, with ``run`` = file name.

    ``records`` stands in where ``articles`` is missing and, if ``empty_falls_back``, also where
    it is empty. Anything but a list is an error.
    """
    use = F.col("articles")
    absent = use.isNull()
    if empty_falls_back:
        absent = absent | use.rlike(r"^\s*\[\s*\]\s*$")
    listed = F.when(absent, F.coalesce("records", use, F.lit("[]"))).otherwise(use)
    checked = F.when(listed.rlike(r"^\s*\["), listed).otherwise(
        F.raise_error(F.concat(F.lit("no list of articles or records in "), "file_name"))
    )
    rows = F.from_json(checked, T.ArrayType(RESULTS))
    return envelopes.select(
        F.col("file_name").alias("run"), F.explode(rows).alias("a")
    ).select("run", "a.*")


def name_metadata(file_name: Column) -> dict[str, Column]:
    """Term, start and end from ``[prefix_]term_start_end.ext``; a term may hold underscores."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), DERIVED_PREFIX, "")
    dated = stem.rlike(NAME_WITH_DATES)
    return {
        "search_term": F.when(dated, F.regexp_extract(stem, NAME_WITH_DATES, 1)).otherwise(stem),
        "start_date": F.when(dated, F.regexp_extract(stem, NAME_WITH_DATES, 2)),
        "end_date": F.when(dated, F.regexp_extract(stem, NAME_WITH_DATES, 3)),
    }


def run_metadata(runs: DataFrame) -> DataFrame:
    """What each run was about: its own fields first, then its file name, then defaults."""
    runs = ensure_columns(runs, ("search_term", "start_date", "end_date"))
    named = name_metadata(F.col("file_name"))
    default = {"search_term": "term", "start_date": "all", "end_date": "all"}
    return runs.withColumns(
        {
            c: F.coalesce(blank_to_null(F.col(c)), blank_to_null(named[c]), F.lit(default[c]))
            for c in default
        }
    )
