"""Table shapes shared by the readers, operators and writers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# Columns of one article as stored in a corpus and as returned by a search.
ARTICLE_COLUMNS = ("article_id", "lccn", "date", "page", "article", "url", "filename")

CORPUS = T.StructType([T.StructField("full_article_id", T.LongType()), *_strings(*ARTICLE_COLUMNS)])

RESULTS = T.StructType(_strings(*ARTICLE_COLUMNS, "newspaper_name"))

LOCATIONS = T.StructType(
    [
        *_strings("SN", "Title", "City", "State"),
        T.StructField("Long", T.DoubleType()),
        T.StructField("Lat", T.DoubleType()),
    ]
)

# Properties carried by every located article.
FEATURE_PROPERTIES = (*ARTICLE_COLUMNS, "Title", "City", "State")

GEOMETRY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        # Read as text so that one odd coordinate voids its own feature only.
        T.StructField("coordinates", T.ArrayType(T.StringType())),
    ]
)

FEATURE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("geometry", GEOMETRY),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("collocate_term", T.StringType()),
        T.StructField("frequency", T.LongType()),
        T.StructField("page_count", T.LongType()),
        T.StructField("first_date", T.StringType()),
        T.StructField("last_date", T.StringType()),
        T.StructField("article_count", T.LongType()),
        T.StructField("cooccurrence_rate", T.DoubleType()),
        T.StructField("mean_relative_position", T.DoubleType()),
    ]
)

BY_TIME = T.StructType(
    [
        T.StructField("time_bin", T.StringType()),
        T.StructField("collocate_term", T.StringType()),
        T.StructField("frequency", T.LongType()),
        T.StructField("ordinal_rank", T.LongType()),
    ]
)

RUNS = T.StructType(
    [
        *_strings("run_id", "search_term", "start_date", "end_date"),
        T.StructField("year", T.IntegerType()),
        T.StructField("match_count", T.LongType()),
    ]
)


def ensure_columns(df: DataFrame, names: Iterable[str], dtype: str = "string") -> DataFrame:
    """Add each missing column as typed nulls; present columns stay as they are."""
    present = {c.lower() for c in df.columns}
    missing = {n: F.lit(None).cast(dtype) for n in names if n.lower() not in present}
    return df.withColumns(missing) if missing else df


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")
    return df
