"""Reading locations, title lookups and tables of earlier results."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from broadsheet.runtime import local_table
from broadsheet.schemas import LOCATIONS, ensure_columns, require_columns

# Headings under which a lookup may keep its key and its title.
KEY_HEADINGS = ("sn", "lccn")
TITLE_HEADINGS = ("title", "newspaper", "name")


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    )


def file_order() -> Column:
    """Place of a row among the files it is read from: path, split and row in the split.

    To be selected straight from the reader. Rows of one split are numbered in their order by one task, and splits
    are told apart by where they begin, so the order is the same however files are cut and dealt to tasks.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_locations(spark: SparkSession, path: str, *, ordinal: bool = False) -> DataFrame:
    """Newspaper locations; ``SN``, ``Long`` and ``Lat`` are required columns.

    ``ordinal`` adds the place in the files under that name, by which the last row of a newspaper is known.
    """
    raw = require_columns(_read_csv(spark, path), ("SN", "Long", "Lat"), "the locations table")
    place = [file_order().alias("ordinal")] if ordinal else []
    if place:
        raw = raw.drop("ordinal").select("*", *place)
    raw = ensure_columns(raw, ("City", "State", "Title"))
    columns = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in LOCATIONS]
    return raw.select(*columns, *(["ordinal"] if place else []))


def title_lookup(df: DataFrame) -> DataFrame:
    """``SN, Title`` from a table whose headings vary; without such headings it is empty.

    A column ``ordinal`` says which row is the last: numbers, or places in files as ``file_order`` gives them.
    """

    headings = {column.strip().lower(): column for column in reversed(df.columns)}  # the first of a kind wins
    keys = [headings[h] for h in headings if h in KEY_HEADINGS]
    titles = [headings[h] for h in headings if h in TITLE_HEADINGS]
    key, title = (min(c, key=df.columns.index, default=None) for c in (keys, titles))
    if key is None or title is None:
        empty = {"SN": pa.string(), "Title": pa.string(), "ordinal": pa.int64()}
        return local_table(df.sparkSession, [], **empty)
    if "ordinal" not in df.columns:
        ordinal = F.monotonically_increasing_id()
    elif isinstance(df.schema["ordinal"].dataType, StructType):
        ordinal = F.col("ordinal")
    else:
        ordinal = F.col("ordinal").cast("long")
    return df.select(
        F.col(f"`{key}`").cast("string").alias("SN"),
        F.col(f"`{title}`").cast("string").alias("Title"),
        ordinal.alias("ordinal"),
    )


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """``title_lookup`` of CSV files; without a column ``ordinal`` rows count in the order of the files."""
    raw = _read_csv(spark, path)
    if "ordinal" not in raw.columns:
        raw = raw.select("*", file_order().alias("ordinal"))
    return title_lookup(raw)


def last_titles(lookup: DataFrame) -> DataFrame:
    """One title per key; the row with the highest ordinal wins."""
    return (
        lookup.where(F.col("SN").isNotNull())
        .groupBy("SN")
        .agg(F.max_by("Title", "ordinal").alias("Title"))
    )


def _kind(spark: SparkSession, path: str) -> str | None:
    """``csv`` or ``json``, from the path or, for a folder, from the files in it."""
    ending = r"\.(csv|json)(\.\w+)?$"
    last = path.rstrip("/").rsplit("/", 1)[-1].lower()
    own = re.search(ending, last)
    if own or "." in last:  # a file of another kind is not a folder to look into
        return own and own[1]
    kinds = {found[1] for name in spark.read.text(path).inputFiles() if (found := re.search(ending, name.lower()))}
    return kinds.pop() if len(kinds) == 1 else None


def read_table(spark: SparkSession, source: str | DataFrame, schema=None) -> DataFrame:
    """A metrics or by-time table from a CSV or JSON file or folder of files, or a DataFrame as it is."""
    if isinstance(source, DataFrame):
        return source
    kind = _kind(spark, source)
    if kind is None:
        raise ValueError("expected a .csv or .json path, a folder of such files, or a DataFrame")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "json":
        return reader.json(source)
    if schema is None:
        reader = reader.option("inferSchema", True)
    return reader.option("header", True).csv(source)
