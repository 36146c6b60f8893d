"""Reading the yearly article corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.schemas import CORPUS

# A yearly file ends with its year, a yearly folder is named by it.
YEAR_FILE = r"_(\d{4})\.parquet$"
YEAR_FOLDER = r"/year=(\d{4})/"

# Fixed value: what Spark's file listing has.
_LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def _file_year() -> Column:
    return F.nullif(F.regexp_extract("_metadata.file_name", YEAR_FILE, 1), F.lit("")).cast("int")


def year_of_path(path: str) -> Column:
    """Year that the folder or the name of a file says, else null."""
    found = (F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in (YEAR_FOLDER, YEAR_FILE))
    return F.coalesce(*found).cast("int")


def read_corpus(
    spark: SparkSession,
    path: str,
    start_year: int | None = None,
    end_year: int | None = None,
    *,
    files: list[str] | None = None,
) -> DataFrame:
    """Articles with a ``year`` column, from ``year=`` folders or files named ``*_<year>.parquet``.

    The year filter is on the partition column or on the file name, so files of other years are
    never opened. Reversed years are swapped; years without a file are simply absent. With
    ``files``, which lie below ``path``, only those are read.
    """
    reader = spark.read.schema(CORPUS)
    df = reader.option("basePath", path).parquet(*files) if files else reader.parquet(path)
    if files is not None and not files:
        df = df.where(F.lit(False))
    if "year" not in df.columns:
        df = df.withColumn("year", _file_year())
    if start_year is not None and end_year is not None:
        lo, hi = sorted((int(start_year), int(end_year)))
        df = df.where(F.col("year").between(lo, hi))
    return df


def stream_corpus(
    spark: SparkSession,
    path: str,
    files_per_batch: int | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """The same corpus as a file stream of articles, with the year of the file, else of the date.

    Files whose folder or name says a year outside the range are not opened.
    """
    reader = spark.readStream.schema(CORPUS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df, said = reader.parquet(path), year_of_path("_metadata.file_path")
    if start_year is not None and end_year is not None:
        df = df.where(said.isNull() | said.between(int(start_year), int(end_year)))
    return df.withColumn("year", F.coalesce(said, F.substring("date", 1, 4).try_cast("int")))


def stream_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the corpus files' paths and years, which opens none of them."""
    reader = spark.readStream.format("binaryFile").schema(_LISTING)
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select("path", year_of_path("path").alias("year"))


def available_years(corpus: DataFrame) -> DataFrame:
    """Years present, ascending. Reads no article column."""
    return corpus.select("year").where(F.col("year").isNotNull()).distinct().orderBy("year")


def year_ranges(years: DataFrame) -> DataFrame:
    """Runs of consecutive years with a label, ``1900-1910`` or ``1912``.

    The window covers distinct calendar years, of which there are at most 9999.
    """
    numbered = years.select("year").distinct().withColumn(
        "island", F.col("year") - F.row_number().over(Window.orderBy("year"))
    )
    return (
        numbered.groupBy("island")
        .agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
        .select(
            "first_year",
            "last_year",
            F.when(F.col("first_year") == F.col("last_year"), F.col("first_year").cast("string"))
            .otherwise(F.concat_ws("-", "first_year", "last_year"))
            .alias("label"),
        )
    )
