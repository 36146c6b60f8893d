"""Corpus-shaped views over the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.locations import locate_articles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an article of three years; every 97th one has no newspaper id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    number = F.col("doc_id").cast("string")
    day = F.date_add(F.lit("1900-01-01").cast("date"), (F.col("doc_id") * 37 % 365 * 3).cast("int"))
    return docs.select(
        F.col("doc_id").alias("full_article_id"),
        number.alias("article_id"),
        F.when(F.col("doc_id") % 97 != 0, F.col("source")).alias("lccn"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("p"), (1 + F.col("doc_id") % 8).cast("string")).alias("page"),
        F.col("text").alias("article"),
        F.concat(
            F.lit("https://example.org/"), "source", F.lit("/"), number, F.lit("/seq-1.jp2")
        ).alias("url"),
        F.concat("source", F.lit("_"), number, F.lit(".json")).alias("filename"),
        F.concat(F.lit("The "), "source", F.lit(" paper")).alias("newspaper_name"),
    )


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").withColumns(
        {
            "SN": F.concat(F.lit("src"), F.col("s_suppkey").cast("string")),
            "Title": F.concat(F.lit("The src"), F.col("s_suppkey").cast("string"), F.lit(" paper")),
        }
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One newspaper per supplier but ``src19``; ``src3`` and ``src4`` share a point and the
    newspapers of nation 7 lack their longitude."""
    k = F.col("s_suppkey")
    spot = F.when(k == 4, 3).otherwise(k)
    return (
        _suppliers(spark, sf_dir)
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .where(k != 19)
        .select(
            "SN",
            "Title",
            F.col("n_name").alias("City"),
            F.col("r_name").alias("State"),
            F.when(F.col("s_nationkey") != 7, -120 + (spot % 100).cast("double") / 2).alias("Long"),
            (25 + (spot % 90).cast("double") / 4).alias("Lat"),
        )
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title lookup; newspapers in debt come a second time with a newer title."""
    every = _suppliers(spark, sf_dir)
    newer = every.where("s_acctbal < 5000")
    return every.select("SN", "Title", F.lit(0).alias("ordinal")).unionAll(
        newer.select("SN", F.concat("Title", F.lit(" (new)")).alias("Title"), F.lit(1).alias("ordinal"))
    )


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates looked up: found for nation 7, not found for newspapers with little money."""
    found = F.col("s_nationkey") == 7
    part = (F.col("s_suppkey") % 8).cast("double") / 4
    return (
        _suppliers(spark, sf_dir)
        .where(found | (F.col("s_acctbal") < 1000))
        .select(
            "SN",
            F.when(found, 37.75 + part).alias("Lat"),
            F.when(found, -77.5 - part).alias("Long"),
        )
    )


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their locations, dates in every accepted spelling."""
    rows = locate_articles(articles(spark, sf_dir), locations(spark, sf_dir), key="lccn")
    style = F.col("full_article_id") % 6
    return rows.withColumn(
        "date",
        F.when(style == 1, F.replace("date", F.lit("-"), F.lit("/")))
        .when(style == 2, F.replace("date", F.lit("-"), F.lit(".")))
        .when(style == 3, F.replace("date", F.lit("-"), F.lit("")))
        .when(style == 4, F.concat("date", F.lit("T00:00:00Z")))
        .when(style == 5, F.concat(F.lit("about "), "date"))
        .otherwise(F.col("date")),
    )
