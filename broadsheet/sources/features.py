"""Reading point features."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions.dates import parse_date
from broadsheet.functions.text import blank_to_null
from broadsheet.schemas import FEATURE, FEATURE_PROPERTIES, ensure_columns

_COLLECTION = T.StructType(
    [
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("features", T.ArrayType(FEATURE)),
    ]
)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features written one per line; files split freely. ``raw`` keeps each line as it stands."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", FEATURE).alias("f"), F.col("value").alias("raw")).select("f.*", "raw")


def read_feature_collection(spark: SparkSession, path: str, stated: Observation | None = None) -> DataFrame:
    """Features of whole-document collections, as ``read_features`` gives them.

    ``raw`` holds each feature as a JSON text of its own, with its ids, numbers, lists and nested values.
    For many files of bounded size: each is one task, and Spark holds its features as one value, which
    may not exceed 2 GB. Larger data belong in lines, see ``read_features``. With ``stated`` the pass that
    reads the features also notes the coordinate systems, see ``stated_crs``.
    """
    # a value that is asked for as text is handed over as it stands in the document
    columns = "features array<string>" + (", crs string" if stated else "")
    docs = spark.read.schema(columns).option("multiLine", True).json(path)
    if stated:
        docs = docs.observe(stated, F.min("crs").alias("first"), F.max("crs").alias("last"))
    # line ends stand between values only, as JSON writes those inside a string in another way
    one_line = F.translate(F.col("raw"), "\r\n", "  ").alias("raw")
    raw = docs.select(F.explode("features").alias("raw")).where("raw is not null").select(one_line)
    return raw.select(F.from_json("raw", FEATURE).alias("f"), "raw").select("f.*", "raw")


def collection_crs(spark: SparkSession, path: str) -> dict | None:
    """Coordinate system that whole-document collections state, for the header of what is written from them.

    None if none states one; an error if they differ. Only the distinct statements come to the driver, two at most.
    """
    docs = spark.read.schema("crs string").option("multiLine", True).json(path)
    stated = docs.where("crs is not null").distinct().limit(2).collect()
    return _only_crs([row.crs for row in stated])


def stated_crs(stated: Observation) -> dict | None:
    """As ``collection_crs``, from what ``read_feature_collection`` noted; waits until its rows are written or collected."""
    return _only_crs(sorted({crs for crs in stated.get.values() if crs is not None}))


def _only_crs(stated: list[str]) -> dict | None:
    if len(stated) > 1:
        raise ValueError("the collections state different coordinate systems")
    return json.loads(stated[0]) if stated else None


def collection_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Term, start and end per collection, each from its metadata, else its own properties, else the
    first feature that has it."""
    docs = spark.read.schema(_COLLECTION).option("multiLine", True).json(path)

    def fact(names: tuple[str, ...]) -> Column:
        def among(values: Column) -> Column:
            return F.coalesce(*[blank_to_null(values[k]) for k in names])

        of_features = F.array_compact(F.transform(F.col("features.properties"), among))
        return F.coalesce(among(F.col("metadata")), among(F.col("properties")), F.get(of_features, F.lit(0)))

    # The property names a run's facts may stand under.
    keys = {
        "search_term": ("search_term", "SearchTerm", "term", "Term"),
        "start_date": ("start_date", "StartDate"),
        "end_date": ("end_date", "EndDate"),
    }
    return docs.select(
        F.col("_metadata.file_name").alias("file_name"),
        *[fact(names).alias(out) for out, names in keys.items()],
    )


def feature_rows(features: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One flat row per feature, every expected property present; geometry kept as Long/Lat."""
    number = lambda i: F.get(F.col("geometry.coordinates"), F.lit(i)).try_cast("double")
    names = (*FEATURE_PROPERTIES, *extra)
    return features.select(
        *[F.col("properties")[n].alias(n) for n in names],
        number(0).alias("Long"),
        number(1).alias("Lat"),
        "properties",
        *(["raw"] if "raw" in features.columns else []),
    )


def valid_point(lon: Column, lat: Column) -> Column:
    return lon.isNotNull() & lat.isNotNull()


def points(rows: DataFrame) -> DataFrame:
    """Rows with usable coordinates, as ``lat``/``lon``, and with their date parsed to ``day``."""
    rows = ensure_columns(rows, ("date", "page", "article", "url", "Title", "City", "State", "lccn"))
    lon, lat = F.col("Long").try_cast("double"), F.col("Lat").try_cast("double")
    return (
        rows.where(valid_point(lon, lat))
        # Column names ignore case, so "lat" takes the place of "Lat".
        .withColumns({"lon": lon, "lat": lat, "day": parse_date(F.col("date"))})
        .drop("Long")
    )
