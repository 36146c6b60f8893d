"""Writing point features."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.schemas import FEATURE_PROPERTIES

# Fixed value: the coordinate reference system of every feature.
CRS = "urn:ogc:def:crs:OGC:1.3:CRS84"


def point_geometry(lon: Column, lat: Column) -> Column:
    """Point, or null where either coordinate is null."""
    return F.when(
        lon.isNotNull() & lat.isNotNull(),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")),
    )


def feature_json(
    located: DataFrame,
    properties: tuple[str, ...] = FEATURE_PROPERTIES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One JSON feature per row in column ``value``; dates and pages become text."""
    kept = [F.col(c).cast("string").alias(c) for c in properties if c in located.columns]
    return located.select(
        *carry,
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                point_geometry(F.col("Long"), F.col("Lat")).alias("geometry"),
                F.struct(*kept).alias("properties"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("value"),
    )


def write_raw_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Features as they were read: their ``raw`` lines, else points rebuilt from the parsed columns."""
    if "raw" in features.columns:
        features.select("raw").write.mode(mode).text(path)
        return
    numbers = F.transform("geometry.coordinates", lambda c: c.try_cast("double"))
    geometry = F.when(
        F.col("geometry").isNotNull(),
        F.struct(F.col("geometry.type").alias("type"), numbers.alias("coordinates")),
    )
    line = F.to_json(
        F.struct("type", geometry.alias("geometry"), "properties"), {"ignoreNullFields": "false"}
    )
    features.select(line.alias("value")).write.mode(mode).text(path)


def write_collection_header(
    spark: SparkSession, path: str, name: str, mode: str = "errorifexists", crs: dict | None = None
) -> None:
    """What a feature collection states once: its type, name and coordinate system (``crs`` as the input had it)."""
    crs = crs or {"type": "name", "properties": {"name": CRS}}
    header = json.dumps({"type": "FeatureCollection", "name": name, "crs": crs})
    spark.range(1).select(F.lit(header).alias("value")).write.mode(mode).text(path)


def write_features(
    located: DataFrame, path: str, mode: str = "errorifexists", run: str | None = None
) -> None:
    """Newline-delimited features, written by all tasks in parallel; one folder per ``run``."""
    lines = feature_json(located, carry=(run,) if run else ())
    writer = lines.write.mode(mode)
    if run:
        writer = writer.partitionBy(run)
    writer.text(path)
