"""Joining articles to newspaper locations, and mending the locations table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.runtime import scalar, stage
from broadsheet.schemas import LOCATIONS, ensure_columns
from broadsheet.sources.tables import last_titles

_PLACE = tuple(f.name for f in LOCATIONS)


def _by_kind(locations: DataFrame) -> DataFrame:
    """Each location once under its id and once under its title."""
    return locations.select(
        F.explode(
            F.array(
                F.struct(F.lit("lccn").alias("kind"), F.col("SN").alias("key")),
                F.struct(F.lit("title").alias("kind"), F.col("Title").alias("key")),
            )
        ).alias("k"),
        *_PLACE,
    ).select("k.kind", "k.key", *_PLACE)


def locate_articles(
    articles: DataFrame,
    locations: DataFrame,
    *,
    key: str = "auto",
    run: str | None = None,
) -> DataFrame:
    """Articles with ``SN, Title, City, State, Long, Lat``; unknown newspapers get nulls.

    ``key`` is ``lccn``, ``title`` or ``auto``: by id if any article has one, else by newspaper
    name if any has one, else nothing joins. With ``run`` that choice is made per run, for all
    runs at once, from a small table computed beforehand. Null keys meet null keys and a repeated location repeats the article. A
    missing title falls back on ``newspaper_name``, which is then dropped.

    No broadcast is forced: Spark broadcasts the locations when their size allows it, and
    otherwise splits an over-full newspaper through adaptive skew handling.
    """
    articles = ensure_columns(articles.drop(*_PLACE), ("lccn", "newspaper_name"))
    locations = ensure_columns(locations, ("City", "State", "Title"))
    if key in ("lccn", "title"):
        left = "lccn" if key == "lccn" else "newspaper_name"
        right = "SN" if key == "lccn" else "Title"
        places = locations.select(F.col(right).alias("_key"), *_PLACE)
        joined = articles.join(places, F.col(left).eqNullSafe(F.col("_key")), "left").drop("_key")
    elif key == "auto":
        has_id = F.max(F.col("lccn").isNotNull())
        has_name = F.max(F.col("newspaper_name").isNotNull())
        if run is None:
            flags = scalar(articles, F.struct(has_id.alias("id"), has_name.alias("name")))
            by_id, by_name = flags["id"], flags["name"]
        else:
            # Staged, one row per run: Spark then knows its size before it plans the join, and
            # does not shuffle article text by run where the runs fit a broadcast.
            flags = stage(
                articles.groupBy(F.col(run).alias("_run")).agg(
                    has_id.alias("_id"), has_name.alias("_name")
                ),
                "runs",
            )
            articles = articles.join(flags, F.col(run) == F.col("_run"), "left")
            by_id, by_name = F.col("_id"), F.col("_name")
        kind = F.when(by_id, F.lit("lccn")).when(by_name, F.lit("title"))
        keyed = articles.withColumn("_kind", kind).withColumn(
            "_key", F.when(F.col("_kind") == "lccn", F.col("lccn")).otherwise(F.col("newspaper_name"))
        )
        joined = keyed.join(
            _by_kind(locations),
            (F.col("_kind") == F.col("kind")) & F.col("_key").eqNullSafe(F.col("key")),
            "left",
        ).drop("_kind", "_key", "kind", "key", "_run", "_id", "_name")
    else:
        raise ValueError("key must be 'lccn', 'title' or 'auto'")
    return joined.withColumn("Title", F.coalesce("Title", "newspaper_name")).drop("newspaper_name")


def missing_coordinates(
    locations: DataFrame, newspapers: Sequence[str] | None = None
) -> DataFrame:
    """Locations to look up: those with the given titles, else those lacking a coordinate."""
    if newspapers:
        return locations.where(F.col("Title").isin(list(newspapers)))
    return locations.where(F.col("Long").isNull() | F.col("Lat").isNull())


def newspapers_to_locate(
    locations: DataFrame, newspapers: Sequence[str] | None = None, ordinal: str = "ordinal"
) -> DataFrame:
    """``SN, Title`` of those locations, one row per id; the last title wins."""
    wanted = missing_coordinates(locations, newspapers)
    if ordinal not in wanted.columns:
        wanted = wanted.withColumn(ordinal, F.monotonically_increasing_id())
    return last_titles(wanted.select("SN", "Title", F.col(ordinal).alias("ordinal")))


def apply_coordinates(
    locations: DataFrame, fetched: DataFrame, *, keep_existing: bool = False
) -> DataFrame:
    """Overwrite coordinates by those fetched, also with null where the lookup found nothing.

    ``keep_existing`` keeps the old coordinates in that case. Of several rows fetched for one id the last
    by ``fetched_at`` counts; without that column, the greatest pair of coordinates.
    """
    place = F.struct(F.col("Lat").alias("lat"), F.col("Long").alias("long"))
    latest = [F.col("fetched_at")] if "fetched_at" in fetched.columns else []
    last = F.max_by(place, F.struct(*latest, place.alias("place")))
    one = fetched.where(F.col("SN").isNotNull()).groupBy(F.col("SN").alias("_sn")).agg(last.alias("_place"))
    found = one.select("_sn", F.col("_place.lat").alias("_lat"), F.col("_place.long").alias("_long"))
    hit = F.col("_sn").isNotNull()
    if keep_existing:
        hit = hit & F.col("_lat").isNotNull() & F.col("_long").isNotNull()
    return (
        locations.join(found, F.col("SN") == F.col("_sn"), "left")
        .withColumns(
            {
                "Lat": F.when(hit, F.col("_lat")).otherwise(F.col("Lat")),
                "Long": F.when(hit, F.col("_long")).otherwise(F.col("Long")),
            }
        )
        .drop("_sn", "_lat", "_long")
    )


def join_stats(located: DataFrame) -> DataFrame:
    """Distinct places (titles, a missing one counting as one place) and articles."""
    return located.agg(
        (
            F.count_distinct("Title")
            + F.coalesce(F.max(F.col("Title").isNull().cast("int")), F.lit(0))
        ).alias("places"),
        F.count("*").alias("articles"),
    )


def place_facets(located: DataFrame) -> DataFrame:
    """Distinct non-blank cities and states, sorted, as ``facet, value``."""
    return (
        located.select(
            F.explode(
                F.array(
                    F.struct(F.lit("City").alias("facet"), F.col("City").alias("value")),
                    F.struct(F.lit("State").alias("facet"), F.col("State").alias("value")),
                )
            ).alias("f")
        )
        .select("f.*")
        .where(F.coalesce("value", F.lit("")) != "")
        .distinct()
        .orderBy("facet", "value")
    )
