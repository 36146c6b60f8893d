"""Map-ready tables: location groups, radii, heat weights and frames, clusters, entries.

Points are rows with ``lat``, ``lon``, ``day`` (see ``sources.features.points``) and the
properties of their articles.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions.dates import (
    format_date,
    frame_times,
    step_column,
    unit_name,
)
from broadsheet.functions.text import (
    blank_to_null,
    escape_markup,
    first_line,
    keyword_context,
    marked_excerpt,
    plain_excerpt,
    strip,
    term_count,
    word_count,
)
from broadsheet.operators.timebins import date_bounds, day_spans
from broadsheet.runtime import local_table, scalar
from broadsheet.schemas import ensure_columns

PRECISION = 6
# Each metric with its denominator and its two display names.
METRICS = {
    "article_count": ("article_count", "Articles", "Articles / Total Articles"),
    "page_count": ("page_count", "Pages", "Pages / Total Pages"),
    "key_term_frequency": ("word_count", "Term Frequency", "Term Frequency / Total Words"),
}
DENOMINATORS = ("word_count", "article_count", "page_count")
# Columns of the attribute table by mode.
TABLE_COLUMNS = {
    "article": ("date", "Title", "article", "url"),
    "minimal": ("date", "Title", "City", "State", "lccn", "page", "url"),
    "lightweight": ("date", "Title", "headline", "City", "State", "page", "url"),
}


def _place_key() -> list[Column]:
    # Adding zero turns -0.0 into 0.0, as both name the same place.
    return [
        (F.round("lat", PRECISION) + 0.0).alias("lat"),
        (F.round("lon", PRECISION) + 0.0).alias("lon"),
    ]


def group_id(lat: Column, lon: Column) -> Column:
    return F.format_string("group_%.6f_%.6f", lat, lon)


def metric_name(metric: str | None) -> str:
    name = (metric or "article_count").strip().lower()
    return name if name in METRICS else "article_count"


def metric_label(metric: str | None, normalize: bool = False) -> str:
    """Display name of a metric."""
    return METRICS[metric_name(metric)][2 if normalize else 1]


def group_stats(points: DataFrame, term: str | None = None) -> DataFrame:
    """Counts per location; text is counted where it lies and only numbers are shuffled."""
    points = ensure_columns(points, ("page", "article"))
    rows = points.select(
        *_place_key(),
        F.nullif(F.col("page").cast("string"), F.lit("")).alias("page"),
        term_count(F.col("article"), term).alias("hits"),
        word_count(F.col("article")).alias("words"),
    )
    stats = rows.groupBy("lat", "lon").agg(
        F.count("*").alias("article_count"),
        F.count_distinct("page").alias("pages"),
        F.sum("hits").cast("long").alias("key_term_frequency"),
        F.sum("words").cast("long").alias("word_count"),
    )
    return stats.select(
        group_id(F.col("lat"), F.col("lon")).alias("group_id"),
        "lat",
        "lon",
        "article_count",
        F.when(F.col("pages") > 0, F.col("pages"))
        .otherwise(F.col("article_count"))
        .alias("page_count"),
        "key_term_frequency",
        "word_count",
    )


def metric_value(metric: str, denominator: str | None) -> Column:
    value = F.col(metric).cast("double")
    if denominator:
        below = F.col(denominator).cast("double")
        value = F.when(below > 0, value / below).otherwise(0.0)
    return F.greatest(value, F.lit(0.0))


def with_values(
    stats: DataFrame,
    *,
    metric: str = "article_count",
    normalize: bool = False,
    denominator: str | None = None,
) -> DataFrame:
    """Add ``value``: the metric, divided by its denominator if normalized.

    Normalizing divides by the metric's own denominator unless one is named. If no group has a
    positive value, every value is 1.0; counts are positive by themselves, so only term hits and
    word counts are checked for that.
    """
    metric = metric_name(metric)
    if denominator is not None and denominator not in DENOMINATORS:
        raise ValueError(f"denominator must be one of {', '.join(DENOMINATORS)}")
    below = (denominator or METRICS[metric][0]) if normalize else None
    groups = stats.withColumn("value", metric_value(metric, below))
    if metric == "key_term_frequency" or below == "word_count":
        top = scalar(groups, F.max("value"))
        groups = groups.withColumn("value", F.when(top > 0, F.col("value")).otherwise(1.0))
    return groups


def map_groups(points: DataFrame, term: str | None = None, **choice) -> DataFrame:
    """Location groups with their stats and ``value`` (see ``with_values``).

    What follows from groups (fallback, radii, heat weights) reads them again. Stage the stats
    first, as ``plans.runs.map_tables`` does, and the text is counted once for all of it.
    """
    return with_values(group_stats(points, term), **choice)


def graduated_radii(
    groups: DataFrame, min_radius: int | None = None, max_radius: int | None = None
) -> DataFrame:
    """Radius per group, linear between the smallest and the largest value."""
    low = max(1, int(min_radius or 6))
    high = max(low + 1, int(max_radius or 28))
    span = scalar(groups, F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")))
    lo, hi = span["lo"], span["hi"]
    share = (F.col("value") - lo) / (hi - lo)
    radius = F.when(hi > lo, low + share * float(high - low)).otherwise(float(high))
    return groups.withColumn(
        "radius", F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), radius))
    )


def point_radii(groups: DataFrame) -> DataFrame:
    return groups.withColumn("radius", F.when(F.col("article_count") > 1, 5.0).otherwise(3.0))


def heat_multiplier(value: float | None) -> float:
    return float(value) if value is not None and float(value) > 0 else 1.0


def _weighted(points: DataFrame, groups: DataFrame, multiplier: float | None) -> DataFrame:
    """Narrow rows ``lat, lon, day, weight``; each point weighs what its group is worth.

    The text stays behind, so the join on the location moves a few numbers per point. Whether the
    groups are small enough to broadcast is Spark's decision, taken before any shuffle if they are
    staged; an over-full location is split by adaptive skew handling.
    """
    factor = heat_multiplier(multiplier)
    worth = groups.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "value")
    lat, lon = (c for c in _place_key())
    slim = points.select("lat", "lon", "day", lat.alias("_lat"), lon.alias("_lon"))
    return slim.join(worth, ["_lat", "_lon"], "left").select(
        "lat",
        "lon",
        "day",
        F.when(F.col("value") > 0, F.col("value") * factor).otherwise(factor).alias("weight"),
    )


def heat_points(
    points: DataFrame, groups: DataFrame, multiplier: float | None = None
) -> DataFrame:
    """Static heat layer: every point with its weight, undated ones included."""
    return _weighted(points, groups, multiplier).select("lat", "lon", "weight")


def frame_spans(
    points: DataFrame,
    *,
    unit: str = "month",
    size: int = 1,
    linger_unit: str = "week",
    linger: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Frames, and for each day that occurs the frames in which its points are shown.

    A day enters at the first frame on or after it, else at the last frame. Without linger it is
    shown there only. With linger it stays while frames lie before day + linger, which may be in
    no frame at all. Both ends are counts of frames before a day, so two look-ups in a calendar
    replace a range join.
    """
    spark = points.sparkSession
    linger = int(linger or 0)
    first, last = date_bounds(points, "day")
    times = frame_times(first, last, unit, size) if first else []
    frames = local_table(spark, enumerate(times), frame_no=pa.int32(), frame_time=pa.date32())
    # Days after the previous frame and up to this one have as many frames before them as its number.
    before = [(times[0], times[0], 0)] if times else []
    for number, (lo, hi) in enumerate(zip(times, times[1:]), 1):
        before.append((lo + dt.timedelta(days=1), hi, number))
    earlier = day_spans(spark, before, frames_before=pa.int32())
    days = points.select("day").where(F.col("day").isNotNull()).distinct()

    def count_before(df: DataFrame, column: str, out: str) -> DataFrame:
        table = earlier.select(F.col("day").alias("_d"), F.col("frames_before").alias("_n"))
        return (
            df.join(table, F.col(column) == F.col("_d"), "left")
            .withColumn(out, F.coalesce("_n", F.lit(len(times))))
            .drop("_d", "_n")
        )

    spans = count_before(days, "day", "_entry").withColumn(
        "first_frame", F.least("_entry", F.lit(len(times) - 1))
    )
    if linger > 0:
        until = step_column(F.col("day"), unit_name(linger_unit, strict=False), linger)
        spans = count_before(spans.withColumn("_until", until), "_until", "_end")
        spans = spans.withColumn("last_frame", F.col("_end") - 1)
    else:
        spans = spans.withColumn("last_frame", F.col("first_frame"))
    shown = spans.where(F.col("last_frame") >= F.col("first_frame"))
    shown = shown.select("day", "first_frame", "last_frame")
    return frames, shown


def heat_frames(
    points: DataFrame,
    groups: DataFrame,
    *,
    unit: str = "month",
    size: int = 1,
    linger_unit: str = "week",
    linger: int = 0,
    multiplier: float | None = None,
    per_point: bool = False,
) -> DataFrame:
    """Heat layer over time: ``frame_no, frame_time, lat, lon, weight``.

    Equal places are added up per frame, with ``points``, so the layer has one row per place and
    frame. ``per_point`` repeats every point for each frame it is shown in. Undated points are in no frame.

    Places are not repeated per day and frame to be added up: a day's points come at one frame and go at
    another, and what is shown between is the running sum of both, as whole numbers of points. All
    points of one place weigh the same, as they are in one group.
    """
    frames, spans = frame_spans(
        points, unit=unit, size=size, linger_unit=linger_unit, linger=linger
    )
    weighted = _weighted(points.where(F.col("day").isNotNull()), groups, multiplier)
    if per_point:
        shown = weighted.join(spans, "day").withColumn(
            "frame_no", F.explode(F.sequence("first_frame", "last_frame"))
        )
        return shown.join(frames, "frame_no").select("frame_no", "frame_time", "lat", "lon", "weight")
    days = weighted.groupBy("lat", "lon", "day").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    events = days.join(spans, "day").select(
        "lat",
        "lon",
        "weight",
        F.inline(
            F.array(
                F.struct(F.col("first_frame").alias("frame"), F.col("n").alias("change")),
                F.struct((F.col("last_frame") + 1).alias("frame"), (-F.col("n")).alias("change")),
            )
        ),
    )
    changes = events.groupBy("lat", "lon", "frame").agg(F.max("weight").alias("weight"), F.sum("change").alias("change"))
    # A place has no more events than there are frames, and one more.
    in_order = Window.partitionBy("lat", "lon").orderBy("frame")
    steps = changes.select(
        "lat",
        "lon",
        "weight",
        F.sum("change").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("points"),
        F.col("frame").alias("_from"),
        (F.lead("frame").over(in_order) - 1).alias("_to"),
    )
    shown = steps.where((F.col("points") > 0) & (F.col("_to") >= F.col("_from")))
    shown = shown.withColumn("frame_no", F.explode(F.sequence("_from", "_to"))).join(frames, "frame_no")
    weight = (F.col("weight") * F.col("points")).alias("weight")
    return shown.select("frame_no", "frame_time", "lat", "lon", weight, "points")


def map_clusters(groups: DataFrame, zoom: int = 4, normalized: bool = False) -> DataFrame:
    """Totals per grid cell: summed metric, locations, articles, size class and label.

    A cell is 80 pixels of a world that is 256 * 2^zoom pixels wide.
    """
    return _labelled(_cells(groups, zoom), normalized)


def map_cluster_levels(
    groups: DataFrame, zooms: Sequence[int] = range(13), normalized: bool = False
) -> DataFrame:
    """``zoom`` and the rows of ``map_clusters`` at each of the whole zooms, from one pass over the groups.

    Locations are added up in the cells of the finest zoom. A cell of a coarser zoom is made of whole finer
    ones, and its number is theirs without the last bits, so coarser levels are merged from those cells, all
    in one aggregate that Spark merges before it shuffles. Repeated zooms count once, no zoom gives no rows.
    """
    levels = sorted({int(zoom) for zoom in zooms})
    if levels != sorted(set(zooms)):
        raise ValueError("zooms must be whole numbers")
    finest = levels[-1] if levels else 0
    every = F.array(*[F.lit(level) for level in levels]).cast("array<int>")
    cells = _cells(groups, finest).withColumn("zoom", F.explode(every))
    coarser = [
        F.expr(f"shiftright({name}, {finest} - zoom)").alias(name) for name in ("cell_x", "cell_y")
    ]
    merged = cells.groupBy("zoom", *coarser).agg(
        *[F.sum(name).alias(name) for name in ("metric_sum", "locations", "articles")]
    )
    return _labelled(merged, normalized)


def _cells(groups: DataFrame, zoom: float) -> DataFrame:
    # Cell widths of whole zooms differ by powers of two only, so that cells nest without rounding.
    cell = 360.0 * 80.0 / 256.0 / 2.0**zoom
    return groups.groupBy(
        F.floor((F.col("lon") + 180.0) / cell).alias("cell_x"),
        F.floor((F.col("lat") + 90.0) / cell).alias("cell_y"),
    ).agg(
        F.sum("value").alias("metric_sum"),
        F.count("*").alias("locations"),
        F.sum("article_count").alias("articles"),
    )


def _labelled(cells: DataFrame, normalized: bool) -> DataFrame:
    size = F.abs(F.col("metric_sum"))
    label = (
        F.format_string("%.4f", F.col("metric_sum"))
        if normalized
        else F.format_number(F.floor(F.col("metric_sum") + 0.5), 0)
    )
    size_class = F.when(size >= 100, "large").when(size >= 10, "medium").otherwise("small")
    return cells.withColumn("size_class", size_class).withColumn("label", label)


def _newspaper() -> Column:
    return F.coalesce(strip(F.coalesce(_nonempty("Title"), _nonempty("newspaper_name"))), F.lit(""))


def _nonempty(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def _trimmed(column: str) -> Column:
    return F.coalesce(strip(F.col(column)), F.lit(""))


def _joined(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts])


def feature_label(date: Column, newspaper: Column, place: Column, headline: Column) -> Column:
    """``date — newspaper — city, state``, else the headline, else ``Feature``."""
    label = _joined(" — ", date, newspaper, place)
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(headline, F.lit("")), F.lit("Feature"))


def map_entries(
    points: DataFrame,
    term: str | None = None,
    *,
    details: bool = False,
    line_length: int | None = 160,
    details_length: int | None = 1200,
) -> DataFrame:
    """Popup rows, one per point, keyed by group: excerpt, keyword context, link and labels.

    First lines and details are excerpts of so many characters; None shows them whole.
    All expressions read their own row, so no group is ever collected.
    """
    points = ensure_columns(
        points,
        ("article_id", "article", "url", "page", "City", "State", "Title", "newspaper_name", "headline"),
    )
    lat, lon = _place_key()
    date, newspaper = format_date(F.col("date")), _newspaper()
    place = _joined(", ", _trimmed("City"), _trimmed("State"))
    headline = _trimmed("headline")
    columns = [
        group_id(lat, lon).alias("group_id"),
        F.col("article_id"),
        feature_label(date, newspaper, place, headline).alias("label"),
        escape_markup(first_line(F.col("article"), line_length)).alias("first_line"),
        keyword_context(F.col("article"), term or "").alias("context"),
        escape_markup(F.replace(_trimmed("url"), F.lit(".jp2"), F.lit(".pdf"))).alias("pdf_url"),
        escape_markup(date).alias("date"),
        escape_markup(newspaper).alias("newspaper"),
        escape_markup(place).alias("place"),
        escape_markup(_trimmed("page")).alias("page"),
    ]
    if details:
        columns.append(marked_excerpt(F.col("article"), term or "", details_length).alias("details"))
    return points.select(*columns)


def map_titles(
    points: DataFrame, term: str | None = None, order: str = "article_id"
) -> DataFrame:
    """Title per group, by the city of its first entry in ``order``."""
    city = F.coalesce(blank_to_null(F.col("city")), F.lit("this location"))
    word = strip(F.lit(term or ""))
    head = F.when(word != "", F.concat(F.lit('Articles mentioning "'), word, F.lit('" in '))).otherwise(
        "Articles in "
    )
    return (
        points.groupBy(*_place_key())
        .agg(
            # An empty struct field stands for null, which min_by would skip as a value.
            F.min(F.struct(F.col(order).alias("o"), F.col("City").alias("city")))["city"].alias("city"),
            F.count("*").alias("article_count"),
        )
        .select(
            group_id(F.col("lat"), F.col("lon")).alias("group_id"),
            F.concat(head, city).alias("title"),
            "article_count",
        )
    )


def format_coordinate(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number.isNull(), "").otherwise(F.format_string("%.6f", number))


def format_metric(value: Column, metric: str, normalized: bool = False) -> Column:
    """Whole counts with thousands separators, other values with four decimals, null as n/a."""
    if metric in ("article_count", "page_count") and not normalized:
        text = F.format_number(F.bround(value, 0), 0)
    else:
        text = F.format_string("%.4f", value)
    return F.when(value.isNull(), "n/a").otherwise(text)


def map_summary(
    points: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Articles, newspapers, cities and the date range; a given range takes precedence."""
    points = ensure_columns(points, ("SN", "lccn", "Title", "newspaper_name", "City"))
    newspaper = F.coalesce(*[_nonempty(c) for c in ("SN", "lccn", "Title", "newspaper_name")])
    counted = points.agg(
        F.count("*").alias("articles"),
        F.count_distinct(newspaper).alias("newspapers"),
        F.count_distinct(_nonempty("City")).alias("cities"),
        F.date_format(F.min("day"), "yyyy-MM-dd").alias("_lo"),
        F.date_format(F.max("day"), "yyyy-MM-dd").alias("_hi"),
    )
    lo = F.coalesce(F.nullif(F.lit(start or ""), F.lit("")), F.col("_lo"))
    hi = F.coalesce(F.nullif(F.lit(end or ""), F.lit("")), F.col("_hi"))
    return counted.select(
        "articles",
        "newspapers",
        "cities",
        F.coalesce(lo, hi).alias("start_date"),
        F.coalesce(hi, lo).alias("end_date"),
    )


def property_rows(points: DataFrame, *keys: str) -> DataFrame:
    """Every property of every point in long form: ``keys``, coordinates as text, property, value.

    Names are data here, so any number of them, in any capitalisation, costs no column and never
    reaches the driver.
    """
    return points.select(
        *keys,
        format_coordinate(F.col("lat")).alias("Latitude"),
        format_coordinate(F.col("lon")).alias("Longitude"),
        F.explode("properties").alias("property", "value"),
    )


def _safe_names(names: Sequence[str]) -> list[str]:
    """Column names that differ by more than capitalisation, as tables in files need them."""
    taken, out = {"latitude", "longitude"}, []
    for name in names:
        free = name
        while free.lower() in taken:
            free += "_"
        taken.add(free.lower())
        out.append(free)
    return out


def attribute_table(
    points: DataFrame,
    mode: str = "full",
    *,
    limit: int | None = None,
    lightweight: bool = False,
    properties: Sequence[str] | None = None,
    order: Sequence[str] = ("day", "article_id"),
    article_length: int | None = 420,
) -> DataFrame:
    """Table of the points: coordinates as text, then the columns of the mode.

    ``full`` shows the listed ``properties``, by their exact names, else all columns of the points;
    ``property_rows`` gives a ``properties`` map whose names are not known. ``lightweight`` chooses fewer
    columns, never fewer rows. Of names that differ by capitalisation only, later ones get a trailing
    underscore. Article text is cut to ``article_length`` characters, None keeps it whole. The optional
    row limit takes the first rows in ``order``.
    """
    mode = (mode or "full").strip().lower()
    if mode in ("article", "minimal"):
        columns = TABLE_COLUMNS[mode]
    elif lightweight:
        columns = TABLE_COLUMNS["lightweight"]
    elif properties:
        columns = tuple(properties)
    else:
        columns = tuple(c for c in points.columns if c not in ("lat", "lon", "day", "properties"))

    def cell(name: str, shown: str) -> Column:
        if name in points.columns:
            value = F.col(name).cast("string")
        elif "properties" in points.columns:
            value = F.col("properties")[name]
        else:
            value = F.lit(None).cast("string")
        if name == "headline" and "properties" in points.columns:
            value = F.coalesce(value, F.col("properties")["Headline"])  # written either way
        text = plain_excerpt(value, article_length) if name == "article" else F.coalesce(value, F.lit(""))
        return text.alias(shown)

    rows = points.orderBy(*order).limit(limit) if limit and limit > 0 else points
    return rows.select(
        format_coordinate(F.col("lat")).alias("Latitude"),
        format_coordinate(F.col("lon")).alias("Longitude"),
        *[cell(c, shown) for c, shown in zip(columns, _safe_names(columns))],
    )
