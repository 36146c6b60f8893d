"""The four runs a user starts: search, locate, collocate, map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.dates import day_range, parse_bin
from broadsheet.operators import collocation, locations, mapping, search
from broadsheet.operators.collocation import Options
from broadsheet.operators.timebins import collocates_by_time
from broadsheet.plans.naming import collocation_paths, search_path
from broadsheet.runtime import stage, staging
from broadsheet.sinks.features import write_collection_header, write_features, write_raw_features
from broadsheet.sinks.results import (
    manifest,
    write_manifest,
    write_results,
    write_table,
    yearly_manifest,
)
from broadsheet.sources.corpus import read_corpus
from broadsheet.sources.features import points as as_points
from broadsheet.sources.payloads import run_metadata
from broadsheet.sources.skipping import read_matching_corpus


def search_run(
    spark: SparkSession,
    corpus: str,
    out: str,
    term: str,
    start: str,
    end: str,
    *,
    titles: DataFrame | None = None,
    cap: int | None = None,
    per_year: bool = False,
    index: str | None = None,
    mode: str = "errorifexists",
    **cleaning: bool,
) -> str | None:
    """Search a corpus folder and write the matches as JSON lines, with a manifest beside them.

    With ``index``, the folder of a text index (see ``sources/skipping.py``), only files that can hold the term are read.

    Without a match nothing is written and the result is None, unless ``per_year``: then the
    manifest lists every searched year, zero counts included. The corpus is scanned once: the
    matches are staged and both outputs read the staged rows.
    """
    lo, hi = day_range(start, end)
    years = int(lo[:4]), int(hi[:4])
    rows = read_matching_corpus(spark, corpus, index, term, *years) if index else read_corpus(spark, corpus, *years)
    found = search.search(rows, term, lo, hi, cap=cap, titles=titles, **cleaning)
    with staging(spark) as put:
        found = put(found, "matches")
        if not per_year and found.isEmpty():
            return None
        path = search_path(out, term, lo, hi)
        write_results(search.in_date_order(found), f"{path}/articles", mode)
        describe = yearly_manifest if per_year else manifest
        write_manifest(describe(found, term, lo, hi), f"{path}/runs", "overwrite")
    return path


def run_term(runs: DataFrame) -> str:
    """Search term of the run behind some results: its own field, else its file name.

    ``runs`` is what ``read_envelopes`` or ``collection_metadata`` returns; only the distinct term
    comes to the driver.
    """
    terms = run_metadata(runs).select("search_term").distinct().limit(2).collect()
    if len(terms) != 1:
        raise ValueError("the results do not belong to exactly one search term")
    return terms[0].search_term


def locate_run(
    articles: DataFrame,
    places: DataFrame,
    path: str,
    *,
    key: str = "auto",
    run: str | None = None,
    mode: str = "errorifexists",
) -> str:
    """Join articles to locations and write point features.

    With ``run``, the column that tells result files apart (see ``envelope_articles``), all files
    are located by one job, each by its own best key, into one folder each.
    """
    located = locations.locate_articles(articles, places, key=key, run=run)
    write_features(located, path, mode, run)
    return path


def collocation_run(
    articles: DataFrame,
    out: str,
    term: str,
    *,
    start: str | None = None,
    end: str | None = None,
    city: str | None = None,
    state: str | None = None,
    time_bin: str | None = None,
    options: Options = Options(),
    drop_terms: Sequence[str] = (),
    located: bool = False,
    crs: dict | None = None,
    mode: str = "overwrite",
) -> dict[str, str | None]:
    """Metrics, by-time table and, for located articles, the occurrence features.

    Rows of ``feature_rows`` carry the lines they were read from, which are then written untouched;
    ``crs`` is the coordinate system their collection stated.
    The articles with a hit are staged once; metrics, their total and the by-time counts read
    that table. Empty inputs leave header-only tables.
    """
    paths = collocation_paths(
        out, term, start=start, end=end, city=city, state=state, time_bin=time_bin,
        options=asdict(options), drop_terms=sorted(drop_terms), located=located,
    )
    if not located:
        city = state = None
    chosen = collocation.filter_articles(articles, start=start, end=end, city=city, state=state)
    # Bins span all chosen articles, also those without a hit; their bounds are observed while the
    # hits are written, without another pass over the text.
    dates = Observation("dates")
    bounds = (F.min("date").alias("start"), F.max("date").alias("end"))
    if time_bin and not (start and end):
        chosen = chosen.observe(dates, *bounds)
    with staging(articles.sparkSession) as put:
        hits = put(
            collocation.with_phrase(chosen, term, options).select(
                *[c for c in ("article_id", "filename", "page", "date", "article") if c in chosen.columns]
            ),
            "hits",
        )
        metrics = collocation.collocate_metrics(hits, term, options)
        metrics = collocation.drop_collocates(metrics, drop_terms)
        write_table(collocation.by_frequency(metrics), paths["metrics"], mode)
        if paths["by_time"]:
            size, unit = parse_bin(time_bin)
            seen = {} if start and end else dates.get
            by_time = collocates_by_time(
                hits, term, size, unit, options, start=start or seen["start"], end=end or seen["end"], put=put
            )
            by_time = collocation.drop_collocates(by_time, drop_terms)
            write_table(by_time.orderBy("time_bin", "ordinal_rank"), paths["by_time"], mode)
    if located:
        found = collocation.occurrences(
            articles, term, start=start, end=end, city=city, state=state
        )
        write = write_raw_features if "raw" in found.columns else write_features
        write(found, paths["occurrences"], mode)
        name = paths["occurrences"].rsplit("/", 1)[-1]
        write_collection_header(articles.sparkSession, f"{paths['occurrences']}_header", name, mode, crs)
    else:
        paths["occurrences"] = None
    return paths


def coordinates_run(
    places: DataFrame,
    fetched: DataFrame,
    out: str,
    *,
    newspapers: Sequence[str] | None = None,
    keep_existing: bool = False,
    mode: str = "errorifexists",
) -> dict[str, str]:
    """List the newspapers to locate, and write the locations with fetched coordinates applied.

    ``fetched`` has ``SN, Lat, Long`` and replaces the web look-up; rows for newspapers that were
    not to be looked up are ignored.
    """
    wanted = locations.newspapers_to_locate(places, newspapers)
    paths = {"wanted": f"{out}/newspapers_to_locate", "updated": f"{out}/locations_updated"}
    wanted.write.mode(mode).json(paths["wanted"])
    asked = fetched.join(wanted.select("SN"), "SN", "left_semi")
    updated = locations.apply_coordinates(places, asked, keep_existing=keep_existing)
    write_table(updated, paths["updated"], mode)
    return paths


def map_tables(
    located: DataFrame,
    term: str | None = None,
    *,
    mode: str = "points",
    metric: str = "article_count",
    normalize: bool = False,
    denominator: str | None = None,
    unit: str = "month",
    size: int = 1,
    linger_unit: str = "week",
    linger: int = 0,
    disable_time: bool = False,
    heat_value: float | None = None,
    min_radius: int | None = None,
    max_radius: int | None = None,
    zoom: int = 4,
    lightweight: bool = False,
    per_point: bool = False,
    table_mode: str = "full",
    row_limit: int | None = None,
    start: str | None = None,
    end: str | None = None,
) -> dict[str, DataFrame]:
    """All tables behind one map: groups, layer, entries, titles, summary, attributes.

    Only the stats per location and, for heat maps, the places and days are computed at once, and
    staged, because several tables start from them; everything else is lazy.

    ``mode`` is ``points``, ``cluster``, ``heatmap`` or ``graduated``; anything else means
    ``points``. The layer of a heat map is framed in time if any point has a date.
    """
    pts = as_points(located)
    groups = mapping.with_values(
        stage(mapping.group_stats(pts, term), "groups"),
        metric=metric, normalize=normalize, denominator=denominator,
    )
    mode = (mode or "points").strip().lower()
    if mode == "heatmap":
        # Read several times, so the articles are not parsed again for each.
        slim = stage(pts.select("lat", "lon", "day"), "points")
        timed = not disable_time and not slim.where(slim.day.isNotNull()).isEmpty()
        layer = (
            mapping.heat_frames(
                slim, groups, unit=unit, size=size, linger_unit=linger_unit, linger=linger,
                multiplier=heat_value, per_point=per_point,
            )
            if timed
            else mapping.heat_points(slim, groups, heat_value)
        )
    elif mode == "graduated":
        layer = mapping.graduated_radii(groups, min_radius, max_radius)
    elif mode == "cluster":
        layer = mapping.map_clusters(groups, zoom, normalize)
    else:
        layer = mapping.point_radii(groups)
    return {
        "groups": groups,
        "layer": layer,
        "entries": mapping.map_entries(pts, term, details=not lightweight),
        "titles": mapping.map_titles(pts, term),
        "summary": mapping.map_summary(pts, start, end),
        "attributes": mapping.attribute_table(
            pts, table_mode, limit=row_limit, lightweight=lightweight
        ),
    }
