"""Every operator as a query over whole test tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from broadsheet.checks import views
from broadsheet.functions.dates import parse_date
from broadsheet.functions.tokens import is_number, phrase_starts, tokens
from broadsheet.operators import collocation, locations, mapping, ranks, search
from broadsheet.operators.collocation import ALL_METRICS, Options
from broadsheet.operators.timebins import collocates_by_time
from broadsheet.plans.runs import collocation_run, coordinates_run
from broadsheet.runtime import let, scratch_path, stage
from broadsheet.schemas import BY_TIME, RUNS
from broadsheet.sinks.features import write_features, write_raw_features
from broadsheet.sinks.results import (
    run_id,
    write_manifest,
    write_results,
    write_table,
    yearly_manifest,
)
from broadsheet.sources.corpus import available_years, read_corpus, year_ranges
from broadsheet.sources.features import (
    feature_rows,
    points,
    read_feature_collection,
    read_features,
    stated_crs,
)
from broadsheet.sources.payloads import read_results, run_metadata
from broadsheet.sources.tables import last_titles, read_locations, read_table, read_titles
from broadsheet.sources.skipping import read_matching_corpus, update_text_index
from broadsheet.streaming.search import read_capped, read_progress, stream_search, stream_search_capped

START, END = "1900-06-01", "1902-05-31"
WORD, PHRASE = "tion", "of the"
DROPPED = ("the", "in", " and ", "zzz")
SELECTED = ("the", "ouand", "zzz-absent")
MATRIX_TERMS = ("the", "of", "and", "to", "in")
CAP = 25

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name; a trailing underscore avoids a name in use."""
    _registry[fn.__name__.rstrip("_")] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_registry)


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    return collocation.filter_articles(views.articles(spark, sf))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return points(views.located(spark, sf))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    rows = locations.locate_articles(
        views.articles(spark, sf), views.locations(spark, sf), key="lccn"
    )
    return rows.drop("SN", "full_article_id")


# --- search -------------------------------------------------------------------------------


@query
def search_keyword(spark, sf):
    return search.search(views.articles(spark, sf), WORD, START, END)


@query
def search_symbol(spark, sf):
    return search.search(views.articles(spark, sf), "%", START, END).select("article_id", "date")


@query
def search_clean(spark, sf):
    broken = views.articles(spark, sf).withColumns(
        {
            "article": F.replace("article", F.lit(", "), F.lit("- \n")),
            "url": F.concat(F.upper("url"), F.lit("?size=.jp2x")),
        }
    )
    found = search.search(
        broken, WORD, START, END, join_hyphens=True, lowercase=True, pdf_urls=True
    )
    return found.select("article_id", "date", "article", "url")


@query
def search_titles(spark, sf):
    found = search.search(
        views.articles(spark, sf), WORD, START, END, titles=views.titles(spark, sf)
    )
    return found.select("article_id", "lccn", "newspaper_name")


@query
def search_cap_per_year(spark, sf):
    found = search.search(views.articles(spark, sf), WORD, START, END, cap=CAP)
    return found.select("article_id", "date", "year")


@query
def search_counts_by_year(spark, sf):
    found = search.search(views.articles(spark, sf), WORD, "1899-01-01", "1903-12-31")
    return search.counts_by_year(found, "1899-01-01", "1903-12-31")


@query
def corpus_years_read(spark, sf):
    """Yearly folders, then a read of two years: files of the third are never opened."""
    path = scratch_path(spark, "corpus")
    rows = views.articles(spark, sf).drop("newspaper_name")
    rows.withColumn("year", F.substring("date", 1, 4).cast("int")).write.partitionBy("year").parquet(path)
    corpus = read_corpus(spark, path, 1902, 1901)
    per_year = corpus.groupBy("year").agg(
        F.count("*").alias("articles"), F.count_distinct("lccn").alias("newspapers")
    )
    return available_years(corpus).join(per_year, "year")


@query
def corpus_year_ranges(spark, sf):
    docs = views.table(spark, sf, "documents")
    return year_ranges(docs.select((1700 + F.col("n_chars") % 300).cast("int").alias("year")))


@query
def run_metadata_(spark, sf):
    """One search run per newspaper, year and page; some carry their facts, some only a name."""
    runs = (
        views.articles(spark, sf)
        .groupBy("lccn", "page", F.substring("date", 1, 4).alias("y"))
        .agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    )
    term = F.concat_ws("_", "lccn", "page")
    named = runs.select(
        F.concat(
            F.when(F.col("page") < "p4", F.lit("merged_")).otherwise(F.lit("")),
            F.concat_ws("_", term, "lo", "hi"),
            F.lit(".json"),
        ).alias("file_name"),
        F.when(F.col("page") > "p5", F.concat(F.lit("of "), "page"))
        .when(F.col("page") > "p4", F.lit(" "))
        .alias("search_term"),
        F.when(F.col("page") > "p6", F.col("lo")).alias("start_date"),
        F.lit(None).cast("string").alias("end_date"),
    )
    found = run_metadata(named)
    facts = {c: F.col(c) for c in ("search_term", "start_date", "end_date")}
    return found.withColumn("run_id", run_id(**facts))


@query
def payload_roundtrip(spark, sf):
    path = scratch_path(spark, "results")
    found = search.search(
        views.articles(spark, sf), WORD, START, END, titles=views.titles(spark, sf)
    )
    write_results(search.in_date_order(found), path)
    return read_results(spark, path).select(
        "article_id", "lccn", "date", "page", "article", "url", "filename", "newspaper_name"
    )


@query
def payload_manifest(spark, sf):
    path = scratch_path(spark, "runs")
    found = search.search(views.articles(spark, sf), WORD, "1899-01-01", "1903-12-31")
    write_manifest(yearly_manifest(found, WORD, "1899-01-01", "1903-12-31"), path)
    return spark.read.schema(RUNS).json(path).drop("run_id")


# --- collocation --------------------------------------------------------------------------


@query
def token_counts(spark, sf):
    words = views.articles(spark, sf).select(F.explode(tokens(F.col("article"))).alias("token"))
    return words.where(~is_number(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@query
def phrase_hits(spark, sf):
    phrase = PHRASE.split()
    found = collocation.with_phrase(views.articles(spark, sf), PHRASE)
    starts = let(tokens(F.col("article")), lambda t: phrase_starts(t, phrase))
    hits = found.select("article_id", F.explode(starts).alias("position"))
    return hits.withColumn("position", F.col("position").cast("long"))


def _rounded(metrics: DataFrame) -> DataFrame:
    wide = ("cooccurrence_rate", "mean_relative_position")
    return metrics.withColumns({c: F.round(c, 9) for c in wide if c in metrics.columns})


@query
def colloc_metrics(spark, sf):
    return _rounded(collocation.collocate_metrics(_dated(spark, sf), PHRASE, ALL_METRICS))


@query
def colloc_metrics_word(spark, sf):
    return _rounded(collocation.collocate_metrics(_dated(spark, sf), WORD, ALL_METRICS))


@query
def colloc_metrics_stopwords(spark, sf):
    options = Options(cooccurrence_rate=True, relative_position=True, drop_stopwords=True)
    return _rounded(collocation.collocate_metrics(_dated(spark, sf), "the tion", options))


@query
def colloc_metrics_dropped(spark, sf):
    path = scratch_path(spark, "metrics")
    metrics = collocation.collocate_metrics(_dated(spark, sf), PHRASE)
    write_table(collocation.by_frequency(collocation.drop_collocates(metrics, DROPPED)), path)
    back = read_table(spark, spark.read.schema("collocate_term string, frequency bigint")
                      .option("header", True).csv(path))
    return back


@query
def colloc_filtered_place(spark, sf):
    chosen = collocation.filter_articles(
        _placed(spark, sf), start=START, end=END, city="nation_8", state="Europe"
    )
    return collocation.collocate_metrics(chosen, "the", Options(page_count=True))


@query
def colloc_by_month(spark, sf):
    return collocates_by_time(
        _dated(spark, sf), WORD, 1, "months", start="1900-01-31", end="1902-12-31"
    )


@query
def colloc_by_2weeks(spark, sf):
    chosen = collocation.filter_articles(views.articles(spark, sf), start=START, end=END)
    return collocates_by_time(chosen, PHRASE, 2, "weeks", start=START, end=END)


@query
def colloc_by_year(spark, sf):
    return collocates_by_time(
        _dated(spark, sf), WORD, 1, "years", Options(drop_stopwords=True)
    )


@query
def occurrences(spark, sf):
    found = collocation.occurrences(
        views.located(spark, sf), PHRASE, start=START, end=END
    )
    return found.select("article_id", "lccn", "date", "Title", "City", "State", "Long", "Lat")


@query
def occurrence_features(spark, sf):
    """Raw features filtered by their properties, written untouched and read again."""
    path, kept = scratch_path(spark, "features"), scratch_path(spark, "occurrences")
    write_features(_placed(spark, sf), path)
    found = collocation.occurrences(
        read_features(spark, path), PHRASE, end=END, city="Nation_8", properties="properties"
    )
    write_raw_features(found, kept)
    rows = feature_rows(read_features(spark, kept))
    return rows.select("article_id", "date", "page", "Title", "State", "article", "url", "Long", "Lat")


@query
def occurrence_features_untouched(spark, sf):
    """Numbers, lists, ids and lines in features come out of the filter as the lines they were."""
    path, kept = scratch_path(spark, "lines"), scratch_path(spark, "kept")
    number = F.col("doc_id").cast("string")
    line = F.concat(
        F.lit('{"type":"Feature","id":'), number, F.lit(',"geometry":{"type":"LineString","coordinates":[[1,2],[3,4.50]]},'),
        F.lit('"properties":{"City":"Rome","list":[1,{"a":2}],"n":'), number, F.lit('.0,"article":"'),
        F.when(F.col("doc_id") % 3 == 0, "some of the few").otherwise("some of a few"), F.lit('"}}'),
    )
    views.table(spark, sf, "documents").select(line.alias("value")).write.text(path)
    found = collocation.occurrences(read_features(spark, path), PHRASE, city="rome", properties="properties")
    write_raw_features(found, kept)
    return spark.read.text(kept).withColumnRenamed("value", "line")


@query
def collocation_tables(spark, sf):
    """A whole run on located articles; its by-time table read back."""
    paths = collocation_run(
        _placed(spark, sf), scratch_path(spark, "run"), PHRASE, start=START, end=END,
        time_bin="3 months", options=Options(page_count=True), drop_terms=DROPPED,
        city="NATION_8", located=True,
    )
    return spark.read.schema(BY_TIME).option("header", True).csv(paths["by_time"])


# --- ranks --------------------------------------------------------------------------------


def _by_month(spark: SparkSession, sf: str) -> DataFrame:
    """The by-time table written once and read back, as chart users do."""
    found = collocates_by_time(_dated(spark, sf), WORD, 1, "months", start="1900-01-01", end="1902-12-31")
    return stage(found, "by_time")


@query
def top_collocates(spark, sf):
    return ranks.top_collocates(collocation.collocate_metrics(_dated(spark, sf), WORD), 20)


@query
def rank_home_bin(spark, sf):
    by_time = _by_month(spark, sf)
    return ranks.rank_series(by_time, ranks.home_bin_terms(by_time, 10, 2))


@query
def rank_global(spark, sf):
    by_time = _by_month(spark, sf)
    terms = ranks.global_terms(by_time, 10)
    means = terms.select("collocate_term", F.round("mean_rank", 9).alias("mean_rank"))
    return ranks.rank_series(by_time, terms).join(means, "collocate_term")


@query
def rank_matrix(spark, sf):
    return ranks.rank_matrix(_by_month(spark, sf), MATRIX_TERMS)


@query
def drop_candidates(spark, sf):
    metrics = stage(collocation.collocate_metrics(_dated(spark, sf), WORD), "metrics")
    return ranks.drop_candidates(metrics, SELECTED)


@query
def drop_candidates_searched(spark, sf):
    metrics = stage(collocation.collocate_metrics(_dated(spark, sf), WORD), "metrics")
    return ranks.search_terms(ranks.drop_candidates(metrics, SELECTED), "TH", 5)


@query
def metrics_ranked(spark, sf):
    metrics = collocation.collocate_metrics(_dated(spark, sf), WORD)
    return ranks.ranked_metrics(metrics)


# --- locations ----------------------------------------------------------------------------


@query
def locate_articles(spark, sf):
    return _placed(spark, sf)


@query
def locate_by_title(spark, sf):
    rows = views.articles(spark, sf).withColumn("lccn", F.lit(None).cast("string"))
    found = locations.locate_articles(rows, views.locations(spark, sf))
    return found.select("article_id", "Title", "City", "State", "Long", "Lat")


@query
def locate_runs(spark, sf):
    """Many result files in one job: files by page, some with ids, some with names only, some bare."""
    rows = views.articles(spark, sf).withColumns(
        {
            "lccn": F.when(F.col("page") <= "p3", F.col("lccn")),
            "newspaper_name": F.when(F.col("page") <= "p6", F.col("newspaper_name")),
        }
    )
    found = locations.locate_articles(rows, views.locations(spark, sf), run="page")
    return found.select("article_id", "page", "Title", "City", "Long")


@query
def missing_coordinates(spark, sf):
    return locations.newspapers_to_locate(views.locations(spark, sf))


@query
def apply_coordinates(spark, sf):
    return locations.apply_coordinates(views.locations(spark, sf), views.fetched(spark, sf))


@query
def locations_csv(spark, sf):
    path = scratch_path(spark, "locations")
    write_table(views.locations(spark, sf), path)
    return read_locations(spark, path)


@query
def titles_csv(spark, sf):
    """A lookup under other headings, in a folder of files, read as the last title per key."""
    path = scratch_path(spark, "titles")
    named = views.titles(spark, sf).select(
        F.col("SN").alias(" LCCN"), F.col("Title").alias("Newspaper"), "ordinal"
    )
    write_table(named, path)
    return last_titles(read_titles(spark, path))


@query
def titles_csv_files(spark, sf):
    """A lookup in many files without an ordinal: the last row of the last file wins."""
    path = scratch_path(spark, "title_files")
    named = views.titles(spark, sf).repartitionByRange(8, "ordinal", "SN").sortWithinPartitions("ordinal", "SN")
    named = named.select(F.col("SN").alias("lccn"), F.col("Title").alias("Name"))
    named.write.option("header", True).option("escape", '"').csv(path)
    return last_titles(read_titles(spark, path))


@query
def locations_last_rows(spark, sf):
    """Newspapers to look up, from location files that name some of them again further on."""
    path = scratch_path(spark, "location_files")
    rows = views.locations(spark, sf).drop("ordinal").withColumn("part", F.lit(0))
    again = rows.withColumns({"Title": F.concat("Title", F.lit(" again")), "part": F.lit(1)}).where("SN LIKE '%1'")
    both = rows.unionByName(again).repartitionByRange(6, "part", "SN").sortWithinPartitions("part", "SN").drop("part")
    both.write.option("header", True).option("escape", '"').csv(path)
    return locations.newspapers_to_locate(read_locations(spark, path, ordinal=True))


@query
def coordinates_updated(spark, sf):
    out = scratch_path(spark, "coordinates")
    paths = coordinates_run(
        views.locations(spark, sf), views.fetched(spark, sf), out, keep_existing=True
    )
    wanted = spark.read.schema("SN string, Title string").json(paths["wanted"])
    return read_locations(spark, paths["updated"]).join(wanted.select("SN"), "SN")


@query
def features_roundtrip(spark, sf):
    path = scratch_path(spark, "features")
    write_features(_placed(spark, sf), path)
    return points(feature_rows(read_features(spark, path)).drop("properties", "raw")).withColumn(
        "day", F.date_format("day", "yyyy-MM-dd")
    )


@query
def place_facets(spark, sf):
    return locations.place_facets(_placed(spark, sf))


@query
def join_stats(spark, sf):
    return locations.join_stats(_placed(spark, sf))


# --- maps ---------------------------------------------------------------------------------


@query
def map_groups(spark, sf):
    return mapping.map_groups(_points(spark, sf), WORD)


def _stats(spark: SparkSession, sf: str, term: str) -> DataFrame:
    return stage(mapping.group_stats(_points(spark, sf), term), "groups")


@query
def map_groups_norm(spark, sf):
    groups = mapping.with_values(
        _stats(spark, sf, WORD), metric="key_term_frequency", normalize=True
    )
    return groups.select(
        "group_id",
        F.round("value", 9).alias("value"),
        mapping.format_metric(F.col("word_count"), "article_count").alias("words"),
    )


@query
def map_groups_no_hit(spark, sf):
    groups = mapping.with_values(_stats(spark, sf, "zqxj"), metric="key_term_frequency")
    return mapping.graduated_radii(groups).select("group_id", "key_term_frequency", "value", "radius")


@query
def map_summary(spark, sf):
    return mapping.map_summary(_points(spark, sf), end="1903-01-01")


@query
def map_radii(spark, sf):
    groups = mapping.with_values(_stats(spark, sf, WORD), metric="key_term_frequency")
    radii = mapping.graduated_radii(groups, 4, 30).select(
        "group_id", "article_count", "value", F.round("radius", 9).alias("graduated")
    )
    return mapping.point_radii(radii).withColumnRenamed("radius", "plain")


def _slim(spark: SparkSession, sf: str) -> DataFrame:
    """Places and days only, written once: heat layers read them several times."""
    return stage(_points(spark, sf).select("lat", "lon", "day"), "points")


def _counted(pts: DataFrame) -> DataFrame:
    """Groups valued by their articles, staged; no text is read for them."""
    stats = mapping.group_stats(pts).select("group_id", "lat", "lon", "article_count")
    return mapping.with_values(stage(stats, "groups"))


@query
def heat_static(spark, sf):
    pts = _slim(spark, sf)
    return mapping.heat_points(pts, _counted(pts), 2.5)


@query
def heat_frames(spark, sf):
    pts = _slim(spark, sf)
    return mapping.heat_frames(pts, _counted(pts), linger_unit="week", linger=6, per_point=True)


@query
def heat_frames_places(spark, sf):
    pts = _slim(spark, sf)
    return mapping.heat_frames(
        pts, _counted(pts), unit="week", size=2, multiplier=0.5
    )


@query
def map_clusters(spark, sf):
    return mapping.map_clusters(mapping.map_groups(_points(spark, sf)), zoom=5)


@query
def map_clusters_levels(spark, sf):
    return mapping.map_cluster_levels(mapping.map_groups(_points(spark, sf)), range(9))


@query
def map_entries(spark, sf):
    return mapping.map_entries(_points(spark, sf), WORD)


@query
def map_entry_details(spark, sf):
    return mapping.map_entries(_points(spark, sf), "amp", details=True).select(
        "article_id", "context", "details"
    )


@query
def map_titles(spark, sf):
    return mapping.map_titles(_points(spark, sf), WORD)


@query
def attribute_table(spark, sf):
    return mapping.attribute_table(_points(spark, sf), "article")


@query
def attribute_table_minimal(spark, sf):
    rows = _points(spark, sf).withColumn("day", parse_date(F.col("date")))
    return mapping.attribute_table(rows, "minimal", limit=300, lightweight=True)


@query
def attribute_table_open(spark, sf):
    """Properties whose names are not known beforehand, some of which differ by capitalisation only."""
    named = {c: F.col(c) for c in ("article_id", "Title", "page", "State")} | {"Page": F.col("date")}
    pairs = [x for k, c in named.items() for x in (F.lit(k), c)]
    every = F.create_map(*pairs)
    open_rows = _points(spark, sf).select(
        "article_id", "lat", "lon", F.map_filter(every, lambda k, v: v.isNotNull()).alias("properties")
    )
    return mapping.property_rows(open_rows, "article_id")


@query
def attribute_table_mixed_case(spark, sf):
    """Listed properties by their exact names; the second of a pair gets another column name."""
    every = F.create_map(F.lit("page"), F.col("page"), F.lit("Page"), F.col("date"), F.lit("Headline"), F.col("Title"))
    rows = _points(spark, sf).select("article_id", "lat", "lon", every.alias("properties"))
    return mapping.attribute_table(rows, properties=("article_id", "page", "Page", "headline"))


@query
def attribute_table_lightweight(spark, sf):
    """Fewer columns, all rows."""
    return mapping.attribute_table(_points(spark, sf), lightweight=True)


@query
def colloc_metrics_stopword_phrase(spark, sf):
    """Stopwords may stand between the two tokens that are left of the phrase."""
    options = Options(page_count=True, drop_stopwords=True)
    return collocation.collocate_metrics(_dated(spark, sf), "attion the thanedble", options)


@query
def colloc_dropped_terms(spark, sf):
    """Dropped terms from a table; a null term stays."""
    metrics = collocation.collocate_metrics(_dated(spark, sf), WORD)
    metrics = metrics.union(spark.range(1).select(F.lit(None).cast("string"), F.lit(0).cast("long")))
    return collocation.drop_collocates(metrics, metrics.where("frequency % 2 = 1").select("collocate_term"))


@query
def colloc_one_year(spark, sf):
    """Results written by year, collocated over a range of one year: other folders are not read."""
    path = scratch_path(spark, "by-year")
    write_results(search.search(views.articles(spark, sf), WORD, START, END), path)
    articles = collocation.filter_articles(read_results(spark, path), start="1901-02-01", end="1901-11-30")
    return collocation.collocate_metrics(articles, WORD)


@query
def metrics_preview(spark, sf):
    return ranks.preview(collocation.collocate_metrics(_dated(spark, sf), WORD), 30, ["collocate_term"])


@query
def metrics_read_back(spark, sf):
    """A table as the engine writes it, read again from its folder."""
    path = scratch_path(spark, "metrics")
    write_table(collocation.collocate_metrics(_dated(spark, sf), WORD), path)
    return read_table(spark, path, "collocate_term string, frequency long")


@query
def collection_roundtrip(spark, sf):
    """Documents of up to ten features with numbers, lists, nested values and nulls; what is written again has them all."""
    path, out = _collections(spark, sf), scratch_path(spark, "features")
    stated = Observation()
    write_raw_features(feature_rows(read_feature_collection(spark, path, stated)), out)
    part = lambda of: F.get_json_object("raw", of)
    return read_features(spark, out).select(
        part("$.id").cast("long").alias("id"),
        part("$.properties.score").cast("double").alias("score"),
        part("$.properties.places").alias("places"),
        part("$.properties.when.sure").alias("sure"),
        F.get("geometry.coordinates", F.lit(1)).cast("double").alias("lat"),
        F.col("properties")["article_id"].alias("article_id"),
        F.lit(stated_crs(stated)["properties"]["name"]).alias("crs"),
    )


def _collections(spark: SparkSession, sf: str) -> str:
    """One file per ten articles. A file costs more than its few bytes, so the tasks are as many as a shuffle has and are not merged by size."""
    path = scratch_path(spark, "collections")
    number = F.col("full_article_id")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        number.alias("id"),
        F.struct(F.lit("Point").alias("type"), F.array(F.lit(-1.5), number / 8).alias("coordinates")).alias("geometry"),
        F.struct(
            "article_id", (number / 4).alias("score"), F.array("page", "lccn").alias("places"), F.struct("date", F.lit(True).alias("sure")).alias("when")
        ).alias("properties"),
    )
    system = F.struct(F.lit("name").alias("type"), F.struct(F.lit("urn:x").alias("name")).alias("properties"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = views.articles(spark, sf).withColumn("document", F.expr("full_article_id div 10"))
    docs = rows.repartition(tasks, "document").groupBy("document").agg(F.collect_list(feature).alias("features"))
    docs = docs.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), system.alias("crs"), "features")))
    # tasks put their files in place themselves; else the driver would move them one by one
    docs.write.options(maxRecordsPerFile=1, **{"mapreduce.fileoutputcommitter.algorithm.version": 2}).text(path)
    return path


def _yearly_corpus(spark: SparkSession, sf: str, label: str, **options) -> str:
    """Articles in year folders, written by the tasks that read them: a larger table gives more tasks, not larger ones."""
    path = scratch_path(spark, label)
    rows = views.articles(spark, sf).drop("newspaper_name").withColumn("year", F.substring("date", 1, 4).cast("int"))
    rows.write.options(**options).partitionBy("year").parquet(path)
    return path


#: Found in few files, in many, in none; and too short for the index.
SKIPPING = ["apache license", WORD, "zzz-absent", "of"]


@query
def search_skipping(spark, sf):
    """The index is built over files of 100 articles; each search opens those that can hold its term."""
    path, index = _yearly_corpus(spark, sf, "corpus", maxRecordsPerFile=100), scratch_path(spark, "text-index")
    update_text_index(spark, path, index)
    found = None
    for term in SKIPPING:
        read = read_matching_corpus(spark, path, index, term, 1900, 1902)
        hits = search.search(read, term, START, END).select(F.lit(term).alias("term"), "article_id", "date", "article", "year")
        found = hits if found is None else found.unionAll(hits)
    return found


# --- streaming ----------------------------------------------------------------------------


def _stream_corpus(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "stream-corpus")
    views.articles(spark, sf).drop("newspaper_name").write.parquet(path)
    return path


@query
def stream_search_(spark, sf):
    corpus, out = _stream_corpus(spark, sf), scratch_path(spark, "stream-out")
    run = stream_search(
        spark, corpus, out, scratch_path(spark, "stream-state"), WORD, START, END, files_per_batch=3
    )
    run.awaitTermination()
    return spark.read.parquet(out).select("article_id", "date", "page", "url", "year")


@query
def stream_search_cap(spark, sf):
    corpus, out = _stream_corpus(spark, sf), scratch_path(spark, "stream-out")
    run = stream_search_capped(
        spark, corpus, out, scratch_path(spark, "stream-state"), WORD, START, END, CAP,
        files_per_batch=3,
    )
    run.awaitTermination()
    return read_capped(spark, out).groupBy("year").agg(F.count("*").alias("kept"))


@query
def stream_search_early_stop(spark, sf):
    """One match a year is enough, and files that come after that can't be read: the stream ends without opening them."""
    corpus, out = _stream_corpus(spark, sf), scratch_path(spark, "stream-out")
    state, ask = scratch_path(spark, "stream-state"), ("", START, END, 1)
    stream_search_capped(spark, corpus, out, state, *ask).awaitTermination()
    broken = spark._jvm.org.apache.hadoop.fs.Path(f"{corpus}/unreadable_1901.parquet")
    file = broken.getFileSystem(spark._jsc.hadoopConfiguration()).create(broken)
    file.writeBytes("not Parquet")
    file.close()
    run = stream_search_capped(spark, corpus, out, state, *ask, once=False)
    run.awaitTermination(120)
    return read_capped(spark, out).groupBy("year").agg(F.count("*").alias("kept")).where(F.lit(not run.isActive))


@query
def stream_progress(spark, sf):
    """What the batches of a search have read and matched, added up."""
    path, out = _yearly_corpus(spark, sf, "stream-corpus"), scratch_path(spark, "stream-out")
    steps, state = scratch_path(spark, "stream-steps"), scratch_path(spark, "stream-state")
    run = stream_search(spark, path, out, state, WORD, START, END, files_per_batch=2, progress=steps)
    run.progress_table.finish(run)
    done = read_progress(spark, steps)
    return done.groupBy("year").agg(F.sum("read").alias("read"), F.sum("matched").alias("matched"))
