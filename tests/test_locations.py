import json

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import locations
from broadsheet.plans.runs import coordinates_run, locate_run
from broadsheet.sinks.features import feature_json, write_raw_features
from broadsheet.sources.features import (
    collection_metadata,
    feature_rows,
    points,
    read_feature_collection,
    read_features,
)

PLACES = "SN string, Title string, City string, State string, Long double, Lat double"
ARTICLES = "article_id string, lccn string, newspaper_name string"


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(
        [
            ("s1", "One", "Rome", "IT", 1.0, 2.0),
            ("s1", "One again", "Rome", "IT", 1.5, 2.5),
            ("s2", "Two", "", None, None, 4.0),
            (None, "Nameless", "Nowhere", "XX", 0.0, 0.0),
        ],
        PLACES,
    )


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_join_by_id_fans_out_and_nulls_meet(rows, places):
    articles = rows([("1", "s1", "n"), ("2", None, "n"), ("3", "s9", "Nine")], ARTICLES)
    found = locations.locate_articles(articles, places)
    assert got(found, "article_id", "Title", "City") == [
        ("1", "One again", "Rome"),
        ("1", "One", "Rome"),
        ("2", "Nameless", "Nowhere"),
        ("3", "Nine", None),
    ]
    assert "newspaper_name" not in found.columns


def test_join_by_name_only_without_any_id(rows, places):
    articles = rows([("1", None, "Two"), ("2", None, "Three")], ARTICLES)
    assert got(locations.locate_articles(articles, places), "article_id", "SN", "Title") == [
        ("1", "s2", "Two"),
        ("2", None, "Three"),
    ]


def test_nothing_to_join_on(rows, places):
    found = locations.locate_articles(rows([("1",)], "article_id string"), places)
    assert got(found, "article_id", "SN", "Title", "Lat") == [("1", None, None, None)]


def test_key_is_chosen_per_run(rows, places):
    data = [("1", "s2", "One", "a"), ("2", None, "One", "a"), ("3", None, "Two", "b"), ("4", None, None, "c")]
    articles = rows(data, ARTICLES + ", run string")
    found = locations.locate_articles(articles, places, run="run")
    assert got(found, "article_id", "SN") == [("1", "s2"), ("2", None), ("3", "s2"), ("4", None)]
    assert got(found.where("article_id = '2'"), "Title") == [("Nameless",)]
    with pytest.raises(ValueError):
        locations.locate_articles(articles, places, key="city")


def test_runs_are_written_apart(rows, spark, places, tmp_path):
    data = [("1", "s2", None, "a.json"), ("2", None, "Two", "b.json"), ("3", None, None, "b.json")]
    articles = rows(data, ARTICLES + ", run string")
    path = locate_run(articles, places, str(tmp_path / "f"), run="run")
    back = read_features(spark, path)
    rows_back = feature_rows(back.select("type", "geometry", "properties"))
    assert got(rows_back, "article_id", "Title") == [("1", "Two"), ("2", "Two"), ("3", None)]
    one = spark.read.text(f"{path}/run=b.json")
    assert one.count() == 2


def test_one_newspaper_may_hold_most_articles(spark, places):
    many = spark.range(20_000).select(
        F.col("id").cast("string").alias("article_id"),
        F.when(F.col("id") % 10 == 0, "s2").otherwise("s1").alias("lccn"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = locations.locate_articles(many, places, key="lccn")
        assert found.count() == 18_000 * 2 + 2_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_missing_coordinates(places):
    assert got(locations.missing_coordinates(places), "SN") == [("s2",)]
    assert got(locations.missing_coordinates(places, ["One", "Two"]), "SN") == [("s1",), ("s2",)]
    assert got(locations.newspapers_to_locate(places, ["One", "One again"]), "SN", "Title") == [("s1", "One again")]


def test_coordinates_are_overwritten_even_by_nothing(rows, places):
    fetched = rows([("s1", None, None), ("s2", 9.0, 8.0)], "SN string, Lat double, Long double")
    assert got(locations.apply_coordinates(places, fetched), "Title", "Long", "Lat") == [
        ("Nameless", 0.0, 0.0), ("One again", None, None), ("One", None, None), ("Two", 8.0, 9.0),
    ]
    kept = locations.apply_coordinates(places, fetched, keep_existing=True)
    assert ("One", 1.0, 2.0) in got(kept, "Title", "Long", "Lat")


def test_coordinates_run(rows, spark, places, tmp_path):
    fetched = rows([("s1", 0.0, 0.0), ("s2", 9.0, 8.0)], "SN string, Lat double, Long double")
    paths = coordinates_run(places, fetched, str(tmp_path))
    assert got(spark.read.json(paths["wanted"]), "SN", "Title") == [("s2", "Two")]
    updated = spark.read.option("header", True).csv(paths["updated"])
    assert got(updated.where("SN is not null"), "SN", "Lat") == [("s1", "2.0"), ("s1", "2.5"), ("s2", "9.0")]


def test_stats_and_facets(rows):
    located = rows([("A", "Rome", "IT"), ("A", "", "IT"), (None, None, "US")], "Title string, City string, State string")
    assert got(locations.join_stats(located), "places", "articles") == [(2, 3)]
    assert got(locations.place_facets(located), "facet", "value") == [("City", "Rome"), ("State", "IT"), ("State", "US")]


def test_features_roundtrip(rows, spark, places, tmp_path):
    articles = rows([("1", "s1", "1900-01-01"), ("2", "s2", None)], "article_id string, lccn string, date string")
    path = locate_run(articles, places, str(tmp_path / "features"))
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert sorted(str(f["geometry"] and f["geometry"]["coordinates"]) for f in lines) == ["None", "[1.0, 2.0]", "[1.5, 2.5]"]
    assert all(set(f["properties"]) >= {"article_id", "lccn", "date", "Title", "City", "State"} for f in lines)
    back = read_features(spark, path)
    assert feature_rows(back).count() == 3
    assert got(points(feature_rows(back)), "article_id", "lat", "lon") == [("1", 2.0, 1.0), ("1", 2.5, 1.5)]
    write_raw_features(back, str(tmp_path / "again"))
    again = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "again")).collect()]
    assert sorted(map(str, again)) == sorted(map(str, lines))
    assert feature_json(articles.selectExpr("*", "1D AS Long", "CAST(NULL AS DOUBLE) AS Lat")).count() == 2


def test_odd_geometries_are_no_points(spark, tmp_path):
    geometries = [
        {"type": "Point", "coordinates": [1, 2]},
        {"type": "Point", "coordinates": ["1.5", "2.5", 7]},
        {"type": "Point", "coordinates": [1]},
        {"type": "Point", "coordinates": ["x", 2]},
        {"type": "Point", "coordinates": [None, 2]},
        {"type": "Polygon", "coordinates": [[[0, 0], [1, 1]]]},
        {"type": "Point"},
        None,
    ]
    features = [{"type": "Feature", "geometry": g, "properties": {"date": "1900.01.02", "n": i}} for i, g in enumerate(geometries)]
    meta = {"search_term": "gold", "start_date": ""}
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "metadata": meta, "features": features}, indent=1))
    rows = feature_rows(read_feature_collection(spark, str(tmp_path / "c.geojson")), extra=("n",))
    assert rows.count() == 8
    assert got(points(rows), "n", "lon", "lat") == [("0", 1.0, 2.0), ("1", 1.5, 2.5)]
    assert str(points(rows).first().day) == "1900-01-02"
    facts = collection_metadata(spark, str(tmp_path / "c.geojson")).first()
    assert (facts.search_term, facts.start_date) == ("gold", None)
