"""Whole-document collections whose features pass through untouched."""

import json
from pathlib import Path

import pytest
from pyspark.sql import Observation

from broadsheet.checks import queries
from broadsheet.sinks.features import write_raw_features
from broadsheet.sources.features import collection_crs, feature_rows, points, read_feature_collection, read_features, stated_crs

FEATURES = [
    {"type": "Feature", "id": 7, "geometry": {"type": "Point", "coordinates": [1.5, -2.25]}, "properties": {"article": "a \"b\"\n", "n": 12, "x": 0.125, "tags": ["p", None, 3], "Deep": {"k": [{}]}}},
    {"type": "Feature", "id": "s-1", "geometry": None, "properties": {"article": None, "date": "1900-01-02", "long": 12345678901234567}, "bbox": [1, 2, 3, 4]},
    {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}, "properties": {}},
]
CRS = {"type": "name", "properties": {"name": "urn:one"}}


def document(folder, name, features, **more):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"type": "FeatureCollection", **more, "features": features}, indent=1))


def test_features_keep_ids_numbers_lists_and_lines(spark, tmp_path):
    document(tmp_path / "in", "one.json", FEATURES, crs=CRS)
    document(tmp_path / "in", "none.json", [])
    read = read_feature_collection(spark, str(tmp_path / "in"))
    write_raw_features(feature_rows(read), str(tmp_path / "out"))
    back = [json.loads(r.raw) for r in read_features(spark, str(tmp_path / "out")).collect()]
    assert sorted(back, key=str) == sorted(FEATURES, key=str)
    assert [(r.lat, r.lon) for r in points(feature_rows(read)).collect()] == [(-2.25, 1.5)]
    assert [r.article for r in feature_rows(read).collect() if r.article] == ['a "b"\n']


def test_coordinate_system_comes_from_the_input(spark, tmp_path):
    document(tmp_path / "in", "one.json", FEATURES, crs=CRS)
    document(tmp_path / "in", "two.json", [], crs=CRS)
    document(tmp_path / "in", "three.json", FEATURES)
    assert collection_crs(spark, str(tmp_path / "in")) == CRS
    document(tmp_path / "in", "four.json", [], crs={"type": "other"})
    with pytest.raises(ValueError, match="different"):
        collection_crs(spark, str(tmp_path / "in"))
    document(tmp_path / "bare", "one.json", FEATURES)
    assert collection_crs(spark, str(tmp_path / "bare")) is None


def test_coordinate_system_is_noted_while_features_are_read(spark, tmp_path):
    document(tmp_path / "in", "one.json", FEATURES, crs=CRS)
    document(tmp_path / "in", "two.json", FEATURES)
    stated = Observation()
    write_raw_features(feature_rows(read_feature_collection(spark, str(tmp_path / "in"), stated)), str(tmp_path / "out"))
    assert stated_crs(stated) == CRS and read_features(spark, str(tmp_path / "out")).count() == 2 * len(FEATURES)
    document(tmp_path / "in", "three.json", [], crs={"type": "other"})
    stated = Observation()
    read_feature_collection(spark, str(tmp_path / "in"), stated).collect()
    with pytest.raises(ValueError, match="different"):
        stated_crs(stated)


def test_collections_are_written_by_all_tasks(spark, tmp_path):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'src1' AS source")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    files = list(Path(queries._collections(spark, str(tmp_path)).removeprefix("file:")).glob("part-*"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
