"""The pipeline's stages on small tables, each against its operator's own results."""

import inspect

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from broadsheet.llm import byte_network, decontamination, quality_rules, registry, simhash
from fixtures_llm import awkward, with_clashes

SF = "/root/testdata/sf0.001"


def test_stages_and_queries_are_registered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "decontamination", "packing"]
    names = entry_points.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry_points.oracle_sql()
    assert "except" not in inspect.getsource(corpus_pipeline) + inspect.getsource(registry)


def test_each_stage_follows_its_operator(spark, tmp_path):
    docs, labels = registry.table(spark, SF, "documents"), registry.table(spark, SF, "labels")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for i, (name, function) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = function(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        if i == 0:
            want = ids(byte_network.classify(docs, labels).where("predicted = 1"))
        elif i == 1:
            want = ids(quality_rules.score_quality(docs, labels.where("quality = 1")).where("kept"))
        elif i == 2:
            want = sorted({r.component_id for r in simhash.simhash_components(docs).collect()})
        else:
            leaked = {r.doc_id for r in decontamination.overlaps(docs, registry.table(spark, SF, "benchmark")).collect()}
            want = [d for d in ids(docs) if d not in leaked]
        assert ids(kept) == want
        docs = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(ids(docs))
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, pieces))


@pytest.mark.parametrize("rows", [None, 0])
def test_stages_take_awkward_and_empty_tables(spark, tmp_path, rows):
    docs = with_clashes(awkward(spark))
    docs = docs if rows is None else docs.limit(rows)
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.read.parquet(str(tmp_path / name))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run_over_whole_tables(spark, name):
    found = registry.queries()[name](spark, SF)
    n = found.count()
    total = registry.table(spark, SF, "documents").count()
    if name.startswith(("op3_", "op4_", "op5_", "op7_", "op8_", "op9_", "op10_")):
        assert n == total
    elif name.startswith(("op1_", "op6_")):
        assert n > total
