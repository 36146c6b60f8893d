"""Plans and inputs that decide whether a job survives large data."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from broadsheet.checks import queries
from broadsheet.functions.ranking import rank_by_frequency
from broadsheet.operators import collocation, locations, ranks
from broadsheet.operators.collocation import Options
from broadsheet.plans.runs import collocation_run
from broadsheet.runtime import shared_dir
from broadsheet.sinks.results import write_results, write_table
from broadsheet.sources.payloads import read_results
from broadsheet.sources.tables import read_table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("filler", ["the ", "' ", "of the "])
def test_long_runs_of_stopwords(rows, filler):
    text = "bank " + filler * 50_000 + "river"
    found = collocation.with_phrase(rows([(text,), ("bank x river",)], "article string"), "bank river", Options(drop_stopwords=True))
    assert [r.article for r in found.collect()] == [text]


def test_dropped_lists_keep_null_terms(rows):
    table = rows([("a", 1), (None, 2), ("b", 3)], "collocate_term string, frequency long")
    for terms in (["a"], [f"t{i}" for i in range(12_000)] + ["a"], rows([("a",)], "collocate_term string")):
        assert {r.collocate_term for r in collocation.drop_collocates(table, terms).collect()} == {None, "b"}


def test_years_prune_folders(rows, tmp_path):
    found = rows([(str(y), f"{y}-05-05", y, "gold rush") for y in (1900, 1901, 1902)], "article_id string, date string, year int, article string")
    write_results(found, str(tmp_path / "r"))
    back = read_results(found.sparkSession, str(tmp_path / "r"))
    chosen = collocation.filter_articles(back, start="1901-01-01", end="1901-12-31")
    assert [r.article_id for r in chosen.collect()] == ["1901"]
    assert "year" in plan_of(chosen).split("PartitionFilters: ")[1].split("]")[0]
    near = collocation.occurrences(back, "gold", start="1901-01-01", end="1901-12-31")
    assert "year" in plan_of(near).split("PartitionFilters: ")[1].split("]")[0] and near.count() == 1


def test_ranks_without_a_one_task_window(rows):
    terms = rows([(f"t{i:03d}", i % 17 * (i % 5)) for i in range(500)], "collocate_term string, frequency long")
    ranked = ranks.ranked_metrics(terms)
    assert "SinglePartition" not in plan_of(ranked)
    want = sorted(((-r.frequency, r.collocate_term) for r in terms.collect()))
    assert {r.collocate_term: r.rank for r in ranked.collect()} == {t: i for i, (_, t) in enumerate(want, 1)}
    grouped = rank_by_frequency(terms.withColumn("g", F.col("frequency") % 2), ["g"], "frequency", "collocate_term", "rank")
    for g in (0, 1):
        want = sorted((-r.frequency, r.collocate_term) for r in terms.collect() if r.frequency % 2 == g)
        assert [r.collocate_term for r in grouped.where(F.col("g") == g).orderBy("rank").collect()] == [t for _, t in want]
    shown = ranks.drop_candidates(terms, ["t001", "t499", "zzz"], 10).collect()
    ranks_of = {r.collocate_term: r["rank"] for r in ranked.collect()}
    assert {r.collocate_term: r["rank"] for r in shown if r.collocate_term != "zzz"} == {
        t: n for t, n in ranks_of.items() if n <= 10 or t in ("t001", "t499")
    }
    assert {r.collocate_term for r in shown if r.selected} == {"t001", "t499", "zzz"}


def test_tables_are_read_back(rows, tmp_path):
    table = rows([("a", 1), ("b, c", 2)], "collocate_term string, frequency long")
    write_table(table, str(tmp_path / "metrics"))
    back = read_table(table.sparkSession, str(tmp_path / "metrics"), table.schema)
    assert sorted(map(tuple, back.collect())) == [("a", 1), ("b, c", 2)]
    table.write.json(str(tmp_path / "lines"))
    assert read_table(table.sparkSession, str(tmp_path / "lines"), table.schema).count() == 2
    with pytest.raises(ValueError):
        table.write.parquet(str(tmp_path / "other"))
        read_table(table.sparkSession, str(tmp_path / "other"))


def test_the_last_fetched_place_counts(rows):
    places = rows([("s", 0.0, 0.0)], "SN string, Lat double, Long double")
    fetched = rows([("s", 1.0, 1.0, "2020-01-02"), ("s", 5.0, 5.0, "2020-01-01")], "SN string, Lat double, Long double, fetched_at string")
    assert [tuple(r) for r in locations.apply_coordinates(places, fetched).collect()] == [("s", 1.0, 1.0)]


def test_a_run_leaves_no_staged_folder(rows, tmp_path):
    spark = rows([(1,)], "i int").sparkSession
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    articles = rows([("1", "1900-01-02", "p1", "gold rush and more"), ("2", "1900-02-02", "p1", "rush of gold")], "article_id string, date string, page string, article string")
    collocation_run(articles, str(tmp_path / "out"), "gold", time_bin="1 months")
    assert set(shared.iterdir()) == before


def test_a_corpus_by_year_is_written_by_as_many_tasks_as_read_it(rows, tmp_path):
    docs = rows([(i, f"text {i}", "src1") for i in range(60)], "doc_id long, text string, source string")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    spark = docs.sparkSession
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        path = queries._yearly_corpus(spark, str(tmp_path), "by-year")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    parts = {f.name.split("-")[1] for f in Path(path.removeprefix("file:")).rglob("part-*.parquet")}
    assert len(parts) >= 6 and spark.read.parquet(path).count() == 60
