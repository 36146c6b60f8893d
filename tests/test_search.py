import json

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import search
from broadsheet.plans.runs import run_term, search_run
from broadsheet.sources.corpus import available_years, read_corpus, year_ranges
from broadsheet.sources.payloads import envelope_articles, read_envelopes, read_results, run_metadata
from broadsheet.sources.tables import last_titles, read_locations, read_table, read_titles
from broadsheet.streaming.search import progress, read_capped, stream_search, stream_search_capped

SCHEMA = (
    "full_article_id bigint, article_id string, lccn string, date string, page string, "
    "article string, url string, filename string"
)


def article(i, date, text, lccn="sn1"):
    return (i, str(i), lccn, date, "p1", text, f"http://x/{i}.jp2", f"f{i}.json")


CORPUS = [
    article(1, "1900-01-05", "a_b Rail-\nroad"),
    article(2, "1900-03-05", "axb", "sn2"),
    article(3, "1900-03-05", "A_B twice a_b", None),
    article(4, "1902-07-01", "a_b", "sn9"),
    article(5, "1902-07-02", None),
    article(6, "1902-12-31", "100% a_b"),
]


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    """Yearly files, named by their year."""
    path = tmp_path_factory.mktemp("corpus")
    for year in ("1900", "1902"):
        data = [a for a in CORPUS if a[3].startswith(year)]
        spark.createDataFrame(data, SCHEMA).toPandas().to_parquet(path / f"Stories_{year}.parquet")
    return str(path)


def ids(df):
    return sorted(int(r.article_id) for r in df.select("article_id").collect())


def test_term_is_a_literal_substring(spark, corpus_dir):
    corpus = read_corpus(spark, corpus_dir)
    assert ids(search.search(corpus, "a_b", "1900-01-01", "1902-12-31")) == [1, 3, 4, 6]
    assert ids(search.search(corpus, "%", "1900-01-01", "1902-12-31")) == [6]
    assert ids(search.search(corpus, "railroad", "1900-01-01", "1902-12-31")) == []


def test_range_is_inclusive_and_years_prune(spark, corpus_dir):
    corpus = read_corpus(spark, corpus_dir, 1902, 1902)
    assert ids(search.search(corpus, "a_b", "1902-07-01", "1902-12-31")) == [4, 6]
    assert [r.year for r in available_years(read_corpus(spark, corpus_dir)).collect()] == [1900, 1902]
    with pytest.raises(ValueError):
        search.search(corpus, "x", "1902-01-01", "1901-01-01")


def scan_facts(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next(line for line in plan.splitlines() if "FileScan" in line)


def test_the_scan_prunes_years_columns_and_dates(spark, corpus_dir, tmp_path):
    corpus = read_corpus(spark, corpus_dir)
    corpus.write.partitionBy("year").parquet(str(tmp_path / "c"))
    laid_out = read_corpus(spark, str(tmp_path / "c"), 1902, 1902)
    # A shuffle keeps the plan adaptive.
    found = search.search(laid_out, "a_b", "1902-01-01", "1902-08-01").groupBy("lccn").count()
    scan = scan_facts(found)
    assert "year" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(date,1902-01-01)" in scan and "full_article_id" not in scan


def test_files_of_other_years_stay_closed(spark, corpus_dir):
    def count(*years):
        return read_corpus(spark, corpus_dir, *years).select("article_id")

    def opened(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        return plan.collectLeaves().head().metrics().apply("numFiles").value()

    assert opened(count()) == 2
    assert opened(count(1902, 1902)) == 1


def test_narrower_search_of_a_search_is_the_narrower_search(spark, corpus_dir):
    corpus = read_corpus(spark, corpus_dir)
    wide = search.search(corpus, "a_b", "1900-01-01", "1902-12-31")
    assert ids(search.search(wide, "a_b", "1900-02-01", "1902-07-01")) == ids(
        search.search(corpus, "a_b", "1900-02-01", "1902-07-01")
    )


def test_repairs_come_after_matching(spark, corpus_dir):
    corpus = read_corpus(spark, corpus_dir)
    found = search.search(
        corpus, "rail-", "1900-01-01", "1900-12-31", join_hyphens=True, lowercase=True, pdf_urls=True
    ).first()
    assert (found.article, found.url) == ("a_b railroad", "http://x/1.pdf")


def test_cap_takes_the_first_of_each_year(spark, corpus_dir):
    corpus = read_corpus(spark, corpus_dir)
    assert ids(search.search(corpus, "a_b", "1900-01-01", "1902-12-31", cap=1)) == [1, 4]
    assert ids(search.search(corpus, "a_b", "1900-01-01", "1902-12-31", cap=0)) == [1, 3, 4, 6]


def test_cap_is_exact_when_one_year_holds_nearly_everything(spark):
    df = spark.range(5000).select(
        F.col("id").cast("string").alias("article_id"),
        F.when(F.col("id") % 100 == 0, 1901).otherwise(1900).alias("year"),
        F.lpad((F.col("id") * 7919 % 5000).cast("string"), 5, "0").alias("date"),
    )
    got = {(r.year, r.date) for r in search.cap_per_year(df, 40).collect()}
    every = sorted((r.year, r.date) for r in df.collect())
    expected = set([e for e in every if e[0] == 1900][:40] + [e for e in every if e[0] == 1901][:40])
    assert got == expected


def test_counts_keep_empty_years(spark, corpus_dir):
    found = search.search(read_corpus(spark, corpus_dir), "a_b", "1900-01-01", "1902-12-31")
    got = {r.year: r.match_count for r in search.counts_by_year(found, "1900-01-01", "1902-12-31").collect()}
    assert got == {1900: 2, 1901: 0, 1902: 2, None: 4}


def test_year_ranges(rows):
    years = rows([(y,) for y in (1912, 1900, 1901, 1902, 1912)], "year int")
    assert sorted(r.label for r in year_ranges(years).collect()) == ["1900-1902", "1912"]


def test_last_title_wins(spark, rows, tmp_path):
    (tmp_path / "t.csv").write_text('LCCN,place,Newspaper\nsn1,x,"Old, one"\nsn2,x,Two\nsn1,x,New\n')
    lookup = read_titles(spark, str(tmp_path / "t.csv"))
    assert {r.SN: r.Title for r in last_titles(lookup).collect()} == {"sn1": "New", "sn2": "Two"}
    (tmp_path / "u.csv").write_text("a,b\n1,2\n")
    assert read_titles(spark, str(tmp_path / "u.csv")).count() == 0


@pytest.mark.parametrize("split", ["200", "128m"])
def test_the_last_row_of_the_last_file_wins(spark, tmp_path, split):
    """Spark deals large files first, so the order of partitions is not that of files."""
    for number, rows in enumerate((3, 40, 400)):
        lines = [f"sn{row},title {number}.{row}" for row in range(rows)] + [f"sn0,end of {number}"]
        (tmp_path / f"{2 - number}.csv").write_text("lccn,title\n" + "\n".join(lines) + "\n")
    (tmp_path / "3.csv").write_text('lccn,title\nsn1,"two\nlines"\n')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = {r.SN: r.Title for r in last_titles(read_titles(spark, str(tmp_path))).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(found) == 400 and found["sn0"] == "end of 0" and found["sn1"] == "two\nlines"
    assert (found["sn2"], found["sn39"], found["sn399"]) == ("title 0.2", "title 1.39", "title 2.399")


def test_locations_need_their_columns(spark, tmp_path):
    (tmp_path / "l.csv").write_text("SN,Long,Lat,City\nsn1,-120.5,25,Rome\nsn2,east,25,\n")
    first, second = read_locations(spark, str(tmp_path / "l.csv")).orderBy("SN").collect()
    assert (first.Long, first.City, first.State, second.Long) == (-120.5, "Rome", None, None)
    (tmp_path / "m.csv").write_text("SN,Long\nsn1,1\n")
    with pytest.raises(ValueError, match="Lat"):
        read_locations(spark, str(tmp_path / "m.csv"))


def test_search_run_writes_results_and_manifest(spark, corpus_dir, tmp_path):
    path = search_run(spark, corpus_dir, str(tmp_path), "a_b", "1900-01-01", "1902-12-31", lowercase=True)
    assert ids(read_results(spark, f"{path}/articles")) == [1, 3, 4, 6]
    run = spark.read.json(f"{path}/runs").first()
    assert (run.search_term, run.match_count, len(run.run_id)) == ("a_b", 4, 8)
    assert search_run(spark, corpus_dir, str(tmp_path), "absent", "1900-01-01", "1902-12-31") is None
    assert not (tmp_path / "absent_1900-01-01_1902-12-31").exists()
    yearly = search_run(spark, corpus_dir, str(tmp_path), "absent", "1900-01-01", "1902-12-31", per_year=True)
    counts = spark.read.json(f"{yearly}/runs")
    assert sorted((r.year, r.match_count) for r in counts.collect()) == [(1900, 0), (1901, 0), (1902, 0)]


def test_envelopes(spark, tmp_path):
    def put(name, **payload):
        (tmp_path / name).write_text(json.dumps(payload, indent=2))

    one, two = {"article_id": "1", "date": "1900-01-01"}, {"article_id": "2", "lccn": None}
    put("gold_rush_1900-01-01_1900-12-31.json", search_term="gold rush", articles=[one, two], match_count=2)
    put("gold_1900.json", search_term="gold", year="1900", records=[two])
    put("gold_1901.json", articles=[], records=[one])
    put("iron_1900.json", articles=[one])

    every = envelope_articles(read_envelopes(spark, str(tmp_path)))
    assert every.groupBy("run").count().count() == 4
    strict = envelope_articles(read_envelopes(spark, str(tmp_path)), empty_falls_back=False)
    assert "gold_1901.json" not in {r.run for r in strict.collect()}
    gold = read_envelopes(spark, str(tmp_path), "gold", 1900)
    assert [r.file_name for r in gold.collect()] == ["gold_1900.json"]
    facts = {r.file_name: r for r in run_metadata(read_envelopes(spark, str(tmp_path), "gold")).collect()}
    assert len(facts) == 3
    assert run_term(gold) == "gold"
    with pytest.raises(ValueError):
        run_term(read_envelopes(spark, str(tmp_path)))
    assert facts["gold_rush_1900-01-01_1900-12-31.json"].search_term == "gold rush"
    assert facts["gold_rush_1900-01-01_1900-12-31.json"].end_date == "1900-12-31"
    put("bad_1.json", articles={"no": "list"})
    with pytest.raises(Exception, match="no list of articles"):
        envelope_articles(read_envelopes(spark, str(tmp_path), "bad")).collect()


def test_names_keep_terms_with_underscores(rows):
    df = rows([("merged_gold_rush_1900-01-01_1900-12-31.geojson",), ("plain.json",)], "file_name string")
    got = {r.file_name[:5]: (r.search_term, r.start_date, r.end_date) for r in run_metadata(df).collect()}
    assert got == {
        "merge": ("gold_rush", "1900-01-01", "1900-12-31"),
        "plain": ("plain", "all", "all"),
    }


def test_read_table_kinds(spark, rows, tmp_path):
    df = rows([("a", 2)], "collocate_term string, frequency bigint")
    assert read_table(spark, df) is df
    (tmp_path / "m.csv").write_text("collocate_term,frequency\na,2\n")
    assert read_table(spark, str(tmp_path / "m.csv")).first().frequency == 2
    with pytest.raises(ValueError):
        read_table(spark, "m.xlsx")


def test_stream_equals_batch(spark, corpus_dir, tmp_path):
    args = ("a_b", "1900-01-01", "1902-12-31")
    run = stream_search(
        spark, corpus_dir, str(tmp_path / "out"), str(tmp_path / "state"), *args, files_per_batch=1
    )
    run.awaitTermination()
    assert sum(p["rows"] for p in progress(run)) == len(CORPUS)
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ids(search.search(read_corpus(spark, corpus_dir), *args))


def test_stream_cap_counts_over_batches_and_survives_replay(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    args = ("word", "1900-01-01", "1901-12-31")

    def add(numbers, year):
        data = [article(i, f"{year}-01-01", "word") for i in numbers]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream_search_capped(spark, source, out, state, *args, cap=5, files_per_batch=1).awaitTermination()
        return {r.year: r["count"] for r in read_capped(spark, out).groupBy("year").count().collect()}

    add(range(3), 1900)
    assert run() == {1900: 3}
    add(range(3, 10), 1900)
    add(range(20, 22), 1901)
    assert run() == {1900: 5, 1901: 2}
    assert {0, 1, 2} <= set(ids(read_capped(spark, out)))

    from broadsheet.operators.search import article_columns
    from broadsheet.streaming.search import YearlyCap

    again = article_columns(spark.createDataFrame([article(i, "1900-01-01", "word") for i in range(3)], SCHEMA))
    YearlyCap(out, 5)(again, 0)
    assert read_capped(spark, out).where("year = 1900").count() == 5
