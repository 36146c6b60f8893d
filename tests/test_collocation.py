import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from broadsheet.functions.tokens import STOPWORDS
from broadsheet.operators import collocation, ranks
from broadsheet.operators.collocation import ALL_METRICS, Options
from broadsheet.operators.timebins import collocates_by_time
from broadsheet.plans.naming import collocation_paths
from broadsheet.plans.runs import collocation_run
from broadsheet.runtime import stage

SCHEMA = "article_id string, filename string, page string, date string, article string"


def brute_force(data, term, drop=False, window=5):
    """Collocates by loops over Python lists."""
    cut = lambda t: [w.lower() for w in re.findall("[A-Za-z0-9']+", t)]
    keep = lambda ts: [t for t in ts if not (drop and t in STOPWORDS)]
    phrase, found, total = keep(cut(term)), defaultdict(list), 0
    for n, (aid, name, page, date, text) in enumerate(data):
        toks = keep(cut(text))
        spots = [i for i in range(len(toks)) if toks[i : i + len(phrase)] == phrase]
        total += bool(spots)
        for i in spots:
            left = toks[max(0, i - window) : i]
            for j, t in enumerate(left + toks[i + len(phrase) : i + len(phrase) + window]):
                if not t.isdigit():
                    found[t].append((aid or name or n, page, date, j - len(left)))
    return {
        t: (
            len(hits),
            len({p for _, p, _, _ in hits if p}),
            min(d for _, _, d, _ in hits),
            max(d for _, _, d, _ in hits),
            len({a for a, *_ in hits}),
            round(len({a for a, *_ in hits}) / max(1, total), 9),
            round(sum(r for *_, r in hits) / len(hits), 9),
        )
        for t, hits in found.items()
    }


def corpus(n=120, seed=7):
    rng = random.Random(seed)
    words = ["the", "of", "bank", "River", "gold", "1900", "don't", "'", "É", "new-born", "x"]
    return [
        (
            rng.choice([str(i), str(i // 2), "", None]),
            rng.choice([f"f{i}", None]),
            rng.choice(["p1", "p2", "", None]),
            f"190{i % 3}-0{1 + i % 9}-1{i % 9}",
            " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))),
        )
        for i in range(n)
    ]


def dated(rows, data):
    return collocation.filter_articles(rows(data, SCHEMA))


@pytest.mark.parametrize("drop", [False, True])
@pytest.mark.parametrize("term", ["bank", "of the bank", "bank river", "gold gold", "don't"])
def test_metrics_agree_with_brute_force(rows, term, drop):
    data = corpus()
    options = Options(True, True, True, True, drop_stopwords=drop)
    found = collocation.collocate_metrics(dated(rows, data), term, options).collect()
    got = {
        r.collocate_term: (
            r.frequency, r.page_count, r.first_date, r.last_date, r.article_count,
            round(r.cooccurrence_rate, 9), round(r.mean_relative_position, 9),
        )
        for r in found
    }
    assert got == brute_force(data, term, drop)


@pytest.mark.parametrize(
    "flags, columns",
    [
        ({}, ["collocate_term", "frequency"]),
        ({"page_count": True}, ["collocate_term", "frequency", "page_count"]),
        ({"cooccurrence_rate": True}, ["collocate_term", "frequency", "article_count", "cooccurrence_rate"]),
        ({"relative_position": True}, ["collocate_term", "frequency", "mean_relative_position"]),
    ],
)
def test_options_choose_columns(rows, flags, columns):
    data = corpus(40)
    metrics = collocation.collocate_metrics(dated(rows, data), "gold", Options(**flags))
    assert metrics.columns == columns
    expected = {t: v[0] for t, v in brute_force(data, "gold").items()}
    assert {r.collocate_term: r.frequency for r in metrics.collect()} == expected


def test_one_term_and_one_article_may_hold_most_of_the_rows(rows):
    data = corpus(30) + [("hot", "h", "p9", "1901-01-01", "bank the " * 4000)] * 3
    got = collocation.collocate_metrics(dated(rows, data), "bank", ALL_METRICS)
    the = got.where("collocate_term = 'the'").first()
    assert (the.frequency, the.article_count) == (brute_force(data, "bank")["the"][0], brute_force(data, "bank")["the"][4])


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_rate_does_not_read_the_text_twice(rows, spark, tmp_path):
    """The subquery for the total runs on the shuffle of the main query."""
    rows(corpus(), SCHEMA).write.parquet(str(tmp_path / "a"))
    articles = collocation.filter_articles(spark.read.parquet(str(tmp_path / "a")))
    plan = executed_plan(collocation.collocate_metrics(articles, "bank", ALL_METRICS))
    subquery = plan.split("Subquery", 2)[2].split("Initial Plan")[0]
    assert "ReusedExchange" in subquery and "FileScan" not in subquery


def test_ranks_tokenize_once(rows, spark, tmp_path):
    rows(corpus(), SCHEMA).write.parquet(str(tmp_path / "a"))
    articles = collocation.filter_articles(spark.read.parquet(str(tmp_path / "a")))
    plans = []

    def put(df, label):
        plans.append(executed_plan(df).split("Initial Plan")[0])
        return stage(df, label)

    by_time = collocates_by_time(articles, "bank", 1, "months", start="1900-01-01", end="1902-12-31", put=put)
    assert len(plans) == 1 and plans[0].count("FileScan") == 1
    final = executed_plan(by_time).split("Initial Plan")[0]
    assert "FileScan" in final and "article" not in final


def test_hits_are_carried_without_text(rows):
    df = collocation.context_terms(dated(rows, corpus(9)), "bank", Options(), ["date"])
    assert df.columns == ["date", "collocate_term"]


def test_positions_left_and_right(rows):
    data = [("1", "f", "p1", "1900-01-01", "x y term z w")]
    df = collocation.context_terms(dated(rows, data), "term", Options(relative_position=True))
    assert {r.collocate_term: r.rel for r in df.collect()} == {"x": -2, "y": -1, "z": 0, "w": 1}


def test_stopwords_shift_the_window(rows):
    data = [("1", "f", "p1", "1900-01-01", "bank of the river")]
    options = Options(relative_position=True, drop_stopwords=True, window=1)
    df = collocation.context_terms(dated(rows, data), "the bank", options)
    assert [(r.collocate_term, r.rel) for r in df.collect()] == [("river", 0)]


def test_no_hit_gives_typed_empty_tables(rows):
    articles = dated(rows, corpus(9))
    metrics = collocation.collocate_metrics(articles, "absent", ALL_METRICS)
    assert metrics.count() == 0 and metrics.schema["frequency"].dataType.typeName() == "long"
    by_time = collocates_by_time(articles, "absent", 1, "months")
    assert by_time.count() == 0 and len(by_time.columns) == 4


def test_filter_articles(rows):
    data = [(d, a, c) for d, a, c in [
        ("1900-01-01", "t", "Rome"), ("1900-12-31", "t", "rome"), ("1901-01-01", "t", "Rome"),
        ("bad", "t", "Rome"), ("1900-05-05", None, "Rome"), ("1900-05-05", "t", None),
    ]]
    df = rows(data, "date string, article string, City string")
    kept = collocation.filter_articles(df, start="1900-01-01", end="1900-12-31", city="ROME")
    assert kept.count() == 2
    with pytest.raises(ValueError):
        collocation.filter_articles(df, start="1900")


def test_dropping_leaves_gaps_in_ranks(rows):
    table = rows([("b", t, r) for r, t in enumerate("abc", 1)], "time_bin string, collocate_term string, ordinal_rank int")
    assert [r.ordinal_rank for r in collocation.drop_collocates(table, [" b ", ""]).orderBy("ordinal_rank").collect()] == [1, 3]
    listed = rows([("a",)], "collocate_term string")
    assert collocation.drop_collocates(table, listed).count() == 2
    assert collocation.drop_collocates(table, []) is table


def test_by_time_adds_up_to_the_metrics(rows):
    articles = dated(rows, corpus())
    by_time = collocates_by_time(articles, "bank", 2, "weeks")
    summed = {r.collocate_term: r.n for r in by_time.groupBy("collocate_term").agg(F.sum("frequency").alias("n")).collect()}
    metrics = {r.collocate_term: r.frequency for r in collocation.collocate_metrics(articles, "bank").collect()}
    assert summed == metrics


def test_ranks_in_a_bin_of_many_ties(rows):
    """Ranks equal a plain sort, also where a huge tie spans many lead characters."""
    rng = random.Random(3)
    data = [(b, "".join(rng.choice("ab'1") for _ in range(rng.randint(1, 6))), rng.choice([1, 1, 1, 2, 50])) for b in ("x", "y") for _ in range(800)]
    table = rows(sorted({(b, t): (b, t, n) for b, t, n in data}.values()), "g string, t string, n bigint")
    from broadsheet.functions.ranking import rank_by_frequency

    got = {(r.g, r.t): r.k for r in rank_by_frequency(table, ["g"], "n", "t", "k").collect()}
    for g in ("x", "y"):
        order = sorted((r for r in table.collect() if r.g == g), key=lambda r: (-r.n, r.t))
        assert [got[g, r.t] for r in order] == list(range(1, len(order) + 1))


def test_occurrences_keep_undated_rows(rows):
    data = [("1900-01-01", "of the", "A"), ("soon", "of the", "A"), ("1905-01-01", "of the", "A"), ("1900-01-01", "of, the", "B"), ("1900-01-01", "ofthe", "A")]
    df = rows(data, "date string, article string, City string")
    kept = collocation.occurrences(df, "of the", start="1900-01-01", end="1901-01-01", city="a")
    assert [r.date for r in kept.orderBy("date").collect()] == ["1900-01-01", "soon"]
    features = df.select(F.create_map(F.lit("date"), "date", F.lit("article"), "article", F.lit("City"), "City").alias("p"))
    assert collocation.occurrences(features, "of the", start="1900-01-01", end="1901-01-01", city="a", properties="p").count() == 2


def test_run_writes_all_tables(rows, spark, tmp_path):
    data = rows([(*a, "Rome", "IT", "The T", 1.0, 2.0) for a in corpus()], SCHEMA + ", City string, State string, Title string, Long double, Lat double")
    paths = collocation_run(
        data, str(tmp_path), "bank", start="1900-01-01", time_bin="1 months", options=ALL_METRICS,
        drop_terms=["the"], located=True, city="rome",
    )
    metrics = spark.read.option("header", True).csv(paths["metrics"])
    assert len(metrics.columns) == 8 and metrics.where("collocate_term = 'the'").count() == 0
    expected = brute_force(corpus(), "bank")
    assert metrics.count() == len(expected) - 1
    by_time = spark.read.option("header", True).csv(paths["by_time"])
    assert by_time.agg(F.sum(F.col("frequency").cast("int"))).first()[0] == sum(v[0] for t, v in expected.items() if t != "the")
    assert spark.read.text(paths["occurrences"]).count() == collocation.occurrences(data, "bank").count()


def test_empty_run_leaves_headers(rows, spark, tmp_path):
    paths = collocation_run(rows([], SCHEMA), str(tmp_path), "bank", time_bin="1 months")
    for name, columns in (("metrics", 2), ("by_time", 4)):
        table = spark.read.option("header", True).csv(paths[name])
        assert len(table.columns) == columns and table.count() == 0


def test_paths_tell_runs_apart():
    one = collocation_paths("o", "gold  rush!", start="1900-01-01", time_bin="1 months", city=None)
    assert one["metrics"].startswith("o/metrics_gold_rush_1900-01-01_all_")
    assert one == collocation_paths("o", "gold  rush!", time_bin="1 months", start="1900-01-01")
    names = {collocation_paths("o", "gold", **p)["metrics"] for p in ({}, {"city": "a"}, {"state": "a"}, {"drop_terms": ["x"]})}
    assert len(names) == 4
    assert collocation_paths("o", "x")["by_time"] is None


@pytest.fixture(scope="module")
def by_time(spark):
    data = [
        ("1900-01-01", "a", 5, 1), ("1900-01-01", "b", 4, 2), ("1900-01-01", "c", 1, 3),
        ("1900-02-01", "c", 9, 1), ("1900-02-01", "a", 2, 2), ("1900-03-01", "d", 1, 1),
    ]
    return spark.createDataFrame(data, "time_bin string, collocate_term string, frequency bigint, ordinal_rank bigint")


def test_home_bin_is_clamped(by_time):
    names = lambda n: [r.collocate_term for r in ranks.home_bin_terms(by_time, 2, n).orderBy("term_order").collect()]
    assert names(1) == names(0) == names(-3) == ["a", "b"]
    assert names(2) == ["c", "a"]
    assert names(99) == ["d"]


def test_global_terms_and_series(by_time):
    top = ranks.global_terms(by_time, 2)
    assert [(r.collocate_term, r.mean_rank) for r in top.orderBy("term_order").collect()] == [("d", 1.0), ("a", 1.5)]
    assert ranks.rank_series(by_time, top).count() == 3


def test_matrix_keeps_bins_without_the_terms(by_time):
    got = ranks.rank_matrix(by_time, ["a", "zz"]).collect()
    assert [(r.time_bin, r.a, r.zz) for r in got] == [("1900-01-01", 1, None), ("1900-02-01", 2, None), ("1900-03-01", None, None)]


def test_drop_candidates(rows, spark):
    metrics = stage(rows([(f"t{i:03}", 1000 - i) for i in range(300)], "collocate_term string, frequency bigint"), "m")
    got = {r.collocate_term: r for r in ranks.drop_candidates(metrics, ["t200", "t001", "gone"]).collect()}
    assert len(got) == 152
    assert (got["t200"].rank, got["t001"].selected, got["t002"].selected) == (201, True, False)
    assert (got["gone"].rank, got["gone"].frequency) == (None, None)


def test_tables_are_checked(rows):
    with pytest.raises(ValueError, match="frequency"):
        ranks.top_collocates(rows([("a",)], "collocate_term string"))
