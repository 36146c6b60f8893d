"""Heat frames from events, and ranks from ranges of rows."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from broadsheet.functions.ranking import rank_by_frequency
from broadsheet.operators import mapping

POINT = "lat double, lon double, day date"


@pytest.mark.parametrize(("unit", "size", "linger_unit", "linger"), [("day", 1, "year", 1), ("week", 2, "week", 0), ("month", 1, "day", 3), ("day", 3, "month", 2)])
def test_frames_equal_points_added_up(spark, unit, size, linger_unit, linger):
    pick = random.Random(linger + size)
    first = dt.date(1900, 1, 1)
    rows = [(pick.choice([1.0, 1.0, 2.5, -0.0]), pick.choice([3.0, 4.25]), first + dt.timedelta(pick.randrange(200))) for _ in range(300)]
    points = spark.createDataFrame([*rows, (1.0, 3.0, None)], POINT)
    groups = mapping.map_groups(points)
    ask = {"unit": unit, "size": size, "linger_unit": linger_unit, "linger": linger, "multiplier": 0.1}
    each = mapping.heat_frames(points, groups, per_point=True, **ask).collect()
    want, weight = Counter(), {}
    for r in each:
        want[r.frame_no, r.frame_time, r.lat + 0.0, r.lon] += 1
        weight[r.lat + 0.0, r.lon] = r.weight
    got = mapping.heat_frames(points, groups, **ask).collect()
    assert {(r.frame_no, r.frame_time, r.lat + 0.0, r.lon): r.points for r in got} == want and len(got) == len(want)
    assert all(r.weight == weight[r.lat + 0.0, r.lon] * r.points for r in got)


def made(plan, node):
    """Rows out of each node of a kind in an executed plan."""
    found, todo = [], [plan]
    while todo:
        at = todo.pop()
        name = at.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(at.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(at.plan())
            continue
        if name == node:
            found.append(at.metrics().apply("numOutputRows").value())
        todo += [at.children().apply(i) for i in range(at.children().size())]
    return found


def test_rows_before_the_sum_do_not_grow_with_linger(spark):
    first = dt.date(1900, 1, 1)
    rows = [(1.0, float(i % 5), first + dt.timedelta(i % 100)) for i in range(1000)]
    points = spark.createDataFrame(rows, POINT)
    shown = mapping.heat_frames(points, mapping.map_groups(points), unit="day", size=1, linger_unit="year", linger=1)
    shown.collect()
    events = sorted(made(shown._jdf.queryExecution().executedPlan(), "Generate"))
    # two for each place and day; what comes after the running sum is the result
    assert events[0] == 2 * 100 and events[-1] == shown.count()


def test_ranks_of_terms_with_one_beginning(spark):
    n = 200_000
    terms = spark.range(n).select(F.format_string("aaaaaaaaaa%07d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("t"), F.lit(1).cast("long").alias("n"))
    ranked = rank_by_frequency(terms, [], "n", "t", "k")
    assert ranked.where("k <> cast(substring(t, 11) as long) + 1").isEmpty() and ranked.count() == n
    spread = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    assert max(spread) < 3 * sorted(spread)[len(spread) // 2]


def test_the_sorted_rows_lie_in_ranges_of_like_size(spark, tmp_path):
    kept = []

    def put(df, label):
        df.write.parquet(str(tmp_path / label))
        kept.append(spark.read.schema(df.schema).parquet(str(tmp_path / label)))
        return kept[-1]

    n = 100_000
    terms = spark.range(n).select(F.format_string("aaaaaaaaaa%07d", "id").alias("t"), F.lit(1).cast("long").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rank_by_frequency(terms, [], "n", "t", "k", put=put)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in kept[0].groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * n / 4


def test_ranks_with_null_groups_and_empty_tables(spark):
    rows = [(None, "b", 2), (None, "a", 2), (None, "c", 9), ("g", "a", 1), ("g", "b", 5)]
    table = spark.createDataFrame(rows, "g string, t string, n long")
    got = {(r.g, r.t): r.k for r in rank_by_frequency(table, ["g"], "n", "t", "k").collect()}
    assert got == {(None, "c"): 1, (None, "a"): 2, (None, "b"): 3, ("g", "b"): 1, ("g", "a"): 2}
    assert rank_by_frequency(table.limit(0), ["g"], "n", "t", "k").collect() == []
