"""Exact ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.runtime import local_table, stage


def rank_by_frequency(
    counts: DataFrame,
    group: list[str],
    frequency: str,
    term: str,
    out: str,
    *,
    put: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """1..n inside each group by frequency descending, then term ascending.

    A window over a whole group would sort that group in one task, and a vocabulary of scanned
    text has no useful bound. Here rows are dealt to tasks by ranges of (group, frequency, term), whose ends
    Spark draws from a sample of the rows, so a large group, a frequent count or a common beginning of
    terms is split like any other stretch of rows. Each task sorts its range and numbers it after
    the rows of the tasks ahead; a group begins with its least number. The sorted rows are written
    to the shared folder once, because a second look must see the same ranges; ``put`` of a run's
    ``staging`` removes them with the run.
    """
    spark = counts.sparkSession
    in_order = [*group, F.desc(frequency), F.asc(term)]
    ranged = counts.repartitionByRange(*in_order).sortWithinPartitions(*in_order)
    ranged = put(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    # The upper part of the number is the task's. A row per task comes to the driver, which knows its tasks.
    task = F.shiftright("_at", 33).cast("int").alias("_task")
    counted = sorted(tuple(row) for row in ranged.groupBy(task).agg(F.count("*")).collect())
    before = accumulate((n for _, n in counted), initial=0)
    ahead = local_table(spark, [(t, b) for (t, _), b in zip(counted, before)], _task=pa.int32(), _ahead=pa.int64())
    place = F.col("_at") - F.shiftleft(F.col("_task").cast("long"), 33) + F.col("_ahead") + 1
    placed = ranged.withColumn("_task", task).join(ahead, "_task").withColumn("_place", place)
    if not group:
        return placed.select(*counts.columns, F.col("_place").cast("long").alias(out))
    first = placed.groupBy(*(F.col(g).alias(f"_of_{i}") for i, g in enumerate(group))).agg(F.min("_place").alias("_first"))
    same = [F.col(g).eqNullSafe(F.col(f"_of_{i}")) for i, g in enumerate(group)]
    rank = F.col("_place") - F.col("_first") + 1
    return placed.join(first, same).select(*counts.columns, rank.cast("long").alias(out))


def first_rows(
    df: DataFrame,
    group: list[str],
    order: list[str],
    n: int,
    *,
    slices: int = 32,
    number: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group by the columns in ``order``.

    Taken first inside slices of each group, by a hash of the order columns, and then among the
    slices' winners, so a group that holds most of the rows is still sorted by many tasks. Both
    steps compile to a group limit that runs before the shuffle. ``number`` names a column to keep
    the place in.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    near = Window.partitionBy(*group, "_slice").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    first = (
        sliced.withColumn("_n", F.row_number().over(near))
        .where(F.col("_n") <= n)
        .withColumn("_n", F.row_number().over(final))
        .where(F.col("_n") <= n)
        .drop("_slice")
    )
    return first.withColumnRenamed("_n", number) if number else first.drop("_n")
