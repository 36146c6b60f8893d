"""Session helpers: shared scratch folder, staged tables, scalar subqueries."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH = "spark.checkpoint.dir"
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A session without that setting gets a temporary folder only in local mode, where driver and tasks
    are one process; anywhere else a missing setting is an error, because a machine-local folder would
    be unseen by other machines and lost with its own.
    """
    named = spark.conf.get(_SCRATCH, None) or spark.sparkContext.getConf().get(_SCRATCH)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"set {_SCRATCH} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="broadsheet-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several outputs start from one costly result: the text is then tokenized once, and
    a lost executor costs a re-read of files and no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files when they end; else these wait for a garbage collection of the driver."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)


@contextmanager
def staging(spark: SparkSession, *, keep_shuffles: bool = True) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``stage`` for the length of a run: its folders are removed, by Spark's own file system, when it ends.

    Without ``keep_shuffles`` the shuffle files behind a staged table go as soon as it is written.
    """
    paths: list[str] = []

    def put(df: DataFrame, label: str) -> DataFrame:
        paths.append(scratch_path(spark, label))
        with nullcontext() if keep_shuffles else _shuffles_removed(spark):
            df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield put
    finally:
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def local_table(spark: SparkSession, rows: Iterable[tuple], **types: pa.DataType) -> DataFrame:
    """A small driver-side table as a local relation, whose size the optimizer knows."""
    columns = list(zip(*rows)) or [()] * len(types)
    arrays = [pa.array(list(c), t) for c, t in zip(columns, types.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(types)))


def scalar(df: DataFrame, expression: Column, *, keep: Iterable[str] = ()) -> Column:
    """One aggregate over ``df`` as a scalar subquery: no join, no one-task window.

    A subquery that reads fewer columns than the main query has a plan of its own and computes
    ``df`` again. Columns named in ``keep`` stay in its plan, so that both share one shuffle.
    """
    alive = [F.max(F.struct(*keep)).alias("alive")] if keep else []
    return df.agg(F.struct(expression.alias("v"), *alive).alias("s")).scalar()["v"]


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    An alias used inside a lambda is inlined by the optimizer and then evaluated once per array
    element. A lambda variable is evaluated exactly once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
