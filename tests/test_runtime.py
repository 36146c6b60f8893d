from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from broadsheet.runtime import let, local_table, scalar, shared_dir, stage


def fake(master, **named):
    conf = dict(named)
    context = SimpleNamespace(master=master, applicationId="a", getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake("spark://host:7077"))
    named = fake("yarn", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert shared_dir(named) == "hdfs:///shared"


def test_stage_uses_the_named_folder(spark):
    staged = stage(spark.range(5), "five")
    assert all(shared_dir(spark) in name for name in staged.inputFiles())
    assert sorted(r.id for r in staged.collect()) == list(range(5))


def test_let_and_scalar(spark):
    df = spark.range(4)
    assert df.select(let(F.col("id") + 1, lambda v: v * v).alias("v")).agg(F.sum("v")).first()[0] == 30
    assert df.where(F.col("id") == scalar(df, F.max("id"))).count() == 1


def test_local_table(spark):
    import pyarrow as pa

    assert local_table(spark, [], a=pa.int32(), b=pa.string()).count() == 0
    assert local_table(spark, [(1, "x")], a=pa.int32(), b=pa.string()).first().b == "x"
