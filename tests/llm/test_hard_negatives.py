"""Hard negatives against scoring everything."""

import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import hard_negatives, registry
from broadsheet.runtime import shared_dir

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=256, positives=5, negatives=3, low=50, high=95):
    """Rows (vec_id, embedding, label) with every pair scored."""
    kept = []
    for key, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((key, [math.floor(scale * float(np.float32(x))) for x in vector], label))
    order = [(key is None, key or 0) for key, _, _ in kept]
    out = []
    for i, (key, vector, label) in enumerate(kept):
        if key is None or key % 50:
            continue
        score = [sum(a * b for a, b in zip(vector, other)) for _, other, _ in kept]
        turn = sorted((j for j in range(len(kept)) if j != i), key=lambda j: (-score[j], order[j], j))
        for p in [j for j in turn if kept[j][2] == label][:positives]:
            inside = [j for j in turn if kept[j][2] != label and low * score[p] <= 100 * score[j] <= high * score[p]]
            out += [(key, kept[p][0], rank, kept[j][0], score[p], score[j]) for rank, j in enumerate(inside[:negatives], 1)]
    return sorted(out, key=str)


def mined(frame, **sizes):
    return sorted((tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % 50 == 0, **sizes).collect()), key=str)


def drawn(seed, n, dims=6, labels=3, spread=0.4):
    pick = random.Random(seed)
    middles = [[pick.gauss(0, 0.3) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = pick.randrange(labels)
        rows.append((i * 5, [pick.gauss(m, spread) for m in middles[label]], label))
    return rows


@pytest.mark.parametrize(("block_rows", "block_anchors"), [(10_000, 10_000), (37, 5), (8, 1)])
def test_against_all_scores(spark, block_rows, block_anchors):
    rows = drawn(1, 260) + [(2, [1.0] * 6, 0), (50_000, [0.0] * 6, 1), (50_050, [-0.5] * 6, 2)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert mined(frame, block_rows=block_rows, block_anchors=block_anchors) == brute(rows)


def test_ties_copies_nulls_and_lengths(spark):
    same = [(i * 10, [0.5, 0.25, -0.125], i % 2) for i in range(30)]
    near = [(1000 + i, [0.4, 0.2, -0.1], i % 3) for i in range(30)]
    odd = [
        (50, [0.5, 0.25], 1), (50, [0.5, 0.25], 1), (None, [0.4, 0.2, -0.1], 0), (100, None, 0), (150, [0.5, None, 1.0], 0), (200, [math.nan, 0.5, 1.0], 0),
        (250, [math.inf, 0.5, 1.0], 0), (300, [], 0), (350, [0.5, 0.25, -0.125, 0.75, 0.5], 2), (400, [0.5, 0.2, 0.0], None), (-50, [0.45, 0.2, 0.0], -1),
    ]
    rows = same + near + odd
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for sizes in ({}, {"block_rows": 9, "block_anchors": 4}):
        assert mined(frame, **sizes) == brute(rows)


def test_large_components(spark):
    rows = [(i * 25, [random.Random(i).gauss(0, 2.0**18), 3.0, -(2.0**19)], i % 4) for i in range(60)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    with pytest.raises(Exception, match="norm above"):
        mined(spark.createDataFrame([(0, [1e30], 1)], SCHEMA))


def test_lists_leave_out_what_cannot_reach_the_limit():
    rows = drawn(3, 400, dims=32)
    table = pa.table(
        {
            "row": pa.array(range(400)), "id": pa.array([r[0] for r in rows]), "label": pa.array([str(r[2]) for r in rows]),
            "parts": pa.array([[math.floor(256 * x) for x in r[1]] for r in rows]),
        }
    )
    block = hard_negatives._Block(table)
    vectors = hard_negatives._matrix(table)[:, block._dims]
    search = hard_negatives._Search(block, vectors[0], np.ones(400, bool))
    exact = vectors @ vectors[0]
    for limit in (search.most * 0.9, search.most * 0.5, search.most * 0.2, 1.0, -np.inf):
        found, scores = search.at_least(limit)
        assert sorted(found) == sorted(np.flatnonzero(exact >= limit)) and (scores == exact[found]).all()
        if limit > search.most * 0.4:
            assert 8 * search.added.sum() < 0.8 * vectors.size


def test_other_columns_empty_tables_and_staged_folders(spark):
    rows = drawn(5, 120)
    frame = spark.createDataFrame(rows, SCHEMA)
    names = "row id parts is_anchor r a score other windows place rank anchor".split()
    assert mined(frame.selectExpr("*", *[f"'mine' AS `{n}`" for n in names])) == brute(rows)
    assert mined(frame.limit(0)) == [] and mined(frame.where("vec_id % 50 <> 0")) == []
    shared = Path(shared_dir(spark))
    before = set(shared.iterdir())
    registry.queries()["op13_hard_negatives"](spark, "/root/testdata/sf0.001").count()
    assert [p.name[:14] for p in set(shared.iterdir()) - before] == ["hard-negatives"]
