"""SimHash groups against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from broadsheet.llm import simhash
from broadsheet.llm.components import components
from fixtures_llm import awkward, sentence, with_clashes


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Smallest reachable index of each, over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", " \n", "One", "A b C", "A b C d", "a a a a a a", "É É b c d e", sentence(2, 300)])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def cloud(n, centers, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centers)]
    out = set(base)
    while len(out) < n:
        out.add(rng.choice(list(base)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    return sorted(out)


@pytest.mark.parametrize("parts, run", [(1, 1024), (2, 1024), (3, 1024), (3, 8), (3, 20)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, parts, run):
    monkeypatch.setattr(simhash, "RUN", run)  # short runs force the full ball
    prints = cloud(300, 3, parts * 100 + run)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "simhash long").repartition(3)
    found = components(simhash.links(frame, parts=parts)).collect()
    roots = {r.node % (1 << 64): r.root for r in found}
    want = brute_groups(prints)
    got = [roots.get(p, p - (1 << 64) if p >> 63 else p) for p in prints]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (7, None)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a)
        root.setdefault(b, b)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    touched = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in touched}


def near_copies(spark):
    long = sentence(4, 400)
    texts = [(i, sentence(i, 60 + i)) for i in range(40)]
    texts += [(100 + i, long + " " + sentence(i, 1)) for i in range(6)] + [(200, long), (201, long), (None, long), (200, long)]
    return spark.createDataFrame(texts, "doc_id long, text string")


@pytest.mark.parametrize("make", [near_copies, awkward])
def test_groups_of_documents(spark, make):
    docs = make(spark)
    rows = docs.collect()
    prints = [brute_print(r.text) for r in rows]
    groups = brute_groups(prints)
    least = {}
    for r, g in zip(rows, groups):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, groups)), key=str)
    assert sorted(map(tuple, simhash.simhash_components(docs).collect()), key=str) == want


@pytest.mark.parametrize("make", [near_copies, awkward])
def test_one_row_of_each_group_stays(spark, make):
    docs = with_clashes(make(spark))
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    found = simhash.simhash_components(make(spark)).where("component_id IS NOT NULL")
    ids = [r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()]
    assert sorted(ids) == sorted(r.component_id for r in found.select("component_id").distinct().collect())


def test_empty_tables(spark):
    none = near_copies(spark).limit(0)
    assert simhash.simhash_components(none).count() == 0
    assert simhash.without_near_copies(none).count() == 0


def test_variants_meet_half_way():
    assert len(simhash._ball(list(range(64)), 2)) == 1 + 64 + 2016


def test_hot_groups_make_few_rows(spark):
    prints = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in cloud(400, 1, 5)], "simhash long")
    assert simhash.links(prints).count() < 60_000
    copies = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(sentence(1, 50)).alias("text"))
    assert {r.component_id for r in simhash.simhash_components(copies).collect()} == {0}
    assert np.uint64(0) == np.bitwise_count(np.uint64(0))


def test_last_piece_of_a_long_run_is_dense():
    import pyarrow as pa

    prints = np.random.default_rng(5).integers(0, 1 << 62, simhash.RUN + 104)
    keys = np.full(len(prints), 7)
    keys[-1] = 8
    edges = [0, simhash.RUN + 100, len(prints)]  # three rows of the run come in the second batch
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(prints[a:b])], ["key", "simhash"]) for a, b in zip(edges, edges[1:])]
    found = [row for batch in simhash._verified(iter(batches)) for row in batch.to_pylist()]
    assert {r["a"] for r in found if r["b"] is None} == set(prints[:-1].tolist())
