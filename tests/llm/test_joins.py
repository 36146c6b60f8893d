"""Decontamination and sharding against brute force."""

import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import columns, decontamination, registry, sharding
from fixtures_llm import awkward, sentence, with_clashes

BENCH = "item_id long, text string"
PASSAGE = "the quick brown fox jumps over a lazy dog while nine old owls watch from their dark tree at noon today"


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_overlaps(docs, items):
    """Every alignment of every distinct passage with every text."""
    distinct = {}
    for item_id, text in items:
        w = tuple(words_of(text))
        if len(w) >= decontamination.LEAST_WORDS:
            distinct[w] = min(item_id, distinct.get(w, item_id))
    out = {}
    for doc_id, text in docs:
        own = words_of(text)
        for w, item_id in distinct.items():
            n = len(w)
            width = min(decontamination.STRETCH, n)
            need = n if n < 7 else -(-8 * width // 10)
            for start in range(-n + 1, len(own)):
                same = [0 <= start + i < len(own) and own[start + i] == w[i] for i in range(n)]
                if max(sum(same[i : i + width]) for i in range(n - width + 1)) >= need:
                    key, value = (doc_id, item_id), (sum(same), -start)
                    out[key] = max(out.get(key, value), value)
    return {(d, i): (m, -s) for (d, i), (m, s) in out.items()}


def changed(text, *places):
    w = text.split()
    for p in places:
        w[p] = "other"
    return " ".join(w)


CASES = [
    PASSAGE, PASSAGE.upper() + "!", "before it " + PASSAGE + " and after", changed(PASSAGE, 3), changed(PASSAGE, 2, 9, 15), changed(PASSAGE, 4, 8, 12, 16),
    changed(PASSAGE, 1, 3, 5, 7, 9, 11), " ".join(PASSAGE.split()[:9]), PASSAGE.replace(" ", ", "), "nothing here at all", "", None, " ".join(reversed(PASSAGE.split())),
    "one two three four five", "one two three four six", sentence(3, 400) + " " + PASSAGE, PASSAGE + " " + PASSAGE,
]
ITEMS = [(1, PASSAGE), (5, PASSAGE.title()), (2, "one two three four five"), (3, "too short"), (4, None), (6, ""), (7, "gap " + PASSAGE)]


def test_overlaps_against_all_alignments(spark):
    docs = [(i, t) for i, t in enumerate(CASES)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): (r.matched, r.position) for r in decontamination.overlaps(frame, spark.createDataFrame(ITEMS, BENCH)).collect()}
    want = brute_overlaps(docs, ITEMS)
    assert got == want
    assert {d for d, _ in got} >= {0, 1, 2, 3, 4, 8, 13, 15, 16} and not {d for d, _ in got} & {7, 9, 10, 11, 12, 14}


def test_seeds_meet_every_allowed_choice_of_replaced_words():
    from itertools import combinations

    def met(n, missing):
        return any(
            all(s + i not in missing for i, mark in enumerate(seed) if mark == "1")
            for seed in decontamination.SEEDS
            for s in range(n - len(seed) + 1)
        )

    for n in range(7, decontamination.STRETCH + 1):  # a stretch of a longer passage is as one of that length
        allowed = n - -(-8 * n // 10)
        assert all(met(n, set(missing)) for missing in combinations(range(n), allowed)), n


def test_passages_with_replaced_words_in_the_middle(spark):
    cases = [(7, (5,)), (10, (3, 4)), (10, (4, 5)), (10, (5, 6)), (11, (4, 5)), (11, (5, 6)), (12, (5, 6))]
    words = PASSAGE.split()
    items = [(n, " ".join(words[:n])) for n in (7, 10, 11, 12)]
    docs = [(i, f"some rain before {changed(' '.join(words[:n]), *places)} and snow after") for i, (n, places) in enumerate(cases)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH)
    got = {(r.doc_id, r.item_id): (r.matched, r.position) for r in decontamination.overlaps(frame, bench).collect()}
    assert got == brute_overlaps(docs, items)
    assert all((i, n) in got for i, (n, _) in enumerate(cases))


def test_rows_without_leaks(spark):
    docs = with_clashes(spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] + [(None, PASSAGE), (None, "fine"), (0, PASSAGE)], "doc_id long, text string"))
    bench = spark.createDataFrame(ITEMS, BENCH)
    kept = decontamination.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([6, 7, 9, 10, 11, 12, 14, None], key=str)
    assert decontamination.without_leaks(docs, bench.limit(0)).count() == docs.count()
    assert decontamination.without_leaks(docs.limit(0), bench).count() == 0
    assert decontamination.overlaps(awkward(spark), bench).count() == 0


def test_a_passage_in_many_texts_makes_a_row_each(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x " + PASSAGE).alias("text"))
    assert decontamination.overlaps(docs, spark.createDataFrame(ITEMS[:2], BENCH)).count() == 3000


def test_no_python_runs_in_native_plans(spark):
    for name in ("op2_decontamination", "op7_sharding"):
        plan = getattr(registry, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", plan)


def check_shards(docs, got):
    assert len(got) == docs.count()
    sizes = collections.Counter(r.shard for r in got)
    counts = [sizes[s] for s in range(sharding.SHARDS)]
    assert max(counts) - min(counts) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}


@pytest.mark.parametrize("share", [0.0, 0.35, 1.0])
def test_shards_with_a_hot_group(spark, share):
    docs = spark.range(1205).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < int(1205 * share), "hot").when(F.col("id") % 5 < 3, F.concat(F.lit("g"), (F.col("id") / 10).cast("int"))).otherwise(F.col("id").cast("string")).alias("text"),
    )
    got = sharding.shard_documents(docs).collect()
    check_shards(docs, got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    spread = collections.defaultdict(set)
    for r in got:
        spread[texts[r.doc_id]].add(r.shard)
    assert sum(len(v) > 1 for k, v in spread.items() if k != "hot") <= 2


def test_shards_of_awkward_rows(spark):
    docs = with_clashes(awkward(spark))
    check_shards(docs, sharding.shard_documents(docs).collect())
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    same = spark.range(100).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    check_shards(same, sharding.shard_documents(same).collect())


def test_members_move_together(spark):
    rows = [(p, s, 3) for p in range(20) for s in (p % 40, (p * 7 + 1) % 40, (p * 3 + 2) % 40)]
    state = spark.createDataFrame(rows, "part long, shard int, n long").dropDuplicates(["part", "shard"])
    got = sharding.propagate(state, dict.fromkeys(range(40), 30)).collect()
    ends = collections.defaultdict(set)
    for r in got:
        ends[r.part].add(r.shard)
    assert all(len(v) == 1 for v in ends.values())


def ends_of_copies(spark, n, hot, linked, size):
    """Shards that the hot text and each group of ``size`` copies end in; shares are of ``n`` rows."""
    i, edge, last = F.col("id"), int(n * hot), int(n * (hot + linked))
    copies = F.concat(F.lit("g"), ((i - edge) / size).cast("long"))
    docs = spark.range(n).select(i.alias("doc_id"), F.when(i < edge, "hot").when(i < last, copies).otherwise(i.cast("string")).alias("text"))
    got = sharding.shard_documents(docs).collect()
    check_shards(docs, got)
    ends = collections.defaultdict(set)
    for r in got:
        ends["hot" if r.doc_id < edge else (r.doc_id - edge) // size if r.doc_id < last else None].add(r.shard)
    ends.pop(None, None)
    return ends.pop("hot", set()), list(ends.values())


@pytest.mark.parametrize("linked", [0.925, 0.975])
def test_copies_meet_where_most_rows_have_one(spark, linked):
    _, groups = ends_of_copies(spark, 8000, 0, linked, 10)
    assert sum(len(v) > 1 for v in groups) <= 0.02 * len(groups)


@pytest.mark.parametrize("hot, linked, size", [(1 / 3, 0.3, 4), (0.011, 0.65, 4), (0.0, 1.0, 2), (1.0, 0.0, 1)])
def test_parts_meet_where_shards_have_room(spark, hot, linked, size):
    n = 8000
    spread, groups = ends_of_copies(spark, n, hot, linked, size)
    parts = -(-int(n * hot) // (n // sharding.SHARDS // 2))
    assert len(spread) <= min(parts + 2, sharding.SHARDS)
    assert sum(len(v) > 1 for v in groups) < sharding.SHARDS


def test_few_parts_are_cut_where_shards_are_full(spark):
    sizes = [7] * 80 + [4] * 60 + [50] * 8  # 1,200 rows fill 40 shards of 30; 50 fit nowhere
    rows = [(p, (p * 11 + i) % 40, 1) for p, n in enumerate(sizes) for i in range(n)]
    cells = spark.createDataFrame(rows, "part long, shard int, n long").groupBy("part", "shard").agg(F.sum("n").alias("n"))
    got = sharding.propagate(cells, dict.fromkeys(range(40), 30)).collect()
    started = {(r.part, r.shard): r.n for r in cells.collect()}
    load, ends, held = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for r in got:
        n = started[r.part, r.start] if r.lo is None else r.hi - r.lo
        load[r.shard] += n
        held[r.part] += n
        ends[r.part].add(r.shard)
    assert set(load.values()) == {30} and [held[p] for p in range(len(sizes))] == sizes
    assert sum(len(v) > 1 for v in ends.values()) < sharding.SHARDS


def test_passages_without_id_are_found(spark):
    texts = [PASSAGE, "one two three four five", "nothing here at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(None, PASSAGE), (None, texts[1]), (4, "some other words that stand nowhere")], BENCH)
    got = decontamination.overlaps(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.item_words) for r in got) == [(0, None, 21), (1, None, 5)]
    assert [r.doc_id for r in decontamination.without_leaks(docs, bench).collect()] == [2]


def test_overlaps_with_a_benchmark_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(columns, "BROADCAST_ROWS", 5)
    items = ITEMS + [(100 + p, " ".join(f"w{p}x{i}" for i in range(30))) for p in range(20)]  # seeds for several blocks
    texts = CASES + [f"left {changed(items[p][1], *places)} right" for p, places in ((7, ()), (9, (3, 8, 15)), (26, (1, 2, 3, 4, 29)), (12, range(0, 30, 2)))]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): (r.matched, r.position) for r in decontamination.overlaps(frame, spark.createDataFrame(items, BENCH)).collect()}
    assert got == brute_overlaps(docs, items)
    assert {(17, 100), (18, 102), (19, 119)} <= got.keys() and not any(d == 20 for d, _ in got)


def test_no_seed_fails_the_filter(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    others = spark.range(5000, 105_000).select(F.xxhash64("id").alias("key"))
    assert decontamination._likely(keys, keys).count() == 5000
    assert decontamination._likely(others, keys).count() < 1000


@pytest.mark.parametrize("most", [columns.BROADCAST_ROWS, 5])
def test_a_long_text_with_many_hits(spark, monkeypatch, most):
    """A row per hit, or per seed that is shuffled, must not hold the words of the text: here they came to ten gigabytes."""
    monkeypatch.setattr(columns, "BROADCAST_ROWS", most)
    docs = spark.createDataFrame([(0, " ".join([PASSAGE] * 1000)), (1, PASSAGE)], "doc_id long, text string")
    got = decontamination.overlaps(docs, spark.createDataFrame(ITEMS[:1], BENCH)).collect()
    assert sorted((r.doc_id, r.item_id, r.position, r.matched) for r in got) == [(0, 1, 0, 21), (1, 1, 0, 21)]


@pytest.mark.parametrize("most", [columns.BROADCAST_ROWS, 0])
def test_equal_keys_and_texts_are_merged(spark, monkeypatch, most):
    monkeypatch.setattr(columns, "BROADCAST_ROWS", most)
    five = "one two three four five"
    docs = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (1, f"x {five}"), (2, PASSAGE), (None, PASSAGE), (None, None)], "doc_id long, text string")
    got = decontamination.overlaps(docs, spark.createDataFrame([(1, PASSAGE), (2, five)], BENCH)).collect()
    assert sorted(((r.doc_id, r.item_id, r.position) for r in got), key=str) == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (None, 1, 0)]
