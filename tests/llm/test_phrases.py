"""Collocations against counting by hand."""

import collections
import random
import re
import string
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from broadsheet.llm import collocations, registry
from broadsheet.runtime import shared_dir
from fixtures_llm import awkward, with_clashes

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "lang string, text string"


def brute(rows, least, longest, top, absorbed=100):
    counts, sizes = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = collections.defaultdict(list)
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < least:
            continue
        n = sizes[lang]
        cuts = [(1000 * a * n // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        holders = (f for (g, w), f in counts.items() if g == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w))))
        if any(100 * f >= absorbed * a for f in holders):
            continue
        found[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]], n))
    out = []
    for lang, ranked in found.items():
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def drawn(seed, rows, words=9):
    pick = random.Random(seed)
    names = ["a", "B", "ü", "don't", "x y", "#", "É", "the", "of", "new", "york"][:words]
    out = []
    for _ in range(rows):
        parts = [pick.choice(names) + pick.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " ", " "]) for _ in range(pick.randrange(40))]
        out.append((pick.choice(["en", "de", None, ""]), "".join(parts)))
    return out


CASES = [(7, 1, 5, 10_000), (50, 4, 5, 30), (10_000, 1, 5, 10_000), (9, 3, 2, 50), (50, 2, 4, 7)]


@pytest.mark.parametrize(("shard_words", "least", "longest", "top"), CASES)
def test_against_counting(spark, shard_words, least, longest, top):
    rows = drawn(least, 60) + [("en", "new york " * 90), ("en", "New York of the new york"), (None, None), ("de", "")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = collocations.collocations(frame, least=least, longest=longest, top=top, shard_words=shard_words)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, least, longest, top)


@pytest.mark.parametrize("shard_words", [30, 1 << 19])
def test_longer_phrases_are_a_row_per_word_at_most(shard_words):
    rows = drawn(3, 80) + [("en", "new york new york the new of " * 9)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    found, want = collections.Counter(), collections.Counter()
    for shard in collocations._shards(iter([batch]), shard_words, 5):
        index = collocations._Index(collocations._index_row(0, shard, 5))
        sent = list(index.runs(np.arange(len(index.pairs().size)), 5))
        assert 0 < sum(b.num_rows for b in sent) <= len(shard.words.ends)
        assert len({(r["phrase"], r["more"]) for b in sent for r in b.to_pylist()}) == sum(b.num_rows for b in sent)
        for r in (r for b in sent for r in b.to_pylist()):
            words, lang = r["phrase"].split("\n")
            more = r["more"].split(" ") if r["more"] else []
            for k in range(len(more) + 1):
                found[lang, tuple([*words.split(" "), *more[:k]])] += r["count"]
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or "und", tuple(words[i : i + k])) for k in (3, 4, 5) for i in range(len(words) - k + 1))
    assert {k: v for k, v in found.items() if v} == want


def test_share_of_a_longer_phrase(spark):
    rows = [("en", "in spite of, in spite of, in spite of, in spite")] * 3
    for absorbed in (100, 75, 70):
        found = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=3, absorbed=absorbed)
        assert sorted(tuple(r) for r in found.collect()) == brute(rows, 3, 5, 2000, absorbed)


def test_cuts_in_a_long_piece_count_nothing_twice(spark):
    rows = [("en", "one two three four five six seven " * 3000)]
    found = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=100, shard_words=11)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 100, 5, 2000)


def test_words_that_collide_in_weak_hashes_stay_apart(spark):
    turn = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = turn.translate(str.maketrans("ab", "ba"))
    rows = [("en", f"{turn} {other}")] * 3 + [("en", f"{other} {turn}")] * 2
    found = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=2)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 2, 5, 2000)


def test_scores_beyond_64_bits(spark):
    totals = [("en", "a", 3 * 10**15), ("en", "b", 7 * 10**9), ("en", "a b", 5 * 10**9)]
    totals = spark.createDataFrame(totals, "lang string, phrase string, f long")
    sizes = spark.createDataFrame([("en", 9 * 10**16 + 7)], "lang string, n long")
    row = collocations._scored(totals, sizes).first()
    assert row["score"] == 1000 * 5 * 10**9 * (9 * 10**16 + 7) // (3 * 10**15 * 7 * 10**9)


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    rows = [r for r in rows if len(r[1] or "") < 100_000]
    short = docs.where("text is null or length(text) < 100000")
    for frame in (short, with_clashes(short)):
        found = collocations.collocations(frame, least=2, top=50)
        assert sorted(tuple(r) for r in found.collect()) == brute(rows, 2, 5, 50)
    none = collocations.collocations(docs.limit(0))
    assert none.columns == "lang rank phrase a l r n score".split() and not none.count()
    assert collocations.collocations(docs).columns == none.columns


def test_query_leaves_only_its_result_staged(spark):
    shared = Path(shared_dir(spark))
    before = set(shared.iterdir())
    registry.queries()["op11_collocations"](spark, "/root/testdata/sf0.001").count()
    assert [p.name.split("-")[0] for p in set(shared.iterdir()) - before] == ["collocations"]
