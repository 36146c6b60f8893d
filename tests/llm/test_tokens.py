"""Token counts, packing and token files against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from broadsheet.llm import packing, token_files
from broadsheet.llm.arrays import slices
from broadsheet.llm.pretokens import BytePairs
from broadsheet.llm.token_counts import count_tokens
from fixtures_llm import awkward, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def random_texts(seed, n):
    rng = random.Random(seed)
    parts = list("abstrevmld'’ \n\t!.,12é") + "'s 're 'll   \n\n 漢 Ⅷ ² 😀   <|endoftext|> \x00 \x85 '' 'S".split(" ") + ["  ", " '"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    points = lambda: rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])
    return texts + ["".join(chr(points()) for _ in range(12)) for _ in range(n // 4)] + ["", None]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", [7, 1 << 20])
def test_ids_equal_the_library(seed, limit):
    texts, encoder = random_texts(seed, 800), BytePairs(PATH)
    whole, got, counted = encoder.whole_tokens(), [], []
    for part in slices(pa.array(texts), limit):
        ids, at = encoder.encode(part)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        counted += encoder.counts(part, whole).tolist()
    assert got == [ids_of(t) for t in texts]
    assert counted == [len(i) for i in got]


def test_a_full_cache_is_forgotten(monkeypatch):
    monkeypatch.setattr("broadsheet.llm.pretokens.CACHE_PIECES", 50)
    encoder, texts = BytePairs(PATH), random_texts(9, 300)
    got = []
    for part in slices(pa.array(texts), 200):
        ids, at = encoder.encode(part)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [ids_of(t) for t in texts]


def test_what_was_counted_is_not_merged_again(monkeypatch):
    encoder, text = BytePairs(PATH), "plain words, qzxvvk words 123 and plain ones"
    part = next(slices(pa.array([text])))
    assert encoder.counts(part, encoder.whole_tokens()).tolist() == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]
    monkeypatch.setattr(encoder, "merged", lambda piece: pytest.fail(f"{piece} is merged again"))
    assert encoder.encode(part)[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_known_pretokens_are_not_sorted_again(monkeypatch):
    encoder, texts = BytePairs(PATH), ["plain words, qzxvvk words 123", "123 qzxvvk and", None, "words" * 40, " and words" * 3]
    part = next(slices(pa.array(texts)))
    encoder.encode(part)
    monkeypatch.setattr("broadsheet.llm.pretokens.distinct_ranges", lambda *_: pytest.fail("known pre-tokens are brought together"))
    ids, at = encoder.encode(part)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ids_of(t) for t in texts]
    assert encoder.counts(part, frozenset()).tolist() == [len(ids_of(t)) for t in texts]


@pytest.mark.parametrize("kinds", [1, 3, 1 << 40])
def test_pretokens_that_share_hashes_stay_apart(monkeypatch, kinds):
    from broadsheet.llm import pretokens

    true = pretokens.sparse_hashes
    monkeypatch.setattr(pretokens, "sparse_hashes", lambda *ranges: true(*ranges) % np.uint64(kinds))  # and all begin at slot 0
    encoder, texts = BytePairs(PATH), random_texts(11, 300) + ["w" * n for n in range(1, 140)] + ["w" * n + "x" for n in range(1, 140)]
    got = []
    for _ in range(2):
        for part in slices(pa.array(texts), 700):
            ids, at = encoder.encode(part)
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [ids_of(t) for t in texts] * 2


def test_whole_tokens_are_most_of_the_vocabulary():
    assert 40_000 < len(BytePairs(PATH).whole_tokens()) <= LIBRARY.get_vocab_size()


def test_counts_of_awkward_rows(spark):
    docs = with_clashes(awkward(spark))
    got = sorted(map(tuple, count_tokens(docs, PATH).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), len(ids_of(r.text))) for r in docs.collect()]
    assert got == sorted([(*w, w[2] > 1024) for w in want], key=str)
    assert count_tokens(docs.limit(0), PATH).count() == 0


def padding(lengths, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


@pytest.mark.parametrize("length", [*range(1, 1100, 13), 1024, 1025, 5000])
def test_cuts_add_up_and_fill_their_slots(length):
    pieces = packing.cuts(length, 1024)
    assert sum(pieces) == length and all(0 < p <= 1024 for p in pieces)
    for p in pieces:
        k = packing.class_of(p, 1024)
        assert k * p <= 1024 and (k == packing.CLASSES or 1024 // k - p <= packing.SLACK * 1024 / k + 1)


def test_packing_of_awkward_rows(spark):
    docs = with_clashes(awkward(spark)).repartition(3)
    pieces = packing.pack(docs, PATH).collect()
    assert packing.pack(docs.limit(0), PATH).count() == 0
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(ids_of(r.text) + [0])
    for doc_id, copies in texts.items():
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert sum(p.length for p in own) == sum(map(len, copies))
        for p in own:
            crcs = {zlib.crc32(np.array(c[p.start : p.start + p.length], "<u4").tobytes()) for c in copies}
            assert p.ids_crc32 in crcs and p.doc_tokens in {len(c) for c in copies}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for group in sequences.values():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024


def test_packing_leaves_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lengths = [r.n for r in packing.pack(docs, PATH).groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").collect()]
    assert padding(lengths, 1024) < 0.02 * sum(lengths)


@pytest.mark.parametrize("size", [1, 2, 3, 64, 65, 1000, 4097])
@pytest.mark.parametrize("key", [0, 1, 12345])
def test_permutation_is_one_to_one(size, key):
    slots = token_files.permuted(np.arange(size), size, key)
    assert sorted(slots.tolist()) == list(range(size))
    if size > 999:
        assert np.mean(np.abs(np.diff(slots))) > size / 5  # scattered
        assert slots.tolist() != token_files.permuted(np.arange(size), size, key + 1).tolist()


def test_token_files_hold_every_sequence(spark, tmp_path):
    docs = with_clashes(awkward(spark)).repartition(3)
    path = str(tmp_path / "shards")
    layout = token_files.write_token_shards(docs, PATH, path, length=64, per_shard=50)
    rows = token_files.read_token_shards(spark, path, layout).collect()
    assert sorted(r.slot for r in rows) == list(range(layout.sequences))
    want = []
    for r in docs.collect():
        ids = ids_of(r.text) + [50256]
        for k in range(-(-len(ids) // 64)):
            own = ids[64 * k : 64 * k + 64]
            want.append((r.doc_id, k, len(own), zlib.crc32(np.array(own, "<u2").tobytes())))
    assert sorted(((r.doc_id, r.sequence, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    # one seek reads any record
    chosen = max(rows, key=lambda r: r.slot)
    (file,) = (tmp_path / "shards" / f"shard={chosen.slot // layout.per_shard}").glob("part-*.txt")
    raw = file.read_bytes()[chosen.byte_offset :][: layout.stride]
    assert zlib.crc32(raw[16 : 16 + 2 * chosen.n_tokens]) == chosen.ids_crc32 and raw[-1:] == b"\n"


def test_token_files_of_an_empty_table(spark, tmp_path):
    layout = token_files.write_token_shards(awkward(spark).limit(0), PATH, str(tmp_path / "none"))
    assert layout.sequences == 0 and token_files.read_token_shards(spark, str(tmp_path / "none"), layout).count() == 0
