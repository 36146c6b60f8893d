"""Different texts that have one hash in a sum of powers modulo 2^64."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from broadsheet.llm import packing, quality_rules, registry, token_counts
from broadsheet.llm.arrays import RangeHashes, distinct_ranges, slices
from broadsheet.llm.pretokens import BytePairs


def pair(length):
    """A word of two letters by the parity of their number's bits, and the same with the letters exchanged."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(length))
    return word, word.translate(str.maketrans("ab", "ba"))


ONE, OTHER = pair(1024)
LONG, LONGER = pair(2048)
TEXTS = [ONE, OTHER, f"{LONG} and {LONGER}", f"{ONE}\n{OTHER}\n{ONE}", None, f"x {OTHER} {ONE} {LONGER} {LONG}"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(registry.BYTE_BPE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_the_words_have_one_hash_and_are_two_kinds():
    data = np.frombuffer(f"{ONE}{OTHER}{ONE}".encode(), np.uint8)
    starts = np.array([0, 1024, 2048])
    hashes = RangeHashes(data)(starts, starts + 1024)
    assert len(set(hashes.tolist())) == 1
    first, kind = distinct_ranges(data, starts, starts + 1024, hashes)
    assert first.tolist() == [0, 1] and kind.tolist() == [0, 1, 0]


@pytest.mark.parametrize("limit", [1, 5000, 1 << 20])
def test_encoder_in_one_slice_and_in_many(library, limit):
    encoder, got, counted = BytePairs(registry.BYTE_BPE), [], []
    whole = encoder.whole_tokens()
    for part in slices(pa.array(TEXTS), limit):
        ids, at = encoder.encode(part)
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
        counted += encoder.counts(part, whole).tolist()
    want = [ids_of(library, t) for t in TEXTS]
    assert got == want and counted == [len(w) for w in want]


def test_token_counts_and_pieces(spark, library):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    want = {i: len(ids_of(library, t)) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, registry.BYTE_BPE).collect()} == want
    import zlib

    for r in packing.pack(docs, registry.BYTE_BPE).collect():
        ids = [*ids_of(library, TEXTS[r.doc_id]), 0][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def shape_by_hand(text):
    lines = [line for line in (text or "").split("\n") if line.split()]
    found = (text or "").split()
    windows = collections.Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    inside = {i + k for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for k in range(5)}
    return len(lines) - len(set(lines)), len(inside)


def test_lines_and_windows():
    texts = [*TEXTS, f"{ONE} a b c d {OTHER} a b c d", f"{ONE} a b c d {ONE} a b c d", f"{ONE}\n{OTHER}", f"{ONE}\n{ONE}", "q w e r t " * 40]
    for limit in (1, 1 << 20):
        got = []
        for part in slices(pa.array(texts), limit):
            shape = quality_rules.shape(quality_rules.Grams(part))
            got += list(zip(shape["n_dup_lines"].tolist(), shape["n_repeat_words"].tolist()))
        assert got == [shape_by_hand(t) for t in texts]
