import hashlib
import random

import numpy as np
import pytest

from siftwise.llm import suffix
from tests.llm.helpers import corpus, documents, real


def expected(rows, n=100):
    """rows in order of doc_id: what is left of each text."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - n + 1):
            gram = data[p : p + n]
            if gram in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(gram)
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        rest = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def found(docs):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(docs).collect()}


def awkward():
    draw = random.Random(9)
    base = "".join(draw.choice("abcd ") for _ in range(900))
    out = [base, base[:99], base[:100], base[1:101], base[200:450] + base[100:350], base[::-1], base[:300] + "é" + base[300:600]]
    out += [base[k : k + 120] + base[500 - k : 640 - k] for k in range(0, 200, 17)]
    return out + ["a" * 350, "b" + "a" * 250 + "c", "ab" * 300, "ba" * 120]


@pytest.mark.parametrize("chunk", [24_000_000, 3_000])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix, "GROUP_ANCHORS", 200)
    monkeypatch.setattr(suffix, "GROUP_SUFFIXES", 50)
    texts = corpus() + awkward()
    docs = documents(spark, texts).repartition(5)
    assert found(docs) == expected(list(enumerate(texts)))


def test_real_documents(spark):
    docs = real(spark)
    assert found(docs) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_common_grams_are_dealt_again(spark, monkeypatch):
    """Keys of more than four rows are narrowed down to single offsets; nothing is left out."""
    monkeypatch.setattr(suffix, "GROUP_SUFFIXES", 4)
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(suffix, "MEETING", 1)
    draw = random.Random(5)
    words = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    line = words(180)
    texts = [words(draw.randint(10, 200)) + line + words(draw.randint(10, 200)) for _ in range(25)] + awkward()
    assert found(documents(spark, texts)) == expected(list(enumerate(texts)))


def test_colliding_hashes_remove_nothing_wrong(spark, monkeypatch):
    """All k-grams and surroundings of a task fall on three hashes: bytes decide."""
    monkeypatch.setattr(suffix, "mix", lambda x: (x % np.uint64(3)) << np.uint64(40))
    draw = random.Random(6)
    texts = ["".join(draw.choice("abcd ") for _ in range(draw.randint(90, 400))) for _ in range(12)]
    texts += [texts[0], texts[1][20:] + texts[2], texts[3][:150] + "x" + texts[3][150:]] + awkward()[:8]
    assert found(documents(spark, texts).coalesce(1)) == expected(list(enumerate(texts)))


def test_very_long_texts(spark):
    text = "".join(random.Random(3).choices("abcdefghij ", k=600_000))
    rows = {r["doc_id"]: r for r in suffix.remove_repeats(documents(spark, [text, "x" + text[1000:500_000], "y" * 300_000])).collect()}
    assert [rows[i]["n_removed"] for i in range(3)] == [0, 499_000, 299_999]


def test_anchors_cover_all_strings_and_agree(monkeypatch):
    """Each string start belongs to one anchor, equal strings to anchors of one gram and place, across slabs too."""
    for bits in (17, 8):
        monkeypatch.setattr(suffix, "SLAB_BITS", bits)
        seen = {}
        for text in (t.encode() for t in awkward()):
            starts = []
            for q, lo, hi, gram, _ in zip(*suffix.anchors(np.frombuffer(text, np.uint8)), strict=True):
                for p in range(lo, hi + 1):
                    starts.append(p)
                    assert p <= q <= p + 76
                    assert seen.setdefault(text[p : p + 100], (int(gram), q - p)) == (int(gram), q - p)
            assert starts == list(range(max(0, len(text) - 99)))


def test_repeated_rows_null_ids_and_empty_table(spark):
    draw = random.Random(1)
    text = "".join(draw.choice("abcdefgh") for _ in range(150))
    docs = documents(spark, [text, text, text, "short", "short"], ids=[4, 4, None, 7, 7])
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"]) for r in suffix.remove_repeats(docs).collect())
    assert rows == [(False, 0, 0), (True, 4, 150), (True, 4, 150), (True, 7, 0), (True, 7, 0)]
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_mergesort_sorts_suffixes():
    draw = np.random.default_rng(2)
    data = draw.integers(97, 99, 3000).astype(np.uint8)
    begin = draw.permutation(2900)[:700]
    end = np.minimum(begin + draw.integers(1, 90, 700), 3000)
    group = draw.integers(0, 9, 700).astype(np.uint64)
    order = suffix.suffix_order(suffix.Hashed(data), begin, end, group)
    keys = [(int(group[i]), data[begin[i] : end[i]].tobytes()) for i in order]
    assert keys == sorted(keys)


def test_common_extension():
    text = suffix.Hashed(np.frombuffer(b"abcdefabcdxx", np.uint8))
    assert text.common(np.array([0]), np.array([6]), np.array([6])).tolist() == [4]
