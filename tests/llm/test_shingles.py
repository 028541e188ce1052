import random

import numpy as np
from xxhash import xxh64_intdigest

from siftwise.llm import shingles, simhash
from tests.llm.helpers import components, corpus, documents


def plain_sets(texts):
    found = []
    for t in texts:
        words = (t or "").encode().lower().split()
        found.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return found


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(draw, words, edits):
    words = list(words)
    for at in draw.sample(range(len(words)), edits):
        words[at] = f"edit{draw.random()}"
    return " ".join(words)


def pairs(draw, n, edits):
    """n texts of 300 words and a near copy of each."""
    texts = []
    for _ in range(n):
        words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(words), edited(draw, words, edits)]
    return texts


def kept(docs):
    return sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).collect())


def test_against_brute_force(spark):
    draw = random.Random(4)
    texts = corpus() + pairs(draw, 10, 4) + pairs(draw, 10, 9)
    base = [f"b{k}" for k in range(200)]
    texts += [edited(draw, base, 3) for _ in range(40)]  # a group whose members are alike through others only
    sets = plain_sets(texts)
    links = [(a, b) for b in range(len(sets)) for a in range(b) if similar(sets[a], sets[b]) >= 0.8]
    assert kept(documents(spark, texts)) == sorted(set(components(range(len(sets)), links).values()))


def test_recall_right_above_the_threshold(spark):
    texts = pairs(random.Random(5), 300, 6)
    sets = plain_sets(texts)
    near = [i for i in range(0, len(texts), 2) if 0.8 <= similar(sets[i], sets[i + 1]) < 0.85]
    found = set(kept(documents(spark, texts)))
    assert len(near) > 150 and sum(i + 1 not in found for i in near) >= 0.99 * len(near)


def test_repeats_do_not_make_texts_similar(spark):
    """Shingles are a set: a line repeated many times outweighs no differing rest."""
    line = "the same line once more and again"
    texts = ["\n".join([line] * 50 + [f"{c}{k}" for k in range(20)]) for c in "pq"]
    assert kept(documents(spark, texts)) == [0, 1]


def test_rows_and_not_ids_are_kept(spark):
    """Null doc_ids, and one doc_id with several texts."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(None, "a"), (None, "b"), (None, "b"), (1, "c"), (1, "d"), (2, "c"), (None, "d"), (3, "e"), (3, "e"), (4, "f"), (None, "f")]
    docs = documents(spark, [text(c) for _, c in rows], ids=[i for i, _ in rows])
    found = [(r["doc_id"], r["text"][0]) for r in simhash.keep_one_of_each(docs).collect()]
    assert sorted(found, key=lambda r: r[1]) == [(None, "a"), (None, "b"), (1, "c"), (1, "d"), (3, "e"), (4, "f")]


def hashed(text):
    return np.array([xxh64_intdigest(s, 42) for s in shingles.shingles(text)], np.uint64)


def test_bits_differ_by_the_angle():
    """Fingerprints are SimHash: pairs of sets differ in about the share angle / pi of their bits, sets of four or five shingles too."""
    draw = random.Random(7)
    short = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(9)) for _ in range(100)]
    for texts in (pairs(draw, 60, 6), [t for s in short for t in (s, " ".join(s.split()[:-1]))]):
        differ, expected = [], []
        for a, b in zip(texts[::2], texts[1::2], strict=True):
            (x, p), (y, q) = shingles.fingerprints(hashed(a)), shingles.fingerprints(hashed(b))
            bits = np.bitwise_count(x ^ y).sum(dtype=int) + np.bitwise_count((p ^ q).view("u8")).sum(dtype=int)
            differ.append(bits / (shingles.TABLES * 30 + 128))
            s, t = shingles.shingles(a), shingles.shingles(b)
            expected.append(np.arccos(len(s & t) / (len(s) * len(t)) ** 0.5) / np.pi)
        assert abs(np.mean(differ) - np.mean(expected)) < 0.015


def test_ball_hashing_against_brute_force(spark, monkeypatch):
    """All that meet in a table share a key, in crowds and over several passes too."""
    draw = random.Random(8)
    base = [f"b{k}" for k in range(200)]
    texts = pairs(draw, 40, 5) + [edited(draw, base, 2) for _ in range(30)]
    monkeypatch.setattr(shingles, "CROWD", 3)
    monkeypatch.setattr(shingles, "VARIANTS", 64)
    prints = [shingles.fingerprints(hashed(t)) for t in texts]
    rows = spark.createDataFrame([(i, p.tolist(), c.tolist()) for i, (p, c) in enumerate(prints)], "rid long, prints array<int>, check array<long>")
    keys = {}
    for r in shingles.meetings(rows).collect():
        keys.setdefault(r["rid"], set()).add(r["key"])
    met = 0
    for b, (q, d) in enumerate(prints):
        for a, (p, c) in enumerate(prints[:b]):
            x = p ^ q
            meet = ((x >> 24 == 0) & (np.bitwise_count(x) <= 2)).any() and np.bitwise_count((c ^ d).view("u8")).sum(dtype=int) <= 40
            met += meet
            assert not meet or keys[a] & keys[b]
    assert met > 300
