import re

from xxhash import xxh64_intdigest

from siftwise.llm import simhash
from tests.llm.helpers import components, corpus, documents, real


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = {i: plain(t) for i, t in rows}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    groups = components(ids, links)
    return {i: (f"{prints[i]:016x}", groups[i]) for i in ids}


def test_against_brute_force(spark):
    texts = [*corpus(), "A Quick BROWN fox É jumps\x0bover\x85it", "a quick brown fox É jumps over\x85it"]
    docs = documents(spark, texts)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    assert found == expected(list(enumerate(texts)))


def test_real_documents(spark):
    docs = real(spark)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    assert found == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_planted_distances(spark, monkeypatch):
    """Chains of fingerprints at distances 1 to 5, in crowded prefixes that must be split."""
    import random

    from siftwise.llm.scratch import Scratch

    monkeypatch.setattr(simhash, "GROUP_ROWS", 50)
    monkeypatch.setattr(simhash, "VARIANTS", 1 << 14)
    draw = random.Random(3)
    values = set()
    for _ in range(12):
        v = draw.getrandbits(64)
        for _ in range(8):
            values.add(v)
            for bit in draw.sample(range(64), draw.randint(1, 5)):
                v ^= 1 << bit
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.fingerprint_links(rows, Scratch(spark, "test")).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    near = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 4]
    assert components(values, links) == components(values, near)


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b c d e", "a b c d e", "a b c d e"], ids=[5, 5, None])
    assert [r["component_id"] for r in simhash.simhash_components(docs).collect()] == [5, 5, 5]
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [5]
