import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwise.llm import sharding
from siftwise.llm.sharding import Node
from tests.llm.helpers import corpus, documents


def test_contract(spark):
    texts = corpus(n=200)
    docs = documents(spark, texts).repartition(3)
    slots = defaultdict(list)
    rows = sharding.shard_documents(docs, sharding.uniform_tree(40), 40).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key")
        assert 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shares_follow_weights_and_growth_moves_only_into_the_new_shard(spark):
    tree = sharding.uniform_tree(40)
    ids = spark.range(60_000)
    rows = ids.select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), sharding.grow(tree, 40)).alias("b")).collect()
    counts = Counter(r["a"] for r in rows)
    assert len(counts) == 40 and all(abs(n - 1500) < 5 * 1500**0.5 for n in counts.values())
    moved = [r for r in rows if r["a"] != r["b"]]
    assert all(r["b"] == 40 for r in moved) and abs(len(moved) - 60_000 / 41) < 5 * (60_000 / 41) ** 0.5


def leaf(s, w=1.0):
    return Node(f"shard{s}", own_weight=w, shard=s)


def test_a_changed_weight_moves_rows_only_to_or_from_its_subtree(spark):
    def tree(w):
        racks = [Node("r0", children=(leaf(0, w), leaf(1))), Node("r1", children=(leaf(2), leaf(3)))]
        return Node("root", children=(Node("g0", children=tuple(racks)), Node("g1", children=(Node("r2", children=(leaf(4), leaf(5))),))))

    rows = spark.range(30_000).select(sharding.shard_of(F.col("id"), tree(1)).alias("a"), sharding.shard_of(F.col("id"), tree(3)).alias("b")).collect()
    # into region g0, within it into rack r0, within it into shard 0; other regions and racks keep theirs among themselves
    assert all(not (r["a"] in (4, 5) and r["b"] in (4, 5)) for r in rows if r["a"] != r["b"])
    assert all(not (r["a"] == 0 and r["b"] != 0) for r in rows)
    share = Counter(r["b"] for r in rows)
    assert share[0] / 30_000 == pytest.approx(3 / 8, abs=0.02) and share[4] / 30_000 == pytest.approx(1 / 8, abs=0.02)


def test_null_ids_repeated_rows_empty_table_and_files(spark, tmp_path):
    docs = documents(spark, ["a", None, "a", "a"], ids=[None, None, 3, 3])
    rows = sharding.shard_documents(docs, sharding.uniform_tree(40), 40).collect()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_id.values())
    assert sorted(r["slot"] for r in rows if r["doc_id"] == 3) == [0, 1] or len(by_id) == 1
    assert sharding.shard_documents(docs.limit(0), sharding.uniform_tree(40), 40).count() == 0
    sharding.write_shards(docs, sharding.uniform_tree(4), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 4


def test_draws_and_slots_are_recomputed(spark):
    """Shards by draws made in plain Python; slots by (doc_id, hash of the text), whatever the order of the rows."""
    from math import log

    texts = corpus(n=60)
    docs = documents(spark, texts)
    tree = sharding.uniform_tree(7, racks=3)
    names = [f.name for f in _nodes(sharding.grow(tree, 7))]
    ids = [r["doc_id"] for r in docs.collect()]
    hashed = docs.select("doc_id", *[F.xxhash64(F.lit(n), "doc_id").alias(n) for n in names], F.xxhash64(F.coalesce("text", F.lit(""))).alias("of_text")).collect()
    draws = {r["doc_id"]: {n: log(((r[n] % 2**64 >> 11) + 0.5) / 2**53) for n in names} for r in hashed}

    def shard(i, node):
        while node.children:
            node = max(node.children, key=lambda c: draws[i][c.name] / c.weight)
        return node.shard

    runs = [{r["doc_id"]: r for r in sharding.shard_documents(d, tree, 7).collect()} for d in (docs, docs.repartition(5, "text"))]
    assert all((r["shard"], r["grown_shard"]) == (shard(i, tree), shard(i, sharding.grow(tree, 7))) for i, r in runs[0].items())
    order = sorted((runs[0][r["doc_id"]]["shard"], r["doc_id"], r["of_text"]) for r in hashed)
    want = {i: sum(1 for o in order if o[0] == s and o < (s, i, h)) for s, i, h in order}
    assert all({i: r["slot"] for i, r in run.items()} == want for run in runs) and len(want) == len(ids)


def _nodes(node):
    return [n for c in node.children for n in (c, *_nodes(c))]


def test_very_long_text(spark):
    text = "é" * 1_000_000
    r = sharding.shard_documents(documents(spark, [text]), sharding.uniform_tree(40), 40).first()
    assert (r["size"], r["text_crc32"], r["slot"]) == (2_000_016, zlib.crc32(text.encode()), 0)
