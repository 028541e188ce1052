import random

import pytest
from pyspark.sql import functions as F

from siftwise.llm import graph, ordering
from siftwise.llm.scratch import Scratch, shared_root
from tests.llm import helpers


@pytest.mark.parametrize("kind", ["random", "path", "star", "loops"])
def test_components(spark, kind):
    draw = random.Random(kind)
    links = {
        "random": [(draw.randrange(200), draw.randrange(200)) for _ in range(150)],
        "path": [(i, i + 1) for i in range(64)] + [(100, 99), (99, 98)],
        "star": [(7, i) for i in range(300)],
        "loops": [(1, 1), (2, 2), (3, 4), (4, 3), (3, 4)],
    }[kind]
    edges = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["component"] for r in graph.components(edges, Scratch(spark, "test")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert found == helpers.components({n for pair in real for n in pair}, real)


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_ranks_and_sums_have_no_gaps(spark):
    """A third of all rows have one key, and many rows are equal in the whole order."""
    scratch = Scratch(spark, "test")
    stored = scratch.save(spark.range(1000, numPartitions=7).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 END AS k", "id % 4 AS v"))
    ordered = ordering.in_order(stored, scratch, "k", "v")
    rows = ordering.with_ranks(ordered, ["k"], "rank", total="v").collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r["k"], []).append((r["rank"], r["v"], r["total"]))
    assert len(rows) == 1000 and sorted(r["id"] for r in rows) == list(range(1000))
    for found in by_key.values():
        found.sort()
        assert [r for r, _, _ in found] == list(range(len(found)))
        assert [v for _, v, _ in found] == sorted(v for _, v, _ in found)
        assert all(t == sum(v for _, v, _ in found[:i]) for i, (_, _, t) in enumerate(found))
    whole = ordering.with_ranks(ordering.in_order(stored, scratch, F.col("id").desc()), [], "rank").collect()
    assert all(r["rank"] == 999 - r["id"] for r in whole)


def test_equal_rows_are_spread_over_files(spark):
    scratch = Scratch(spark, "test")
    stored = scratch.save(spark.range(40_000, numPartitions=4).selectExpr("1 AS k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ordering.in_order(stored, scratch, "k").groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 20_000


def test_packed_rows_keep_any_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, _row int, _key int")
    assert ordering.unpacked(ordering.packed(df), df.columns).collect() == [(1, 2, 3)]


def test_scratch_tables_are_dropped(spark):
    scratch = Scratch(spark, "test")
    stored = scratch.save(spark.range(3).withColumnRenamed("id", "x"))
    assert stored.count() == 3 and scratch.root.startswith(shared_root(spark))
    scratch.drop(stored, None)
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST|not found"):
        spark.read.parquet(stored._scratch_path).count()
