import random

import pytest
from pyspark.sql import functions as F

from siftwise import queries as core
from siftwise.config import TransferConfig
from siftwise.explicit import TransferGraph
from siftwise.functions import bloom
from siftwise.functions.bloom import bits_for
from siftwise.harness import canonical, compare, summary
from siftwise.operators import filters
from siftwise.session import TransferSession, always

DATA = "/root/testdata/sf0.001"
MODES = [
    {"heuristic": h, "pass_mode": p, "filter_type": f}
    for h, p, f in (("largest_root", "both", "all"), ("join_order", "both", "bf_only"), ("join_order", "forward_only", "minmax_only"), ("largest_root", "forward_only", "bf_only"))
]


@pytest.mark.parametrize("name", core.QUERIES)
def test_rows_are_those_of_plain_sql(spark, name):
    assert canonical(core.run(spark, DATA, name).collect()) == canonical(core.plain(spark, DATA, name).collect())


@pytest.mark.parametrize("name", ["q5_region_revenue", "join_order_dag", "left_join_preserved", "anti_join", "mark_in_or", "multi_col_key", "empty_build"])
@pytest.mark.parametrize("mode", MODES, ids=lambda m: "-".join(m.values()))
def test_rows_in_every_mode(spark, name, mode):
    assert canonical(core.run(spark, DATA, name, **mode).collect()) == canonical(core.plain(spark, DATA, name).collect())


@pytest.mark.parametrize("name", ["q5_region_revenue", "multi_col_key", "anti_join"])
def test_large_filters_are_read_by_subqueries(spark, monkeypatch, name):
    monkeypatch.setattr("siftwise.functions.bloom.LITERAL_BYTES", 0)
    made = core.run(spark, DATA, name)
    assert canonical(made.collect()) == canonical(core.plain(spark, DATA, name).collect())
    assert "scalar-subquery" in made._jdf.queryExecution().optimizedPlan().toString()


def test_two_tables_are_left_alone(spark):
    core.register_tables(spark, DATA, core.BIG)
    df = spark.sql(core.QUERIES["two_table_noop"].sql)
    assert always(spark).transfer(df) is df


def test_filters_reach_the_scan(spark):
    core.register_tables(spark, DATA, core.BIG)
    session = always(spark, profiling=True)
    plan = session.sql(core.QUERIES["minmax_only"].sql)._jdf.queryExecution().toString()
    assert "might_contain" in plan and "GreaterThanOrEqual(l_orderkey" in plan
    uses = {(u.build, u.table): u for u in session.profile.uses}
    assert uses["orders", "lineitem"].rows_out < uses["orders", "lineitem"].rows_in
    assert "CREATE orders" in session.profile.text() and session.profile_rows().count() == len(session.profile.uses)


def test_empty_builds_empty_the_plan(spark):
    core.register_tables(spark, DATA, core.BIG)
    made = always(spark).sql("SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'NONE'")
    assert "LocalRelation <empty>" in made._jdf.queryExecution().optimizedPlan().toString()


def test_gate_leaves_out_what_cannot_pay(spark):
    core.register_tables(spark, DATA, core.BIG)
    sql = core.QUERIES["q5_region_revenue"].sql
    session = TransferSession(spark)
    df = spark.sql(sql)
    assert session.transfer(df) is df and any("is small" in x for x in session.profile.skipped)
    session = TransferSession(spark, min_probe_bytes=0)
    session.sql("SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
    assert not session.profile.builds


def test_gate_looks_at_what_a_build_reads(spark):
    core.register_tables(spark, DATA, core.BIG)
    session = TransferSession(spark, min_probe_bytes=0)
    session.sql(core.QUERIES["q5_region_revenue"].sql)
    assert session.profile.builds and any("lineitem is larger than" in x for x in session.profile.skipped)


def test_builds_that_keep_most_rows_are_not_used(spark):
    core.register_tables(spark, DATA, core.BIG)
    sql = "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > {}"
    for least, used in ((-1e6, 0), (9000, 2)):
        session = TransferSession(spark, min_probe_bytes=0)
        assert session.sql(sql.format(least)).collect() == spark.sql(sql.format(least)).collect()
        assert len(session.profile.uses) == used, session.profile.skipped


def test_keys_are_dealt_to_several_filters(spark, monkeypatch):
    assert [bloom.pieces_for(n) for n in (0, 4_000_000, 4_000_001, 8_000_001, 32_000_000)] == [1, 1, 2, 4, 8]
    monkeypatch.setattr(bloom, "PIECE_KEYS", 100)
    rows = spark.range(0, 4000, 2).selectExpr("id AS k").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    config = TransferConfig(filter_type="bf_only")
    for estimate, pieces in ((None, 32), (5000, 1), (10, 32)):  # the last is far too low
        (found,), _ = filters.build_filters(spark, rows, [(F.col("k"), "BIGINT")], config, estimate)
        assert len(found.blooms) == pieces and found.rows == 2000
        probe = spark.range(4000).selectExpr("id AS k")
        kept = {r["k"] for r in probe.filter(found.predicate(spark, F.col("k"))).collect()}
        assert set(range(0, 4000, 2)) <= kept and len(kept) < 2200
    # a piece without keys lets nothing through
    (found,), _ = filters.build_filters(spark, spark.range(1).selectExpr("id AS k"), [(F.col("k"), "BIGINT")], config)
    found.blooms = (*found.blooms, None)
    assert spark.range(1).selectExpr("id AS k").filter(found.predicate(spark, F.col("k"))).count() <= 1


def test_preserved_rows_are_kept(spark):
    spark.createDataFrame([(1, 10), (2, 20), (None, 30), (4, 40)], "k int, v int").createOrReplaceTempView("hz_a")
    spark.createDataFrame([(1, 7), (2, 8), (9, 9)], "k int, w int").createOrReplaceTempView("hz_b")
    spark.createDataFrame([(7, 1), (9, 2)], "w int, z int").createOrReplaceTempView("hz_c")
    for sql in (
        "SELECT * FROM hz_a LEFT JOIN hz_b ON hz_a.k = hz_b.k LEFT JOIN hz_c ON hz_b.w = hz_c.w",
        "SELECT * FROM hz_c RIGHT JOIN hz_b ON hz_b.w = hz_c.w RIGHT JOIN hz_a ON hz_a.k = hz_b.k",
        "SELECT * FROM hz_a FULL OUTER JOIN hz_b ON hz_a.k = hz_b.k LEFT JOIN hz_c ON hz_b.w = hz_c.w",
        "SELECT * FROM hz_a WHERE NOT EXISTS (SELECT 1 FROM hz_b JOIN hz_c ON hz_b.w = hz_c.w WHERE hz_b.k = hz_a.k)",
        "SELECT * FROM hz_a WHERE k NOT IN (SELECT k FROM hz_b JOIN hz_c ON hz_b.w = hz_c.w)",
        "SELECT * FROM hz_a JOIN hz_b ON hz_a.k <=> hz_b.k JOIN hz_c ON hz_b.w = hz_c.w",
        "SELECT * FROM (SELECT *, sum(v) OVER (ORDER BY v) AS s FROM hz_a) a JOIN hz_b ON a.k = hz_b.k JOIN hz_c ON hz_b.w = hz_c.w",
        "SELECT * FROM (SELECT * FROM hz_a ORDER BY v LIMIT 2) a JOIN hz_b ON a.k = hz_b.k JOIN hz_c ON hz_b.w = hz_c.w",
        "SELECT a.k, n FROM (SELECT k, count(*) AS n FROM hz_a GROUP BY GROUPING SETS ((k), ())) a LEFT JOIN hz_b ON a.k = hz_b.k LEFT JOIN hz_c ON hz_b.w = hz_c.w",
    ):
        plain = spark.sql(sql)
        for mode in MODES:
            assert canonical(always(spark, **mode).transfer(spark.sql(sql)).collect()) == canonical(plain.collect()), sql


def test_odd_keys(spark):
    nan = float("nan")
    spark.createDataFrame([(1, 1.0, "a"), (2, nan, "b"), (3, -0.0, None), (None, 0.0, "é")], "i int, d double, s string").createOrReplaceTempView("ok_a")
    spark.createDataFrame([(1, nan, "b"), (2, 0.0, "é"), (7, 5.0, "z")], "i long, d double, s string").createOrReplaceTempView("ok_b")
    spark.createDataFrame([(1, 1.0, "b"), (2, nan, "é")], "i long, d double, s string").createOrReplaceTempView("ok_c")
    spark.sql("SELECT CAST(i AS DECIMAL(10, 2)) AS m, CAST(i AS DECIMAL(12, 3)) AS w, CAST('2024-01-01' AS DATE) + CAST(i AS INT) AS t FROM ok_b").createOrReplaceTempView("ok_d")
    for sql in (
        "SELECT * FROM ok_a a JOIN ok_b b ON a.i = b.i JOIN ok_c c ON b.i = c.i",
        "SELECT * FROM ok_a a JOIN ok_b b ON a.d = b.d JOIN ok_c c ON b.d = c.d",
        "SELECT * FROM ok_a a JOIN ok_b b ON a.s = b.s JOIN ok_c c ON b.s = c.s",
        "SELECT * FROM ok_d a JOIN ok_d b ON a.m = b.w JOIN ok_d c ON b.w = c.m",
        "SELECT * FROM ok_d a JOIN ok_d b ON a.t = b.t JOIN ok_d c ON b.t = c.t",
        "SELECT * FROM ok_a a JOIN ok_b b ON a.i = b.i AND a.s = b.s JOIN ok_c c ON b.i = c.i AND a.s = c.s",
    ):
        for mode in MODES:
            assert canonical(always(spark, **mode).sql(sql).collect()) == canonical(spark.sql(sql).collect()), sql


@pytest.mark.parametrize("seed", range(12))
def test_random_joins(spark, seed):
    draw = random.Random(seed)
    n = draw.randint(3, 6)
    for t in range(n):
        rows = [(draw.choice([None, *range(12)]), draw.randint(0, 12), draw.randint(0, 99)) for _ in range(draw.randint(0, 40))]
        spark.createDataFrame(rows, f"x{t} int, y{t} long, v{t} int").createOrReplaceTempView(f"rj_{t}")
    sql = "SELECT * FROM rj_0"
    for t in range(1, n):
        how = draw.choice(["JOIN", "JOIN", "JOIN", "LEFT JOIN", "RIGHT JOIN", "LEFT SEMI JOIN", "LEFT ANTI JOIN", "FULL OUTER JOIN"])
        other = 0 if "SEMI" in sql or "ANTI" in sql else draw.randrange(t)
        if how in ("LEFT SEMI JOIN", "LEFT ANTI JOIN") and t < n - 1:
            how = "JOIN"
        sql += f" {how} (SELECT * FROM rj_{t} WHERE v{t} < {draw.randint(20, 120)}) ON {draw.choice('xy')}{other} = {draw.choice('xy')}{t}"
    want = canonical(spark.sql(sql).collect())
    for mode in MODES[:2]:
        assert canonical(always(spark, **mode).sql(sql).collect()) == want, sql


def test_explicit_graph(spark):
    o = spark.createDataFrame([(i, i % 20) for i in range(200)], "ok long, ck long")
    c = spark.createDataFrame([(i, i % 5) for i in range(20)], "ck2 int, nk int")
    n = spark.createDataFrame([(1, "one"), (7, "none")], "nk2 int, name string")
    g = TransferGraph(spark).table("o", o).table("c", c).table("n", n)
    g.edge("o", "c", on=[("ck", "ck2")]).edge("c", "n", on=[("nk", "nk2")])
    made = g.reduce()
    assert made["c"].count() == 4 and made["o"].count() == 40 and made["n"].count() == 1
    assert all(made[k].columns == df.columns for k, df in (("o", o), ("c", c), ("n", n)))
    with pytest.raises(ValueError):
        g.edge("o", "n", on=[], how="sideways")


def test_settings(spark):
    with pytest.raises(ValueError):
        TransferConfig(heuristic="random")
    spark.conf.set("siftwise.filter_type", "bf_only")
    spark.conf.set("siftwise.flip_roots", "false")
    try:
        config = TransferConfig.of(spark)
        assert config.filter_type == "bf_only" and config.flip_roots is False
    finally:
        spark.conf.unset("siftwise.filter_type")
        spark.conf.unset("siftwise.flip_roots")


def test_bloom_sizes():
    assert [bits_for(n) for n in (0, 1, 43, 1000, 10**9)] == [512, 512, 1024, 16384, 1 << 26]


def test_displays_and_explain(spark, capsys):
    core.register_tables(spark, DATA, core.BIG)
    sql = core.QUERIES["q5_region_revenue"].sql
    always(spark, display_dag=True, display_physical_dag=True, profiling=True).sql(sql)
    out = capsys.readouterr().out
    assert "=== DAG ===" in out and "=== Physical Plan DAG ===" in out and "planning:" in out
    text = always(spark).explain(spark.sql(sql), run=True)
    assert "CREATE_BF [1 filters]" in text and "USE_BF (passthrough, pushed to scan)" in text and "Scan parquet" in text
    assert "no transfer" in always(spark).explain(spark.sql("SELECT 1"))


def test_harness_reports_errors_and_differences(spark):
    good = lambda: spark.range(5)
    bad = lambda: spark.range(5).select(F.raise_error(F.lit("boom")))
    outcomes = [compare(spark, "same", good, good, runs=2, no_own="both"), compare(spark, "differ", good, lambda: spark.range(4)), compare(spark, "fail", bad, bad)]
    assert [o.equal for o in outcomes] == [True, False, False] and outcomes[2].verdict == "error"
    assert "1 of 3 agree" in summary(outcomes)


def test_harness_with_a_baseline(spark, tmp_path, capsys):
    from siftwise.harness import main

    file = str(tmp_path / "baseline.json")
    asked = ["--data", DATA, "--query", "q5_region_revenue", "empty_build", "anti_join", "--limit", "2"]
    assert main([*asked, "--save-baseline", file]) == 0
    assert main([*asked, "--baseline", file, "--heuristic", "join_order", "--verbose"]) == 0
    assert "2 of 2 agree" in capsys.readouterr().out


def test_stream_is_reduced(spark, tmp_path):
    from siftwise.streaming.static_side import reduce_stream

    src = str(tmp_path / "in")
    spark.range(100).selectExpr("id", "id % 10 AS k").write.parquet(src)
    static = spark.createDataFrame([(3,), (4,)], "k long")
    stream = reduce_stream(spark.readStream.schema("id long, k long").parquet(src), "k", static, "k")
    query = stream.join(static, "k").writeStream.format("memory").queryName("reduced").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("reduced").count() == 20


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    for name in ("transfer_dag_text", "explain_text", "profile_rows"):
        assert e.queries()[name](spark, DATA).count() > 0
