"""Registered queries: each runs through predicate transfer, and its plain SQL says what must come out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from siftwise.session import always
from siftwise.sources.tables import register_tables


@dataclass(frozen=True)
class Query:
    """sql is both Spark's and the oracle's, unless oracle is given."""

    sql: str
    options: dict = field(default_factory=dict)
    oracle: str = ""


BIG = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")
REVENUE = "CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue"
CHAIN = """SELECT r_name, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY r_name"""
RANGE = f"""SELECT c_mktsegment, count(*) AS n, {REVENUE} FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    WHERE o_orderdate >= TIMESTAMP '1996-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY c_mktsegment"""
BRANCHES = f"""SELECT p_brand, count(*) AS n, {REVENUE} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey
    WHERE p_size < 10 AND n_name IN ('NATION_3', 'NATION_7', 'NATION_11') GROUP BY p_brand"""

QUERIES: dict[str, Query] = {
    "q5_region_revenue": Query(f"""SELECT n_name, {REVENUE} FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY n_name"""),
    "q3_segment_orders": Query(f"""SELECT o_orderkey, {REVENUE}, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00'
        GROUP BY o_orderkey, o_orderdate"""),
    "forward_only_chain": Query(CHAIN, {"pass_mode": "forward_only"}),
    "backward_pass_chain": Query(CHAIN, {"pass_mode": "both"}),
    "join_order_dag": Query("""SELECT n_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY n_name""", {"heuristic": "join_order"}),
    "flip_roots_off": Query(BRANCHES, {"heuristic": "join_order", "flip_roots": False}),
    "flip_roots_on": Query(BRANCHES, {"heuristic": "join_order", "flip_roots": True}),
    "multi_col_key": Query("""SELECT p_brand, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity FROM lineitem
        JOIN (SELECT l_partkey AS pk, l_suppkey AS sk, max(l_quantity) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey, l_suppkey) t
          ON l_partkey = pk AND l_suppkey = sk
        JOIN part ON p_partkey = l_partkey WHERE p_size = 7 AND l_quantity = top GROUP BY p_brand"""),
    "minmax_only": Query(RANGE, {"filter_type": "minmax_only"}),
    "bf_only": Query(RANGE, {"filter_type": "bf_only"}),
    "empty_build": Query("""SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment = 'NO SUCH SEGMENT'"""),
    "null_keys": Query("""SELECT n_name, count(*) AS n FROM
        (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS k FROM orders) o
        JOIN customer ON k = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY n_name"""),
    "int_bigint_key": Query("""SELECT r_name, count(*) AS n FROM (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nk FROM customer) c
        JOIN nation ON nk = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey
        WHERE r_name = 'AFRICA' GROUP BY r_name"""),
    "string_key": Query("""SELECT n_name, count(*) AS n FROM (SELECT c_custkey, concat('NATION_', CAST(c_nationkey AS VARCHAR(9))) AS name FROM customer) c
        JOIN nation ON name = n_name JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 3 GROUP BY n_name"""),
    "semi_join": Query("""SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY n_name"""),
    "anti_join": Query("""SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY n_name"""),
    "left_join_preserved": Query("""SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS with_order, count(l_orderkey) AS with_line
        FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) o ON o_custkey = c_custkey
        LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' WHERE c_acctbal > 5000 GROUP BY c_mktsegment"""),
    "right_join_preserved": Query("""SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS with_order FROM
        (SELECT * FROM orders WHERE o_totalprice > 450000) o RIGHT JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 GROUP BY c_mktsegment"""),
    "full_outer_barrier": Query("""SELECT r_name, count(*) AS n, count(s) AS suppliers FROM
        (SELECT coalesce(a.k, b.k) AS k, s FROM (SELECT c_nationkey AS k, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) a
          FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) b ON a.k = b.k) f
        JOIN nation ON f.k = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY r_name"""),
    "cross_barrier": Query("""SELECT n_name, count(*) AS n FROM region CROSS JOIN (SELECT n_name, n_regionkey, c_custkey FROM nation
        JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND n_nationkey < 5) t
        WHERE r_name LIKE 'A%' GROUP BY n_name"""),
    "theta_barrier": Query("""SELECT count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey
        JOIN region ON r_regionkey < n_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE n_name = 'NATION_4' AND c_acctbal > 9000"""),
    "mark_in_or": Query("""SELECT c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'EUROPE' AND (c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)) GROUP BY c_mktsegment"""),
    "scalar_subquery": Query("""SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE n_regionkey = 2 AND o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY n_name"""),
    "grouped_agg_under_join": Query("""SELECT c_mktsegment, count(*) AS n, sum(items) AS items FROM
        (SELECT l_orderkey AS k, count(*) AS items FROM lineitem GROUP BY l_orderkey) l JOIN orders ON k = o_orderkey
        JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000 GROUP BY c_mktsegment"""),
    "rollup_barrier": Query("""SELECT n_name, segment, n FROM (SELECT c_nationkey AS k, c_mktsegment AS segment, count(*) AS n FROM customer
        GROUP BY ROLLUP (c_nationkey, c_mktsegment)) t JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA'"""),
    "window_barrier": Query("""SELECT c_mktsegment, count(*) AS n FROM (SELECT o_custkey, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t
        JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE rn = 1 AND c_acctbal > 8000 GROUP BY c_mktsegment"""),
    "limit_barrier": Query("""SELECT c_mktsegment, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500) t
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY c_mktsegment"""),
    "union_leaf": Query("""SELECT n_name, count(*) AS n FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0) u JOIN customer ON k = c_custkey
        JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 4 GROUP BY n_name"""),
    "intersect_leaf": Query("""SELECT n_name, count(*) AS n FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
        INTERSECT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') u JOIN customer ON k = c_custkey
        JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 4 GROUP BY n_name"""),
    "except_leaf": Query("""SELECT n_name, count(*) AS n FROM (SELECT c_custkey AS k FROM customer
        EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000) u JOIN customer ON k = c_custkey
        JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 4 GROUP BY n_name"""),
    "renamed_columns": Query("""SELECT y AS nation_name, count(*) AS n FROM (SELECT b AS d, y FROM (SELECT c_nationkey AS a, c_custkey AS b FROM customer) t
        JOIN (SELECT n_nationkey AS x, n_name AS y FROM nation WHERE n_regionkey = 0) m ON a = x) z JOIN orders ON o_custkey = d GROUP BY y"""),
    "disconnected_components": Query("""SELECT a.n AS asia, b.n AS small_parts FROM
        (SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') a
        CROSS JOIN (SELECT count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
          WHERE p_size = 1 AND s_acctbal > 0) b"""),
    "self_join": Query("""SELECT n1.n_name AS customer_nation, n2.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
        WHERE n1.n_name = 'NATION_3' AND n2.n_name IN ('NATION_7', 'NATION_9') GROUP BY n1.n_name, n2.n_name"""),
    "correlated_subquery": Query("""SELECT p_brand, count(*) AS n FROM lineitem l JOIN part ON p_partkey = l.l_partkey JOIN supplier ON s_suppkey = l.l_suppkey
        WHERE p_size < 5 AND l.l_quantity < (SELECT 0.4 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey) GROUP BY p_brand"""),
    "lift_filter": Query("""SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE length(c_name) + c_nationkey > 35 AND n_regionkey < 3 GROUP BY n_name"""),
    "bloom_membership": Query("""SELECT count(DISTINCT l_orderkey) AS orders, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderpriority = '5-LOW'""", {"filter_type": "bf_only"}),
    "two_table_noop": Query(f"SELECT o_orderpriority, {REVENUE} FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderpriority"),
    "cte_chain": Query("""WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 350000),
        asia AS (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
        SELECT l_returnflag, count(*) AS n FROM lineitem JOIN big ON l_orderkey = o_orderkey JOIN asia ON o_custkey = c_custkey GROUP BY l_returnflag"""),
    "date_range_key": Query("""SELECT count(*) AS n FROM orders a JOIN (SELECT DISTINCT o_orderdate AS d FROM orders WHERE o_totalprice > 480000) b ON a.o_orderdate = d
        JOIN customer ON a.o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"""),
    "events_labels": Query("""SELECT event_type, count(*) AS n FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE n_regionkey = 1 AND value > 10 GROUP BY event_type"""),
    "labels_documents": Query("""SELECT source, count(*) AS n FROM documents JOIN labels ON documents.doc_id = labels.doc_id
        JOIN (SELECT doc_id AS e, max(n_chars) AS m FROM documents WHERE lang = 'en' GROUP BY doc_id) d ON e = labels.doc_id WHERE quality = 0 GROUP BY source"""),
}


def run(spark: SparkSession, sf_dir: str, name: str, **changes) -> DataFrame:
    """A registered query, with transfer wherever it applies."""
    register_tables(spark, sf_dir, BIG)
    query = QUERIES[name]
    return always(spark, **(query.options | changes)).sql(query.sql)


def plain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same query by Spark alone."""
    register_tables(spark, sf_dir, BIG)
    return spark.sql(QUERIES[name].sql)


def _text_rows(spark: SparkSession, text: str) -> DataFrame:
    lines = [(i, x) for i, x in enumerate(text.splitlines())]
    return spark.createDataFrame(lines, "line int, text string")


def transfer_dag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of the flagship query's transfer tree and of its DAG."""
    register_tables(spark, sf_dir, BIG)
    df = spark.sql(QUERIES["q5_region_revenue"].sql)
    return _text_rows(spark, "\n".join(always(spark, heuristic=h).explain(df) for h in ("largest_root", "join_order")))


def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query's schedule after it ran, and its physical plan."""
    register_tables(spark, sf_dir, BIG)
    return _text_rows(spark, always(spark).explain(spark.sql(QUERIES["q5_region_revenue"].sql), run=True))


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter of the flagship query removed."""
    register_tables(spark, sf_dir, BIG)
    session = always(spark, profiling=True)
    session.transfer(spark.sql(QUERIES["q5_region_revenue"].sql))
    return session.profile_rows()


#: A chain whose filters are ranges only, so that what each removed can be told by SQL.
RANGES = """SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey BETWEEN 3 AND 7 AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'"""


def profile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the range filters of a chain removed on the way to the largest table."""
    register_tables(spark, sf_dir, BIG)
    session = always(spark, profiling=True, filter_type="minmax_only", pass_mode="forward_only")
    session.transfer(spark.sql(RANGES))
    return session.profile_rows().select("build_table", "probe_table", "rows_in", "rows_out")


PROFILE_ORACLE = """WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey BETWEEN 3 AND 7),
    c0 AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey BETWEEN 3 AND 7),
    c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey BETWEEN (SELECT min(k) FROM n) AND (SELECT max(k) FROM n)),
    o0 AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'),
    o AS (SELECT k FROM o0 WHERE c BETWEEN (SELECT min(k) FROM c) AND (SELECT max(k) FROM c))
    SELECT 'nation' AS build_table, 'customer' AS probe_table, (SELECT count(*) FROM c0) AS rows_in, (SELECT count(*) FROM c) AS rows_out
    UNION ALL SELECT 'customer', 'orders', (SELECT count(*) FROM o0), (SELECT count(*) FROM o)
    UNION ALL SELECT 'orders', 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_orderkey BETWEEN (SELECT min(k) FROM o) AND (SELECT max(k) FROM o))"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: (lambda spark, sf_dir, name=name: run(spark, sf_dir, name)) for name in QUERIES}
    return found | {f.__name__: f for f in (transfer_dag_text, explain_text, profile_rows, profile_ranges)}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle or q.sql for name, q in QUERIES.items()} | {"profile_ranges": PROFILE_ORACLE}
