"""Predicate transfer over named tables, for callers without access to Catalyst's plans of whole queries.

    g = TransferGraph(spark)
    g.table("o", orders).table("c", customers).table("n", nations)
    g.edge("o", "c", on=[("o_custkey", "c_custkey")])
    g.edge("c", "n", on=[("c_nationkey", "n_nationkey")])
    reduced = g.reduce()            # a dict of DataFrames, to be joined as before
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwise.config import TransferConfig
from siftwise.plans.graph import Edge, JoinGraph, Table
from siftwise.profiling import Profile
from siftwise.session import TableState, Transfer, perform, planned

#: Which way filters may flow: (first to second, second to first).
WAYS = {"inner": (True, True), "left_semi": (True, True), "left": (True, False), "right": (False, True), "left_anti": (True, False)}


class NamedTable(TableState):
    """A DataFrame; key columns are (name, type)."""

    def __init__(self, name: str, df: DataFrame, size: int, filtered: bool):
        super().__init__(name, size, filtered, False, size)
        self.df = df

    def key(self, column) -> tuple[Column, str]:
        return F.col(column[0]), column[1]

    def rows(self) -> DataFrame:
        return self.df if self.predicate is None else self.df.filter(self.predicate)

    def label(self, column) -> str:
        return column[0]


class TransferGraph:
    def __init__(self, spark: SparkSession, **changes):
        self.spark = spark
        self.config = TransferConfig.of(spark, **({"gate": False, "min_probe_bytes": 0} | changes))
        self.tables: dict[int, NamedTable] = {}
        self.ids: dict[str, int] = {}
        self.sizes: dict[int, int] = {}
        self.edges: list[Edge] = []
        self.profile = Profile()

    def table(self, name: str, df: DataFrame, rows: int | None = None, filtered: bool = True) -> TransferGraph:
        """rows: how many, for the choice of the root; counted if not given."""
        self.ids[name] = i = len(self.ids)
        self.sizes[i] = df.count() if rows is None else rows
        self.tables[i] = NamedTable(name, df, self.sizes[i], filtered)
        return self

    def edge(self, first: str, second: str, on: Sequence[tuple[str, str]], how: str = "inner") -> TransferGraph:
        if how not in WAYS:
            raise ValueError(f"how is one of {', '.join(WAYS)}, not {how!r}")
        a, b = self.ids[first], self.ids[second]
        pairs = tuple(((x, t), (y, t)) for x, y in on for t in [self._common(a, x, b, y)])
        self.edges.append(Edge(a, b, pairs, *WAYS[how]))
        return self

    def _common(self, a: int, x: str, b: int, y: str) -> str:
        """The type that both keys are compared in, as Spark's own join would."""
        one, other = self.tables[a].df.select(F.col(x).alias("k")), self.tables[b].df.select(F.col(y).alias("k"))
        return one.union(other)._jdf.schema().apply(0).dataType().sql()

    def plan(self) -> Transfer | None:
        graph = JoinGraph({i: Table(i, t.name, self.sizes[i]) for i, t in self.tables.items()}, self.edges, list(self.tables)).merged()
        return planned(graph, dict(self.tables), self.config)

    def reduce(self) -> dict[str, DataFrame]:
        self.profile = Profile()
        if transfer := self.plan():
            perform(self.spark, transfer, self.config, self.profile)
        return {t.name: t.rows() for t in self.tables.values()}
