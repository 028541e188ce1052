"""Predicate transfer for any query of a session.

    ts = TransferSession(spark)
    ts.sql("SELECT ... many joins ...")     # reduced tables, the same rows
    ts.transfer(df)                         # the same for a DataFrame
    print(ts.explain(df))
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from siftwise.config import TransferConfig
from siftwise.operators.filters import BuildRecord, KeyFilter, build_filters, in_parallel
from siftwise.plans.graph import PLANNERS, JoinGraph, Step, TransferPlan, schedule
from siftwise.plans.printer import levels_text, steps_text, tree_text
from siftwise.plans.reader import Leaf, PlanReader, Scope
from siftwise.plans.rewriter import column_of, filtered, frame, rewritten
from siftwise.profiling import Profile, UseRecord

log = logging.getLogger(__name__)


class TableState:
    """A table's rows as far as filters have reduced them. Subclasses say how keys become columns."""

    def __init__(self, name: str, size: int, filtered: bool, barrier: bool, estimate: int | None = None):
        self.name, self.size, self.filtered, self.barrier, self.estimate = name, size, filtered, barrier, estimate
        self.predicate: Column | None = None
        self.version = 0
        self.filters: dict[tuple, KeyFilter] = {}

    def add(self, predicate: Column) -> None:
        self.predicate = predicate if self.predicate is None else self.predicate & predicate
        self.version += 1

    def key(self, column) -> tuple[Column, str]:
        raise NotImplementedError

    def rows(self) -> DataFrame:
        raise NotImplementedError

    def label(self, column) -> str:
        raise NotImplementedError

    def whole(self) -> int | None:
        """The rows of the table before any reduction, if they are cheap to count."""
        return None


class PlanTable(TableState):
    """A table of a Catalyst plan; key columns are (expression id, type)."""

    def __init__(self, spark: SparkSession, leaf: Leaf):
        super().__init__(leaf.name, leaf.size, leaf.filtered, leaf.barrier, leaf.rows)
        self.spark, self.leaf = spark, leaf

    def key(self, column) -> tuple[Column, str]:
        return column_of(self.spark, self.leaf.attributes[column[0]]), column[1]

    def rows(self) -> DataFrame:
        return frame(self.spark, filtered(self.spark, self.leaf.node, self.predicate))

    def label(self, column) -> str:
        return self.leaf.attributes[column[0]].name()

    def whole(self) -> int | None:
        """No column is read, so Parquet's footers tell the count."""
        node = self.leaf.node
        while node.children().size() == 1:
            node = node.children().apply(0)
        return frame(self.spark, node).count() if node.children().isEmpty() else None


@dataclass
class Transfer:
    """One join graph with its plan, schedule and what came of it."""

    plan: TransferPlan
    steps: list[Step]
    tables: dict[int, TableState]
    used: dict[int, str] = field(default_factory=dict)

    @property
    def names(self) -> dict:
        found = {}
        for s in self.steps:
            for x, y in s.pairs:
                found[s.build, x] = self.tables[s.build].label(x)
                found[s.probe, y] = self.tables[s.probe].label(y)
        return found


def planned(graph: JoinGraph, tables: dict[int, TableState], config: TransferConfig) -> Transfer | None:
    """The transfer of a graph; none if it has one edge or less."""
    if len(graph.edges) <= 1:
        return None
    plan = PLANNERS[config.heuristic](graph, config.flip_roots)
    return Transfer(plan, schedule(plan, config.pass_mode), tables)


def _wanted(step: Step, tables: dict[int, TableState], config: TransferConfig) -> str:
    """Why a step is left out; empty if it isn't."""
    build, probe = tables[step.build], tables[step.probe]
    if build.barrier:
        return f"{build.name} would be computed twice"
    if config.gate and not build.filtered and not build.version:
        return f"nothing has reduced {build.name}"
    if config.gate and probe.size < config.min_probe_bytes:
        return f"{probe.name} is small"
    if config.gate and build.size > probe.size:
        return f"{build.name} is larger than {probe.name}"
    return ""


def perform(spark: SparkSession, transfer: Transfer, config: TransferConfig, profile: Profile) -> None:
    """Builds and applies the filters of a schedule, wave by wave. Builds of a wave run side by side."""
    tables = transfer.tables
    for wave in sorted({s.wave for s in transfer.steps}):
        wanted: dict[int, list[Step]] = {}
        for s in (s for s in transfer.steps if s.wave == wave):
            if why := _wanted(s, tables, config):
                profile.skipped.append(f"{tables[s.build].name} -> {tables[s.probe].name}: {why}")
                transfer.used[s.sequence] = f"skipped: {why}"
            else:
                wanted.setdefault(s.build, []).append(s)
        if not wanted:
            continue

        def build(table: int, steps: list[Step]) -> None:
            state = tables[table]
            columns = [c for c in dict.fromkeys(x for s in steps for x, _ in s.pairs) if (c, state.version) not in state.filters]
            if not columns:
                return
            found, micros = build_filters(spark, state.rows(), [state.key(c) for c in columns], config, state.estimate, state.whole)
            state.filters |= {(c, state.version): f for c, f in zip(columns, found, strict=True)}
            kinds = " and ".join(k for k, has in (("Bloom", any(f.blooms for f in found)), ("range", any(f.low is not None for f in found))) if has)
            profile.builds.append(BuildRecord(state.name, len(columns), max(f.rows for f in found), micros, kinds or "count", steps[0].forward, [tables[s.probe].name for s in steps]))

        in_parallel([lambda t=t, s=s: build(t, s) for t, s in wanted.items()])
        versions = {t: tables[t].version for t in wanted}
        for s in (s for steps in wanted.values() for s in steps):
            probe, source = tables[s.probe], tables[s.build]
            tests = []
            if any(source.filters[x, versions[s.build]].dull for x, _ in s.pairs):
                profile.skipped.append(f"{source.name} -> {probe.name}: {source.name} keeps most of its rows")
                transfer.used[s.sequence] = f"skipped: {source.name} keeps most of its rows"
                continue
            for x, y in s.pairs:
                key, _ = probe.key(y)
                test = source.filters[x, versions[s.build]].predicate(spark, key)
                tests += [] if test is None else [test]
            use = UseRecord(probe.name, source.name, ", ".join(probe.label(y) for _, y in s.pairs), s.forward, s.sequence)
            if tests:
                if config.profiling:
                    use.rows_in = probe.rows().count()
                for test in tests:
                    probe.add(test)
                if config.profiling:
                    use.rows_out = probe.rows().count()
            transfer.used[s.sequence] = "passthrough, pushed to scan" if tests else "too many keys"
            profile.uses.append(use)


class TransferSession:
    """Queries of a Spark session with predicate transfer. Settings come from the session unless given."""

    def __init__(self, spark: SparkSession, **changes):
        self.spark, self.changes = spark, changes
        self.profile = Profile()

    @property
    def config(self) -> TransferConfig:
        return TransferConfig.of(self.spark, **self.changes)

    def sql(self, query: str, **arguments) -> DataFrame:
        return self.transfer(self.spark.sql(query, **arguments))

    def read(self, df: DataFrame) -> tuple[object, list[Scope]]:
        plan = df._jdf.queryExecution().optimizedPlan()
        return plan, PlanReader(self.spark).read(plan)

    def plans(self, df: DataFrame, config: TransferConfig | None = None) -> tuple[object, list[Transfer]]:
        """The optimized plan, and what transfer would do in each of its join graphs."""
        config = config or self.config
        plan, scopes = self.read(df)
        made = [planned(s.graph(), {i: PlanTable(self.spark, leaf) for i, leaf in s.leaves.items()}, config) for s in scopes]
        return plan, [t for t in made if t]

    def transfer(self, df: DataFrame) -> DataFrame:
        """A DataFrame with the same rows, whose tables are reduced before they are joined."""
        config, self.profile = self.config, Profile()
        with self.profile.timed("planning_micros"):
            plan, transfers = self.plans(df, config)
        predicates: dict[tuple[int, ...], Column] = {}
        for t in transfers:
            self._display(t, config)
            perform(self.spark, t, config, self.profile)
            predicates |= {s.leaf.path: s.predicate for s in t.tables.values() if s.predicate is not None}
        if config.profiling:
            print(self.profile.text())
        if not predicates:
            return df
        return frame(self.spark, rewritten(self.spark, plan, predicates))

    def _display(self, t: Transfer, config: TransferConfig) -> None:
        if log.isEnabledFor(logging.DEBUG):
            log.debug("%s\n%s", levels_text(t.plan, t.names), steps_text(t.steps, t.plan, t.names))
        if config.display_dag:
            print(tree_text(t.plan, t.names) if config.heuristic == "largest_root" else levels_text(t.plan, t.names))
        if config.display_physical_dag:
            print(levels_text(t.plan, t.names))

    def explain(self, df: DataFrame, run: bool = False) -> str:
        """The schedule of each join graph; with run, filters are built and the physical plan follows."""
        config, profile = self.config, Profile()
        plan, transfers = self.plans(df, config)
        parts, predicates = [], {}
        for t in transfers:
            if run:
                perform(self.spark, t, config, profile)
                predicates |= {s.leaf.path: s.predicate for s in t.tables.values() if s.predicate is not None}
            shown = levels_text if config.heuristic == "join_order" else tree_text
            parts += [shown(t.plan, t.names), steps_text(t.steps, t.plan, t.names, t.used)]
        if not transfers:
            parts.append("no transfer: there are fewer than two join edges")
        if run:
            made = frame(self.spark, rewritten(self.spark, plan, predicates))
            parts.append(made._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return "\n".join(parts)

    def profile_rows(self) -> DataFrame:
        """The last transfer's filters: one row for each use."""
        rows = [(u.sequence, u.build, u.table, u.columns, u.forward, u.rows_in, u.rows_out) for u in self.profile.uses]
        return self.spark.createDataFrame(rows, "sequence int, build_table string, probe_table string, columns string, forward boolean, rows_in long, rows_out long")


def transferred(df: DataFrame, **changes) -> DataFrame:
    return TransferSession(df.sparkSession, **changes).transfer(df)


def always(spark: SparkSession, **changes) -> TransferSession:
    """A session that leaves out no filter because of sizes, as suits tests and small data."""
    return TransferSession(spark, **({"gate": False, "min_probe_bytes": 0} | changes))


__all__ = ["TransferSession", "always", "perform", "planned", "transferred"]
