"""Text pictures of transfer plans, and the annotations of an explained query."""

from __future__ import annotations

from siftwise.plans.graph import Edge, Step, TransferPlan


def row_count(n: int) -> str:
    """Thousands, millions and billions of rows with one decimal."""
    for size, unit in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
        if n >= size:
            return f"{n / size:.1f}{unit} rows"
    return f"{n} rows"


def _label(edge: Edge, names: dict) -> str:
    return ", ".join(f"{names.get((edge.b, y), y)} / {names.get((edge.a, x), x)}" for x, y in edge.pairs)


def _box(plan: TransferPlan, table: int) -> str:
    t = plan.graph.tables[table]
    return f"[{t.name} (table {t.id}), {row_count(t.rows)}]"


def tree_text(plan: TransferPlan, names: dict | None = None) -> str:
    """Each table under its parent, with the key columns (parent's / child's) of the edge."""
    names = names or {}
    lines = ["=== DAG ==="]

    def draw(table: int, lead: str, edge: Edge | None, last: bool) -> None:
        mark = "" if edge is None else ("`-- " if last else "|-- ")
        lines.append(f"{lead}{mark}{_box(plan, table)}" + (f"  on {_label(edge, names)}" if edge else ""))
        below = plan.children(table)
        for i, e in enumerate(below):
            draw(e.a, lead if edge is None else lead + ("    " if last else "|   "), e, i + 1 == len(below))

    for root in plan.roots:
        draw(root, "", None, True)
    return "\n".join(lines)


def levels_text(plan: TransferPlan, names: dict | None = None) -> str:
    """Tables level by level, each with all of its parents."""
    names = names or {}
    lines = ["=== Physical Plan DAG ==="]
    for level in range(max(plan.levels.values(), default=-1) + 1):
        lines.append(f"level {level}:")
        for table in (t for t, x in plan.levels.items() if x == level):
            lines.append(f"  {_box(plan, table)}")
            lines += [f"    -> {_box(plan, e.b)}  on {_label(e, names)}" for e in plan.parents[table]]
    return "\n".join(lines)


def steps_text(steps: list[Step], plan: TransferPlan, names: dict | None = None, kinds: dict[int, str] | None = None) -> str:
    """CREATE and USE lines of a schedule, in order; filters of a table for several others are one CREATE."""
    names, kinds, lines, at = names or {}, kinds or {}, [], 0
    tables = plan.graph.tables
    while at < len(steps):
        same = [steps[at]]
        while at + len(same) < len(steps) and (s := steps[at + len(same)]).build == same[0].build and s.forward == same[0].forward:
            same.append(s)
        build = tables[same[0].build]
        columns = dict.fromkeys(names.get((build.id, x), x) for s in same for x, _ in s.pairs)
        probes = dict.fromkeys(tables[s.probe].name for s in same)
        lines.append(
            f"CREATE_BF [{len(columns)} filters] {'forward' if same[0].forward else 'backward'}: build table {build.name}, "
            f"build columns ({', '.join(f'{build.name}.{c}' for c in columns)}), probe tables {', '.join(probes)}, estimated cardinality {build.rows}"
        )
        for s in same:
            probe = tables[s.probe]
            columns = ", ".join(f"{probe.name}.{names.get((probe.id, y), y)}" for _, y in s.pairs)
            lines.append(f"  USE_BF ({kinds.get(s.sequence, 'passthrough, pushed to scan')}): build table {build.name}, probe table {probe.name}, probe columns ({columns})")
        at += len(same)
    return "\n".join(lines)
