"""What a transfer did and how long it took."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from siftwise.operators.filters import BuildRecord


@dataclass
class UseRecord:
    table: str
    build: str
    columns: str
    forward: bool
    sequence: int
    rows_in: int | None = None
    rows_out: int | None = None

    @property
    def selectivity(self) -> float | None:
        """Percent of rows that stay."""
        return None if not self.rows_in else 100.0 * (self.rows_out or 0) / self.rows_in


@dataclass
class Profile:
    planning_micros: int = 0
    builds: list[BuildRecord] = field(default_factory=list)
    uses: list[UseRecord] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    @contextmanager
    def timed(self, name: str):
        begun = time.perf_counter()
        try:
            yield
        finally:
            setattr(self, name, getattr(self, name) + int((time.perf_counter() - begun) * 1e6))

    def text(self) -> str:
        lines = [f"planning: {self.planning_micros} us"]
        for b in self.builds:
            lines.append(f"CREATE {b.table}: {b.rows} rows, {b.kinds}, {b.micros} us, {'forward' if b.forward else 'backward'}")
        for u in self.uses:
            told = "" if u.rows_in is None else f": {u.rows_in} -> {u.rows_out} rows, {u.selectivity or 0:.1f} %"
            lines.append(f"USE {u.table} <- {u.build} ({u.columns}), {'forward' if u.forward else 'backward'}{told}")
        counted = [u for u in self.uses if u.rows_in]
        for way in (True, False):
            some = [u for u in counted if u.forward is way]
            if some:
                gone = sum(u.rows_in - u.rows_out for u in some)
                lines.append(f"{'forward' if way else 'backward'}: {gone} rows removed")
        if counted:
            total = sum(u.rows_in for u in counted)
            lines.append(f"removed in all: {100.0 * sum(u.rows_in - u.rows_out for u in counted) / total:.1f} %")
        return "\n".join([*lines, *(f"skipped: {x}" for x in self.skipped)])
