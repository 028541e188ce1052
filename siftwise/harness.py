"""Runs each query with and without predicate transfer, compares rows, and reports times.

A query that fails on either side is an error, not an equal result. Rows are compared without regard to order.

    python -m siftwise.harness --data FOLDER [--query NAME ...] [--limit N] [--runs N] [--heuristic join_order]
        [--no-own plain|transfer|both] [--save-baseline FILE | --baseline FILE] [--verbose]
"""

from __future__ import annotations

import argparse
import json
import math
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Times within this share count as the same.
SAME = 0.05
#: Spark's own runtime filters, turned off on either side for a fair comparison.
OWN_FILTERS = ("spark.sql.optimizer.runtime.bloomFilter.enabled", "spark.sql.optimizer.dynamicPartitionPruning.enabled")


@dataclass
class Outcome:
    query: str
    equal: bool
    plain_s: float = 0.0
    transfer_s: float = 0.0
    error: str = ""

    @property
    def speedup(self) -> float:
        return self.plain_s / self.transfer_s if self.transfer_s else 0.0

    @property
    def verdict(self) -> str:
        if self.error:
            return "error"
        return "faster" if self.speedup > 1 + SAME else "slower" if self.speedup < 1 - SAME else "same"


def canonical(rows: list) -> list[str]:
    """Rows as text, sorted; doubles to nine digits, as their sums depend on order."""
    return sorted(str(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r)) for r in rows)


def _timed(make: Callable[[], DataFrame], runs: int) -> tuple[list, float]:
    best, rows = math.inf, []
    for _ in range(runs):
        begun = time.perf_counter()
        rows = make().collect()
        best = min(best, time.perf_counter() - begun)
    return rows, best


def compare(
    spark: SparkSession, name: str, plain: Callable[[], DataFrame] | tuple[list[str], float], transfer: Callable[[], DataFrame], runs: int = 1, no_own: str = ""
) -> Outcome:
    """plain may be a baseline's rows and seconds. no_own: plain, transfer or both, to turn Spark's own runtime filters off there."""
    try:
        got = {}
        for side, make in (("plain", plain), ("transfer", transfer)):
            if isinstance(make, tuple):
                got[side] = make
                continue
            off = no_own in (side, "both")
            held = {k: spark.conf.get(k) for k in OWN_FILTERS}
            try:
                for k in OWN_FILTERS if off else ():
                    spark.conf.set(k, "false")
                rows, seconds = _timed(make, runs)
                got[side] = canonical(rows), seconds
            finally:
                for k, v in held.items():
                    spark.conf.set(k, v)
    except Exception as e:
        return Outcome(name, False, error=f"{type(e).__name__}: {str(e)[:300]}")
    (a, plain_s), (b, transfer_s) = got["plain"], got["transfer"]
    return Outcome(name, a == b, plain_s, transfer_s)


def summary(outcomes: list[Outcome]) -> str:
    """A line for each query, and the geometric mean of the speedups of those that agree."""
    lines = [f"{o.query}: {'PASS' if o.equal else 'FAIL'} {o.error or f'{o.plain_s:.2f} s, {o.transfer_s:.2f} s, {o.speedup:.2f}x {o.verdict}'}" for o in outcomes]
    good = [o for o in outcomes if o.equal and o.speedup > 0]
    if good:
        mean = math.exp(sum(math.log(o.speedup) for o in good) / len(good))
        counts = {v: sum(o.verdict == v for o in good) for v in ("faster", "slower", "same")}
        lines.append(f"{len(good)} of {len(outcomes)} agree; geometric mean {mean:.2f}x; " + ", ".join(f"{n} {v}" for v, n in counts.items()))
    return "\n".join(lines)


def main(arguments: list[str]) -> int:
    from siftwise import queries as core

    parser = argparse.ArgumentParser(prog="siftwise.harness")
    parser.add_argument("--data", required=True)
    parser.add_argument("--query", nargs="*", default=list(core.QUERIES))
    parser.add_argument("--limit", type=int)
    parser.add_argument("--runs", type=int, default=1)
    parser.add_argument("--heuristic", choices=("largest_root", "join_order"))
    parser.add_argument("--no-own", choices=("plain", "transfer", "both"), default="")
    parser.add_argument("--save-baseline")
    parser.add_argument("--baseline")
    parser.add_argument("--verbose", action="store_true")
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    changes = {"heuristic": asked.heuristic} if asked.heuristic else {}
    names = asked.query[: asked.limit]
    if asked.save_baseline:
        made = {}
        for name in names:
            rows, seconds = _timed(lambda n=name: core.plain(spark, asked.data, n), asked.runs)
            made[name] = [canonical(rows), seconds]
        with open(asked.save_baseline, "w") as file:
            json.dump(made, file)
        return 0
    known = {}
    if asked.baseline:
        with open(asked.baseline) as file:
            known = {n: (rows, seconds) for n, (rows, seconds) in json.load(file).items()}
    outcomes = []
    for name in names:
        plain = known.get(name) or (lambda n=name: core.plain(spark, asked.data, n))
        outcomes.append(compare(spark, name, plain, lambda n=name: core.run(spark, asked.data, n, **changes), asked.runs, asked.no_own))
        if asked.verbose:
            print(outcomes[-1], flush=True)
    print(summary(outcomes))
    return int(not all(o.equal for o in outcomes))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
