"""Builds filters from key columns and turns them into predicates.

A build of a table of few rows is one aggregate over its keys: count, least, greatest and a Bloom filter for each. For other tables
the first aggregate counts distinct keys too, and, if they are few enough, Bloom filters are made in a second one over the
distinct keys: those are few after the map-side distinct, so partial filters come from few tasks however many the table has.
Many keys are dealt by their hash to several filters, none of which is larger than Spark can build.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwise.config import TransferConfig
from siftwise.functions.bloom import bloom_aggregate, key_hash, might_contain, piece_of, pieces_for

#: Types whose range is kept.
RANGED = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DATE", "TIMESTAMP", "TIMESTAMP_NTZ", "STRING")
#: A build that keeps more than this share of its table's rows is not worth a filter.
MOST_KEPT = 0.8
#: Tables of at most so many rows, by estimate, are built from in one job. They have few tasks, so few partial filters are sent.
ONE_JOB_ROWS = 2_000_000


@dataclass
class KeyFilter:
    """What is known of the keys of one column: its type, its number of rows, range and Bloom filters, one for each piece of the hashes."""

    type: str
    rows: int
    low: object = None
    high: object = None
    blooms: tuple[bytes | None, ...] = ()
    dull: bool = False

    def predicate(self, spark: SparkSession, key: Column) -> Column | None:
        """A test that each joining row passes. Null keys never join."""
        if not self.rows:
            return F.lit(False)
        test = None
        key = key.cast(self.type)
        if self.low is not None:
            test = key.between(_literal(self.low, self.type), _literal(self.high, self.type))
        if self.blooms:
            found = self._found(spark, key_hash(key))
            test = found if test is None else test & found
        return None if test is None else key.isNotNull() & test

    def _found(self, spark: SparkSession, hashes: Column) -> Column:
        tests = [F.lit(False) if b is None else might_contain(spark, b, hashes) for b in self.blooms]
        found, piece = tests[-1], piece_of(hashes, len(tests))
        for i in reversed(range(len(tests) - 1)):
            found = F.when(piece == i, tests[i]).otherwise(found)
        return found


@dataclass
class BuildRecord:
    table: str
    columns: int
    rows: int
    micros: int
    kinds: str
    forward: bool = True
    probes: list[str] = field(default_factory=list)


def _kept(value: Column, type_: str) -> Column:
    """A range end in a form that comes to the driver and back unchanged."""
    if type_ == "TIMESTAMP":
        return F.unix_micros(value)
    if type_ in ("TIMESTAMP_NTZ", "DATE"):
        return value.cast("string")
    return value


def _literal(value, type_: str) -> Column:
    return F.timestamp_micros(F.lit(value)) if type_ == "TIMESTAMP" else F.lit(value).cast(type_)


def _blooms(own: DataFrame, key: str, distinct: int) -> tuple[bytes | None, ...]:
    """Filters of the key's distinct values, at most pieces_for(max_keys) of them and 8 MiB each."""
    pieces = pieces_for(distinct)
    hashes = key_hash(F.col(key))
    own = own.select(key).filter(F.col(key).isNotNull()).distinct()
    made = bloom_aggregate(hashes, -(-distinct // pieces)).alias("b")
    if pieces == 1:
        return (bytes(own.agg(made).first()["b"]),)
    found = {r["p"]: bytes(r["b"]) for r in own.groupBy(piece_of(hashes, pieces).alias("p")).agg(made).collect()}
    return tuple(found.get(p) for p in range(pieces))


def build_filters(
    spark: SparkSession, rows: DataFrame, keys: Sequence[tuple[Column, str]], config: TransferConfig, estimate: int | None = None,
    whole: Callable[[], int | None] = lambda: None,
) -> tuple[list[KeyFilter], int]:
    """A filter for each (key column, type) of a table's rows, and the microseconds that it took. `estimate`: of the rows;
    too low a one costs a second job. `whole` counts the
    table before any reduction; filters of builds that keep most of it are marked dull and get no Bloom filter of their own job."""
    begun = time.perf_counter()
    ranges = config.filter_type != "bf_only"
    blooms = config.filter_type != "minmax_only"
    named = [k.cast(t).alias(f"k{i}") for i, (k, t) in enumerate(keys)]
    table = rows.select(*named).filter(" OR ".join(f"k{i} IS NOT NULL" for i in range(len(keys))))
    asked = [F.count(f"k{i}").alias(f"n{i}") for i in range(len(keys))]
    for i, (_, t) in enumerate(keys):
        if ranges and t in RANGED:
            asked += [_kept(F.min(f"k{i}"), t).alias(f"low{i}"), _kept(F.max(f"k{i}"), t).alias(f"high{i}")]
    few = blooms and estimate is not None and estimate <= min(ONE_JOB_ROWS, config.max_keys)
    for i in range(len(keys) if blooms else 0):
        key = F.col(f"k{i}")
        made = bloom_aggregate(F.when(key.isNotNull(), key_hash(key)), estimate) if few else F.approx_count_distinct(key, 0.05)
        asked.append(made.alias(f"b{i}"))
    told = table.agg(*asked).first().asDict()
    found = [KeyFilter(t, told[f"n{i}"], told.get(f"low{i}"), told.get(f"high{i}")) for i, (_, t) in enumerate(keys)]
    most = max(f.rows for f in found)
    total = whole() if config.gate and most else None
    if total and most > MOST_KEPT * total:
        for f in found:
            f.dull = True
        return found, int((time.perf_counter() - begun) * 1e6)
    for i, f in enumerate(found if blooms else []):
        if not f.rows:
            continue
        if few and f.rows <= 2 * max(1, estimate):
            f.blooms = (bytes(told[f"b{i}"]),)
            continue
        distinct = table.agg(F.approx_count_distinct(f"k{i}", 0.05)).first()[0] if few else told[f"b{i}"]
        distinct = int(distinct * 1.15) + 16  # the count is approximate
        if distinct <= config.max_keys:
            f.blooms = _blooms(table, f"k{i}", distinct)
    return found, int((time.perf_counter() - begun) * 1e6)


def in_parallel(tasks: list) -> list:
    """Runs Spark jobs side by side; the first error is raised."""
    if len(tasks) == 1:
        return [tasks[0]()]
    results: list = [None] * len(tasks)
    errors: list = []

    def run(i: int) -> None:
        try:
            results[i] = tasks[i]()
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(len(tasks))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]
    return results
