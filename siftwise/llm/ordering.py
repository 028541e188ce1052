"""Total orders, gapless ranks and running sums over tables of any size, without a single-task window.

Rows are range-sorted into files that follow one another, so a row's place is its file's place and its own in the file.
Files are counted per key, the counts are summed up over the files of a key, and rows are numbered inside their
file. A key with any share of the rows is spread over as many files as it fills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwise.llm.scratch import Scratch


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct, _row, so that no name of theirs meets an operator's own."""
    return docs.select(F.struct("*").alias("_row"))


def field(name: str) -> Column:
    return F.col("_row").getField(name)


def unpacked(rows: DataFrame, columns: Sequence[str], **values: Column) -> DataFrame:
    """The columns of a table from packed(), some of them with other values."""
    return rows.select(*[values.get(c, field(c)).alias(c) for c in columns])


def in_order(df: DataFrame, scratch: Scratch, *order: Column | str) -> DataFrame:
    """The rows of df, stored in the order given, with _part (the file's place) and _index (the row's in it).

    Rows equal in the order are split between files like others. df is computed twice, so it had better be stored.
    """
    by = [*order, F.col("_tie")]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    stored = scratch.save(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie"))
    name = F.col("_metadata.file_name")
    place = F.regexp_extract(name, r"part-(\d+)", 1).cast("long") * 1_000_000
    place += F.coalesce(F.nullif(F.regexp_extract(name, r"-c(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    return stored.select("*", place.alias("_part"), F.col("_metadata.row_index").alias("_index"))


def with_ranks(ordered: DataFrame, keys: Sequence[str], name: str, **sums: str) -> DataFrame:
    """Adds name: 0, 1, ... among the rows of equal keys, of a table from in_order() sorted by the keys first.

    sums name further columns: the total of a column over the earlier rows of equal keys. Null keys are equal.
    """
    counts = [F.count(F.lit(1)).alias("_n"), F.min("_index").alias("_first"), *[F.sum(c).alias(f"_of_{s}") for s, c in sums.items()]]
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = ordered.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at")).agg(*counts)
    starts = starts.select("*", before("_n").alias("_start"), *[before(f"_of_{s}").alias(f"_start_{s}") for s in sums])
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = ordered.join(starts, same)
    inside = Window.partitionBy(*keys, "_part").orderBy("_index").rowsBetween(Window.unboundedPreceding, -1)
    for s, c in sums.items():
        rows = rows.withColumn(s, F.col(f"_start_{s}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    own = [c for c in ordered.columns if c not in ("_part", "_index")]
    return rows.select(*own, (F.col("_start") + F.col("_index") - F.col("_first")).alias(name), *sums)
