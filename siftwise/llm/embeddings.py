"""Embedding near-duplicates by sorted projection passes.

In each pass vectors are ordered by a word of sign bits of random projections, so the order is
lexicographic by concatenated random hashes, and neighbours in the order are compared: those of a
block and the first rows of the next one. Verified pairs are united across passes. Where links reach
the end of a window, as in a group of copies longer than it, the window is extended block by block
until they no longer do.

How many passes a vector takes part in is measured. The leading bits that its key shares with the ends of
what it was compared with tell how many bits a neighbour must share to have met it, and so the chance that
a pair right at the threshold was missed. Vectors for which that chance, over all passes, is above the
stated one go on to a further round among themselves, in which every block is compared with more
following ones: twice as many in each round, so a crowded region ends by being compared whole.
A pair with one vector that stopped was looked for often enough from that vector's side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwise.llm.graph import components
from siftwise.llm.scratch import Scratch

THRESHOLD = 0.9
#: Chance of missing a pair that lies right at the threshold.
MISS = 1e-3
#: Rows of a block, and rows of the next block that its rows are compared with.
BLOCK, OVERLAP = 1024, 256
BITS = 64
#: Passes of one further round; those of the first follow from the number of vectors.
ROUND = 4


def passes_for(vectors: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Passes of the first round: enough where vectors spread evenly over sign words."""
    bits = max(1.0, math.log2(max(2, vectors) / OVERLAP))
    return max(4, math.ceil(math.log(miss) / math.log(1 - _agree(threshold) ** bits)))


def _agree(threshold: float) -> float:
    """Chance that one sign bit of two vectors at the threshold is the same."""
    return 1 - math.acos(threshold) / math.pi


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _scaled(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = _matrix(column)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _keys(first: int, passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One key, signed, for each pass from `first` on."""
        planes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes = {dim: [np.random.default_rng((seed, first + p, dim)).standard_normal((dim, BITS)) for p in range(passes)]}
                x = _scaled(part.column("embedding"))
                keys = np.empty((len(x), passes), np.int64)
                for p, plane in enumerate(planes[dim]):
                    words = np.packbits(x @ plane > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)
                    keys[:, p] = (words ^ np.uint64(1 << 63)).view(np.int64)
                offsets = pa.array(np.arange(0, keys.size + 1, passes, dtype=np.int32))
                yield pa.record_batch({"rid": part.column("rid"), "dim": part.column("dim"), "keys": pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))})

    return run


def _shared(keys: np.ndarray, key: int) -> np.ndarray:
    """Leading bits that each key has in common with one."""
    differ = (keys ^ np.int64(key)).view(np.uint64)
    high, low = differ >> np.uint64(32), differ & np.uint64(0xFFFFFFFF)
    half = np.where(high > 0, high, low).astype(np.float64)
    bits = np.floor(np.log2(np.maximum(half, 1))).astype(int)
    return np.where(high > 0, 31 - bits, np.where(low > 0, 63 - bits, 64))


def _fresh(ranks: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray, turns: int, size: int, overlap: int) -> np.ndarray:
    """Which pairs no other comparison holds: neither the windows of the first `turns` passes, nor blocks up to `ends`."""
    out = np.ones(len(i), bool)
    for k in range(0, len(i), 16384):
        a, b = i[k : k + 16384], j[k : k + 16384]
        low, high = np.minimum(ranks[a], ranks[b]), np.maximum(ranks[a], ranks[b])
        gap = high // size - low // size
        met = ((gap == 0) | ((gap == 1) & (high % size < overlap)))[:, :turns].any(axis=1)
        end = np.where(ranks[a] <= ranks[b], ends[a], ends[b])
        out[k : k + 16384] = ~met & ~(high // size <= end).any(axis=1)
    return out


def _links(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs from left and right rows whose cosine, in double precision, reaches the threshold."""
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    rough = unit.astype(np.float32)
    i, j = np.nonzero(rough[left] @ rough[right].T >= threshold - 1e-4)
    i, j = left[i], right[j]
    exact = np.concatenate([np.einsum("ij,ij->i", unit[i[k : k + 65536]], unit[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.empty(0)])
    return i[exact >= threshold], j[exact >= threshold]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that the pairs lead to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[label]
        if (label == before).all():
            return label


#: A link (rid, other); or what a row's comparisons in a pass add (rid, turn, degree, after, before); or a window
#: whose links reach its end (dim, turn, block, reach).
OUT_SQL = "rid long, other long, degree long, after int, before int, dim int, turn int, block long, reach long"
OUT = pa.schema([(name, pa.int64() if kind == "long" else pa.int32()) for name, kind in (c.split() for c in OUT_SQL.split(", "))])
#: More bits than a key has: nothing is known to have been compared beyond.
UNKNOWN = BITS + 1


def _part(n: int, **columns) -> pa.Table:
    filled = {name: np.full(n, value) if np.isscalar(value) else value for name, value in columns.items()}
    return pa.Table.from_arrays([pa.array(filled[f.name], f.type) if f.name in filled else pa.nulls(n, f.type) for f in OUT], schema=OUT)


def _told(table: pa.Table, i, j, after, before, dim: int, turn: int, block: int, reach: int | None) -> pa.Table:
    """Links as a forest, counts and borders of rows, and how far the window's links reach."""
    rid, copies = table.column("rid").to_numpy(), table.column("copies").to_numpy()
    degree = np.zeros(len(rid), np.int64)
    np.add.at(degree, i, copies[j])
    np.add.at(degree, j, copies[i])
    label = _forest(len(rid), i, j)
    bound = np.flatnonzero(label != np.arange(len(rid)))
    parts = [_part(len(bound), rid=rid[bound], other=rid[label[bound]]), _part(len(rid), rid=rid, turn=turn, degree=degree, after=after, before=before)]
    if reach is not None:
        parts.append(_part(1, dim=dim, turn=turn, block=block, reach=reach))
    return pa.concat_tables(parts)


def _window(threshold: float, size: int, overlap: int):
    def run(table: pa.Table) -> pa.Table:
        """A block and the first rows of the next one."""
        dim, turn, block = (table.column(c)[0].as_py() for c in ("dim", "turn", "block"))
        ranks, ends, key = _matrix(table.column("ranks"), np.int64), _matrix(table.column("ends"), np.int64), table.column("key").to_numpy()
        at = ranks[:, turn]
        own = at // size == block
        i, j = _links(_scaled(table.column("embedding")), np.flatnonzero(own), np.arange(len(at)), threshold)
        up = at[i] < at[j]
        i, j = i[up], j[up]
        reaches = (~own[j] & (at[j] % size >= overlap * 3 // 4)).any()
        new = _fresh(ranks, ends, i, j, turn, size, overlap)
        end = _shared(key, key[at.argmax()]) + 1 if not own.all() else 0
        after = np.where(own, end, UNKNOWN)
        start = _shared(key, key[at.argmin()]) + 1 if block else 0
        # the first rows of a block are told of their past by the window before it
        before = np.where(own & (at % size < overlap) & (block > 0), UNKNOWN, start)
        return _told(table, i[new], j[new], after, before, dim, turn, block, block if reaches else None)

    return run


def _beyond(threshold: float, size: int, overlap: int, all_blocks: bool):
    def run(table: pa.Table) -> pa.Table:
        """Block `block` against block `other`; only pairs that nothing else holds."""
        dim, turn, block, other = (table.column(c)[0].as_py() for c in ("dim", "turn", "block", "other"))
        ranks, ends, key = _matrix(table.column("ranks"), np.int64), _matrix(table.column("ends"), np.int64), table.column("key").to_numpy()
        at = ranks[:, turn]
        mine = at // size == block
        i, j = _links(_scaled(table.column("embedding")), np.flatnonzero(mine), np.flatnonzero(~mine), threshold)
        new = _fresh(ranks, ends, i, j, ranks.shape[1], size, overlap)
        reaches = (at[j] % size >= size * 3 // 4).any()
        # no row of the other block: ranks have no gaps, so nothing follows
        after = np.where(mine, _shared(key, key[at.argmax()]) + 1 if not mine.all() else 0, UNKNOWN)
        # only where all blocks are compared with the next ones is all between the two compared too
        start = _shared(key, key[at.argmin()]) + 1 if block else 0
        before = np.where(mine, UNKNOWN, start) if all_blocks and mine.any() else UNKNOWN
        return _told(table, i[new], j[new], after, before, dim, turn, block, other if reaches else None)

    return run


def _ranked(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, and its rank and key in each pass, by a range sort whose files are in order."""
    flat = keyed.select("rid", "dim", F.posexplode("keys").alias("turn", "key"))
    flat = flat.repartitionByRange("dim", "turn", "key", "rid").sortWithinPartitions("dim", "turn", "key", "rid")
    stored = scratch.save(flat.select("dim", "turn", "key", "rid"))
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    stored = stored.select("*", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))
    before = Window.partitionBy("dim", "turn").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("dim", "turn", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = stored.join(starts, ["dim", "turn", "_part"]).withColumn("rank", F.col("_start") + F.col("_row") - F.col("_first"))
    # one entry a pass, so a list of bounded length
    listed = ranked.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("turn", "rank", "key"))).alias("r"))
    return listed.select("rid", F.col("r.rank").alias("_ranks"), F.col("r.key").alias("keys"))


def _held(each: DataFrame, jobs: list[DataFrame]) -> DataFrame:
    """For each row and pass of the round the last block its block is compared with: before the last step, and with it."""
    last = len(jobs) - 1
    steps = reduce(DataFrame.unionByName, [job.withColumn("_step", F.lit(k)) for k, job in enumerate(jobs)])
    ends = steps.groupBy("dim", "turn", "block").agg(F.max(F.when(F.col("_step") < last, F.col("_to"))).alias("_was"), F.max("_to").alias("_is"))
    of = lambda c: F.coalesce(F.col(c), F.lit(-1).cast("long")).alias(c)
    rows = each.select("rid", "dim", "turn", "block").join(ends, ["dim", "turn", "block"], "left")
    listed = rows.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("turn", of("_was"), of("_is")))).alias("r"))
    return listed.select("rid", F.col("r._was").alias("_was"), F.col("r._is").alias("_is"))


def _round(rows: DataFrame, first: int, passes: int, reach: int, scratch: Scratch, threshold: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Passes `first` on over rows (rid, dim, embedding, copies, ranks, ends, left), each block compared with `reach` whole
    following ones at least. Returns what the windows told, and the rows with ranks and ends of these passes too."""
    keyed = rows.select("rid", "dim", "embedding").mapInArrow(_keys(first, passes, seed), "rid long, dim int, keys array<long>")
    placed = rows.join(_ranked(keyed, scratch), "rid").withColumn("ranks", F.concat("ranks", "_ranks")).drop("_ranks")
    none = F.array_repeat(F.lit(-1).cast("long"), passes)
    placed = scratch.save(placed)
    each = placed.select("*", F.posexplode("keys").alias("_local", "key")).drop("keys")
    each = each.withColumn("turn", F.col("_local") + first).withColumn("rank", F.element_at("ranks", F.col("turn") + 1))
    each = each.withColumn("block", F.floor(F.col("rank") / BLOCK))
    names = ["dim", "turn", "block", "rid", "copies", "ranks", "ends", "key", "embedding"]
    also = (F.col("rank") % BLOCK < OVERLAP) & (F.col("block") > 0)
    windows = each.withColumn("block", F.explode(F.when(also, F.array("block", F.col("block") - 1)).otherwise(F.array("block"))))
    windows = windows.withColumn("ends", F.concat("ends", none)).select(names)
    told = scratch.save(windows.groupBy("dim", "turn", "block").applyInArrow(_window(threshold, BLOCK, OVERLAP), OUT_SQL))
    found, jobs, step = [told], [], max(1, reach)
    # every block, or windows whose links reach their end: the next blocks, then twice as many at a time
    opened = each.select("dim", "turn", "block").distinct() if reach else told.filter("block is not null").select("dim", "turn", "block")
    opened = opened.withColumn("_from", F.col("block"))
    while True:
        job = scratch.save(opened.withColumn("_to", F.col("_from") + step))
        if not job.limit(1).count():
            break
        jobs.append(job)
        ends = F.transform("_is", lambda end, k: F.when(k + first < F.col("turn"), end).otherwise(F.element_at("_was", k + 1)))
        wide = each.join(_held(each, jobs), "rid").withColumn("ends", F.concat("ends", ends)).select(names)
        asked = job.withColumn("other", F.explode(F.sequence(F.col("_from") + 1, F.col("_to")))).select("dim", "turn", "block", "other")
        left = wide.join(asked, ["dim", "turn", "block"])
        right = wide.withColumnRenamed("block", "other").join(asked, ["dim", "turn", "other"])
        both = left.unionByName(right)
        compare = _beyond(threshold, BLOCK, OVERLAP, all_blocks=bool(reach) and len(jobs) == 1)
        told = scratch.save(both.groupBy("dim", "turn", "block", "other").applyInArrow(compare, OUT_SQL))
        found.append(told)
        last = job.select("dim", "turn", "block", F.col("_to").alias("reach"))
        opened = told.filter("block is not null").join(last, ["dim", "turn", "block", "reach"]).select("dim", "turn", "block", F.col("reach").alias("_from"))
        step *= 2
    placed = placed.drop("keys")
    if jobs:
        placed = placed.join(_held(each, jobs), "rid").withColumn("ends", F.concat("ends", "_is")).drop("_was", "_is")
    else:
        placed = placed.withColumn("ends", F.concat("ends", none))
    return reduce(DataFrame.unionByName, found), placed


def _compared(reps: DataFrame, scratch: Scratch, threshold: float, miss: float, seed: int) -> DataFrame:
    """rid, other: links that join all that are linked; and rid, degree: linked rows, counted with their copies."""
    empty = F.array().cast("array<long>")
    rows = reps.select("rid", "dim", "embedding", "copies", empty.alias("ranks"), empty.alias("ends"), F.lit(0.0).alias("left"))
    first, passes, reach, all_found = 0, passes_for(reps.count(), threshold, miss), 0, []
    while True:
        found, placed = _round(rows, first, passes, reach, scratch, threshold, seed)
        all_found.append(found.filter("rid is not null").select("rid", "other", "degree"))
        seen = found.filter("turn is not null and rid is not null").groupBy("rid", "turn").agg(F.min("after").alias("_after"), F.min("before").alias("_before"))
        bits = F.greatest("_after", "_before")
        missed = F.log(F.greatest(1 - F.pow(F.lit(_agree(threshold)), bits), F.lit(1e-300)))
        gain = seen.groupBy("rid").agg(F.sum(missed).alias("_gain"))
        rows = placed.join(gain, "rid").withColumn("left", F.col("left") + F.col("_gain")).drop("_gain")
        rows = scratch.save(rows.filter(F.col("left") > math.log(miss)))
        if not rows.limit(1).count():
            return reduce(DataFrame.unionByName, all_found)
        first, passes, reach = first + passes, ROUND, max(1, 2 * reach)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, seed: int = 11) -> DataFrame:
    """Returns vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of
    different dimensions don't link. Equal vectors are compared once and count with their number. A null vec_id is
    a vector like any other; a component's id is the least vec_id that isn't null in it. An empty table gives no rows; columns
    besides vec_id and embedding are not read.
    """
    scratch = Scratch(vectors.sparkSession, "embed")
    real = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fit = F.coalesce(F.forall("embedding", real) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = rows.filter(fit)
    reps = good.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    reps = scratch.save(reps.withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    found = _compared(reps, scratch, threshold, miss, seed)
    degree = found.groupBy("rid").agg(F.sum("degree").alias("others"))
    links = found.filter("other is not null").select(F.col("rid").alias("a"), F.col("other").alias("b"))
    rooted = components(links, scratch).select(F.col("node").alias("rid"), "component")
    told = reps.join(degree, "rid", "left").join(rooted, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    told = scratch.save(told.select("rid", "first_id", "copies", "component", F.coalesce("others", F.lit(0)).alias("others")))
    least = told.groupBy("component").agg(F.min("first_id").alias("component_id"))
    told = told.join(least, "component").select("rid", "component_id", (F.col("others") + F.col("copies") - 1).alias("n_links"))
    named = reps.select("rid", "embedding").join(told, "rid").select(F.col("embedding").alias("_vector"), "component_id", "n_links")
    linked = good.join(named, F.col("embedding") == F.col("_vector")).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
