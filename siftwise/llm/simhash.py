"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most four bits have a common variant within two bits of
each. Every distinct fingerprint emits all its variants within half the radius; equal variants
link. The 2,081 variants of a fingerprint are dealt by their leading bits, and a task makes
those that begin with its own bits, so that only one row for each (fingerprint, prefix) is
shuffled and not one for each variant. Prefixes with many rows are extended by further bits until
each fits, so a hot one is split. All fingerprints that meet in a variant are within the radius
of one another, so a chain through them keeps them connected without all their pairs; the links
of the chains are deduplicated and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwise.llm import shingles
from siftwise.llm.graph import components
from siftwise.llm.ordering import unpacked
from siftwise.llm.scratch import Scratch

WORDS = 4
RADIUS = 4
SEED = 42
#: Bits by which a prefix is extended, and the rows beyond which a prefix is extended again.
STEP, GROUP_ROWS = 8, 100_000
#: Variants made at once.
VARIANTS = 1 << 22


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text, unsigned. A null, empty or white text has fingerprint 0."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[len(tokens) - n :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), "<u8", n)
    set_in = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, "u8").view("i8"))], schema=schema)

    return run


def _flips(bits: int, most: int, shift: int) -> list[list[int]]:
    """Masks over `bits` bits that begin at `shift`, by their number of set bits."""
    return [[sum(1 << (shift + b) for b in c) for c in combinations(range(bits), k)] for k in range(most + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _extend(rows: DataFrame, depth: int, half: int) -> DataFrame:
    """Rows (value, fp, used) dealt to all values of the next STEP bits still within reach.

    value: the fingerprint with its leading bits replaced by those of the variants wanted.
    """
    masks = _flips(STEP, half, 64 - depth - STEP)
    arrays = [F.array(*[F.lit(_signed(m)) for k in range(left + 1) for m in masks[k]]) for left in range(half + 1)]
    case = F.when(F.col("used") == half, arrays[0])
    for used in range(half - 1, -1, -1):
        case = case.when(F.col("used") == used, arrays[half - used])
    return rows.select("fp", "used", "value", F.explode(case).alias("_mask")).select(
        (F.col("value").bitwiseXOR(F.col("_mask"))).alias("value"),
        "fp",
        (F.col("used") + F.bit_count("_mask")).cast("int").alias("used"),
    )


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("value", 64 - depth)


def _meet(depth: int, radius: int):
    """Links between fingerprints that meet in a variant, for the rows of one prefix."""
    half = radius // 2
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def chains(values: np.ndarray, fps: np.ndarray) -> np.ndarray:
        order = np.argsort(values)
        same = np.flatnonzero(values[order[1:]] == values[order[:-1]])
        return np.stack([fps[order[same]], fps[order[same + 1]]], axis=1)

    def run(table: pa.Table) -> pa.Table:
        value, fp = (table.column(c).to_numpy().view("u8") for c in ("value", "fp"))
        used = table.column("used").to_numpy()
        masks = [np.array(m, "u8") for m in _flips(64 - depth, half, 0)]
        sets = {u: np.concatenate(masks[: half - u + 1]) for u in range(half + 1)}
        rows = sum(int((used == u).sum()) * len(m) for u, m in sets.items())
        passes = -(-rows // VARIANTS)
        found = [np.empty((0, 2), "u8")]
        for turn in range(passes):
            made, owners = [], []
            for u, m in sets.items():
                v, f = value[used == u], fp[used == u]
                block = max(1, VARIANTS // 4 // len(m))
                for at in range(0, len(v), block):
                    all_ = v[at : at + block, None] ^ m[None, :]
                    own = np.broadcast_to(f[at : at + block, None], all_.shape)
                    if passes > 1:
                        keep = all_ * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
                        keep = keep % np.uint64(passes) == turn
                        made.append(all_[keep])
                        owners.append(own[keep])
                    else:
                        made.append(all_.ravel())
                        owners.append(own.ravel())
            found.append(np.unique(chains(np.concatenate(made), np.concatenate(owners)), axis=0))
        links = np.unique(np.concatenate(found), axis=0)
        links = links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= radius]
        return pa.table([pa.array(links[:, i].view("i8")) for i in (0, 1)], schema=schema)

    return run


def fingerprint_links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """From distinct fingerprints fp: pairs a, b that connect all those within the radius."""
    half = radius // 2
    rows = distinct.select(F.col("fp").alias("value"), "fp", F.lit(0).alias("used"))
    links, depth = None, 0
    while True:
        rows = scratch.save(_extend(rows, depth, half))
        depth += STEP
        counts = rows.groupBy(_prefix(depth).alias("_p")).count()
        hot = counts.filter(F.col("count") > GROUP_ROWS).select("_p")
        some = depth < 64 and bool(hot.limit(1).count())
        fit = rows.join(hot, _prefix(depth) == hot["_p"], "left_anti") if some else rows
        here = fit.withColumn("_p", _prefix(depth)).groupBy("_p").applyInArrow(_meet(depth, radius), "a long, b long")
        links = here if links is None else links.unionByName(here)
        if not some:
            return links
        rows = rows.join(hot, _prefix(depth) == hot["_p"], "left_semi")


def simhash_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Returns doc_id, fp, fingerprint (16 hexadecimal digits) and component_id.

    Texts without words, null ones too, have fingerprint 0 and link like any other. component_id is
    the least doc_id reachable over links of at most `radius` differing bits; null doc_ids count
    only if a component has no other. Repeated rows are returned each; an empty table gives no
    rows; columns besides doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(words), "doc_id long, fp long")
    prints = scratch.save(prints)
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    rooted = components(fingerprint_links(distinct.select("fp"), scratch, radius), scratch)
    linked = scratch.save(distinct.join(rooted, distinct["fp"] == rooted["node"]).select("fp", "first_id", "component"))
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = linked.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    of = distinct.join(of, F.col("fp") == F.col("_fp"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    return prints.join(of, F.col("fp") == F.col("_fp")).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, words: int = shingles.WORDS, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """One row of each group of near copies; columns of docs, whatever their names. A null text counts as empty; a very long one is
    compared as a whole; an empty table gives no rows.

    The row with the least doc_id stays, null doc_ids last; among rows with one doc_id that of the least hash of
    doc_id and text. Rows that share a doc_id but not the text are told apart; of rows equal in both any one stays.
    Near copies are rows connected by exact Jaccard similarities of their sets of word shingles, among those that ball
    hashing of the sets' SimHash brings together: not op1's one fingerprint of 64 bits, whose four bits are too tight for pairs
    of similarity 0.8, but several (see shingles.py).
    """
    kept = shingles.near_copies(docs, words, similarity).select(F.col("first.row_key").alias("_kept"))
    rows = docs.select(F.struct("*").alias("_row"), shingles.row_key().alias("_key"))
    rows = rows.join(kept, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key"])
    return unpacked(rows, docs.columns)
