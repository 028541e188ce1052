"""Near copies by Jaccard similarity of word shingles: SimHash and ball hashing, then an exact check.

Texts with one set of shingles are one node. Each bit of a set's SimHash is the sign of a sum of its shingles' random
weights, so two sets differ in a bit with about the chance of their angle / pi: 0.1515 at most for a similarity of 0.8, as
cosines are 2 s / (1 + s) at least (sets of four and five shingles: 0.159 measured, 0.148 by angle). 64 bits can't hold such
pairs within few bits, so there are TABLES fingerprints, and sets meet in one if its leading bits are equal and the others
within two bits: equal variants within one, half of that, as op1's. Of sets that meet, those whose CHECK further bits are
within REACH go on. They are compared shingle by shingle before they are united; only pairs already connected through other
sets of their key are left out, so a large group of near copies of one text is united by as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwise.llm.graph import components
from siftwise.llm.scratch import Scratch

WORDS, SIMILARITY = 5, 0.8
#: A pair that differs in each bit with the chance 0.1515 meets with 0.102 in a table, with 0.9999 in any of them; with 0.159, 0.086 and 0.9996.
TABLES, EXACT, BALL = 88, 6, 24
#: Bits compared where sets meet: of CHECK, pairs of 0.8 differ in 19.4 with a deviation of 4.1, unrelated ones in 64.
CHECK, REACH = 128, 40
SEED = 42
#: Variants made at once, and members beyond which those of one variant are compared by one search instead of all at once.
VARIANTS, CROWD = 1 << 22, 8
#: Texts taken from a batch at once, and shingles hashed at once.
TEXTS, BLOCK = 256, 256  # BLOCK: sums of bytes fit into 16 bits


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """The distinct runs of `words` words; a shorter text is one run, one without words has none."""
    tokens = (text or "").encode().lower().split()  # as in simhash.fingerprint
    return {b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of a set of shingles, given by their 64-bit hashes: EXACT + BALL bits for each table, and the CHECK bits as two longs.

    Weights are bytes drawn by the hash, so that sums of few shingles, too, differ nearly by their angle and hardly ever tie.
    """
    bits = TABLES * (EXACT + BALL) + CHECK
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, -(-bits // 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums, lanes = np.zeros((2, len(factors), 4), np.int64), np.uint64(0x00FF00FF00FF00FF)
    for at in range(0, len(hashes), BLOCK):
        drawn = hashes[at : at + BLOCK, None] * factors
        drawn ^= drawn >> np.uint64(29)
        drawn *= np.uint64(0xBF58476D1CE4E5B9)
        drawn ^= drawn >> np.uint64(32)
        sums[1] += ((drawn >> np.uint64(8)) & lanes).sum(axis=0).view("<u2").reshape(-1, 4)
        drawn &= lanes
        sums[0] += drawn.sum(axis=0).view("<u2").reshape(-1, 4)
    found = (2 * sums > 255 * len(hashes)).transpose(1, 2, 0).ravel()[:bits]
    tables = found[:-CHECK].reshape(TABLES, EXACT + BALL) @ (1 << np.arange(EXACT + BALL))
    return tables.astype(np.int32), np.packbits(found[-CHECK:]).view("<i8")


def _signed_sets(words: int):
    from xxhash import xxh3_128_digest, xxh64_intdigest

    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.string()), ("of_set", pa.binary()), ("prints", pa.list_(pa.int32())), ("check", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                names, prints, checks = [], [], []
                for text in part.column(2).to_pylist():
                    found = shingles(text, words)
                    hashes = np.sort(np.fromiter((xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))
                    names.append(xxh3_128_digest(hashes.tobytes()))
                    tables, check = fingerprints(hashes)
                    prints.append(tables if found else tables[:0])
                    checks.append(check)
                columns = [pa.array(names, pa.binary()), pa.array(prints, pa.list_(pa.int32())), pa.array(checks, pa.list_(pa.int64()))]
                yield pa.record_batch([part.column(0), part.column(1), *columns], schema=schema)

    return run


def _near(check: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(check[a] ^ check[b]).sum(axis=1, dtype=np.int64) <= REACH


def _meetings(ball: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Links that connect the rows which meet in a variant, and whose check bits are near."""
    masks = np.array([0, *[1 << k for k in range(BALL)]], np.int64)  # within one bit
    passes = max(1, -(-len(ball) * len(masks) // VARIANTS))
    links = [np.empty((0, 2), np.int64)]
    for turn in range(passes):
        made, owners = [], []
        for at in range(0, len(ball), VARIANTS // 16):
            all_ = (ball[at : at + VARIANTS // 16, None] ^ masks).ravel()
            keep = np.flatnonzero(all_ % passes == turn)
            made.append(all_[keep])
            owners.append(at + keep // len(masks))
        values, owners = np.concatenate(made), np.concatenate(owners)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        for lag in range(1, CROWD):
            same = np.flatnonzero(values[lag:] == values[:-lag])
            if not len(same):
                break
            a, b = owners[same], owners[same + lag]
            near = _near(check, a, b)
            links.append(np.unique(np.stack([a[near], b[near]], axis=1), axis=0))
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        sizes = np.diff(np.append(starts, len(values)))
        for k in np.flatnonzero(sizes > CROWD):
            left = owners[starts[k] : starts[k] + sizes[k]]
            while len(left):
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    one = queue.pop()
                    near = _near(check, left, np.full(len(left), one))
                    queue.extend(left[near])
                    links.append(np.stack([np.full(near.sum(), one), left[near]], axis=1))
                    left = left[~near]
    return np.unique(np.concatenate(links), axis=0)


def _met(table: pa.Table) -> pa.Table:
    """For the rows of one table and one value of its leading bits: a key for each group connected by meetings."""
    from xxhash import xxh64_intdigest

    rid, part = table.column("rid").to_numpy(), table.column("part")[0].as_py()
    ball = table.column("print").to_numpy().astype(np.int64) & ((1 << BALL) - 1)
    check = np.stack([table.column(c).to_numpy().view("u8") for c in ("one", "two")], axis=1)
    up: dict[int, int] = {}

    def root(n: int) -> int:
        while (above := up.setdefault(n, n)) != n:
            up[n] = n = up[above]
        return n

    for a, b in _meetings(ball, check).tolist():
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    members = list(up)
    # equal keys of different groups would only compare more
    keys = [xxh64_intdigest(f"{part} {rid[root(n)]}") >> 1 for n in members]
    return pa.table([pa.array(keys, pa.int64()), pa.array(rid[members], pa.int64())], schema=pa.schema([("key", pa.int64()), ("rid", pa.int64())]))


def meetings(sets: DataFrame) -> DataFrame:
    """From rid, prints and check: key and rid of all that meet others, a key for each group; a set may be in groups of several tables."""
    table, one = F.posexplode("prints").alias("table", "print"), F.col("check")
    rows = sets.select("rid", one[0].alias("one"), one[1].alias("two"), table)
    part = F.col("table") * (1 << EXACT) + F.shiftright("print", BALL)
    return rows.select("rid", "one", "two", "print", part.alias("part")).groupBy("part").applyInArrow(_met, "key long, rid long")


def _united(words: int, similarity: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        """For the texts of one key: links that connect all those with a chain of similar pairs."""
        rid, ids, flat, sizes = table.column("rid").to_numpy(), {}, [], []
        for at in range(0, len(rid), TEXTS):
            for text in table.column("text").slice(at, TEXTS).to_pylist():
                found = [ids.setdefault(s, len(ids)) for s in shingles(text, words)]
                flat.append(np.array(found, np.int32))
                sizes.append(len(found))
        sizes, left = np.array(sizes), np.arange(len(rid))
        # those not reached yet, one after another, and where each begins
        rest, links, mark = np.concatenate(flat), [], np.zeros(len(ids), bool)
        while len(left):
            queue, left, rest = [left[0]], left[1:], rest[sizes[left[0]] :]
            while queue and len(left):
                one = queue.pop()
                mark[flat[one]] = True
                both = np.add.reduceat(mark[rest], np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
                mark[flat[one]] = False
                near = both / (sizes[left] + sizes[one] - both) >= similarity
                if near.any():
                    queue.extend(left[near])
                    links.append(np.stack([np.full(near.sum(), rid[one]), rid[left[near]]], axis=1))
                    rest, left = rest[np.repeat(~near, sizes[left])], left[~near]
        links = np.concatenate(links or [np.empty((0, 2), np.int64)])
        return pa.table([pa.array(links[:, i]) for i in (0, 1)], schema=schema)

    return run


def row_key() -> Column:
    """Equal for rows with equal doc_id and text, null-safe; a null text counts as empty."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Returns, for each component of near copies, first: the least doc_id of its rows and that row's row_key.

    A link is a pair of rows whose sets of shingles have at least that Jaccard similarity. Texts without words, null
    ones too, are alike. Null doc_ids come last; among rows with one doc_id the least row_key counts. An empty
    table gives no rows; columns besides doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "shingles")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    prints = scratch.save(slim.mapInArrow(_signed_sets(words), "doc_id long, row_key string, of_set binary, prints array<int>, check array<long>"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    sets = prints.groupBy("of_set").agg(F.min(row).alias("first"), F.first("prints").alias("prints"), F.first("check").alias("check"))
    sets = scratch.save(sets.withColumn("rid", F.monotonically_increasing_id()))
    keyed = scratch.save(meetings(sets))
    names = [F.bit_xor(F.xxhash64("rid")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "rid")).alias("_y")]
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), *names).filter("_n > 1")
    # many keys have the same members; one of them is enough
    met = scratch.save(keyed.join(groups.groupBy("_n", "_x", "_y").agg(F.min("key").alias("key")), "key").select("key", "rid"))
    asked = met.select("rid").distinct().join(sets, "rid").select("rid", F.col("first.row_key").alias("_row"))
    texts = slim.select("row_key", "text").join(asked, F.col("row_key") == F.col("_row")).dropDuplicates(["rid"])
    texts = scratch.save(texts.select("rid", "text"))
    links = scratch.save(met.join(texts, "rid").groupBy("key").applyInArrow(_united(words, similarity), "a long, b long"))
    rooted = components(links, scratch)
    of = sets.join(rooted, sets["rid"] == rooted["node"], "left").select(F.coalesce("component", "rid").alias("component"), "first")
    return of.groupBy("component").agg(F.min("first").alias("first"))
