"""Removal of repeated 100-byte strings by a hash-compared suffix sort.

Prefix polynomial hashes give the hash of any substring in constant time, so a binary search finds the common
extension of two suffixes in logarithmic time. That is the comparison of a mergesort of suffixes;
common extensions of neighbours are then verified byte by byte.

Sorting every suffix of a corpus would shuffle many times its size. A string of 100 bytes has one anchor, the
k-gram of least hash in it (leftmost among equals), and equal strings have equal anchors in the same place.
So only suffixes at anchors are sorted, a few for each hundred bytes. An anchor stands for the strings
whose anchor it is, and its surroundings are the bytes that they cover:

1. A task finds the anchors of its documents. Anchors with equal k-gram and surroundings (two 64-bit hashes, then byte by byte)
   are one occurrence: the strings of all but the first are repeated. So a passage that a third of all documents hold leaves a task once.
   Of those of different tasks, the ones with equal k-gram, shape and surroundings by both hashes are told by the hashes alone.
2. Where a k-gram has several surroundings, as at the ends of a shared passage, their first occurrences fetch
   them and are sorted as suffixes; runs of the sort with long enough common extensions,
   to the right by the sort and to the left by hash, are equal strings, and are compared byte by byte.
3. Anchors of a very common k-gram are first sorted where they are, so that each string leaves a task once, and then dealt by more than the
   k-gram: by the bytes that all strings of a narrow range of offsets from the anchor hold. Equal strings still meet.
4. The documents join what was found in them and drop it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwise.llm.scratch import Scratch

#: Bytes of a repeated string, and of an anchor.
LENGTH, GRAM = 100, 24
#: Text that a task looks at at once; anchors and suffixes that a group holds, on average.
CHUNK_BYTES, GROUP_ANCHORS, GROUP_SUFFIXES = 12_000_000, 200_000, 16_000
#: Rows taken from a batch at once, and rows of a byte-by-byte comparison.
SLICE, COMPARED = 256, 1 << 13
#: Offsets of a string from its anchor: those of one key when the anchors of a common k-gram are dealt again.
OFFSETS, NARROW = LENGTH - GRAM + 1, 8
#: Anchors of one k-gram that a task sends to meet those of others; of more it sends one and asks for the surroundings of all.
MEETING = 64
SLAB_BITS = 17
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n + n // 4, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                setattr(cls, name, np.multiply.accumulate(row))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashed:
    """Bytes with their prefix polynomial hashes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.up, self.down = Powers.to(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=self.prefix[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[begin]) * self.down[begin]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The common extension of suffixes at a and b, most at most, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a, a + mid) == self.of(b, b + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place, first and last string start, gram hash, and hash of the surroundings of each anchor."""
    n = len(data)
    starts = n - LENGTH + 1
    if starts <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    text = Hashed(data)
    span = LENGTH - GRAM + 1
    grams = mix((text.prefix[GRAM:] - text.prefix[:-GRAM]) * text.down[: n - GRAM + 1])
    mask = np.uint64((1 << SLAB_BITS) - 1)
    slab = (1 << SLAB_BITS) - LENGTH
    places, firsts, lasts = [], [], []
    for at in range(0, starts, slab):
        part = grams[at : min(at + slab, starts) + span - 1]
        key = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:  # least of windows of 1, 2, 4, ... then of span
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        place = (key & mask).astype(np.int64)
        turn = np.flatnonzero(place[1:] != place[:-1]) + 1
        first = np.concatenate(([0], turn))
        places.append(place[first] + at)
        firsts.append(first + at)
        lasts.append(np.concatenate((turn, [len(place)])) - 1 + at)
    q, lo, hi = np.concatenate(places), np.concatenate(firsts), np.concatenate(lasts)
    shape = ((q - lo) * 256 + (hi - lo)).astype(np.uint64)
    return q, lo, hi, grams[q], mix(text.of(lo, hi + LENGTH) ^ (shape * np.uint64(0xD1342543DE82EF95)))


_FOUND = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("place", pa.int32()), ("gram", pa.int64())])
_FOUND_SQL = "kind int, bucket int, data binary, doc_id long, digest long, begin int, end int, place int, gram long"
#: Kinds of rows: packed anchors for a bucket, a repeated range, an anchor whose surroundings are asked for, surroundings to be sorted, those of a common k-gram.
ANCHORS, REPEATED, ASKED, DEALT, COMMON = 0, 1, 2, 3, 4
_ANCHOR = np.dtype([("gram", "<u8"), ("around", "<u8"), ("doc", "<u4"), ("place", "<u4"), ("before", "u1"), ("more", "u1"), ("asked", "u1")])
_DOC = np.dtype([("id", "<i8"), ("digest", "<i8")])


def _table(n: int, **columns) -> pa.Table:
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND)


def _pack(docs: np.ndarray, rows: np.ndarray) -> bytes:
    """Columns one after another; documents that the rows don't name are left out."""
    used, doc = np.unique(rows["doc"], return_inverse=True)
    rows = rows.copy()
    rows["doc"] = doc
    return b"".join([np.array([len(used), len(rows)], "<u4").tobytes(), docs[used].tobytes(), *[rows[c].tobytes() for c in _ANCHOR.names]])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n_docs, n = (int(x) for x in np.frombuffer(data, "<u4", 2))
    at = 8 + n_docs * _DOC.itemsize
    rows = np.empty(n, _ANCHOR)
    for name in _ANCHOR.names:
        kind = _ANCHOR[name]
        rows[name] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return np.frombuffer(data, _DOC, n_docs, 8), rows


def _ranges(docs: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    """Rows for repeated ranges; those of one document that overlap become one."""
    if not len(doc):
        return _table(0)
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    far = np.maximum.accumulate(end + doc.astype(np.int64) * (1 << 32)) - doc.astype(np.int64) * (1 << 32)  # the furthest end so far
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (begin[1:] > far[:-1])))[: len(doc)]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1
    own = docs[doc[heads]]
    n = len(heads)
    return _table(n, kind=np.full(n, REPEATED, np.int32), doc_id=own["id"], digest=own["digest"], begin=begin[heads].astype(np.int32), end=far[tails].astype(np.int32))


def _equal_bytes(data: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes at i and at j are equal."""
    out = np.empty(len(i), bool)
    steps, last = np.arange(int(size.max()) if len(size) else 0), len(data) - 1
    for k in range(0, len(i), COMPARED):
        s = slice(k, k + COMPARED)
        same = data[np.minimum(i[s, None] + steps, last)] == data[np.minimum(j[s, None] + steps, last)]
        out[s] = (same | (steps >= size[s, None])).all(axis=1)
    return out


def first_occurrences(data: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows, in order of occurrence, hold surroundings that no earlier one has. Hashes propose, bytes decide."""
    order = np.lexsort((rows["around"], rows["gram"]))
    gram, where = rows["gram"][order], rows["around"][order]
    head = np.concatenate(([True], (gram[1:] != gram[:-1]) | (where[1:] != where[:-1])))[: len(order)]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = order[~head]
    of = first[~head]
    size = rows["more"][later].astype(np.int64) + LENGTH
    same = (rows["before"][later] == rows["before"][of]) & (rows["more"][later] == rows["more"][of])
    same[same] = _equal_bytes(data, start[later][same], start[of][same], size[same])
    out = np.ones(len(rows), bool)
    out[later[same]] = False
    return out


def _find(buckets: int):
    def chunk(held: list[tuple[int, int, bytes]]) -> Iterator[pa.Table]:
        held.sort(key=lambda x: x[:2])
        docs = np.array([x[:2] for x in held], _DOC)
        data = np.frombuffer(b"".join([x[2] for x in held]), np.uint8)
        parts, starts, base = [], [], 0
        for i, (_, _, text) in enumerate(held):
            q, lo, hi, gram, around = anchors(data[base : base + len(text)])
            rows = np.empty(len(q), _ANCHOR)
            rows["gram"], rows["around"], rows["doc"], rows["place"], rows["before"], rows["more"], rows["asked"] = gram, around, i, q, q - lo, hi - lo, 0
            parts.append(rows)
            starts.append(lo + base)
            base += len(text)
        rows = np.concatenate(parts)
        # documents are in order, so the first of those alike is the first occurrence
        fresh = first_occurrences(data, rows, np.concatenate(starts))
        begin = rows["place"].astype(np.int64) - rows["before"]
        if not fresh.all():
            yield _ranges(docs, rows["doc"][~fresh], begin[~fresh], begin[~fresh] + rows["more"][~fresh] + LENGTH)
        rows, begin = rows[fresh], begin[fresh]
        order = np.argsort(rows["gram"], kind="stable")
        rows, begin = rows[order], begin[order]
        head = np.concatenate(([True], rows["gram"][1:] != rows["gram"][:-1]))[: len(rows)]
        crowd = np.diff(np.append(np.flatnonzero(head), len(rows))) > MEETING
        crowded = np.repeat(crowd, np.diff(np.append(np.flatnonzero(head), len(rows))))
        if crowded.any():
            yield _asks(docs, rows[crowded], begin[crowded])
        rows["asked"] = crowded
        rows = rows[~crowded | head]
        bucket = (rows["gram"] >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for some in np.split(order, cuts):
            if len(some):
                yield _table(1, kind=[ANCHORS], bucket=[int(bucket[some[0]])], data=[_pack(docs, rows[some])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches):
            for doc, digest, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if len(text) >= LENGTH:
                    held.append((doc, digest, text))
                    size += len(text)
                if size >= CHUNK_BYTES:
                    for table in chunk(held):
                        yield from table.to_batches()
                    held, size = [], 0
        if held:
            for table in chunk(held):
                yield from table.to_batches()

    return run


def _asks(docs: np.ndarray, rows: np.ndarray, begin: np.ndarray) -> pa.Table:
    own, n = docs[rows["doc"]], len(rows)
    return _table(n, kind=np.full(n, ASKED, np.int32), doc_id=own["id"], digest=own["digest"], begin=begin.astype(np.int32), end=(begin + rows["more"] + LENGTH).astype(np.int32), place=rows["place"].astype(np.int32), gram=rows["gram"].view(np.int64))


def _resolve(table: pa.Table) -> pa.Table:
    """The anchors of one bucket: those whose k-gram and surroundings (by two hashes and their shape) stand earlier are repeated; of
    the others, those whose k-gram has several are asked for."""
    parts = [_unpack(x) for x in table.column("data").to_pylist()]
    shift, every = 0, []
    for docs, rows in parts:
        rows["doc"] += shift
        shift += len(docs)
        every.append(rows)
    docs, rows = np.concatenate([d for d, _ in parts]), np.concatenate(every)
    docs, renumbered = np.unique(docs, return_inverse=True)  # sorted by id, then digest
    rows["doc"] = renumbered[rows["doc"]]
    rows = rows[np.lexsort((rows["place"], rows["doc"], rows["more"], rows["before"], rows["around"], rows["asked"], rows["gram"]))]
    changed = lambda *names: np.concatenate(([True], np.any([rows[c][1:] != rows[c][:-1] for c in names], axis=0)))
    gram = np.cumsum(changed("gram")) - 1
    first = changed("gram", "asked", "around", "before", "more")
    several = np.bincount(gram, weights=first)[gram] > 1
    begin = rows["place"].astype(np.int64) - rows["before"]
    later, asked = ~first & (rows["asked"] == 0), first & several & (rows["asked"] == 0)
    ranges = _ranges(docs, rows["doc"][later], begin[later], begin[later] + rows["more"][later] + LENGTH)
    return pa.concat_tables([ranges, _asks(docs, rows[asked], begin[asked])])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, as texts may be long."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


_PIECE = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("place", pa.int32()), ("bytes", pa.binary())])
_PIECE_SQL = "kind int, key long, low int, high int, doc_id long, digest long, begin int, end int, place int, bytes binary"


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The surroundings of each anchor asked for in a document. low and high: which offsets from the anchor its strings may have."""
    for batch in slices(batches):
        rows = []
        for doc, digest, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(a["kind"], a["gram"], 0, OFFSETS, doc, digest, a["begin"], a["end"], a["place"], text[a["begin"] : a["end"]]) for a in asked]
            if len(rows) > 20_000:
                yield _piece_rows(rows)
                rows = []
        if rows:
            yield _piece_rows(rows)


def _narrowed(width: int):
    """Rows once more for each width offsets, with a key of all bytes that strings of these offsets share; bytes that they don't use are left out."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for _, _, low, high, doc, digest, begin, end, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = place - begin
                for first in range(low // width * width, high, width):
                    past = min(first + width, OFFSETS)
                    least, most = max(first, low, at + LENGTH - len(data)), min(past, high, at + 1) - 1
                    if least <= most:
                        key = xxh64_intdigest(data[at - first : at + LENGTH - past + 1], first * 128 + past)
                        own = data[at - most : at + LENGTH - least]
                        rows.append((DEALT, key - (1 << 64) if key >> 63 else key, least, most + 1, doc, digest, place - most, place - most + len(own), place, own))
            for k in range(0, len(rows), 20_000):
                yield _piece_rows(rows[k : k + 20_000])

    return run


def _firsts(limit: int):
    """From rows in order of key: repeated ranges among those of one task, and the rows with what is left of their offsets."""

    def some(table: pa.Table) -> Iterator[pa.RecordBatch]:
        begin, place, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("begin", "place", "low", "high"))
        repeated = repeated_starts(table)
        steps = np.arange(repeated.shape[1])
        offset = (place - begin)[:, None] - steps
        size = np.array([len(x) for x in table.column("bytes").to_pylist()])
        left = ~repeated & (offset >= low[:, None]) & (offset < high[:, None]) & (steps + LENGTH <= size[:, None])
        ranges = _repeated_ranges(table, repeated)
        none = [pa.nulls(ranges.num_rows, f.type) for f in _PIECE]
        told = {c: ranges.column(c).combine_chunks() for c in ("kind", "doc_id", "digest", "begin", "end")}
        yield from pa.Table.from_arrays([told.get(f.name, n) for f, n in zip(_PIECE, none, strict=True)], schema=_PIECE).to_batches()
        kept = np.flatnonzero(left.any(axis=1))
        most = offset[kept, left[kept].argmax(axis=1)]
        least = offset[kept, left.shape[1] - 1 - left[kept][:, ::-1].argmax(axis=1)]
        rows = table.take(pa.array(kept))
        for name, values in (("low", least), ("high", most + 1)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values, pa.int32()))
        yield from rows.cast(_PIECE).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                if n and n + part.num_rows > limit:
                    yield from some(pa.Table.from_batches(held, _PIECE))
                    held, n = [], 0
                held.append(part.cast(_PIECE) if part.schema != _PIECE else part)
                n += part.num_rows
        if n:
            yield from some(pa.Table.from_batches(held, _PIECE))

    return run


def _common_keys(pieces: DataFrame, scratch: Scratch, limit: int) -> DataFrame:
    """Repeated ranges among stored rows whose keys have more than limit of them."""
    ranges, width = None, NARROW
    while True:
        tasks = max(1, pieces.count() // (4 * limit))
        local = scratch.save(pieces.coalesce(tasks).sortWithinPartitions("key").mapInArrow(_firsts(limit), _PIECE_SQL))
        here = local.filter(F.col("kind") == REPEATED)
        dealt = scratch.save(local.filter(F.col("kind") != REPEATED).mapInArrow(_narrowed(width), _PIECE_SQL))
        counts = dealt.groupBy("key").count().filter("count > 1")
        counts = scratch.save(counts)
        some = dealt.join(counts.filter(F.col("count") <= limit).select("key"), "key")
        here = here.select("doc_id", "digest", "begin", "end").unionByName(_sorted(some, limit))
        ranges = here if ranges is None else ranges.unionByName(here)
        hot = counts.filter(F.col("count") > limit).select("key")
        if not hot.limit(1).count():
            return ranges
        pieces, width = scratch.save(dealt.join(hot, "key", "left_semi").select(_PIECE.names)), 1


def _sorted(pieces: DataFrame, limit: int, rows: int | None = None) -> DataFrame:
    """Repeated ranges among rows of equal keys; keys are dealt to groups of about limit rows."""
    groups = max(1, math.ceil((pieces.count() if rows is None else rows) / limit))
    dealt = pieces.withColumn("_bucket", F.pmod(F.shiftright("key", 20), F.lit(groups)).cast("int"))
    return dealt.groupBy("_bucket").applyInArrow(repeated_strings, _FOUND_SQL).select("doc_id", "digest", "begin", "end")


def suffix_order(text: Hashed, begin: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes text[begin:end] by group, then bytes: a bottom-up mergesort.

    Each comparison costs the logarithm of the suffixes' length. All merges of a level are done at once: an
    element's place is its place in its run and how many of the sibling run come before it.
    Runs meet in one group at most, so others stay as they are.
    """
    order = np.argsort(group, kind="stable")
    n = len(order)

    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        la, lb = end[a] - begin[a], end[b] - begin[b]
        most = np.minimum(la, lb)
        same = text.common(begin[a], begin[b], most)
        inside = same < most
        last = len(text.data) - 1
        byte_a, byte_b = text.data[np.minimum(begin[a] + same, last)], text.data[np.minimum(begin[b] + same, last)]
        return np.where(inside, byte_a < byte_b, la < lb)

    sorted_group = group[order]
    edge = np.flatnonzero(np.concatenate(([True], sorted_group[1:] != sorted_group[:-1])))
    begins = np.repeat(edge, np.diff(np.append(edge, n)))
    ends = np.repeat(np.append(edge[1:], n), np.diff(np.append(edge, n)))
    at = np.arange(n)
    width = 1
    while width < n:
        left = at // (2 * width) * (2 * width)
        mid = np.minimum(left + width, n)
        right = np.minimum(left + 2 * width, n)
        # a group's part of the pair of runs: sorted parts on either side of mid
        active = np.flatnonzero((begins < mid) & (ends > mid))
        if len(active):
            lo, hi = np.maximum(left[active], begins[active]), np.minimum(right[active], ends[active])
            middle = mid[active]
            from_left = active < middle
            a, b = np.where(from_left, middle, lo), np.where(from_left, hi, middle)
            x = order[active]
            base = a.copy()
            while (open_ := a < b).any():
                probe = (a + b) >> 1
                y = order[np.minimum(probe, n - 1)]
                # from the left: how many are less than x; from the right: how many aren't greater
                ahead = np.zeros(len(x), bool)
                k = np.flatnonzero(open_)
                fl = from_left[k]
                one, two = np.where(fl, y[k], x[k]), np.where(fl, x[k], y[k])
                result = less(one, two)
                ahead[k] = np.where(fl, result, ~result)
                a, b = np.where(open_ & ahead, probe + 1, a), np.where(open_ & ~ahead, probe, b)
            moved = np.where(from_left, active - lo, active - middle) + (a - base) + lo
            order[moved] = x
        width *= 2
    return order


def _exact_common(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common extensions byte by byte, of LENGTH at most."""
    out = np.empty(len(a), np.int64)
    steps, last = np.arange(LENGTH), len(data) - 1
    for k in range(0, len(a), COMPARED):
        s = slice(k, k + COMPARED)
        i = np.minimum(a[s, None] + steps, last)
        j = np.minimum(b[s, None] + steps, last)
        same = (data[i] == data[j]) & (steps < most[s, None])
        out[s] = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
    return out


def repeated_strings(table: pa.Table) -> pa.Table:
    """From surroundings that share their keys: ranges whose strings stand earlier in another one."""
    return _repeated_ranges(table, repeated_starts(table))


def repeated_starts(table: pa.Table) -> np.ndarray:
    """For each row, by string start from its begin: whether that string stands earlier in a row of the same key."""
    gram = table.column("key").to_numpy().view(np.uint64)
    least, past = (table.column(c).to_numpy() for c in ("low", "high"))
    doc_id, digest = (table.column(c).to_numpy() for c in ("doc_id", "digest"))
    lo, place = (table.column(c).to_numpy().astype(np.int64) for c in ("begin", "place"))
    pieces = table.column("bytes").to_pylist()
    size = np.array([len(p) for p in pieces], np.int64)
    start = np.cumsum(size) - size
    text = Hashed(np.frombuffer(b"".join(pieces), np.uint8))
    n = len(pieces)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((lo, digest, doc_id))] = np.arange(n)
    anchor, stop = start + place - lo, start + size
    stop = np.minimum(stop, anchor + LENGTH)
    order = suffix_order(text, anchor, stop, gram)
    a, b = order[:-1], order[1:]
    together = gram[a] == gram[b]
    most = np.minimum(stop[a] - anchor[a], stop[b] - anchor[b])
    common = np.where(together, _exact_common(text.data, anchor[a], anchor[b], most), -1)
    wrong = together & (common < most) & (text.data[np.minimum(anchor[a] + common, len(text.data) - 1)] > text.data[np.minimum(anchor[b] + common, len(text.data) - 1)])
    if wrong.any():  # a collision of hashes: sort by the bytes themselves
        order = np.array(sorted(range(n), key=lambda i: (gram[i], text.data[anchor[i] : stop[i]].tobytes())))
        a, b = order[:-1], order[1:]
        most = np.minimum(stop[a] - anchor[a], stop[b] - anchor[b])
        common = np.where(gram[a] == gram[b], _exact_common(text.data, anchor[a], anchor[b], most), -1)
    repeated = np.zeros((n, LENGTH + 1), bool)  # by string start from lo; the last column stays empty
    steps = np.arange(LENGTH)
    for before in range(LENGTH - GRAM + 1):
        joined = common >= LENGTH - before
        run = np.concatenate(([0], np.cumsum(~joined)))
        in_run = np.zeros(n, bool)
        in_run[:-1] |= joined
        in_run[1:] |= joined
        begin = anchor[order] - before
        fit = in_run & (begin >= start[order]) & (begin + LENGTH <= (start + size)[order]) & (least[order] <= before) & (before < past[order])
        k = np.flatnonzero(fit)
        if len(k) < 2:
            continue
        left = text.of(begin[k], anchor[order[k]])
        by = np.lexsort((rank[order[k]], left, run[k]))
        k, left = k[by], left[by]
        head = np.concatenate(([True], (run[k][1:] != run[k][:-1]) | (left[1:] != left[:-1])))
        first = k[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
        later = np.flatnonzero(~head)
        i, j = begin[k[later]], begin[first[later]]
        same = np.concatenate([(text.data[i[c : c + COMPARED, None] + steps] == text.data[j[c : c + COMPARED, None] + steps]).all(axis=1) for c in range(0, len(i), COMPARED)] or [np.empty(0, bool)])
        who = order[k[later[same]]]
        repeated[who, anchor[who] - before - start[who]] = True
    return repeated


def _repeated_ranges(table: pa.Table, repeated: np.ndarray) -> pa.Table:
    n = len(repeated)
    lo = table.column("begin").to_numpy().astype(np.int64)
    flat = np.diff(np.concatenate((np.zeros((n, 1), np.int8), repeated.astype(np.int8)), axis=1), axis=1)
    who, first = np.nonzero(flat == 1)
    _, past = np.nonzero(flat == -1)
    own = np.empty(n, _DOC)
    own["id"], own["digest"] = table.column("doc_id").to_numpy(), table.column("digest").to_numpy()
    docs, doc = np.unique(own, return_inverse=True)
    return _ranges(docs, doc[who], lo[who] + first, lo[who] + past - 1 + LENGTH)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in slices(batches):
        rows = []
        for doc, text, spans, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cuts: list[list[int]] = []
            for s in sorted((s["begin"], s["end"]) for s in spans or ()):
                if cuts and s[0] <= cuts[-1][1]:
                    cuts[-1][1] = max(cuts[-1][1], s[1])
                else:
                    cuts.append(list(s))
            at, kept = 0, []
            for begin, end in cuts:
                kept.append(text[at:begin])
                at = end
            rest = b"".join([*kept, text[at:]])
            rows.append((doc, len(text), len(text) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), rest))
            again = text if len(text) < LENGTH else b""  # what is left of a later row with the same doc_id and text
            for _ in range(copies - 1):
                rows.append((doc, len(text), len(text) - len(again), int(again != text), hashlib.sha256(again).hexdigest(), again))
                if len(rows) > 20_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) for every row.

    A null text counts as empty; a text of fewer than 100 bytes loses nothing; one of any length is searched as a whole. Rows of one doc_id are ordered by their
    texts' hashes; of wholly equal rows all but one are later copies. A null doc_id comes before all others. An empty table gives no rows; columns besides doc_id and
    text are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    lowest = F.lit(-(1 << 63)).cast("long")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc_id"), F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))
    key = ["doc_id", "digest"]
    # equal rows are brought together by a map-side combined aggregate and searched once
    repeated = scratch.save(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    if repeated.limit(1).count():
        several = rows.drop("copies").join(repeated, key)
        # rows that only their hash makes equal stay apart
        one = several.groupBy(*key, "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("text")) - 1)
        one = one.select("doc_id", (F.col("digest") + F.col("_n")).alias("digest"), "text", "copies")
        rows = scratch.save(rows.join(repeated, key, "left_anti").unionByName(one))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / 39 / GROUP_ANCHORS))
    dealt = rows.select(*key, "text").mapInArrow(_find(buckets), _FOUND_SQL)
    # what is found before the shuffle passes through; packed anchors meet in their bucket
    spread = F.when(F.col("kind") == ANCHORS, F.col("bucket")).otherwise(F.pmod(F.xxhash64("doc_id", "digest", "begin"), F.lit(buckets)).cast("int"))
    found = scratch.save(dealt.groupBy(spread.alias("_bucket")).applyInArrow(_meet, _FOUND_SQL))
    scratch.release()
    asked = found.filter(F.col("kind") == ASKED).select(*key, "begin", "end", "place", "gram")
    counts = asked.groupBy("gram").count().filter(F.col("count") > GROUP_SUFFIXES)
    common = scratch.save(counts)
    n_common = common.agg(F.sum("count")).first()[0] or 0

    marked = asked.withColumn("kind", F.lit(DEALT))
    if n_common:
        marked = asked.join(common.select(F.col("gram").alias("_gram")), F.col("gram") == F.col("_gram"), "left")
        marked = marked.withColumn("kind", F.when(F.col("_gram").isNull(), DEALT).otherwise(COMMON)).drop("_gram")
    per_doc = marked.groupBy(*key).agg(F.collect_list(F.struct("kind", "gram", "begin", "end", "place")).alias("asked"))
    # texts are shuffled once for both ways
    pieces = scratch.save(rows.join(per_doc, key).select(*key, "text", "asked").mapInArrow(_cut, _PIECE_SQL))
    scratch.release()
    edges = _sorted(pieces.filter(F.col("kind") == DEALT), GROUP_SUFFIXES, asked.count() - n_common)
    if n_common:
        edges = edges.unionByName(_common_keys(pieces.filter(F.col("kind") == COMMON), scratch, GROUP_SUFFIXES))
    edges = scratch.save(edges)
    scratch.release()
    ranges = found.filter(F.col("kind") == REPEATED).select("doc_id", "digest", "begin", "end").unionByName(edges)
    per_doc = ranges.groupBy(*key).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    told = rows.join(per_doc, key, "left").select("doc_id", "text", "spans", "copies")
    kept = told.mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return kept.withColumn("doc_id", F.nullif("doc_id", lowest))


def _meet(table: pa.Table) -> pa.Table:
    packed = np.array(table.column("kind")) == ANCHORS
    if not packed.any():
        return table.select(_FOUND.names)
    resolved = _resolve(table.filter(pa.array(packed)))
    return resolved if packed.all() else pa.concat_tables([table.filter(pa.array(~packed)).select(_FOUND.names), resolved])
