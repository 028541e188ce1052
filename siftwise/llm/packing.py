"""Best-fit decreasing over documents of any number, with a segment tree over capacities.

Pieces of one length are interchangeable, so the state of best-fit decreasing is how many bins
are open at each remaining capacity. The plan is made on the histogram of lengths (as many
entries as the capacity, however large the corpus): for each length, longest first, a segment
tree over remaining capacities finds the tightest open bin in logarithmic time, and runs of
equal pieces go to runs of equal bins. The result is what best-fit decreasing gives
piece by piece. Pieces then find their place in the plan by length and rank.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwise.llm.ordering import in_order, with_ranks
from siftwise.llm.scratch import Scratch

CAPACITY = 4096
END_ID = 1
#: Words that a worker remembers the ids of, and the longest such word in bytes.
MEMO_WORDS, MEMO_BYTES = 500_000, 48
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class CapacityTree:
    """Which capacities 1..n have open bins; the tightest one that fits, in log n steps."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, open_: bool) -> None:
        i = self.leaves + capacity
        self.any[i] = open_
        while i := i >> 1:
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = self.leaves + least
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of pieces put into runs of bins: length, first rank, first bin, pieces a bin, offset."""
    tree, free = CapacityTree(capacity), {}
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(left: int, first: int, n: int) -> None:
        if left > 0:
            free.setdefault(left, deque()).append((first, n))
            tree.set(left, True)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-todo // (capacity // length))
                bins += n
            else:
                first, n = free[room].popleft()
            each = room // length
            full = min(n, todo // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if full < n and 0 < todo < each:
                runs.append((length, rank, first + full, todo, capacity - room))
                put(room - todo * length, first + full, 1)
                full, todo = full + 1, 0
            if full < n:
                free.setdefault(room, deque()).appendleft((first + full, n - full))
            if room in free:
                tree.set(room, bool(free[room]))
    table = np.array(runs, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "each", "offset"), table.T, strict=True))


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


# How a tokenizer file says that it normalises and splits texts, if WordMemo may go word by word.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class WordMemo:
    """Token ids of whole texts, word by word where the file's rules are WORD_RULES, else by the tokenizer alone.

    Those rules drop white space, never join text across it and ignore case, so a text's ids are its
    lower-case words' ids in turn. A word of letters alone is one piece to the rules and goes to the merges
    directly; ASCII punctuation after letters is a piece of its own; any other word goes through all rules.
    Ids are held as little-endian bytes. Two generations of words are remembered: a full one
    becomes the old one, and words met again move on.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.by_word = all(rules.get(k) == v for k, v in WORD_RULES.items()) and rules["model"]["type"] == "BPE"
        self.special = [t["content"].lower() for t in rules.get("added_tokens") or ()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes: ASCII letters
            return array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        stem = word.rstrip(PUNCTUATION)
        text = stem.decode()
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            if len(stem) < len(word):
                return self._get(stem) + self._get(word[len(stem) :])
            return array("I", [t.id for t in self.model.tokenize("".join([self.letters[b] for b in word]))]).tobytes()
        return self._whole(word.decode())

    def _learn(self, words: set[bytes]) -> list[bytes]:
        """Makes all words known; returns those too long to be remembered."""
        known, old = self.known, self.old
        new = words.difference(known)
        for w in new:
            ids = old.get(w)
            known[w] = self._word(w) if ids is None else ids
        return [w for w in new if len(w) > MEMO_BYTES]

    def _get(self, word: bytes) -> bytes:
        ids = self.known.get(word) or self.old.get(word)
        if ids is None:
            ids = self.known[word] = self._word(word)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self._whole(t) for t in texts]
        if len(self.known) > MEMO_WORDS:
            self.known, self.old = {}, self.known
        odd = ["<|" in t for t in texts] if all("<|" in s for s in self.special) else [True] * len(texts)  # may hold a special token
        # lower() and split() of bytes: A-Z, and the six ASCII white spaces
        split = [[] if o else t.encode().lower().split() for t, o in zip(texts, odd, strict=True)]
        long = self._learn(set().union(*split))
        ids = self.known.__getitem__
        out = [self._whole(t) if o else b"".join(map(ids, ws)) for t, ws, o in zip(texts, split, odd, strict=True)]
        for w in long:
            del self.known[w]
        return out


def _pieces(path: str, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo = WordMemo(path)
        for batch in batches:
            docs, texts, hashes = batch.columns
            for at in range(0, len(docs), 256):
                rows = []
                encoded = memo.encode([t or "" for t in texts.slice(at, 256).to_pylist()])
                for doc, digest, ids in zip(docs.slice(at, 256).to_pylist(), hashes.slice(at, 256).to_pylist(), encoded, strict=True):
                    view = memoryview(ids + end)
                    for k, lo in enumerate(range(0, len(view), 4 * capacity)):
                        cut = view[lo : lo + 4 * capacity]
                        rows.append((doc, digest, k, lo // 4, len(cut) // 4, zlib.crc32(cut)))
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run, "doc_id long, text_hash long, piece int, start long, length long, ids_crc32 long"


def _place(plan: dict[str, np.ndarray]):
    key = plan["length"] << 48 | plan["rank"]
    order = np.argsort(key)
    key, first, bins, each, offset = key[order], plan["rank"][order], plan["bin"][order], plan["each"][order], plan["offset"][order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(key, length << 48 | rank, side="right") - 1
            turn, inside = np.divmod(rank - first[at], each[at])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [pa.array(bins[at] + turn), pa.array(offset[at] + inside * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    A document is its text's ids and END_ID; only longer ones than the capacity are cut. A
    null or empty text is one piece of length 1; a null doc_id stays null; repeated rows are packed
    each; a very long text is encoded as a whole and becomes as many pieces as it fills; an empty table gives no rows; columns
    besides doc_id and text are not read. Equal lengths are ranked by doc_id (null first), a hash of the text and piece, so that reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    run, schema = _pieces(tokenizer, capacity)
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    pieces = scratch.save(pieces.mapInArrow(run, schema))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity entries at most
    run, schema = _place(plan_bins(histogram, capacity))
    ordered = in_order(pieces, scratch, "length", "doc_id", "text_hash", "piece")
    return with_ranks(ordered, ["length"], "_rank").drop("text_hash").mapInArrow(run, schema)
