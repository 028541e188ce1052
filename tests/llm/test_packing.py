import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from siftwise.llm import packing
from siftwise.llm.queries import tokenizer_path
from tests.llm.helpers import corpus, documents, real


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(docs, capacity=4096):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = docs.collect()
    pieces = {}
    for r in packing.pack_documents(docs, tokenizer_path(), capacity).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert len(pieces) == len(rows)
    bins = {}
    for r in rows:
        ids = ids_of(tokenizer, r["text"])
        own = sorted(pieces[r["doc_id"]], key=lambda p: p["piece"])
        assert [p["start"] for p in own] == list(range(0, len(ids), capacity))
        for p in own:
            part = np.array(ids[p["start"] : p["start"] + capacity], "<u4")
            assert (p["length"], p["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
            bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(len(v) for v in pieces.values()), len(bins), [n for placed in bins.values() for _, n in placed]


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [f for f in free if f >= n]
        if fit:
            best = min(fit)
            free[free.index(best)] = best - n
        else:
            free.append(capacity - n)
    return sorted(free)


def test_small_corpus(spark):
    _, bins, lengths = check(documents(spark, [*corpus(), "don't STOP'S É'll\x1cx <|endoftext|> I’m... (a)b,", "日本語。テスト"]), 256)
    assert bins == len(one_by_one(lengths, 256))


def test_real_documents(spark):
    _, bins, lengths = check(real(spark))
    assert bins == len(one_by_one(lengths, 4096))


def test_plan_is_best_fit_decreasing():
    draw = random.Random(4)
    for capacity in (10, 64, 301):
        for _ in range(60):
            lengths = [draw.randint(1, capacity) for _ in range(draw.randint(1, 120))]
            histogram = {n: lengths.count(n) for n in set(lengths)}
            plan = packing.plan_bins(histogram, capacity)
            used, counts = {}, dict.fromkeys(histogram, 0)
            for i, n in enumerate(plan["length"]):
                later = [plan["rank"][j] for j in range(len(plan["rank"])) if plan["length"][j] == n and plan["rank"][j] > plan["rank"][i]]
                upto = min(later, default=histogram[n])
                for rank in range(plan["rank"][i], upto):
                    turn, inside = divmod(rank - plan["rank"][i], plan["each"][i])
                    used.setdefault(plan["bin"][i] + turn, []).append((plan["offset"][i] + inside * n, n))
                    counts[n] += 1
            assert counts == histogram
            for placed in used.values():
                ends = [o + n for o, n in sorted(placed)]
                assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= capacity
            assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == one_by_one(lengths, capacity)


def test_capacity_tree():
    tree = packing.CapacityTree(100)
    for c in (5, 17, 99):
        tree.set(c, True)
    assert [tree.tightest(n) for n in (1, 5, 6, 17, 18, 100)] == [5, 5, 17, 17, 99, None]
    tree.set(17, False)
    assert tree.tightest(6) == 99


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b", "a b", None], ids=[1, 1, None])
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    assert sorted(r["length"] for r in rows) == [1, 3, 3] and len({r["sequence_id"] for r in rows}) == 1
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_reruns_agree(spark):
    docs = documents(spark, corpus())
    key = lambda r: (r["doc_id"], r["piece"])
    runs = [sorted(packing.pack_documents(d, tokenizer_path(), 128).collect(), key=key) for d in (docs, docs.repartition(5, "text"))]
    assert runs[0] == runs[1]


def test_other_rules_are_not_taken_for_granted(tmp_path):
    """A vocabulary that keeps case and white space is encoded as a whole."""
    path = "/opt/tokenizers/byte_bpe_50k.json"
    memo = packing.WordMemo(path)
    texts = ["Two  Words\n here", "don't STOP", ""]
    assert not memo.by_word and packing.WordMemo(tokenizer_path()).by_word
    assert memo.encode(texts) == [np.array(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_very_long_text(spark):
    text = "word and word, " * 70_000
    n, _, lengths = check(documents(spark, [text, "x"]))
    assert n > 50 and lengths.count(4096) >= n - 3
