import hashlib

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siftwise.llm import merkle
from tests.llm.helpers import corpus, documents, real


def expected(rows):
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(xxh64_intdigest(r[1].encode(), 42))))
    out = []
    for k, (i, text) in enumerate(rows):
        half = len(text) // 2
        following = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - half] + following[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following))
    return out


def near(a, b):
    """The share of the larger text's distinct slices that both have, by the texts themselves."""
    if a == b:
        return 1.0
    one, other = ({p[k : k + 16] for p in t.split("\n") for k in range(0, len(p), 16)} for t in (a, b))
    most = max(len(one), len(other))
    return min(len(one & other) / most, 1 - 0.5 / most) if most else 0.0


def check(docs):
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in merkle.fingerprint_documents(docs).collect()}
    assert set(got) == {w[:3] for w in want}
    prints = {}
    for w in want:
        r, (text, edited, following) = got[w[:3]], w[3:]
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert (r["near_edited"] == 1) == (text == edited) == (r["fingerprint"] == r["edited_fingerprint"])
        assert (r["near_next"] == 1) == (text == following)
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(near(text, edited)), pytest.approx(near(text, following)))
    assert len(set(prints.values())) == len(prints)
    return got


def test_small_corpus_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 5)
    texts = [*corpus(), "😀é" * 40, "tail"]
    check(documents(spark, texts).repartition(3))


def test_real_documents(spark):
    rows = check(real(spark)).values()
    long = [r for r in rows if r["n_chars"] > 500]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.4 > 0.1 > sum(r["near_next"] for r in long) / len(long)


def test_ties_null_ids_one_row_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 2)
    docs = documents(spark, ["bb", "aa", "cc", "dd", None, "ee ff gg"], ids=[3, 3, None, None, 9, 1])
    check(docs)
    check(documents(spark, ["alone and its own next"]))
    assert merkle.fingerprint_documents(docs.limit(0)).count() == 0


def test_differing_branches_locate_edits(spark):
    text = "\n".join(f"paragraph number {i} of the text" for i in range(60))
    other = text.replace("number 37 of", "number 37, edited, of").replace("number 5 of", "no. 5 of")
    df = spark.createDataFrame([(text, other), (text, text), (text, text + "\nmore")], "a string, b string")
    df = merkle.with_tree(merkle.with_tree(df, "a"), "b", "edited_")
    assert [r[0] for r in df.select(merkle.differing_paragraphs()).collect()] == [[5, 37], [], [60]]


@pytest.mark.parametrize("ids", [[5] * 30, [None] * 30, [i % 3 for i in range(30)]])
def test_equal_and_null_ids_are_spread(spark, monkeypatch, ids):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 4)
    check(documents(spark, [f"text number {i} " * (i + 1) for i in range(30)], ids=ids))


def test_equal_rows_are_treated_once(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 2)
    docs = documents(spark, ["same text " * 9] * 7 + ["aa", None, None, "bb"], ids=[4] * 7 + [1, None, None, 6])
    rows = merkle.fingerprint_documents(docs).collect()
    assert len(rows) == 11 and sorted(r["near_next"] for r in rows if r["doc_id"] == 4)[1:] == [1.0] * 6
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((repr(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted((repr(w[0]), *w[1:3]) for w in want)


def test_plan_does_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 2)
    sizes = []
    for n in (40, 400):
        plan = merkle.fingerprint_documents(documents(spark, [f"t{i}" for i in range(n)]))._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
    assert abs(sizes[1] - sizes[0]) < 200


def test_very_long_text(spark):
    check(documents(spark, ["long line " * 100_000, "a\n" * 20_000, "x"]))


def test_count_below(spark):
    bounds = [2, 3, 5, 8, 13, 21, 34]
    rows = spark.range(40).select("id", merkle._count_below(F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[1::2])), 2, F.col("id")).alias("n")).collect()
    assert all(r["n"] == sum(b <= r["id"] for b in bounds) for r in rows)
