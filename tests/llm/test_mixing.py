import re
from collections import defaultdict

import pytest

from siftwise.llm import mixing
from tests.llm.helpers import corpus, documents, real

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes, share=1.5, most=2.0):
    """Shares by weight; what is above a source's limit is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not above:
            return out | {s: level * weight[s] for s in open_}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def check(docs):
    texts = {r["doc_id"]: (r["source"], r["text"] or "") for r in docs.collect()}
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == len(texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for source, text in texts.values():
        sizes[source] += len(WORD.findall(text))
    want = targets(sizes)
    for r in rows:
        source, text = texts[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (len(WORD.findall(text)), sizes[source])
        assert r["target"] == pytest.approx(want[source]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix_documents(docs.repartition(3)).collect()
    key = lambda r: (r["doc_id"], r["taken"], r["position"], r["repeat_position"])
    assert sorted(map(repr, map(key, rows))) == sorted(map(repr, map(key, again)))
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in again}
    return rows


def sources(n):
    return [None if i % 9 == 4 else "a" if i % 3 else f"s{i % 7}" for i in range(n)]


def test_small_corpus(spark):
    texts = corpus()
    rows = check(documents(spark, texts, sources(len(texts))))
    placed = [r["position"] for r in rows if r["position"] is not None]
    assert placed == sorted(placed) and all(0 <= p <= 1 for p in placed)


def test_real_documents(spark):
    check(real(spark))


@pytest.mark.parametrize("most", [1.0, 2.5])
def test_taken_documents(spark, most):
    """Every word that the mix takes is delivered, however many turns that needs."""
    texts = corpus()
    docs = documents(spark, texts, sources(len(texts))).withColumnRenamed("fp", "_words")
    taken = defaultdict(int)
    for r in mixing.taken_documents(docs, share=most - 0.25, most=most).collect():
        assert r["n_chars"] == len(r["text"]) and (texts[r["doc_id"]] or "").startswith(r["text"])
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
    rows = mixing.mix_documents(docs, share=most - 0.25, most=most).collect()
    assert taken == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    assert max(r["taken"] / r["size"] for r in rows if r["size"]) > most - 0.3
    assert mixing.taken_documents(docs, most=most).columns == docs.columns


def test_turns_of_repeated_rows(spark):
    docs = documents(spark, ["a b c d e"] * 5 + [None, "", "f g"], ["x"] * 6 + [None] * 2, ids=[1] * 5 + [None, 2, None])
    rows = mixing.mix_documents(docs, share=3.0, most=3.0).collect()
    given = [r["text"] for r in mixing.taken_documents(docs, share=3.0, most=3.0).collect()]
    assert sum(r["taken"] for r in rows) == 81 == sum(len(t.split()) for t in given)
    assert mixing.taken_documents(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "word " * 300_000
    docs = documents(spark, [text, "a b"], ["x", "y"])
    assert {r["size"] for r in mixing.mix_documents(docs).collect()} == {300_000, 2}
    assert sum(r["text"].count("word") for r in mixing.taken_documents(docs).collect()) == next(r["taken"] for r in mixing.mix_documents(docs).collect() if r["size"] > 2)


def test_as_many_sources_as_documents(spark):
    texts = [f"w{i} " * (i % 17 + 1) for i in range(300)]
    check(documents(spark, texts, [f"host{i:03d}" for i in range(300)]))


def test_demand_is_inverted(spark):
    for schedule in ((1.5, 1.0, 0.5), (1.0, 1.0), (0.2, 2.0, 0.2, 1.0)):
        steps = len(schedule) - 1
        areas = [(a + b) / 2 / steps for a, b in zip(schedule, schedule[1:], strict=False)]

        def share(t, schedule=schedule, areas=areas, steps=steps):
            k = min(int(t * steps), steps - 1)
            u = t - k / steps
            return (sum(areas[:k]) + schedule[k] * u + (schedule[k + 1] - schedule[k]) * steps * u * u / 2) / sum(areas)

        for r in spark.range(21).select((mixing.F.col("id") / 20).alias("d"), mixing.demand_inverse(mixing.F.col("id") / 20, schedule).alias("t")).collect():
            assert share(r["t"]) == pytest.approx(r["d"], abs=1e-9)


def test_empty_texts_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b c", "a b c", None, "", "d"], ["x", "x", "x", None, None], ids=[1, 1, None, 2, 3])
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == 5
    own = [r for r in rows if r["source"] == "x"]
    assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix_documents(documents(spark, [None, ""], ["x", "y"])).collect()] == [0, 0]
