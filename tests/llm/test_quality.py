import zlib

import numpy as np

from siftwise.llm import quality
from tests.llm.helpers import documents, real


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect()]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [(r["score"], y, r["predicted"]) for r, y in truth if r["held_out"]]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert np.mean([p == y for _, y, p in held]) > 0.85
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows.values())


def test_pairs_are_ranked():
    draw = np.random.default_rng(1)
    x = draw.standard_normal((400, 6))
    y = (x @ np.array([2.0, -1, 0, 0, 0.5, 0]) + 0.1 * draw.standard_normal(400) > -1).astype(int)
    model = quality.fit(x, y)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.93
    assert np.allclose(quality.fit(x, np.ones(400, int)).score(x), 0.5)


def test_awkward_rows(spark):
    docs = documents(spark, ["good text here.", "BAD!! BAD!!", None, "", "x" * 100_000, "good text here."], ids=[1, 2, 3, 4, None, 1])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (99, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 6
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert scores[3] == scores[4]
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_labels_held_out_are_never_learned_from(spark):
    docs, labels = real(spark), real(spark, "labels")
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    one = sorted(map(tuple, quality.score_documents(docs, labels).collect()))
    assert one == sorted(map(tuple, quality.score_documents(docs, flipped).collect()))


def test_each_row_is_kept_by_its_own_prediction(spark):
    """One doc_id with a good and a bad text, and null doc_ids."""
    good = lambda k: f"A calm sentence number {k} stands here. It is followed by another one."
    bad = lambda k: f"BUY!!! {k} $$$ CLICK *** NOW!!! FREE $$$ ### {k} !!!"
    texts = [t(k) for k in range(40) for t in (good, bad)]
    rows = [(None, good(90)), (None, bad(90)), (500, good(91)), (500, bad(91))]
    docs = documents(spark, [*texts, *[t for _, t in rows]], ids=[*range(80), *[i for i, _ in rows]])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    kept = [(r["doc_id"], r["text"]) for r in quality.keep_good(docs, labels).collect()]
    assert {t for i, t in kept if i in (None, 500)} == {good(90), good(91)}
    assert [i for i, _ in kept if i not in (None, 500)] and all(i % 2 == 0 for i, _ in kept if i not in (None, 500))


def test_fit_against_plain_descent():
    """Weights as by plain gradient descent over all pairs; the cut as by trying all."""
    draw = np.random.default_rng(3)
    rows = draw.standard_normal((90, 4)) * [1, 5, 0.1, 2] + [0, 3, 1, -2]
    truth = (rows - rows.mean(0)) / rows.std(0) @ [1.5, -1.0, 0.5, 0.0]
    labels = (truth + 0.8 * draw.standard_normal(90) > 0).astype(int)
    model = quality.fit(rows, labels)
    z = (rows - rows.mean(0)) / (rows.std(0) + 1e-6)
    x = np.array([z[i] - z[j] for i in np.flatnonzero(labels == 1) for j in np.flatnonzero(labels == 0)])
    w = np.zeros(4)
    for _ in range(20_000):
        w -= 0.1 * (1e-3 * w - (x / (1 + np.exp(x @ w))[:, None]).mean(0))
    assert model.weights @ w / np.linalg.norm(model.weights) / np.linalg.norm(w) > 0.99
    assert abs(np.linalg.norm(model.weights) / np.linalg.norm(w) - 1) < 0.25

    def balanced(said):
        return ((said & (labels == 1)).sum() / (labels == 1).sum() + (~said & (labels == 0)).sum() / (labels == 0).sum()) / 2

    raw = z @ model.weights
    assert abs(balanced(model.score(rows) >= 0.5) - max(balanced(raw >= cut) for cut in raw)) < 1e-9


def test_all_pairs_are_learned_from():
    """Where the weights end, the gradient over all 202,500 pairs is nought."""
    draw = np.random.default_rng(5)
    rows = draw.standard_normal((900, 5))
    labels = (rows @ np.array([1.0, -0.5, 0.3, 0, 0]) + draw.standard_normal(900) > 0).astype(int)
    labels[np.argsort(rows[:, 4])[:450]] = 0
    model = quality.fit(rows, labels)
    z = np.clip((rows - rows.mean(0)) / (rows.std(0) + 1e-6), -8, 8)
    x = (z[labels == 1][:, None, :] - z[labels == 0][None, :, :]).reshape(-1, 5)
    assert len(x) > 100_000
    gradient = 1e-3 * model.weights - (x / (1 + np.exp(x @ model.weights))[:, None]).mean(0)
    assert np.abs(gradient).max() < 1e-5


def test_all_labelled_rows_are_learned_from(spark):
    """More than 20,000 labelled rows: scores as by a fit on all of them at once."""
    draw = np.random.default_rng(6)
    ids = [i for i in range(36_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(ids) > 23_000
    texts = [" ".join("ab!?c1."[draw.integers(7)] * draw.integers(1, 6) for _ in range(draw.integers(1, 8))) for _ in ids]
    truth = [int(len(t) - 6 * t.count("!") + 8 * draw.standard_normal() > 12) for t in texts]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(list(zip(ids, truth, strict=True)), "doc_id long, quality int")
    rows = np.array([quality.features(t) for t in texts], float)
    model = quality.fit(rows, np.array(truth))
    found = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    assert np.abs(model.score(rows) - [found[i] for i in ids]).max() < 1e-6
