import numpy as np

from siftwise.llm import embeddings
from tests.llm.helpers import components, real


def expected(rows, threshold=0.9):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = [i for i, _ in rows]
    links = []
    names = sorted(good)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= threshold:
                links.append((a, b))
    groups = components(ids, links)
    degree = dict.fromkeys(ids, 0)
    for pair in links:
        for x in pair:
            degree[x] += 1
    return {i: (degree[i], groups[i], groups[i] == i) for i in ids}


def found(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, rid int")


def clusters(seed=1, n=900, dim=16):
    draw = np.random.default_rng(seed)
    rows = [(i, draw.standard_normal(dim)) for i in range(n)]
    middle = draw.standard_normal(dim)
    rows += [(n + i, middle + 0.05 * draw.standard_normal(dim)) for i in range(350)]
    for i in range(60):
        rows.append((n + 400 + i, rows[i][1] + 0.08 * draw.standard_normal(dim)))
        rows.append((n + 500 + i, rows[i][1] * (i + 1)))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(n + 600 + i, rows[3][1]) for i in range(9)]
    return [*rows, (5000, None), (5001, []), (5002, [0.0] * dim), (5003, [None] * dim), (5004, [float("nan")] * dim), (5005, [1.0, 2.0]), (5006, [2.0, 4.0])]


def test_against_brute_force(spark):
    rows = clusters()
    assert found(table(spark, rows)) == expected(rows)


def test_windows_are_extended(spark, monkeypatch):
    """A group of near copies many times as long as a block."""
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    monkeypatch.setattr(embeddings, "OVERLAP", 8)
    rows = clusters(seed=2, n=150)
    got, want = found(table(spark, rows)), expected(rows)
    assert {i: x[1:] for i, x in got.items()} == {i: x[1:] for i, x in want.items()}
    assert sum(x[0] for x in got.values()) >= 0.998 * sum(x[0] for x in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_real_vectors(spark):
    df = real(spark, "embeddings")
    assert found(df) == expected([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_null_ids_and_empty_table(spark):
    df = table(spark, [(None, [1.0, 0.0]), (3, [1.0, 0.01]), (3, [1.0, 0.01])])
    rows = embeddings.near_vectors(df).collect()
    assert sorted((r["n_links"], r["component_id"]) for r in rows) == [(2, 3), (2, 3), (2, 3)]
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_crowded_region(spark):
    """Over ten blocks; a third of all vectors lie in one region below the threshold, with pairs right above it."""
    draw, dim, n = np.random.default_rng(5), 48, 12_000
    x = draw.standard_normal((n, dim))
    x[: n // 3] = 1.7 * draw.standard_normal(dim) + x[: n // 3]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(600):
        at = draw.integers(n // 3) if k % 2 else n // 3 + draw.integers(n // 3)
        side = draw.standard_normal(dim)
        side -= side @ unit[at] * unit[at]
        cosine = draw.uniform(0.901, 0.93)
        unit[n - 600 + k] = cosine * unit[at] + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    unit = unit.astype(np.float32).astype(float)
    length = np.linalg.norm(unit, axis=1)
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(unit)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rid int")
    want = np.zeros(n, int)
    for k in range(0, n, 1000):
        want[k : k + 1000] = ((unit[k : k + 1000] @ unit.T) / length[k : k + 1000, None] / length >= 0.9).sum(axis=1) - 1
    got = np.zeros(n, int)
    for r in embeddings.near_vectors(df).collect():
        got[r["vec_id"]] = r["n_links"]
    assert want.sum() >= 1200 and (got <= want).all()
    assert got.sum() >= 0.998 * want.sum(), (got.sum(), want.sum())
