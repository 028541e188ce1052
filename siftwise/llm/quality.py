"""Bradley-Terry pairwise ranking of documents by quality.

Pairs of a better and a worse labelled document give feature differences; logistic loss on
them learns one weight per feature, and a document's score is its weighted features. A
quantile of the training scores is the threshold between good and bad.

All labelled rows and all their pairs count. The loss of a pair depends on its two scores only, so a
sum over all pairs is a convolution of the scores' histograms; each Newton step reads the
training rows twice, where they are, and only sums come to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwise.llm.ordering import in_order, with_ranks
from siftwise.llm.scratch import Scratch

#: Points of the grid that scores are counted on, of the coarser one for the curvature, and rows of sums that reach the driver.
FINE, COARSE, SUMS = 1 << 14, 256, 8
#: Decimals to which a model is rounded, so that the order in which tasks are summed up does not show.
DECIMALS = 9
#: Weight of the squared weights in the loss.
L2 = 1e-3
SYMBOLS = b"!?.,;:'\"-()|*#$%&@/\\_=+<>{}[]~^"
FEATURES = len(SYMBOLS) + 16
_LETTER = re.compile(r"[^\W\d_]")
_UPPER = np.array([chr(c).isupper() for c in range(0x250)])
_ALPHA = np.array([chr(c).isalpha() for c in range(0x250)])


def features(text: str | None) -> np.ndarray:
    """Rates over the whole text; all zero for a null or empty one."""
    out = np.zeros(FEATURES, np.float32)
    text = text or ""
    if not text:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.minimum(points, 0x24F)
    n = len(points)
    seen = np.bincount(np.minimum(points, 127), minlength=128)
    symbols = np.frombuffer(SYMBOLS, np.uint8)
    k = len(symbols)
    out[:k] = np.sqrt(seen[symbols] / n)
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    alpha, upper = int(_ALPHA[low].sum()), int(_UPPER[low].sum())
    lengths = np.array([len(x) for x in words] or [0])
    bare = [x.strip("!?.,;:'\"-()|*#$%&") for x in words]
    out[k:] = (
        alpha / n,
        upper / max(1, alpha),
        seen[48:58].sum() / n,
        (seen[9] + seen[10] + seen[32]) / n,
        (points > 127).mean(),
        min(lengths.mean(), 30) / 10,
        min(lengths.std(), 30) / 10,
        len(set(words)) / w,
        len(set(lines)) / max(1, len(lines)),
        min(w / max(1, len(lines)), 200) / 100,
        sum(x[-1] in ".!?:;,\"'" for x in lines) / max(1, len(lines)),
        sum(not x for x in bare) / w,
        sum(x.isupper() and len(x) > 1 for x in bare) / w,
        np.log1p(w) / 10,
        len(set(zip(words, words[1:], strict=False))) / w,
        1.0,
    )
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, hashes = batch.columns
        for at in range(0, len(ids), 1024):
            found = [features(t).tobytes() for t in texts.slice(at, 1024).to_pylist()]
            yield pa.record_batch([ids.slice(at, 1024), hashes.slice(at, 1024), pa.array(found, pa.binary())], names=["doc_id", "text_hash", "features"])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.round(_standard(rows, self.mean, self.scale) @ self.weights, DECIMALS)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(rows) - self.threshold) / self.spread, -40, 40)))


#: Sums what a function of (rows, labels) makes of all training rows; None without rows.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray | None]


def _standard(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((rows - mean) / scale, -8, 8)


def _places(raw: np.ndarray, first: float, step: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each score the grid point below it, and the share that the next point takes."""
    at = np.clip((raw - first) / step, 0, n - 1)
    low = np.minimum(at.astype(np.int64), n - 2)
    return low, at - low


def _counted(raw: np.ndarray, first: float, step: float, n: int, values: np.ndarray | None = None) -> np.ndarray:
    """Sums of 1, or of values, by grid point."""
    low, share = _places(raw, first, step, n)
    one = np.ones(len(raw)) if values is None else values
    return np.bincount(low, one * (1 - share), n) + np.bincount(low + 1, one * share, n)


def _over(counts: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray], step: float) -> np.ndarray:
    """At each grid point x the sum of counts at y times kernel(y - x)."""
    n = len(counts)
    size = 1 << (3 * n - 1).bit_length()
    made = np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel(np.arange(n - 1, -n, -1) * step), size), size)
    return made[n - 1 : 2 * n - 1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _curve(x: np.ndarray) -> np.ndarray:
    return _sigmoid(x) * _sigmoid(-x)


def _weights(total: Total, mean: np.ndarray, scale: np.ndarray, good: float, bad: float, l2: float) -> np.ndarray:
    """Newton's method on the logistic loss of the differences of all pairs (a row labelled 1, a row labelled 0)."""
    d, pairs = len(mean), good * bad

    def counts(w):
        reach = 8 * np.abs(w).sum() + 1e-6  # scores are within, as rows are clipped
        step = 2 * reach / (FINE - 1)

        def made(rows, labels):
            raw = _standard(rows, mean, scale) @ w
            return np.stack([_counted(raw[labels == y], -reach, step, FINE) for y in (1, 0)])

        found = total(made)
        loss = found[0] @ _over(found[1], lambda x: np.logaddexp(0, x), step) / pairs + l2 / 2 * w @ w
        return found, -reach, step, loss

    def slopes(w, found, first, step):
        """Gradient and curvature. The coarser grid has points of the finer one only, so that the same kernel, linear
        between the points, weighs all parts of the curvature, and it can't turn negative."""
        used = np.flatnonzero(found.sum(axis=0) > 0)
        each = max(1, -(-int(used[-1] - used[0]) // (COARSE - 1)))
        start, wide = first + used[0] * step, each * step
        points = first + step * np.arange(FINE)
        coarse = [_counted(points, start, wide, COARSE, c) for c in found]
        pull = [_over(found[1], _sigmoid, step), _over(found[0], lambda x: _sigmoid(-x), step)]
        bend = [_over(coarse[1], _curve, wide), _over(coarse[0], _curve, wide)]

        def made(rows, labels):
            z = _standard(rows, mean, scale)
            raw = z @ w
            gradient, direct, sums = np.zeros(d), np.zeros((d, d)), []
            for k, y in enumerate((1, 0)):
                mine, at = z[labels == y], raw[labels == y]
                gradient += (2 * k - 1) * (np.interp(at, points, pull[k]) @ mine)
                low, share = _places(at, start, wide, COARSE)
                direct += (mine * (bend[k][low] * (1 - share) + bend[k][low + 1] * share)[:, None]).T @ mine
                sums.append(np.stack([_counted(at, start, wide, COARSE, column) for column in mine.T], axis=1))
            return np.concatenate([gradient, direct.ravel(), sums[0].ravel(), sums[1].ravel()])

        parts = np.split(total(made), np.cumsum([d, d * d, COARSE * d]))
        above, below = parts[2].reshape(COARSE, d), parts[3].reshape(COARSE, d)
        places = np.arange(COARSE)
        cross = above.T @ _curve((places[:, None] - places[None, :]) * wide) @ below
        hessian = (parts[1].reshape(d, d) - cross - cross.T) / pairs + l2 * np.eye(d)
        return parts[0] / pairs + l2 * w, hessian

    w = np.zeros(d)
    *state, loss = counts(w)
    for _ in range(25):
        gradient, hessian = slopes(w, *state)
        move = -np.linalg.solve(hessian, gradient)
        for _ in range(20):  # shorter steps where a whole one leads upwards
            *state, after = counts(w + move)
            if after <= loss + 1e-9:
                break
            move /= 2
        w, loss = w + move, after
        if np.abs(move).max() < 1e-6:
            break
    return np.round(w, DECIMALS)


def _model(total: Total, cut: Callable[[Model, int, int], float], l2: float) -> Model:
    """cut finds the threshold on the raw scores of a model, given the numbers of rows labelled 1 and 0."""
    sums = total(lambda rows, labels: np.concatenate([[len(rows), (labels == 1).sum(), (labels == 0).sum()], rows.sum(0)]))
    if sums is None:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 1.0)
    n, good, bad = (int(x) for x in sums[:3])
    mean = np.round(sums[3:] / n, DECIMALS)
    scale = np.round(np.sqrt(total(lambda rows, labels: ((rows - mean) ** 2).sum(0)) / n), DECIMALS) + 1e-6
    if not good or not bad:
        return Model(mean, scale, np.zeros(len(mean)), 0.0, 1.0)
    model = Model(mean, scale, _weights(total, mean, scale, good, bad, l2), 0.0, 1.0)
    first, second = total(lambda rows, labels: np.array([(raw := model.raw(rows)).sum(), raw @ raw])) / n
    spread = float(np.round(np.sqrt(max(0.0, second - first * first)), DECIMALS)) + 1e-9
    return replace(model, threshold=cut(model, good, bad), spread=spread)


def fit(rows: np.ndarray, labels: np.ndarray, l2: float = L2) -> Model:
    """Fits weights on all pairs (a row labelled 1, a row labelled 0), and the threshold on all rows. Without both
    labels every score is 0.5."""

    def cut(model: Model, good: int, bad: int) -> float:
        values, at = np.unique(model.raw(rows), return_inverse=True)
        below_good, below_bad = (np.cumsum(np.bincount(at[labels == y], minlength=len(values))) for y in (1, 0))
        best = int(np.argmax(below_bad * good - below_good * bad))
        return float((values[best] + values[min(best + 1, len(values) - 1)]) / 2)

    return _model(lambda made: made(rows, labels) if len(rows) else None, cut, l2)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of training rows."""
    rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).reshape(-1, FEATURES)
    return rows.astype(float), batch.column(1).to_numpy(zero_copy_only=False)


def _total(train: DataFrame) -> Total:
    """Sums over a table of features and quality, by tasks and then by few tasks, so that what reaches the driver
    grows with neither rows nor tasks."""

    def total(made):
        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [None]
            for batch in batches:
                if batch.num_rows:
                    part = np.asarray(made(*_read(batch)), float)
                    found = [part if found[0] is None else found[0] + part]
            if found[0] is not None:
                yield pa.record_batch([pa.array([found[0].tobytes()], pa.binary()), pa.array([list(found[0].shape)])], names=["sums", "shape"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = shape = None
            for batch in batches:
                for part, shape in zip(batch.column(0), batch.column(1), strict=True):  # noqa: B007
                    part = np.frombuffer(part.as_py(), float)
                    found = part if found is None else found + part
            if found is not None:
                yield pa.record_batch([pa.array([found.tobytes()], pa.binary()), pa.array([shape.as_py()])], names=["sums", "shape"])

        schema = "sums binary, shape array<long>"
        rows = train.mapInArrow(parts, schema).repartition(SUMS).mapInArrow(added, schema).collect()
        return sum(np.frombuffer(bytes(r[0]), float).reshape(r[1]) for r in rows) if rows else None

    return total


def _cut(train: DataFrame, scratch: Scratch):
    """The threshold of the best balanced accuracy over all training rows, by running sums over their sorted scores."""

    def cut(model: Model, good: int, bad: int) -> float:
        schema = pa.schema([("raw", pa.float64()), ("quality", pa.int64())])

        def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows, labels = _read(batch)
                    yield pa.record_batch([pa.array(model.raw(rows)), pa.array(labels, pa.int64())], schema=schema)

        sums = [F.sum((F.col("quality") == y).cast("long")).alias(c) for y, c in ((1, "good"), (0, "bad"))]
        values = scratch.save(train.mapInArrow(raw, "raw double, quality long").groupBy("raw").agg(*sums))
        ranked = with_ranks(in_order(values, scratch, "raw"), [], "_rank", below_good="good", below_bad="bad")
        gain = (F.col("below_bad") + F.col("bad")) * F.lit(good) - (F.col("below_good") + F.col("good")) * F.lit(bad)
        best = ranked.select("raw", gain.alias("gain")).agg(F.min(F.struct((-F.col("gain")).alias("gain"), "raw"))).first()[0]["raw"]
        after = values.filter(F.col("raw") > best).agg(F.min("raw")).first()[0]
        return float((best + (best if after is None else after)) / 2)

    return cut


def _scores(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.binary()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, FEATURES)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(model.score(rows.astype(float)))], schema=schema)

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from. A null doc_id is not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _text_hash() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash and score of every row of docs."""
    scratch = Scratch(docs.sparkSession, "quality")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("text_hash"))
    found = slim.mapInArrow(_features, "doc_id long, text_hash binary, features binary")
    found = scratch.save(found)
    asked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    train = scratch.save(found.join(asked, "doc_id").select("features", F.col("quality").cast("long").alias("quality")))
    model = _model(_total(train), _cut(train, scratch), L2)
    return found.mapInArrow(_scores(model), "doc_id long, text_hash binary, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Returns doc_id, held_out, score and predicted (1: good) for every row of docs.

    All labelled rows that aren't held out are fitted on. Null and empty texts share one score. Null labels and labels without a document are
    ignored; repeated rows are scored each; an empty table gives no rows; columns besides
    doc_id and text, and of labels doc_id and quality, are not read.
    """
    return _scored(docs, labels).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good; columns of docs. Each row's own prediction decides, whatever its doc_id: a
    score depends on the text only, so rows go by a hash of it. A null text counts as empty."""
    bad = _scored(docs, labels).filter("score < 0.5").select(F.col("text_hash").alias("_bad")).distinct()
    return docs.join(bad, _text_hash() == F.col("_bad"), "left_anti")
