"""Quality classifier: Naive Bayes support vectors over n-gram indicators, by dual coordinate descent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.features import byte_grams, passing, remainder, sample, scores

BITS = 15
#: Labelled rows that a fit reads at most.
SAMPLE = 12_000
FOLDS, TAKE = 5, 0.3


def ratios(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """Log ratio of the classes' smoothed indicator counts for each n-gram."""
    p, q = np.full(size, alpha), np.full(size, alpha)
    for f, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[f] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def hinge(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (the last one is the bias) of the linear hinge-loss model over r-scaled indicators of unit length."""
    w, bias = np.zeros(len(r)), 0.0
    unit = np.array([1 / np.sqrt(r[f] @ r[f] + 1) for f in rows])
    a, rng = np.zeros(len(y)), np.random.default_rng(seed)
    cap = np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1)))
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], r[rows[i]]
            g = y[i] * (w[f] @ v + bias) * unit[i] - 1
            new = min(max(a[i] - g, 0.0), cap[i])
            if new != a[i]:
                step = (new - a[i]) * y[i] * unit[i]
                w[f] += step * v
                bias += step
                most = max(most, abs(new - a[i]))
                a[i] = new
        if most < 1e-3:
            break
    return np.append(w, bias)


def margins(rows: tuple[np.ndarray, np.ndarray], n: int, w: np.ndarray, r: np.ndarray) -> np.ndarray:
    at, f = rows
    v = r[f]
    top = np.bincount(at, weights=v * w[f], minlength=n) + w[-1]
    return top / np.sqrt(np.bincount(at, weights=v * v, minlength=n) + 1)


def platt(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that make the margin a probability, by Newton steps with Platt's targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z, b = np.stack((m, np.ones(len(m)))), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(b @ z)))
        h = (z * (p * (1 - p))) @ z.T + 1e-6 * np.eye(2)
        b = b - np.linalg.solve(h, z @ (p - t))
    return float(b[0]), float(b[1])


def train(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Ratios, weights, slope and offset; the margins that set the last two come from halves not trained on."""
    y = np.where(y > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        base = 8.0 if len(y) and y[0] > 0 else -8.0 if len(y) else 0.0
        return np.zeros(1 << BITS), np.zeros((1 << BITS) + 1), 0.0, base
    m = np.zeros(len(y))
    for half in (0, 1):
        fit, rest = [i for i in range(len(y)) if i % 2 == half], [i for i in range(len(y)) if i % 2 != half]
        r = ratios([rows[i] for i in fit], y[fit], 1 << BITS)
        w = hinge([rows[i] for i in fit], y[fit], r, epochs=6)
        for i in rest:
            m[i] = margins((np.zeros(len(rows[i]), np.int64), rows[i]), 1, w, r)[0]
    slope, offset = platt(m, y)
    r = ratios(rows, y, 1 << BITS)
    return r, hinge(rows, y, r), slope, offset


def _scorer(docs: DataFrame, labels: DataFrame, most: int):
    """What turns n texts' features into probabilities, learnt from labelled rows outside the fold of remainder 0."""
    known = labels.filter(remainder(FOLDS) != 0).select("doc_id", F.col("quality").cast("int").alias("y")).dropna()
    rows, y = sample(docs, known, most, byte_grams, 5, np.uint16)
    r, w, slope, offset = train(rows, y)
    return lambda found, n: 1 / (1 + np.exp(-(slope * margins(found, n, w, r) + offset)))


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    Learns from at most `most` rows of labels (doc_id, quality) outside the fold of remainder 0; rows with a null
    label or none to join are not learnt from. With labels of one class only, or none, all scores are the same.
    Null and empty texts have no n-grams and get the score of the bias. Repeated rows are scored alike.
    """
    out = scores(docs, byte_grams, _scorer(docs, labels, most))
    return out.select("doc_id", (remainder(FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= TAKE).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not rejected, with their columns; each row is judged by its own text, whatever its id."""
    score = _scorer(docs, labels, most)
    return passing(docs, lambda buf, offs, n: score(byte_grams(buf, offs), n) >= TAKE)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
