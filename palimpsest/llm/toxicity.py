"""Toxicity: non-negative positive-unlabelled learning over word indicators, the risk summed over all unlabelled texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytesops import texts
from palimpsest.llm.features import remainder, sample, scores, word_grams
from palimpsest.llm.storage import stage, unstage

BITS = 20
#: Confirmed toxic rows that a fit reads at most; of unlabelled texts it reads all.
POSITIVE = 6_000
FOLDS = 5
#: Positives that must hold a feature, and standard errors by which it must be more frequent among them.
LEAST, APART = 3, 5.0
STEPS, RATE, DECAY = 60, 0.1, 1e-4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _frequencies(docs: DataFrame, some: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of docs, and of those that hold each of the features some (ascending), over all of them."""

    def run(batches):
        total, n = np.zeros(len(some) + 1, np.int64), 0
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(0)):
                _, f = word_grams(buf, offs)
                at = np.searchsorted(some, f)
                hit = at < len(some)
                hit[hit] = some[at[hit]] == f[hit]
                total[:-1] += np.bincount(at[hit], minlength=len(some))
                n += hi - lo
        total[-1] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "c"])

    got = docs.select("text").mapInArrow(run, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    total = np.zeros(len(some) + 1, np.int64)
    total[got.column("i").to_numpy()] = got.column("c").to_numpy()
    return int(total[-1]), total[:-1]


def _vectors(docs: DataFrame, column: np.ndarray) -> DataFrame:
    """(cols, n): the distinct sets of known features that docs hold, as 32-bit numbers, and how many hold each."""

    def run(batches):
        for batch in batches:
            held: dict[bytes, int] = {}
            for lo, hi, buf, offs in texts(batch.column(0)):
                at, f = word_grams(buf, offs)
                known = column[f] >= 0
                at, c = at[known], column[f[known]].astype(np.int32)
                ends = np.searchsorted(at, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    key = c[ends[i] : ends[i + 1]].tobytes()
                    held[key] = held.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["cols", "n"])

    return docs.select("text").mapInArrow(run, "cols binary, n long").groupBy("cols").agg(F.sum("n").alias("n"))


def _unlabelled(vectors: DataFrame, w: np.ndarray) -> np.ndarray:
    """Over all unlabelled texts, the sum of g's gradient weighted by sigmoid(g), then the sum of log(1 - sigmoid(g))."""

    def run(batches):
        total = np.zeros(len(w) + 1)
        for batch in batches:
            col = batch.column(0)
            raw = np.frombuffer(b"".join(col.to_pylist()), np.int32)
            size = np.asarray(pa.compute.binary_length(col)) // 4
            at, n = np.repeat(np.arange(len(size)), size), batch.column(1).to_numpy()
            s = _sigmoid(np.bincount(at, weights=w[raw], minlength=len(size)) + w[-1])
            total[: len(w)] += np.bincount(raw, weights=(n * s)[at], minlength=len(w))
            total[len(w) - 1] += (n * s).sum()
            total[-1] += (n * np.log(1 - s + 1e-12)).sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "x"])

    got = vectors.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(len(w) + 1)
    total[got.column("i").to_numpy()] = got.column("x").to_numpy()
    return total


def nnpu(positive: list[np.ndarray], features: int, texts_: int, unlabelled, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Weights (the last one is the bias) of a linear classifier minimising the non-negative risk by Adam.

    The risk is prior * E+[l(g)] + max(0, Eu[l(-g)] - prior * E+[l(-g)]), l the logistic loss; where the second
    part falls below zero, a step goes up its gradient alone. positive: the features of each positive; unlabelled(w):
    the sums of _unlabelled() over all texts_ unlabelled texts, so every step sees every text.
    """
    at, col = np.repeat(np.arange(len(positive)), [len(f) for f in positive]), np.concatenate(positive)
    w, m, v = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    w[-1] = -1.0
    for t in range(1, steps + 1):
        sp = _sigmoid(np.bincount(at, weights=w[col], minlength=len(positive)) + w[-1])
        sums = unlabelled(w)
        negative = -sums[-1] / texts_ + prior * np.log(1 - sp + 1e-12).mean()
        dp, sign = (np.full(len(sp), -prior), 1.0) if negative >= 0 else (prior * sp, -1.0)
        grad = sign * sums[:-1] / texts_ + np.bincount(col, weights=dp[at] / len(sp), minlength=features + 1)
        grad[-1] += dp.mean()
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def train(docs: DataFrame, positive: list[np.ndarray], prior: float) -> np.ndarray | None:
    """Weights by feature number and bias, from the features of positives and all texts of docs; None without either.

    A feature is an indicator that is clearly more frequent among the positives than among all texts; both
    frequencies are exact. The fit then reads each distinct set of features once a step.
    """
    if not positive:
        return None
    count = np.bincount(np.concatenate(positive), minlength=1 << BITS)
    some = np.flatnonzero(count >= LEAST)
    n, free = _frequencies(docs, some)
    if not n:
        return None
    noise = np.sqrt((count[some] + free + 1) / (len(positive) + n) / min(len(positive), n))
    often = some[count[some] / len(positive) - free / n > APART * noise]
    column = np.full(1 << BITS, -1, np.int32)
    column[often] = np.arange(len(often))
    vectors = stage(_vectors(docs, column), "vectors")
    w = nnpu([column[f][column[f] >= 0] for f in positive], len(often), n, lambda w: _unlabelled(vectors, w), prior)
    unstage(vectors)
    full = np.zeros((1 << BITS) + 1)
    full[often], full[-1] = w[:-1], w[-1]
    return full


def toxicity_scores(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    Confirmed toxic rows of labels (doc_id, toxic) outside the fold of remainder 0 are the positives, `positive` of
    them at most; all texts outside that fold, whatever their label, are the unlabelled. The prior is the share of
    toxic rows among the labels learnt from. Without positives or texts the score is the prior for all. Null and
    empty texts get the score of the bias; null labels are not learnt from; repeated rows are scored alike.
    """
    known = labels.filter(remainder(FOLDS) != 0).select("doc_id", F.col("toxic").cast("int").alias("y")).dropna()
    toxic = known.agg(F.avg("y")).first()[0] or 0.0
    prior = min(max(float(toxic), 0.001), 0.5)
    p, _ = sample(docs, known.filter("y = 1"), positive, word_grams, 9)
    w = train(docs.filter(remainder(FOLDS) != 0), p, prior)

    def score(found, n):
        if w is None:
            return np.full(n, prior)
        at, f = found
        return 1 / (1 + np.exp(-np.clip(np.bincount(at, weights=w[f], minlength=n) + w[-1], -500, 500)))

    out = scores(docs, word_grams, score)
    return out.select("doc_id", (remainder(FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
