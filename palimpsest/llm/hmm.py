"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact scaled forward scores."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytesops import LOWER, U, mix, prefix, spans, texts, words
from palimpsest.llm.features import remainder
from palimpsest.llm.storage import stage

STATES, ROUNDS = 8, 6
#: Words that have a class of their own; all other words share ENDINGS classes by their last bytes.
OWN, ENDINGS = 4000, 1024
#: Words whose counts every task holds (16 bytes each); counts of all others are joined.
HEAD = 300_000
#: Tokens of a training piece, and of pieces whose states are held at once.
PIECE, TOKENS = 1024, 1 << 20
FOLDS, HELD = 7, 2
CLASSES = OWN + ENDINGS + 1
END = CLASSES - 1


def _words(buf: np.ndarray, offs: np.ndarray):
    """Hash, ending class and text number of each lower-cased word."""
    low = LOWER[buf]
    start, end, doc = words(low, offs)
    pre = prefix(low)
    tail = np.maximum(start, end - 3)
    return spans(pre, start, end).view(np.int64), (mix(spans(pre, tail, end)) % U(ENDINGS)).astype(np.int64), doc


def count_words(docs: DataFrame) -> DataFrame:
    """(h, ending, c) of each distinct word of docs (text), counted over all of them."""

    def run(batches):
        for batch in batches:
            parts = [_words(buf, offs)[:2] for _, _, buf, offs in texts(batch.column(0), 8 << 20)]
            if parts:
                h, first, c = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
                e = np.concatenate([p[1] for p in parts])[first]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(e.astype(np.int32)), pa.array(c)], ["h", "ending", "c"])

    parts = docs.select("text").mapInArrow(run, "h long, ending int, c long")
    return parts.groupBy("h").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


def _frequent(counts: DataFrame) -> DataFrame:
    """At most HEAD of the words: all above a count that a histogram of bounded length sets."""
    step = F.floor(F.log2("c") * 16).cast("int").alias("step")
    left, least = HEAD, 1 << 30
    for r in sorted(counts.groupBy(step).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
        if r.n > left:
            break
        left, least = left - r.n, r.step
    return counts.filter(F.floor(F.log2("c") * 16) >= least)


def forward(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Log10 likelihood of each sequence by the scaled forward recursion; emit is (class, state)."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    flat, offs = np.concatenate(seqs).astype(np.int64), np.concatenate(([0], np.cumsum(size)))[:-1]
    offs, size = offs[order], size[order]
    out, a = np.zeros(len(seqs)), None
    active = np.searchsorted(-size, -np.arange(size[0]), "left") if len(size) else []
    for t, n in enumerate(active):
        a = (np.broadcast_to(start, (n, len(start))) if t == 0 else a[:n] @ move) * emit[flat[offs[:n] + t]]
        scale = a.sum(1)
        out[order[:n]] += np.log10(scale)
        a = a / scale[:, None]
    return out


def settled(move: np.ndarray) -> np.ndarray:
    """The shares of the states far from a start."""
    return np.linalg.matrix_power(move, 64).mean(0)


def expected(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Baum-Welch counts of the sequences: starts, moves and emissions, in one vector.

    A sequence is counted in pieces of PIECE tokens. Only its first piece begins at the start probabilities and counts
    as a start; the others begin at the settled ones, and the move across a cut is not counted.
    """
    s, rest = len(start), settled(move)
    pieces = [(x[i : i + PIECE], i == 0) for x in seqs for i in range(0, len(x), PIECE)]
    pieces.sort(key=lambda p: -len(p[0]))
    ends = np.cumsum([len(p) for p, _ in pieces]) if pieces else []
    starts, moves, emits = np.zeros(s), np.zeros((s, s)), np.zeros((len(emit), s))
    lo = 0
    while lo < len(pieces):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - len(pieces[lo][0]) + TOKENS, "right")))
        part, head = [p for p, _ in pieces[lo:hi]], np.array([h for _, h in pieces[lo:hi]])
        lo = hi
        size = np.array([len(p) for p in part])
        grid = np.zeros((size[0], len(part)), np.int64)
        for i, p in enumerate(part):
            grid[: len(p), i] = p
        active = np.searchsorted(-size, -np.arange(size[0]), "left")
        alpha, scale = [], []
        for t, n in enumerate(active):
            a = (np.where(head[:, None], start, rest) if t == 0 else alpha[-1][:n] @ move) * emit[grid[t, :n]]
            scale.append(a.sum(1))
            alpha.append(a / scale[-1][:, None])
        beta = np.ones((active[-1], s))
        post = [alpha[-1] * beta]
        for t in range(len(active) - 1, 0, -1):
            n = active[t]
            b = beta[:n] * emit[grid[t, :n]] / scale[t][:, None]
            moves += alpha[t - 1][:n].T @ b
            beta = np.ones((active[t - 1], s))
            beta[:n] = b @ move.T
            post.append(alpha[t - 1] * beta)
        starts += post[-1][head].sum(0)
        kind = np.concatenate([grid[t, : active[t]] for t in range(len(active) - 1, -1, -1)])
        mass = np.concatenate(post)
        for k in range(s):
            emits[:, k] += np.bincount(kind, weights=mass[:, k], minlength=len(emit))
    return np.concatenate((starts, (moves * move).ravel(), emits.ravel()))


def estimate(counts: np.ndarray, base: np.ndarray, s: int = STATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, move and emission probabilities of the counts; emissions lean on the classes' overall shares."""
    starts, moves, emits = counts[:s] + 1, counts[s : s + s * s].reshape(s, s) + 0.1, counts[s + s * s :].reshape(CLASSES, s)
    emits = emits + 50 * base[:, None]
    return starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0)


def leaning(seqs: list[bytes]) -> np.ndarray:
    """Counts of a first guess in which each sequence leans to a state of its own, told by its CRC-32."""
    emits = np.zeros((CLASSES, STATES))
    for x in seqs:
        emits[:, zlib.crc32(x) % STATES] += np.bincount(np.frombuffer(x, np.uint16), minlength=CLASSES)
    return np.concatenate((np.zeros(STATES + STATES * STATES), emits.ravel()))


def summed(train: DataFrame, count) -> np.ndarray:
    """count(list of sequences as bytes), a vector, summed over all of train (seq)."""
    size = STATES + STATES * STATES + CLASSES * STATES

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += count(batch.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "x"])

    sums = train.select("seq").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(size)
    total[sums.column("i").to_numpy()] = sums.column("x").to_numpy()
    return total


def fit(train: DataFrame, base: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A model of all sequences of train: a first guess by leaning(), then rounds of Baum-Welch over all of them."""
    emits = summed(train, leaning)[STATES + STATES * STATES :].reshape(CLASSES, STATES) + 20 * base[:, None]
    model = np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.02 / STATES) + 0.98 * np.eye(STATES), emits / emits.sum(0)
    for _ in range(rounds):
        # 32-bit probabilities do for counts; a task adds them up in 64 bits.
        small = [x.astype(np.float32) for x in model]
        model = estimate(summed(train, lambda seqs, small=small: expected([np.frombuffer(x, np.uint16) for x in seqs], *small)), base)
    return model


def hmm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs (doc_id, text).

    A word is emitted in two steps: the state emits its class (the word itself if it is one of the OWN most
    frequent, else its ending's), the class emits the word by its count plus one, an unseen word by one. Word counts,
    class counts, the first guess and each of ROUNDS rounds of Baum-Welch cover every training text whole, so the model
    depends on the texts alone, not on how they are stored; the score is the exact forward likelihood of the whole
    token sequence. Counts of the HEAD most frequent words go to
    every task; all others are joined by hash. Null and empty texts are one end; repeated rows are rows; a null
    doc_id belongs to the fold of the empty text. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held", remainder(FOLDS) == HELD)
    counts = stage(count_words(docs.filter("not held")), "words")
    ends = docs.filter("not held").count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    top = _frequent(counts).toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    th, tc, te = (top.column(x).to_numpy() for x in ("h", "c", "ending"))
    kind = np.where(np.arange(len(th)) < OWN, np.arange(len(th)), OWN + te)
    by_ending = {r.ending: (r.n, r.v) for r in counts.groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    mass, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for e, (x, y) in by_ending.items():
        mass[OWN + e], types[OWN + e] = x, y
    np.subtract.at(mass, OWN + te[:OWN], tc[:OWN])
    np.subtract.at(types, OWN + te[:OWN], 1)
    mass[: min(OWN, len(tc))] = tc[:OWN]
    mass[END] = ends
    base = (mass + 1) / (mass + 1).sum()
    inner = np.log10(np.maximum(mass + types + 1, 1))
    inner[:OWN] = inner[END] = 0
    order = np.argsort(th)
    known = spark.sparkContext.broadcast((th[order], tc[order], kind[order].astype(np.int32)))
    low = math.log10(n + v + 1)

    def encode(batches):
        hs, cs, ks = known.value
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(1), 4 << 20):
                h, e, doc = _words(buf, offs)
                rows = hi - lo
                u, back = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(hs, u), max(len(hs) - 1, 0))
                hit = hs[at] == u if len(hs) else np.zeros(len(u), bool)
                c = np.where(hit, cs[at], 0)[back] if len(hs) else np.zeros(len(h), np.int64)
                k = np.where(hit[back], ks[at][back], OWN + e) if len(hs) else OWN + e
                seen = hit[back]
                size = np.bincount(doc, minlength=rows)
                word = np.where(seen, np.log10(c + 1.0), 0.0)
                own = np.where(k < OWN, 0.0, word - inner[k])
                head = np.bincount(doc, weights=word, minlength=rows)
                within = np.bincount(doc, weights=own, minlength=rows)
                seq = np.full(len(h) + rows, END, np.uint16)
                seq[np.arange(len(h)) + doc] = k
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.concatenate(([0], np.cumsum(2 * (size + 1)))).astype(np.int64)), pa.py_buffer(seq)]).cast(pa.binary())
                far = np.flatnonzero(~seen)
                far = far[np.lexsort((h[far], doc[far]))]
                new = np.ones(len(far), bool)
                new[1:] = (h[far][1:] != h[far][:-1]) | (doc[far][1:] != doc[far][:-1])
                go = np.flatnonzero(new)
                tf = np.diff(np.append(go, len(far)))
                far = far[go]
                pairs = pa.StructArray.from_arrays([pa.array(h[far]), pa.array(tf.astype(np.int32))], ["h", "tf"])
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[far], np.arange(rows + 1)).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(rows)), batch.column(0).slice(lo, rows), batch.column(2).slice(lo, rows), raw, pa.array(size + 1), pa.array(np.bincount(doc[seen], minlength=rows)), pa.array(head), pa.array(within), tails],
                    ["uid", "doc_id", "held", "seq", "n", "known", "head", "within", "tail"],
                )
                uid += rows

    coded = stage(docs.select("doc_id", "text", "held").mapInArrow(encode, "uid long, doc_id long, held boolean, seq binary, n long, known long, head double, within double, tail array<struct<h:long,tf:int>>"), "coded")
    model = fit(coded.filter("not held"), base)

    def score(batches):
        for batch in batches:
            got = forward([np.frombuffer(x.as_py(), np.uint16) for x in batch.column(1)], *model)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 2, 3, 4, 5, 6, 7)], pa.array(got)], ["uid", "doc_id", "held", "n", "known", "head", "within", "path"])

    path = coded.select("uid", "seq", "doc_id", "held", "n", "known", "head", "within").mapInArrow(score, "uid long, doc_id long, held boolean, n long, known long, head double, within double, path double")
    rare = coded.select("uid", F.inline("tail"))
    rare = rare.join(counts.select("h", "c"), "h", "left").groupBy("uid").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("far"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more"))
    out = path.join(rare, "uid", "left")
    far, more = F.coalesce("far", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return out.select(
        "doc_id",
        F.col("held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + more + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head") + far + F.lit(math.log10(ends + 1)) - F.col("n") * F.lit(low)).alias("base_score"),
        (F.col("path") + F.col("within") + far).alias("score"),
    )


def op6_hmm_scores(spark, sf_dir: str) -> DataFrame:
    return hmm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
