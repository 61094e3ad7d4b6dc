"""Dense and BM25 ranking, reranking, and the measures of a ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import postings
from palimpsest.functions.text import dot, tokens
from palimpsest.plans.spread import spread

#: Rows of a query block that is broadcast against the corpus; more queries are scored block by block.
QUERY_BLOCK = 4096
#: Documents of a block of scores.
STEP = 256
#: Pairs of a block of BM25 scores, and (query, document, term) hits summed in it, unless one document has more.
CELLS = 1 << 18


def top_k(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*(order or (F.desc("score"), F.desc("doc_id"))))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, *columns: str) -> Iterator[list]:
    """The rows of a stated query set, QUERY_BLOCK or so at a time: what the driver and each task hold has a bound."""
    n = queries.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    for i in range(parts):
        yield (queries.filter(block == i) if parts > 1 else queries).select("query_id", *columns).collect()


class _Best:
    """The k best documents of each query among all that a task has seen: by score, then by larger id."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, [(np.zeros(0), np.zeros(0, np.int64))] * queries
        self.least = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray, there: np.ndarray | None = None) -> None:
        """scores (document, query) of documents ids; there marks the pairs that count."""
        ok = scores >= self.least
        if there is not None:
            ok &= there
        for q in np.flatnonzero(ok.any(0)):
            pick = np.flatnonzero(ok[:, q])
            s, d = np.concatenate((self.held[q][0], scores[pick, q])), np.concatenate((self.held[q][1], ids[pick]))
            best = np.lexsort((-d, -s))[: self.k]
            self.held[q] = s[best], d[best]
            if len(best) == self.k:
                self.least[q] = s[best[-1]]

    def batch(self, names: list) -> pa.RecordBatch:
        n = [len(d) for _, d in self.held]
        ids, scores = np.concatenate([d for _, d in self.held] or [np.zeros(0, np.int64)]), np.concatenate([s for s, _ in self.held] or [np.zeros(0)])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), n)), pa.array(ids), pa.array(scores)], ["query_id", "doc_id", "score"])


SCORED = "query_id long, doc_id long, score double"


def _union(parts: list[DataFrame], spark) -> DataFrame:
    # Not from an empty list: that is an RDD read by Python, a second set of workers beside those that score.
    out = parts[0] if parts else spark.range(0).select(F.col("id").alias("query_id"), F.col("id").alias("doc_id"), F.lit(0.0).alias("score"))
    for part in parts[1:]:
        out = out.union(part)
    return out


def dense_top(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k largest dot products of each query (query_id, qv) over all (doc_id, dv).

    Scores are exact, of 64-bit floats, rounded to 6 decimals; ties by larger doc_id. The query set is a matrix that
    every task holds, QUERY_BLOCK rows at a time; a task multiplies its vectors by it batch by batch and hands on the
    k best of each query, so what is shuffled does not grow with the corpus but with the tasks. Null vectors and null
    ids are left out.
    """
    found = []
    for rows in _blocks(queries.filter("qv is not null and query_id is not null"), "qv"):
        if not rows:
            continue
        names, matrix = [r.query_id for r in rows], np.array([r.qv for r in rows], np.float64).T

        def run(batches, names=names, matrix=matrix):
            best = _Best(len(names), k)
            for batch in batches:
                ids, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                vectors = flat.reshape(len(ids), -1)
                for lo in range(0, len(ids), STEP):
                    best.add(np.round(vectors[lo : lo + STEP] @ matrix, 6), ids[lo : lo + STEP])
            yield best.batch(names)

        there = corpus.filter("dv is not null and doc_id is not null")
        found.append(there.select(F.col("doc_id").cast("long").alias("doc_id"), "dv").mapInArrow(run, SCORED))
    return top_k(_union(found, corpus.sparkSession), k)


def dense_top_by(queries: DataFrame, corpus: DataFrame, by: str, k: int) -> DataFrame:
    """dense_top() within each value of a column of the corpus, such as a commit; its values are few.

    Stored by that column, a corpus is read one partition at a time.
    """
    values = [r[0] for r in corpus.select(by).distinct().orderBy(by).collect()]
    out = corpus.sparkSession.createDataFrame([], SCORED + ", rank int").withColumn(by, F.lit(None).cast(corpus.schema[by].dataType))
    for x in values:
        out = out.union(dense_top(queries, corpus.filter(F.col(by).eqNullSafe(F.lit(x))), k).withColumn(by, F.lit(x).cast(corpus.schema[by].dataType)))
    return out.select("query_id", by, "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def occurrence_top(vectors: DataFrame, occurrences: DataFrame, vector: list | np.ndarray, k: int) -> DataFrame:
    """occurrences (commit, path, symbol, version_id, content_id, ...) with score and rank: the k best of each commit.

    Each distinct content that occurs is scored once, by its vector (content_id, vec); ties by path, symbol, version_id.
    """
    held = vectors.join(occurrences.select("content_id").distinct(), "content_id", "left_semi")
    scored = held.select("content_id", dot(F.col("vec"), F.lit(np.asarray(vector, np.float64))).alias("score"))
    w = Window.partitionBy("commit").orderBy(F.desc("score"), "path", "symbol", "version_id")
    return occurrences.join(scored, "content_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dense_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): exact dot products of a stated query set (query_id, qv) against all (doc_id, dv).

    Every pair is a row; where the best of each query are wanted, dense_top() is the way. The query set is broadcast in
    blocks of QUERY_BLOCK vectors, so what each task holds has a bound.
    """
    n = queries.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    out = None
    for i in range(parts):
        part = corpus.crossJoin(F.broadcast(queries.filter(block == i) if parts > 1 else queries))
        part = part.select("query_id", "doc_id", F.round(dot(F.col("qv"), F.col("dv")), 6).alias("score"))
        out = part if out is None else out.union(part)
    return out


def _vocabulary(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the queries' terms, ascending, and by term its queries with how often each has it (offsets, query, count)."""
    h, q = [], []
    for lo, _, t, d in postings.tokens(pa.array([r.text for r in rows], pa.string())):
        h.append(t)
        q.append(d + lo)
    if not h:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms, at = np.unique(np.concatenate(h), return_inverse=True)
    cell, count = np.unique(at * len(rows) + np.concatenate(q), return_counts=True)
    return terms, np.searchsorted(cell // len(rows), np.arange(len(terms) + 1)), cell % len(rows), count


def _found(terms: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and frequency of the terms among a chunk's tokens, by document."""
    at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
    hit = terms[at] == h if len(terms) else np.zeros(len(h), bool)
    cell, tf = np.unique(doc[hit] * max(len(terms), 1) + at[hit], return_counts=True)
    return cell // max(len(terms), 1), cell % max(len(terms), 1), tf


def _steps(hits: np.ndarray, queries: int) -> Iterator[tuple[int, int]]:
    """First and end document of blocks of scores; hits: how many stand before each document, and in all."""
    lo, n = 0, len(hits) - 1
    while lo < n:
        hi = min(n, lo + max(1, min(STEP, CELLS // queries)), max(lo + 1, int(np.searchsorted(hits, hits[lo] + CELLS, "right")) - 1))
        yield lo, hi
        lo = hi


def _corpus_counts(corpus: DataFrame, terms: np.ndarray) -> tuple[int, float, np.ndarray]:
    """Documents, their mean length in tokens, and how many hold each of the terms, in one scan."""

    def run(batches):
        total = np.zeros(len(terms) + 2, np.int64)
        for batch in batches:
            for lo, hi, h, doc in postings.tokens(batch.column(0)):
                total[:-2] += np.bincount(_found(terms, h, doc)[1], minlength=len(terms))
                total[-2:] += hi - lo, len(h)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "c"])

    got = corpus.select("text").mapInArrow(run, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    total = np.zeros(len(terms) + 2, np.int64)
    total[got.column("i").to_numpy()] = got.column("c").to_numpy()
    return int(total[-2]), float(total[-1]) / max(int(total[-2]), 1), total[:-2]


def bm25_top(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents (doc_id, text) of each query (query_id, text) that share a term.

    weight = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf / (tf + k1 (1 - b + b dl / avgdl)), tokens as functions.tokens;
    repeated query terms count as often as they occur; scores are rounded to 6 decimals, ties by larger doc_id.
    Two scans: one counts N, avgdl and the df of the queries' terms, one scores whole documents where they are read.
    The queries' terms, QUERY_BLOCK queries at a time, are all that a task holds beside its chunk, and it hands on the
    k best of each query, so common terms cost no shuffle. Null texts are empty; null doc_ids are left out of ranks.
    """
    docs = spread(corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = []
    for rows in _blocks(queries.filter("query_id is not null"), "text"):
        terms, offs, query, qtf = _vocabulary(rows)
        if not len(terms):
            continue
        n, avg, df = _corpus_counts(docs, terms)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        names, width = [r.query_id for r in rows], np.diff(offs)

        def run(batches, terms=terms, offs=offs, query=query, qtf=qtf, idf=idf, avg=avg, names=names, width=width):
            best = _Best(len(names), k)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for lo, hi, h, doc in postings.tokens(batch.column(1)):
                    d, t, tf = _found(terms, h, doc)
                    dl = np.bincount(doc, minlength=hi - lo)
                    w = idf[t] * tf / (tf + k1 * (1 - b + b * dl[d] / (avg or 1.0)))
                    of = np.searchsorted(d, np.arange(hi - lo + 1))
                    hits = np.concatenate(([0], np.cumsum(width[t])))[of]
                    for first, end in _steps(hits, len(names)):
                        a, z = of[first], of[end]
                        m = width[t[a:z]]
                        at = np.repeat(offs[t[a:z]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                        cell = np.repeat(d[a:z] - first, m) * len(names) + query[at]
                        size = (end - first) * len(names)
                        score = np.bincount(cell, weights=np.repeat(w[a:z], m) * qtf[at], minlength=size).reshape(-1, len(names))
                        there = np.bincount(cell, minlength=size).reshape(-1, len(names)) > 0
                        best.add(np.round(score, 6), ids[lo + first : lo + end], there)
            yield best.batch(names)

        found.append(docs.filter("doc_id is not null").mapInArrow(run, SCORED))
    return top_k(_union(found, corpus.sparkSession), k)


def bm25_scores(queries: DataFrame, corpus: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of all pairs that share a term, weighted as bm25_top() does, by joins on terms.

    Common terms make nearly every pair a row: where the best of each query are wanted, bm25_top() is the way.
    """
    docs = spread(corpus.select("doc_id", "text")).select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("dl", F.size("t"))
    n, avg = docs.agg(F.count("*"), F.avg("dl")).first()
    asked = queries.select("query_id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    words = asked.select("term").distinct()
    tf = docs.select("doc_id", "dl", F.explode("t").alias("term")).join(words, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("qtf") * idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(avg or 1))))
    pairs = asked.join(df, "term").join(tf, "term").select("query_id", "doc_id", weight.alias("w"))
    return pairs.groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))


def holding(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id) of every document whose text holds a query's text, as substrings, once a pair.

    One scan a block of queries; an automaton over their texts walks each whole text once. An empty query is in every
    text that is not null; null texts hold and match nothing.
    """
    found = []
    for rows in _blocks(queries.filter("text is not null"), "text"):
        if not rows:
            continue

        def run(batches, rows=rows):
            import ahocorasick

            by, machine = {}, ahocorasick.Automaton()
            for r in rows:
                by.setdefault(r.text, []).append(r.query_id)
            for text in filter(None, by):
                machine.add_word(text, text)
            machine.make_automaton()
            for batch in batches:
                query, doc = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen = {t for _, t in machine.iter(text)} if len(machine) else set()
                    for t in seen | ({""} & by.keys()):
                        query += by[t]
                        doc += [i] * len(by[t])
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, pa.int64())], ["query_id", "doc_id"])

        there = spread(corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null"))
        found.append(there.mapInArrow(run, "query_id long, doc_id long"))
    out = corpus.sparkSession.createDataFrame([], "query_id long, doc_id long")
    for part in found:
        out = out.union(part)
    return out


def positives(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, rank) of each query's positive, null beyond k."""
    hit = ranked.filter(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    return qrels.join(hit, ["query_id", "doc_id"], "left").select("query_id", F.col("rank").cast("long").alias("rank"))


def measures(ranks: DataFrame, k: int = 10) -> DataFrame:
    """Means for one binary positive a query."""
    hit = F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    return ranks.agg(
        F.count("*").alias("queries"),
        F.round(F.avg(hit), 5).alias("hit"),
        F.round(F.avg(hit / k), 5).alias("precision"),
        F.round(F.avg(F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(0.0)), 5).alias("mrr"),
        F.round(F.avg(F.when(F.col("rank") <= k, 1.0 / F.log2(1.0 + F.col("rank"))).otherwise(0.0)), 5).alias("ndcg"),
    )


def rank_buckets(ranks: DataFrame) -> DataFrame:
    r = F.col("rank")
    name = F.when(r == 1, "rank_1").when(r <= 3, "rank_2_3").when(r <= 10, "rank_4_10").when(r <= 20, "rank_11_20").when(r <= 100, "rank_21_100").otherwise("not_in_top_100")
    keys = ranks.sparkSession.createDataFrame([(x,) for x in ("rank_1", "rank_2_3", "rank_4_10", "rank_11_20", "rank_21_100", "not_in_top_100")], "bucket string")
    found = ranks.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))
    return keys.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def ambiguous(ranked: DataFrame, fraction: float) -> DataFrame:
    """The ceil(n * fraction) queries with the smallest margin between their first two documents."""
    margin = ranked.groupBy("query_id").agg((F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias("margin"))
    n = margin.count()
    most = -int(-n * fraction // 1)
    return margin.withColumn("margin", F.round("margin", 6)).orderBy("margin", "query_id").limit(most)


def rerank_merge(ranked: DataFrame, head: DataFrame) -> DataFrame:
    """head (query_id, doc_id, place) goes first in its order; all other documents keep theirs behind it."""
    tail = ranked.join(head.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(1).alias("_p"), F.col("rank").alias("_o"))
    both = head.select("query_id", "doc_id", F.lit(0).alias("_p"), F.col("place").alias("_o")).union(tail)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "_o"))
    return both.select("query_id", "doc_id", place.alias("rank")).withColumn("score", 1000 - (F.col("rank") - 1))


def movement(before: DataFrame, after: DataFrame, low: int = 2, high: int = 10) -> DataFrame:
    """How many positives moved between rank 1 and ranks low to high."""
    both = before.select("query_id", F.col("rank").alias("a")).join(after.select("query_id", F.col("rank").alias("b")), "query_id", "full_outer")
    return both.agg(
        F.count_if(F.col("a").between(low, high) & (F.col("b") == 1)).alias("promoted"),
        F.count_if((F.col("a") == 1) & ~F.col("b").eqNullSafe(F.lit(1))).alias("demoted"),
        F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"),
    )
