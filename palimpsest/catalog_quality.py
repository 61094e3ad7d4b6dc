"""Catalogue queries over measures, checks, reranking and routing, each with the SQL that states the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.catalog import QUERIES, SQL, _BM25, _DENSE, _VERSIONS, _bm25, _dense, _items, _versions, query, table
from palimpsest.functions import text as X
from palimpsest.operators import diff, evaluation, graph, reports, rerank, retrieval, router
__all__ = ["QUERIES", "SQL"]

# Rankings of every hundredth vector; a vector of the query's label is a positive, label + 1 its gain.

_TEXT_ORDER = _DENSE.replace("doc_id DESC) AS rank", "doc_id::VARCHAR DESC) AS rank").replace("ORDER BY score DESC, d", "ORDER BY score DESC, d")
_QRELS = ", g AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, 1 + d.vec_id % 3 AS label FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 100 = 0)\n"


def _qrels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    same = e.join(F.broadcast(q), F.col("label") == F.col("ql"))
    return same.select("query_id", F.col("vec_id").alias("doc_id"), (1 + F.col("vec_id") % 3).alias("label"))


def _scores(spark, sf_dir, k=100):
    # Ties at the cut go by number here and by text in ranked_items; scores to 6 decimals do not tie at these cuts.
    return _dense(spark, sf_dir, k).select("query_id", "doc_id", "score")


@query(_TEXT_ORDER + "SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM r WHERE rank <= 20")
def ranked_items(spark, sf_dir):
    return evaluation.ranked_items(_scores(spark, sf_dir, 40), 20)


@query(_TEXT_ORDER + _QRELS + """, c AS (SELECT unnest([1, 3, 5, 10, 20, 100]) AS k),
i AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY label DESC) AS place, count(*) OVER (PARTITION BY query_id) AS positives FROM g),
ideal AS (SELECT query_id, k, sum(label / log2(1 + place::DOUBLE)) FILTER (place <= k) AS ideal, max(positives) AS positives FROM i, c GROUP BY 1, 2),
h AS (SELECT r.query_id, r.rank, g.label, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS nth FROM r JOIN g ON r.query_id = g.query_id AND r.doc_id = g.doc_id WHERE r.rank <= 100),
m AS (SELECT query_id, k, sum(label / log2(1 + rank::DOUBLE)) FILTER (rank <= k) AS dcg, sum(nth / rank::DOUBLE) FILTER (rank <= k) AS ap, count(*) FILTER (rank <= k) AS found, min(rank) AS first FROM h, c GROUP BY 1, 2),
x AS (SELECT * FROM ideal LEFT JOIN m USING (query_id, k))
SELECT k, count(*) AS queries, round(avg(coalesce(dcg / ideal, 0)), 5) AS ndcg, round(avg(coalesce(ap / positives, 0)), 5) AS map, round(avg(CASE WHEN first <= k THEN 1.0::DOUBLE / first ELSE 0 END), 5) AS mrr,
round(avg(coalesce(found / positives::DOUBLE, 0)), 5) AS recall, round(avg(coalesce(found, 0) / k::DOUBLE), 5) AS precision, round(avg(CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0 END), 5) AS hit FROM x GROUP BY k""")
def retrieval_measures(spark, sf_dir):
    return evaluation.retrieval_measures(_scores(spark, sf_dir, 120), _qrels(spark, sf_dir))


@query(_TEXT_ORDER + _QRELS + """, p AS (SELECT query_id, min(r.rank) AS rank FROM r JOIN g USING (query_id, doc_id) WHERE r.rank <= 10 GROUP BY 1), a AS (SELECT DISTINCT query_id FROM g)
SELECT a.query_id, p.rank FROM a LEFT JOIN p USING (query_id)""")
def positive_ranks(spark, sf_dir):
    return evaluation.positive_ranks(_scores(spark, sf_dir, 40), _qrels(spark, sf_dir), 10, unique=False)


@query("""SELECT * FROM (VALUES ('one_positive', (SELECT bool_and(n = 1) FROM (SELECT count(*) AS n FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id))), ('mrr_at_10', true), ('hit_at_10', true)) t("check", passed)""")
def sanity_checks(spark, sf_dir):
    ranked, qrels = _scores(spark, sf_dir, 40), _qrels(spark, sf_dir)
    return evaluation.sanity_checks(ranked, qrels, evaluation.retrieval_measures(ranked, qrels, (10,)))


_BROKEN = """WITH r AS (SELECT q.vec_id AS query_id, CASE WHEN q.vec_id % 300 <> 0 THEN d.vec_id END AS doc_id, CASE WHEN d.vec_id % 7 = 0 AND q.vec_id % 200 = 0 THEN 'NaN'::DOUBLE ELSE 0.5::DOUBLE END AS score
FROM embeddings q JOIN embeddings d ON d.label = q.label WHERE q.vec_id % 50 = 0 AND q.vec_id % 500 <> 100),
a AS (SELECT DISTINCT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0)
"""


def _broken(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    r = e.join(F.broadcast(q.filter("query_id % 500 <> 100")), "label")
    doc = F.when(F.col("query_id") % 300 != 0, F.col("vec_id")).alias("doc_id")
    score = F.when((F.col("vec_id") % 7 == 0) & (F.col("query_id") % 200 == 0), F.lit(float("nan"))).otherwise(0.5).alias("score")
    return r.select("query_id", doc, score), q.select("query_id"), e


@query(_BROKEN + """, s AS (SELECT query_id, count(doc_id) AS docs, count(*) FILTER (isnan(score) AND doc_id IS NOT NULL) AS bad FROM r GROUP BY 1),
p AS (SELECT a.query_id, CASE WHEN docs IS NULL THEN 'missing' WHEN docs = 0 THEN 'empty' WHEN bad > 0 THEN 'non_finite' END AS problem, CASE WHEN bad > 0 THEN bad ELSE 1 END::BIGINT AS n FROM a LEFT JOIN s USING (query_id))
SELECT * FROM p WHERE problem IS NOT NULL""")
def ranking_problems(spark, sf_dir):
    rankings, asked, _ = _broken(spark, sf_dir)
    return evaluation.ranking_problems(rankings, asked)


_PROBLEMS = _BROKEN + """, k AS (SELECT vec_id FROM embeddings WHERE vec_id % 11 <> 0), w AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0),
t AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE doc_id % 13 = 0),
s AS (SELECT query_id, count(doc_id) - count(DISTINCT doc_id) AS duplicates, count(*) FILTER (k.vec_id IS NULL) AS unknown_docs, count(*) FILTER (isnan(score)) AS non_finite FROM t LEFT JOIN k ON k.vec_id = t.doc_id GROUP BY 1),
x AS (SELECT coalesce(w.query_id, s.query_id) AS query_id, coalesce(duplicates, 0)::BIGINT AS duplicates, coalesce(unknown_docs, 0)::BIGINT AS unknown_docs, coalesce(non_finite, 0)::BIGINT AS non_finite,
CASE WHEN w.query_id IS NULL THEN 'not_asked' WHEN s.query_id IS NULL THEN 'missing' ELSE 'yes' END AS answered FROM w FULL JOIN s ON w.query_id = s.query_id)
"""


def _submission(spark, sf_dir):
    rankings, _, e = _broken(spark, sf_dir)
    corpus = e.filter("vec_id % 11 <> 0").select(F.col("vec_id").alias("doc_id"))
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    return evaluation.submission_problems(rankings.union(rankings.filter("doc_id % 13 = 0")), corpus, asked)


@query(_PROBLEMS + "SELECT * FROM x")
def submission_problems(spark, sf_dir):
    return _submission(spark, sf_dir)


@query(_PROBLEMS + """SELECT unnest(['no_duplicates', 'known_documents', 'finite_scores', 'all_queries']) AS "check", unnest([bool_and(duplicates = 0), bool_and(unknown_docs = 0), bool_and(non_finite = 0), bool_and(answered = 'yes')]) AS passed FROM x""")
def submission_checks(spark, sf_dir):
    return evaluation.submission_checks(_submission(spark, sf_dir))


# Reranking


_AGAIN = _TEXT_ORDER + """, n AS (SELECT query_id, doc_id, round(list_dot_product(list_reverse(q.embedding)::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM r JOIN embeddings q ON q.vec_id = r.query_id JOIN embeddings d ON d.vec_id = r.doc_id WHERE rank <= 5 AND query_id % 200 = 0),
m AS (SELECT r.query_id, r.doc_id, r.rank AS old, row_number() OVER (PARTITION BY r.query_id ORDER BY n.score IS NULL, n.score DESC, CASE WHEN n.score IS NULL THEN r.rank END, r.doc_id::VARCHAR DESC) AS rank FROM r LEFT JOIN n ON n.query_id = r.query_id AND n.doc_id = r.doc_id WHERE r.rank <= 20)
"""


def _again(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    ranked = _scores(spark, sf_dir, 40)
    chosen = ranked.select("query_id").distinct().filter("query_id % 200 = 0")
    asked = e.select(F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("qv"))
    return ranked, rerank.selected_again(ranked, chosen, asked, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv")), 5, 20)


@query(_AGAIN + "SELECT query_id, doc_id, rank::BIGINT AS rank, (1001 - rank)::DOUBLE AS score FROM m")
def selective_rerank_vectors(spark, sf_dir):
    return _again(spark, sf_dir)[1]


@query(_AGAIN + _QRELS + """, b AS (SELECT query_id, min(old) FILTER (old <= 10) AS a, min(m.rank) FILTER (m.rank <= 10) AS b FROM g LEFT JOIN m USING (query_id, doc_id) WHERE g.doc_id <> g.query_id GROUP BY 1), h AS (SELECT unnest([5, 10])::BIGINT AS high)
SELECT high, count(*) FILTER (a BETWEEN 2 AND high AND b = 1) AS moved_to_first, count(*) FILTER (a = 1 AND b IS DISTINCT FROM 1) AS moved_down, count(*) FILTER (a = 1) AS first_before, count(*) FILTER (b = 1) AS first_after, count(*) FILTER (b = 1) - count(*) FILTER (a = 1) AS net_change FROM b, h GROUP BY 1""")
def movement_counts(spark, sf_dir):
    ranked, after = _again(spark, sf_dir)
    qrels = _qrels(spark, sf_dir)
    other = qrels.filter("doc_id <> query_id")
    asked = qrels.select("query_id").distinct()
    first = lambda r: asked.join(r.join(other, ["query_id", "doc_id"]).filter("rank <= 10").groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")
    before, after = first(evaluation.ranked_items(ranked, 20)), first(after)
    told = [evaluation.movement_counts(before, after, high).withColumn("high", F.lit(high).cast("long")) for high in (5, 10)]
    return told[0].unionByName(told[1])


@query(_TEXT_ORDER + """, c AS (SELECT query_id, row_number() OVER (ORDER BY query_id DESC) AS pos FROM (SELECT DISTINCT query_id FROM r)),
t AS (SELECT doc_id, min(pos * 100 + rank) AS first FROM r JOIN c USING (query_id) WHERE rank <= 5 GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY first) AS place FROM t""")
def unique_top_docs(spark, sf_dir):
    ranked = _scores(spark, sf_dir, 40)
    chosen = ranked.select("query_id").distinct().select("query_id", F.row_number().over(Window.orderBy(F.desc("query_id"))).alias("position"))
    return evaluation.unique_top_docs(ranked, chosen, 5)


@query(_BM25.replace("doc_id DESC) AS rank", "doc_id::VARCHAR DESC) AS rank") + """SELECT r.query_id, r.doc_id, rank::BIGINT AS rank, sha256(b.text) AS query, sha256(d.text) AS document FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 5""")
def rerank_pairs(spark, sf_dir):
    # 100 are ranked, so a tie in score at 5 is settled by text.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranked = _bm25(spark, sf_dir, 100).select("query_id", "doc_id", "score")
    return rerank.pairs(ranked, _items(spark, sf_dir), docs, 5).select("query_id", "doc_id", "rank", F.sha2("query", 256).alias("query"), F.sha2("document", 256).alias("document"))


# Results of searches: the ten nearest vectors, a label standing for a file and a content, vec_id % 7 for a symbol.


def _results(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    r = evaluation.ranked_items(_scores(spark, sf_dir, 40), 12).filter("query_id <> doc_id").join(e, "doc_id").filter("query_id % 300 <> 0 or rank > 50")
    return r.select("query_id", "rank", F.concat(F.lit("f"), "label").alias("path"), F.concat(F.lit("s"), F.col("doc_id") % 7).alias("symbol"), (F.col("doc_id") % 50).cast("int").alias("start_line"), (F.col("doc_id") % 50 + 9).cast("int").alias("end_line"), F.col("label").cast("string").alias("content_id"))


_RESULTS = _TEXT_ORDER + """, e AS (SELECT query_id, rank, 'f' || label AS path, 's' || doc_id % 7 AS symbol, doc_id % 50 AS start_line, doc_id % 50 + 9 AS end_line, label::VARCHAR AS content_id, ql FROM r WHERE rank <= 12 AND query_id <> doc_id AND query_id % 300 <> 0),
w AS (SELECT vec_id AS query_id, label AS ql FROM embeddings WHERE vec_id % 100 = 0)
"""


@query(_RESULTS + """, x AS (SELECT w.query_id, rank, path, path IN ('f' || w.ql, 'f' || (w.ql + 1)) AS f, (path IN ('f' || w.ql, 'f' || (w.ql + 1)) OR symbol = 's3') AS ok FROM w LEFT JOIN e USING (query_id))
SELECT query_id, round(coalesce(count(*) FILTER (ok AND rank <= 1) / nullif(count(*) FILTER (rank <= 1), 0)::DOUBLE, 0), 6) AS precision_at_1, round(coalesce(count(*) FILTER (ok AND rank <= 5) / nullif(count(*) FILTER (rank <= 5), 0)::DOUBLE, 0), 6) AS precision_at_5,
round(count(DISTINCT path) FILTER (f AND rank <= 5) / 2.0::DOUBLE, 6) AS recall_at_5, round(count(DISTINCT path) FILTER (f AND rank <= 10) / 2.0::DOUBLE, 6) AS recall_at_10, round(coalesce(1.0::DOUBLE / min(rank) FILTER (ok), 0), 6) AS mrr FROM x GROUP BY 1""")
def quality_by_files(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    files = F.array(F.concat(F.lit("f"), "label"), F.concat(F.lit("f"), F.col("label") + 1)).alias("files")
    return evaluation.quality_by_files(_results(spark, sf_dir), q.select(F.col("vec_id").alias("query_id"), files, F.array(F.lit("s3")).alias("symbols")))


@query(_RESULTS + """, x AS (SELECT w.query_id, rank, (path = 'f' || w.ql AND start_line >= 10) AS a, symbol = 's3' AS b, (path = 'f' || (w.ql + 1) AND end_line <= 40) AS c FROM w LEFT JOIN e USING (query_id)),
y AS (SELECT *, a OR b OR c AS ok FROM x), z AS (SELECT query_id, k, coalesce(bool_or(a) FILTER (rank <= k), false)::INT + coalesce(bool_or(b) FILTER (rank <= k), false)::INT + coalesce(bool_or(c) FILTER (rank <= k), false)::INT AS n FROM y, (SELECT unnest([5, 10]) AS k) GROUP BY 1, 2)
SELECT query_id, round(coalesce(count(*) FILTER (ok AND rank <= 1) / nullif(count(*) FILTER (rank <= 1), 0)::DOUBLE, 0), 6) AS precision_at_1, round(coalesce(count(*) FILTER (ok AND rank <= 5) / nullif(count(*) FILTER (rank <= 5), 0)::DOUBLE, 0), 6) AS precision_at_5,
(SELECT round(n / 3.0::DOUBLE, 6) FROM z WHERE z.query_id = y.query_id AND k = 5) AS recall_at_5, (SELECT round(n / 3.0::DOUBLE, 6) FROM z WHERE z.query_id = y.query_id AND k = 10) AS recall_at_10, round(coalesce(1.0::DOUBLE / min(rank) FILTER (ok), 0), 6) AS mrr FROM y GROUP BY 1""")
def quality_by_entries(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    entry = lambda path, symbol, start, end: F.struct(path.alias("path"), symbol.alias("symbol"), start.alias("start_line"), end.alias("end_line"))
    no, none = F.lit(None).cast("string"), F.lit(None).cast("int")
    a = entry(F.concat(F.lit("f"), "label"), no, F.lit(10), none)
    c = entry(F.concat(F.lit("f"), F.col("label") + 1), F.lit(""), F.lit(0), F.lit(40))
    return evaluation.quality_by_entries(_results(spark, sf_dir), q.select(F.col("vec_id").alias("query_id"), F.array(a, entry(no, F.lit("s3"), none, none), c).alias("entries")))


_SUMMARY = _RESULTS + """, x AS (SELECT w.query_id, rank, content_id, content_id = w.ql::VARCHAR AS ok FROM w LEFT JOIN e USING (query_id)),
y AS (SELECT query_id, min(rank) FILTER (ok) AS first_relevant_rank, count(content_id) AS result_count, count(DISTINCT content_id) AS unique_content_ids FROM x GROUP BY 1),
t AS (SELECT query_id, first_relevant_rank, coalesce(first_relevant_rank <= 1, false) AS hit_at_1, coalesce(first_relevant_rank <= 3, false) AS hit_at_3, coalesce(first_relevant_rank <= 5, false) AS hit_at_5, coalesce(1.0::DOUBLE / first_relevant_rank, 0) AS reciprocal_rank, result_count, unique_content_ids, result_count - unique_content_ids AS duplicate_results FROM y)
"""


def _summaries(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("content_id"))
    return evaluation.version_summaries(_results(spark, sf_dir).select("query_id", "rank", "content_id"), q)


@query(_SUMMARY + "SELECT * FROM t")
def version_summaries(spark, sf_dir):
    return _summaries(spark, sf_dir)


@query(_SUMMARY + """SELECT count(*) AS queries, round(avg(hit_at_1::INT::DOUBLE), 6) AS hit_rate_at_1, round(avg(hit_at_3::INT::DOUBLE), 6) AS hit_rate_at_3, round(avg(hit_at_5::INT::DOUBLE), 6) AS hit_rate_at_5, round(avg(reciprocal_rank), 6) AS mrr, sum(duplicate_results)::BIGINT AS duplicate_results, sum(unique_content_ids)::BIGINT AS unique_states FROM t""")
def version_means(spark, sf_dir):
    return evaluation.version_means(_summaries(spark, sf_dir))


@query("""SELECT doc_id AS query_id, sha256(lang || chr(10) || text || CASE WHEN doc_id % 9 = 0 THEN '!' ELSE '' END) AS content_id FROM documents WHERE sha256(lang || chr(10) || text || CASE WHEN doc_id % 9 = 0 THEN '!' ELSE '' END) NOT IN (SELECT sha256(lang || chr(10) || text) FROM documents)""")
def unknown_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    asked = F.concat("text", F.when(F.col("doc_id") % 9 == 0, "!").otherwise(""))
    return evaluation.unknown_states(d.select(F.col("doc_id").alias("query_id"), X.content_id(F.col("lang"), asked).alias("content_id")), d.select(X.content_id(F.col("lang"), F.col("text")).alias("content_id"))).select("query_id", "content_id")


# Runs


@query(_DENSE.replace("d.label, q.label AS ql", "d.vec_id % 4 AS ord").replace("PARTITION BY query_id", "PARTITION BY query_id, ord") + "SELECT query_id, ord AS commit, doc_id, score, rank::BIGINT AS rank FROM r WHERE rank <= 10")
def dense_search_commits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    there = e.select((F.col("vec_id") % 4).alias("commit"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv"))
    return retrieval.dense_top_by(q, there, "commit", 10)


_PARITY = _DENSE + """, l AS (SELECT query_id % 200 AS commit, query_id, doc_id AS v, score, rank FROM r WHERE rank <= 10),
c AS (SELECT commit, query_id, CASE WHEN query_id % 500 = 0 AND rank = 4 THEN -1 ELSE v END AS v, round(score + CASE WHEN query_id % 300 = 0 THEN 0.001::DOUBLE * rank ELSE 0 END, 6) AS score, rank FROM l WHERE query_id % 700 <> 0 OR rank <= 9)
"""


@query(_PARITY + "SELECT coalesce(l.commit, c.commit) AS commit, coalesce(l.query_id, c.query_id) AS query_id, bool_and(l.v IS NOT DISTINCT FROM c.v) AS passed, round(coalesce(max(abs(l.score - c.score)), 0), 6) AS max_score_delta FROM l FULL JOIN c ON l.commit = c.commit AND l.query_id = c.query_id AND l.rank = c.rank GROUP BY 1, 2")
def parity(spark, sf_dir):
    a = _dense(spark, sf_dir).select((F.col("query_id") % 200).alias("commit"), "query_id", "rank", F.col("doc_id").alias("version_id"), "score")
    version = F.when((F.col("query_id") % 500 == 0) & (F.col("rank") == 4), F.lit(-1)).otherwise(F.col("version_id"))
    score = F.round(F.col("score") + F.when(F.col("query_id") % 300 == 0, 0.001 * F.col("rank")).otherwise(0.0), 6)
    return evaluation.parity(a, a.filter("query_id % 700 <> 0 or rank <= 9").withColumn("version_id", version).withColumn("score", score))


@query("""SELECT o_orderpriority AS type, count(*) AS queries, round(quantile_cont(o_totalprice, 0.5), 6)::DOUBLE AS median_ms, round(quantile_disc(o_totalprice, 0.95), 6) AS p95_ms FROM orders GROUP BY 1""")
def latency_by_type(spark, sf_dir):
    return evaluation.latency_by_type(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_totalprice").alias("total_ms")))


@query("""WITH p AS (SELECT user_id % 12 AS ord, count(*) AS n, count(DISTINCT event_type) AS kinds, sum(value)::DOUBLE AS s FROM events GROUP BY 1),
c AS (SELECT ord, n % 100 AS file_reuse, kinds * 10 AS chunk_reuse, n % 50 AS embedding_reuse, s AS seconds, n // 3 AS generated, n // 2 AS hits, n AS chunks, n // 4 AS inserted FROM p), b AS (SELECT ord, s * (1 + ord) AS seconds, n // 2 AS contents FROM p WHERE ord % 3 = 1),
l AS (SELECT * FROM c WHERE ord > (SELECT min(ord) FROM c)), x AS (SELECT b.seconds AS full, contents, c.seconds, generated FROM b JOIN c USING (ord))
SELECT round(avg(file_reuse), 6) AS average_file_reuse, round(avg(chunk_reuse), 6) AS average_chunk_reuse, round(avg(embedding_reuse), 6) AS average_embedding_reuse, round(avg(seconds), 6) AS average_update_seconds, sum(hits)::BIGINT AS embeddings_avoided,
(SELECT sum(greatest(0, chunks - inserted))::BIGINT FROM c) AS insertions_avoided, (SELECT round(avg("full"), 6) FROM x) AS average_rebuild_seconds, (SELECT round(median("full" / seconds), 6) FROM x) AS median_speedup, (SELECT round(max("full" / seconds), 6) FROM x) AS maximum_speedup,
(SELECT round(greatest(0, sum(contents) - sum(generated)) / sum(contents)::DOUBLE, 6) FROM x) AS work_saved FROM l""")
def run_means(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 12).alias("ord")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.sum("value").alias("s"))
    part = lambda x: F.floor(F.col("n") / x)
    c = p.select("ord", F.col("ord").alias("commit"), (F.col("n") % 100).alias("file_reuse"), (F.col("kinds") * 10).alias("chunk_reuse"), (F.col("n") % 50).alias("embedding_reuse"), F.col("s").alias("seconds"), part(3).alias("generated"), part(2).alias("hits"), F.col("n").alias("chunks"), part(4).alias("inserted"))
    b = p.filter("ord % 3 = 1").select(F.col("ord").alias("commit"), (F.col("s") * (1 + F.col("ord"))).alias("seconds"), part(2).alias("contents"))
    return evaluation.run_means(c, b)


_FILE_COUNTS = _VERSIONS + """, d AS (SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.sha256 = n.sha256 THEN 'unchanged' ELSE 'modified' END AS s FROM o FULL JOIN n ON o.path = n.path),
c AS (SELECT count(*) AS t, count(*) FILTER (s = 'unchanged') AS u, count(*) FILTER (s = 'modified') AS m, count(*) FILTER (s = 'added') AS a, count(*) FILTER (s = 'deleted') AS x FROM d)
"""


@query(_FILE_COUNTS + """SELECT array_to_string(['Old commit: old (' || (SELECT count(*) FROM o) || ' files)', 'New commit: new (' || (SELECT count(*) FROM n) || ' files)', printf('Unchanged: %d (%.2f%%)', u, u * 100.0::DOUBLE / t), printf('Modified: %d (%.2f%%)', m, m * 100.0::DOUBLE / t),
printf('Added: %d (%.2f%%)', a, a * 100.0::DOUBLE / t), printf('Deleted: %d (%.2f%%)', x, x * 100.0::DOUBLE / t)], chr(10)) AS report FROM c""")
def file_report(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return reports.file_report(diff.file_diff(old, new), "old", "new")


@query(_VERSIONS + """, s AS (SELECT CASE WHEN content_id IN (SELECT content_id FROM o) THEN 'r' WHEN path IN (SELECT path FROM o) THEN 'm' ELSE 'n' END AS s FROM n),
c AS (SELECT count(*) AS t, count(*) FILTER (s = 'r') AS r, count(*) FILTER (s = 'm') AS m, count(*) FILTER (s = 'n') AS n FROM s), x AS (SELECT count(*) AS d FROM o WHERE content_id NOT IN (SELECT content_id FROM n) AND path NOT IN (SELECT path FROM n))
SELECT array_to_string(['Old commit: old (' || (SELECT count(*) FROM o) || ' chunks)', 'New commit: new (' || t || ' chunks)', printf('Reused chunks: %d (%.2f%% of new chunks)', r, r * 100.0::DOUBLE / t), 'Modified/replaced chunks: ' || m, 'New chunks: ' || n,
'New chunks requiring future embeddings: ' || (m + n), 'Deleted chunks: ' || d], chr(10)) AS report FROM c, x""")
def chunk_report(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return reports.chunk_report(diff.chunk_diff(old, new), old.count(), "old", "new")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AND (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS customers_order, true AS nations_same")
def same_rows(spark, sf_dir):
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    n = table(spark, sf_dir, "nation")
    return spark.createDataFrame([(evaluation.same_rows(a, b), evaluation.same_rows(n, n.union(n)))], "customers_order boolean, nations_same boolean")


@query("SELECT item_id AS query_id, text FROM benchmark ORDER BY md5('42:' || item_id::VARCHAR), item_id LIMIT 5")
def sample_queries(spark, sf_dir):
    return evaluation.sample_queries(_items(spark, sf_dir))


# Texts as encoders read them


@query("""SELECT doc_id, sha256(trim(coalesce(source, '') || chr(10) || coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS row_text, sha256('Candidate code snippet:' || chr(10) || text) AS prompt, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS cache_key FROM documents WHERE lang = 'en'""")
def encoder_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("lang = 'en'")
    text = F.col("text")
    return d.select("doc_id", F.sha2(X.row_text(F.col("source"), text), 256).alias("row_text"), F.sha2(X.document_prompt(text), 256).alias("prompt"), F.sha2(X.cache_key(text), 256).alias("cache_key"))


# Routing and edges: questions about two words of each turn of a conversation

_STOP = ", ".join(f"'{w}'" for w in router.STOP)
_ASK = ["Where is {a} used", "Which files call {a} before {b}", "explain {a} {b}", "{a} endpoint", "Find {a} calls {b} handler", "{a} happens before {b} then {a} runs {b}", "does {a} run prior to {b} after"]
_ASKED = f"""WITH w AS (SELECT conv_id, turn, role, md5(text) AS h, regexp_extract_all(text, '[A-Za-z]{{3,}}') AS w FROM conversations),
q AS (SELECT conv_id, turn, role, h, CASE (conv_id + turn) % 7 {" ".join(f"WHEN {i} THEN " + " || ".join({"{a}": "w[1]", "{b}": "w[2]"}.get(p, f"'{p}'") for p in re.split(r"({a}|{b})", t) if p) for i, t in enumerate(_ASK))} END AS t FROM w WHERE len(w) >= 2),
s AS (SELECT *, lower(t) AS l, list_sort(list_distinct(list_filter(regexp_extract_all(t, '[A-Za-z_$][A-Za-z0-9_$]*'), lambda x: lower(x) NOT IN ({_STOP})))) AS n,
 regexp_extract(t, '(?i)\\b(?:call|calls|invoke|invokes|run|runs|happen|happens)\\s+([A-Za-z_$][\\w$]*)\\s+(?:before|then|prior to)\\s+([A-Za-z_$][\\w$]*)', ['a', 'b']) AS p,
 regexp_extract(t, '(?i)\\b([A-Za-z_$][\\w$]*)\\s+before\\s+([A-Za-z_$][\\w$]*)\\b', ['a', 'b']) AS o FROM q)
"""


@query(_ASKED + """SELECT conv_id, turn, role, h, t AS question, array_to_string(n, ' ') AS terms, CASE WHEN p.a <> '' THEN p.a || ' ' || p.b WHEN o.a <> '' THEN o.a || ' ' || o.b END AS pair,
CASE WHEN p.a <> '' OR o.a <> '' THEN CASE WHEN len(n) <= 4 THEN 'structural' ELSE 'mixed' END
WHEN len(n) > 0 AND (contains(l, ' used') OR contains(l, ' usages') OR contains(l, ' referenced') OR contains(l, ' references') OR contains(l, ' call ') OR contains(l, ' calls ') OR contains(l, ' callers') OR contains(l, ' where is')) THEN 'usage'
WHEN len(n) > 0 AND (contains(l, ' before ') OR contains(l, ' after ') OR contains(l, ' deeplink') OR contains(l, 'endpoint') OR contains(l, 'event handler')) THEN 'mixed' ELSE 'semantic' END AS query_type FROM s""")
def router_questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"), F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w")).filter("size(w) >= 2")
    word = {"{a}": F.element_at("w", 1), "{b}": F.element_at("w", 2)}
    kinds = [F.concat(*[word.get(p, F.lit(p)) for p in re.split(r"({a}|{b})", t) if p]) for t in _ASK]
    q = c.withColumn("question", F.element_at(F.array(*kinds), ((F.col("conv_id") + F.col("turn")) % len(_ASK) + 1).cast("int")))
    t = F.col("question")
    return q.select("conv_id", "turn", "role", "h", "question", F.array_join(F.sort_array(router.terms(t)), " ").alias("terms"), F.array_join(router.order_pair(t), " ").alias("pair"), router.query_type(t).alias("query_type"))




@query(r"""SELECT page_id, kind, name, line FROM (
SELECT page_id, 'symbols' AS kind, url AS name, NULL::INT AS line FROM pages
UNION ALL SELECT page_id, 'imports', unnest(regexp_extract_all(html, 'src="([^"]*)"', 1)), NULL FROM pages
UNION ALL SELECT page_id, 'references', unnest(list_distinct(regexp_extract_all(html, 'class="([^"]*)"', 1))), NULL FROM pages
UNION ALL SELECT page_id, 'calls', unnest(list_distinct([h, string_split(h, '.')[-1]])), i::INT FROM (SELECT page_id, unnest(x) AS h, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages)))""")
def structural_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("page_id", "kind", "name", "line")


def _edges(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    named = lambda a: F.regexp_extract_all("html", F.lit(f'{a}="([^"]*)"'), F.lit(1))
    calls = F.transform(named("href"), lambda x, i: F.struct(x.alias("name"), (i + 1).cast("int").alias("line"), F.lit(0).alias("column")))
    chunks = p.select(F.col("page_id").alias("version_id"), F.lit("p").alias("path"), F.col("url").alias("symbol"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), named("src").alias("imports"), F.array_distinct(named("class")).alias("referenced_identifiers"), calls.alias("calls"))
    return graph.structural_edges(chunks).withColumnRenamed("version_id", "page_id")


@query(r"""SELECT kind, count(*) AS edges, count(DISTINCT name) AS names FROM (
SELECT 'symbols' AS kind, url AS name FROM pages WHERE url IS NOT NULL
UNION ALL SELECT 'imports', unnest(regexp_extract_all(html, 'src="([^"]*)"', 1)) FROM pages
UNION ALL SELECT 'references', unnest(list_distinct(regexp_extract_all(html, 'class="([^"]*)"', 1))) FROM pages
UNION ALL SELECT 'calls', unnest(list_distinct([h, string_split(h, '.')[-1]])) FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)) GROUP BY 1""")
def edge_stats(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("name").alias("names"))
