"""Queries over the driver's tables, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text as X
from palimpsest.operators import chunking, diff, evolution, graph, retrieval, scan
from palimpsest.plans.spread import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Texts and their identities


@query("""SELECT doc_id, sha256(lang || chr(10) || text) AS content_id, sha256(text) AS content_sha256 FROM documents""")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_id(F.col("lang"), F.col("text")).alias("content_id"), F.sha2("text", 256).alias("content_sha256"))


@query("""SELECT sha256(lang || chr(10) || text) AS content_id, min(doc_id) AS first_doc, count(*) AS occurrences FROM documents GROUP BY 1""")
def content_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(X.content_id(F.col("lang"), F.col("text")).alias("content_id")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("occurrences"))


@query(r"""WITH p AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 240 THEN substring(t, 1, 240) || '...' ELSE t END AS preview FROM p""")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(r"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\n$', ''), chr(10))) END::BIGINT AS lines FROM documents""")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.line_count(F.col("text")).cast("long").alias("lines"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\n+', '') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '\n+$', '') AS t FROM a)
SELECT doc_id, sha256(CASE WHEN t = '' THEN t ELSE t || chr(10) END) AS normal FROM b""")
def normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalize(F.col("text")), 256).alias("normal"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::BIGINT AS n, sha256(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)), ' ')) AS tokens FROM documents""")
def tokenize_basic(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("tokens"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\d+|==|!=|<=|>=|[-+*/%]=?|[(){}\[\].,:]') AS x FROM documents)
SELECT doc_id, len(x)::BIGINT AS n, sha256(array_to_string(list_transform(x, lambda y: lower(y)), ' ')) AS tokens FROM t""")
def tokenize_code(spark, sf_dir):
    t = X.tokens(F.col("text"), X.CODE)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("tokens"))


@query(r"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\d+|==|!=|<=|>=|[-+*/%]=?|[(){}\[\].,:]'), lambda y: lower(y)) AS x FROM documents),
s AS (SELECT doc_id, flatten(list_transform(x, lambda y: list_concat([y], list_filter(string_split(y, '_'), lambda p: p <> '' AND p <> y)))) AS x FROM t)
SELECT doc_id, len(x)::BIGINT AS n, sha256(array_to_string(x, ' ')) AS tokens FROM s""")
def tokenize_code_split(spark, sf_dir):
    t = X.tokens_split(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("tokens"))


# Scan


def _files(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".js", ".md", ".go", ".png", ".tar.gz")]), (F.col("doc_id") % 6 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 13 == 0, "node_modules").otherwise("src")
    path = F.concat(folder, F.lit("/"), "source", F.lit("/f"), F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), (F.col("n_chars") * 100).alias("size"))


_FILES = """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'node_modules' ELSE 'src' END || '/' || source || '/f' || doc_id || ['.py', '.js', '.md', '.go', '.png', '.tar.gz'][doc_id % 6 + 1] AS path, n_chars * 100 AS size FROM documents"""
_REASON = """CASE WHEN list_has_any(string_split(path, '/'), ['node_modules', 'dist', 'build', 'target', 'out', 'env', 'venv']) OR regexp_matches(path, '(\\.png|\\.tar\\.gz)$') THEN 'excluded'
WHEN size > 2000000 THEN 'too_large' WHEN NOT regexp_matches(path, '\\.(py|js|go)$') THEN 'unsupported_extension' ELSE 'candidate' END""".replace("\\\\", "\\")


@query(f"SELECT doc_id, {_REASON} AS reason, CASE WHEN regexp_matches(path, '\\.py$') THEN 'python' WHEN regexp_matches(path, '\\.js$') THEN 'javascript' WHEN regexp_matches(path, '\\.go$') THEN 'go' END AS language FROM ({_FILES})")
def scan_filter(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", scan.scan_reason(F.col("path"), F.col("size")).alias("reason"), scan.language(F.col("path")).alias("language"))


@query(f"""SELECT k.reason, count(f.reason) AS n FROM (VALUES ('excluded'), ('too_large'), ('unsupported_extension'), ('binary'), ('candidate')) k(reason)
LEFT JOIN (SELECT {_REASON} AS reason FROM ({_FILES})) f ON k.reason = f.reason GROUP BY 1""")
def scan_skip_counts(spark, sf_dir):
    return scan.skip_counts(_files(spark, sf_dir).select(scan.scan_reason(F.col("path"), F.col("size")).alias("reason")))


# Two versions of a corpus


def _versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")

    def make(rows, text):
        rows = rows.select("doc_id", "lang", "source", text.alias("text"))
        return rows.select(F.col("doc_id").cast("string").alias("path"), F.col("doc_id").cast("string").alias("occurrence_key"), F.sha2("text", 256).alias("sha256"), X.content_id(F.col("lang"), F.col("text")).alias("content_id"), F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text"), 256).alias("version_id"))

    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    return make(d.filter("doc_id % 7 <> 0"), F.col("text")), make(d.filter("doc_id % 5 <> 0"), changed)


_VERSIONS = """WITH o AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS sha256, sha256(lang || chr(10) || text) AS content_id, sha256(doc_id || ':' || text) AS version_id FROM documents WHERE doc_id % 7 <> 0),
m AS (SELECT doc_id, lang, CASE WHEN doc_id % 11 = 0 THEN text || ' x' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0),
n AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS sha256, sha256(lang || chr(10) || text) AS content_id, sha256(doc_id || ':' || text) AS version_id FROM m)
"""


@query(_VERSIONS + "SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.sha256 = n.sha256 THEN 'unchanged' ELSE 'modified' END AS status FROM o FULL JOIN n ON o.path = n.path")
def file_diff(spark, sf_dir):
    return diff.file_diff(*_versions(spark, sf_dir))


@query(_VERSIONS + """, d AS (SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.sha256 = n.sha256 THEN 'unchanged' ELSE 'modified' END AS status FROM o FULL JOIN n ON o.path = n.path)
SELECT status, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6)::DOUBLE AS percentage FROM d GROUP BY 1""")
def file_diff_summary(spark, sf_dir):
    d = diff.file_diff(*_versions(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))
    total = d.agg(F.sum("n").alias("total"))
    return d.crossJoin(F.broadcast(total)).select("status", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percentage"))


@query(_VERSIONS + """SELECT version_id, path AS occurrence_key, CASE WHEN content_id IN (SELECT content_id FROM o) THEN 'reused' WHEN path IN (SELECT path FROM o) THEN 'modified_replaced' ELSE 'new' END AS status FROM n
UNION ALL SELECT version_id, path, 'deleted' FROM o WHERE content_id NOT IN (SELECT content_id FROM n) AND path NOT IN (SELECT path FROM n)""")
def chunk_diff(spark, sf_dir):
    return diff.chunk_diff(*_versions(spark, sf_dir))


@query(_VERSIONS + "SELECT coalesce(o.path, n.path) AS occurrence_key, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_id = n.content_id THEN 'unchanged' ELSE 'modified' END AS status FROM o FULL JOIN n ON o.path = n.path")
def index_update_diff(spark, sf_dir):
    return diff.index_diff(*_versions(spark, sf_dir))


@query(_VERSIONS + """, h AS (SELECT content_id, content_id IN (SELECT content_id FROM o) AS hit FROM n)
SELECT count(*) AS total, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(DISTINCT content_id) FILTER (NOT hit) AS generated,
greatest(0, count(*) FILTER (NOT hit) - count(DISTINCT content_id) FILTER (NOT hit))::BIGINT AS duplicate_avoided, round(count(*) FILTER (hit) * 100.0::DOUBLE / count(*), 6) AS reuse_percentage,
round(1 - count(DISTINCT content_id) FILTER (NOT hit) / count(*)::DOUBLE, 6) AS work_reduction FROM h""")
def embedding_reuse_report(spark, sf_dir):
    return diff.reuse_report(*_versions(spark, sf_dir))


@query(_VERSIONS + """, d AS (SELECT CASE WHEN o.path IS NULL THEN 'a' WHEN n.path IS NULL THEN 'r' WHEN o.content_id = n.content_id THEN 'u' ELSE 'm' END AS s FROM o FULL JOIN n ON o.path = n.path),
oc AS (SELECT DISTINCT content_id FROM o), nc AS (SELECT DISTINCT content_id FROM n)
SELECT (SELECT count(*) FROM d WHERE s = 'u') AS unchanged_occurrences, (SELECT count(*) FROM d WHERE s = 'm') AS modified_replaced_occurrences,
(SELECT count(*) FROM d WHERE s IN ('a', 'm')) AS added_occurrences, (SELECT count(*) FROM d WHERE s IN ('r', 'm')) AS removed_occurrences,
(SELECT count(*) FROM nc WHERE content_id IN (FROM oc)) AS reused_vectors, (SELECT count(*) FROM nc WHERE content_id NOT IN (FROM oc)) AS vectors_newly_inserted,
(SELECT count(*) FROM oc WHERE content_id NOT IN (FROM nc)) AS vectors_tombstoned, (SELECT count(*) FROM nc) AS active_vectors_after_update""")
def index_update_counts(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return diff.index_update(old, new, old)


# Aggregates over chunks


@query("""SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6)::DOUBLE AS median FROM documents GROUP BY GROUPING SETS ((lang), (source))""")
def chunk_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.median("n_chars"), 6).alias("median"))


@query("""SELECT lang, round(quantile_cont(n_chars, 0.5), 6)::DOUBLE AS p50, round(quantile_cont(n_chars, 0.75), 6)::DOUBLE AS p75, round(quantile_cont(n_chars, 0.95), 6)::DOUBLE AS p95, max(n_chars) AS top,
quantile_disc(n_chars, 0.9) AS nearest90 FROM documents GROUP BY lang""")
def length_percentiles(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = lambda q: F.round(F.percentile("n_chars", q), 6)
    return d.groupBy("lang").agg(p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.95).alias("p95"), F.max("n_chars").alias("top"), F.expr("percentile_disc(0.9) within group (order by n_chars)").cast("long").alias("nearest90"))


@query("""SELECT lang, sum(m)::BIGINT AS loc FROM (SELECT lang, source, max(n_chars) AS m FROM documents GROUP BY 1, 2) GROUP BY 1""")
def loc_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.max("n_chars").alias("m")).groupBy("lang").agg(F.sum("m").alias("loc"))


@query(r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS x FROM documents),
w AS (SELECT doc_id, x, unnest(range(0, (ceil(greatest(0, len(x) - 8) / 5.0) * 5 + 1)::BIGINT, 5)) AS pos FROM l)
SELECT doc_id, 'window_' || lpad((pos // 5 + 1)::INT::VARCHAR, 4, '0') AS symbol, (pos + 1)::BIGINT AS start_line, least(pos + 8, len(x))::BIGINT AS end_line, sha256(array_to_string(x[pos + 1:pos + 8], chr(10))) AS body FROM w""")
def fallback_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return chunking.windows(d, 8, 3).select(F.col("id").alias("doc_id"), "symbol", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.sha2("text", 256).alias("body"))


# Dense retrieval


def _dense(spark, sf_dir, k=10, queries="vec_id % 100 = 0"):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter(queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return retrieval.dense_top(q, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv")), k)


_DENSE = """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label, q.label AS ql, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM s)
"""


@query(_DENSE + "SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM r WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(_DENSE + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS k FROM s WHERE query_id <> doc_id),
m AS (SELECT query_id, min(k) FILTER (label = ql) AS first, count(*) FILTER (label = ql AND k <= 10) AS hits FROM o GROUP BY 1)
SELECT round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END), 5) AS hit, round(avg(hits / 10.0::DOUBLE), 5) AS precision, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END), 5) AS mrr FROM m""")
def dense_label_eval(spark, sf_dir):
    # Ranks beyond 10 count for none of the measures; one more than 10 makes up for the query itself.
    lab = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    s = _dense(spark, sf_dir, 11).filter("query_id <> doc_id")
    s = s.join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(lab.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    k = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id")))
    m = s.withColumn("k", k).groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("k"))).alias("first"), F.count_if((F.col("label") == F.col("ql")) & (F.col("k") <= 10)).alias("hits"))
    return m.agg(F.round(F.avg(F.when(F.col("first") <= 10, 1.0).otherwise(0.0)), 5).alias("hit"), F.round(F.avg(F.col("hits") / 10.0), 5).alias("precision"), F.round(F.avg(F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0)), 5).alias("mrr"))


@query(_DENSE + """, m AS (SELECT query_id, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS margin FROM r GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY margin, query_id) AS k, count(*) OVER () AS n FROM m)
SELECT query_id, margin FROM o WHERE k <= ceil(n * 0.25::DOUBLE)""")
def ambiguous_queries(spark, sf_dir):
    return retrieval.ambiguous(_dense(spark, sf_dir), 0.25)


@query(_DENSE + """, h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM r WHERE rank <= 3),
u AS (SELECT query_id, doc_id, 0 AS p, place AS o FROM h UNION ALL SELECT query_id, doc_id, 1, rank FROM r WHERE rank <= 10 AND rank > 3)
SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY p, o))::BIGINT AS rank, (1001 - row_number() OVER (PARTITION BY query_id ORDER BY p, o))::BIGINT AS score FROM u""")
def selective_rerank(spark, sf_dir):
    ranked = _dense(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    head = ranked.filter("rank <= 3").withColumn("place", place).select("query_id", "doc_id", "place")
    return retrieval.rerank_merge(ranked, head).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.col("score").cast("long").alias("score"))


_EVO = """WITH s AS (SELECT vec_id, vec_id % 4 AS ord, label AS content, round(list_dot_product((SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM embeddings),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 20)
"""


def _evo(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    s = retrieval.dense_scores(q, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv")))
    s = s.join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("content")), "doc_id").withColumn("ord", F.col("doc_id") % 4)
    k = F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("score"), "doc_id"))
    return s.withColumn("k", k).filter("k <= 20").select(F.col("doc_id").alias("vec_id"), "ord", "content", "score")


@query(_EVO + "SELECT vec_id, ord, content, score FROM c ORDER BY score DESC, ord, vec_id LIMIT 15")
def evolution_search_raw(spark, sf_dir):
    return _evo(spark, sf_dir).orderBy(F.desc("score"), "ord", "vec_id").limit(15)


@query(_EVO + ", g AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY score DESC, ord, vec_id) AS b FROM c) SELECT vec_id, ord, content, score FROM g WHERE b = 1 ORDER BY score DESC, content LIMIT 5")
def evolution_search_grouped(spark, sf_dir):
    return evolution.best_states(_evo(spark, sf_dir), 5, F.col("ord"), F.col("vec_id"))


# BM25


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, sf_dir, depth=10):
    return retrieval.bm25_top(_items(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"), depth)


_BM25 = r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q AS (SELECT item_id AS query_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY 1, 2),
x AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))), 6) AS score
 FROM qt JOIN df USING (term) JOIN tf USING (term), n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM s)
"""
_POSITIVE = ", p AS (SELECT item_id AS query_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1), k AS (SELECT p.query_id, r.rank FROM p LEFT JOIN r ON p.query_id = r.query_id AND p.doc_id = r.doc_id AND r.rank <= 10)\n"


@query(_BM25 + "SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _positive(spark, sf_dir):
    held = retrieval.holding(_items(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"))
    return held.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))


def _ranks(spark, sf_dir, depth=10):
    return retrieval.positives(_bm25(spark, sf_dir, depth), _positive(spark, sf_dir), depth)


@query(_BM25 + _POSITIVE + """SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 5) AS hit, round(avg(CASE WHEN rank <= 10 THEN 0.1::DOUBLE ELSE 0 END), 5) AS precision,
round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 5) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(1 + rank) ELSE 0 END), 5) AS ndcg FROM k""")
def bm25_eval(spark, sf_dir):
    return retrieval.measures(_ranks(spark, sf_dir))


@query(_BM25 + _POSITIVE.replace("r.rank <= 10", "r.rank <= 100") + """, b AS (SELECT CASE WHEN rank = 1 THEN 'rank_1' WHEN rank <= 3 THEN 'rank_2_3' WHEN rank <= 10 THEN 'rank_4_10' WHEN rank <= 20 THEN 'rank_11_20' WHEN rank <= 100 THEN 'rank_21_100' ELSE 'not_in_top_100' END AS bucket FROM k)
SELECT v.bucket, count(b.bucket) AS n FROM (VALUES ('rank_1'), ('rank_2_3'), ('rank_4_10'), ('rank_11_20'), ('rank_21_100'), ('not_in_top_100')) v(bucket) LEFT JOIN b USING (bucket) GROUP BY 1""")
def rank_buckets(spark, sf_dir):
    return retrieval.rank_buckets(_ranks(spark, sf_dir, 100))


# Evolution


def _chain(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    top = table(spark, sf_dir, "events").agg(F.max("event_id").alias("top"))
    e = e.crossJoin(F.broadcast(top)).withColumn("ord", F.floor(F.col("event_id") / ((F.col("top") + 1) / F.lit(90.0))))
    e = e.groupBy(F.col("user_id").alias("key"), "ord").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("content"))
    return e, spark.range(90).select(F.col("id").alias("ord"))


_CHAIN = """WITH e AS (SELECT user_id AS key, floor(event_id / (((SELECT max(event_id) FROM events) + 1) / 90.0::DOUBLE))::BIGINT AS ord, arg_max(event_type, (ts, event_id)) AS content FROM events GROUP BY 1, 2),
g AS (SELECT k.key, o.ord, e.content FROM (SELECT DISTINCT key FROM e) k CROSS JOIN range(90) o(ord) LEFT JOIN e ON e.key = k.key AND e.ord = o.ord),
l AS (SELECT *, lag(content) OVER (PARTITION BY key ORDER BY ord) AS old, count(content) OVER (PARTITION BY key, content ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g),
t AS (SELECT key, ord, old, content AS new, CASE WHEN content IS NULL AND old IS NOT NULL THEN 'deleted' WHEN content IS NULL THEN NULL WHEN old IS NULL AND seen > 0 THEN 'reintroduced' WHEN old IS NULL THEN 'added' WHEN old = content THEN 'unchanged' ELSE 'modified' END AS transition FROM l)
"""


@query(_CHAIN + "SELECT key, ord, content FROM g")
def evolution_chains(spark, sf_dir):
    return evolution.states(*_chain(spark, sf_dir))


@query(_CHAIN + "SELECT key, ord, old, new, transition FROM t WHERE transition IS NOT NULL")
def evolution_transitions(spark, sf_dir):
    return evolution.transitions(*_chain(spark, sf_dir))


@query(_CHAIN + "SELECT transition, count(*) AS n, count(DISTINCT key) AS chains FROM t WHERE transition IS NOT NULL GROUP BY 1")
def evolution_metrics(spark, sf_dir):
    return evolution.transitions(*_chain(spark, sf_dir)).groupBy("transition").agg(F.count("*").alias("n"), F.countDistinct("key").alias("chains"))


@query(_CHAIN + """, s AS (SELECT key, (4 * count(*) FILTER (transition = 'modified') + 3 * count(*) FILTER (transition = 'deleted') + 3 * count(*) FILTER (transition = 'reintroduced') + count(*) FILTER (transition = 'added'))::BIGINT AS score FROM t WHERE transition IS NOT NULL GROUP BY 1)
SELECT * FROM s WHERE score > 1 ORDER BY score DESC, key LIMIT 5""")
def interesting_chains(spark, sf_dir):
    return evolution.interesting(evolution.transitions(*_chain(spark, sf_dir)))


@query(_CHAIN + "SELECT content, count(DISTINCT key) AS chains, min(ord) AS first_ord, max(ord) AS last_ord FROM e GROUP BY 1")
def lineage(spark, sf_dir):
    e, _ = _chain(spark, sf_dir)
    return e.groupBy("content").agg(F.countDistinct("key").alias("chains"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query(_CHAIN + """, w AS (SELECT DISTINCT key, content FROM e),
s AS (SELECT key, content, min(ord) AS first_ord, max(ord) AS last_ord, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS ords FROM e WHERE ord BETWEEN 10 AND 79 GROUP BY 1, 2),
i AS (SELECT key, new AS content, old AS predecessor, transition AS introduced_by, row_number() OVER (PARTITION BY key, new ORDER BY ord) AS k FROM t WHERE transition IN ('added', 'reintroduced', 'modified') AND ord BETWEEN 10 AND 79),
x AS (SELECT key, old AS content, new AS successor, transition AS removed_by, row_number() OVER (PARTITION BY key, old ORDER BY ord) AS k FROM t WHERE transition IN ('deleted', 'modified') AND ord BETWEEN 11 AND 80)
SELECT w.key, w.content, s.first_ord, s.last_ord, coalesce(s.ords, '') AS ords, i.predecessor, i.introduced_by, x.successor, x.removed_by FROM w
LEFT JOIN s USING (key, content) LEFT JOIN (SELECT * FROM i WHERE k = 1) i USING (key, content) LEFT JOIN (SELECT * FROM x WHERE k = 1) x USING (key, content)""")
def evolution_context(spark, sf_dir):
    e, commits = _chain(spark, sf_dir)
    zero = F.lit(0).cast("long")
    t = evolution.transitions(e, commits).withColumn("lines_added", zero).withColumn("lines_removed", zero)
    c = evolution.context(e.select("key", "content"), e, t, 10, 79)
    return c.select("key", "content", "first_ord", "last_ord", F.array_join("ords", ",").alias("ords"), "predecessor", "introduced_by", "successor", "removed_by")


@query("""WITH c AS (SELECT conv_id, turn, role, sha256(text) AS h, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM conversations)
SELECT conv_id, turn, role, CASE WHEN p IS NULL THEN 'added' WHEN p = h THEN 'unchanged' ELSE 'modified' END AS transition FROM c""")
def conversation_diff(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    h = F.sha2("text", 256)
    p = F.lag(h).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return c.select("conv_id", "turn", "role", F.when(p.isNull(), "added").when(p == h, "unchanged").otherwise("modified").alias("transition"))


# Graph and routing


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS name FROM pages""")
def graph_edges(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("name"))


@query(r"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS name FROM pages) SELECT CASE WHEN starts_with(name, '/') THEN 'calls' ELSE 'imports' END AS kind, count(*) AS edges, count(DISTINCT name) AS names FROM e GROUP BY 1""")
def graph_stats(spark, sf_dir):
    return graph_edges(spark, sf_dir).groupBy(F.when(F.startswith("name", F.lit("/")), "calls").otherwise("imports").alias("kind")).agg(F.count("*").alias("edges"), F.countDistinct("name").alias("names"))


@query(r"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM documents),
p AS (SELECT doc_id, unnest(t) AS name, generate_subscripts(t, 1)::BIGINT AS line FROM t),
a AS (SELECT doc_id, min(line) AS a FROM p WHERE name = 'the' GROUP BY 1)
SELECT a.doc_id, a.a AS first_at, min(p.line) AS second_at FROM a JOIN p ON p.doc_id = a.doc_id AND p.name = 'that' AND p.line > a.a GROUP BY 1, 2""")
def call_order(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("version_id"), F.posexplode(X.tokens(F.col("text"))).alias("p", "name"))
    edges = d.select("version_id", "name", (F.col("p") + 1).cast("long").alias("line"), F.lit(0).alias("column"))
    return graph.call_order(edges, "the", "that").select(F.col("version_id").alias("doc_id"), F.col("a.line").alias("first_at"), F.col("b.line").alias("second_at"))


_TERMS = ["the", "of", "and"]


@query(r"""WITH p AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS name FROM documents),
f AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['the', 'of', 'and'], name)) AS k FROM p WHERE name IN ('the', 'of', 'and'))
SELECT doc_id, name FROM f WHERE k = 1 ORDER BY list_position(['the', 'of', 'and'], name), doc_id LIMIT 25""")
def search_references(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    e = d.select(F.col("doc_id").alias("version_id"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("name"))
    e = e.select("version_id", "name", F.lit("references").alias("kind"), F.col("version_id").cast("string").alias("path"), F.lit("").alias("symbol"), F.lit(1).alias("start_line"))
    return graph.references(e, _TERMS, 25).select(F.col("version_id").alias("doc_id"), "name")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS path, l_linenumber::VARCHAR AS symbol, (l_linenumber * 2)::BIGINT AS a, (l_linenumber * 2 + l_quantity)::BIGINT AS b FROM lineitem)
SELECT s.path, s.symbol, arg_min(y.symbol, (y.b - y.a, y.a, y.symbol)) AS parent FROM s LEFT JOIN s y ON s.path = y.path AND y.a <= s.a AND y.b >= s.b AND y.b - y.a > s.b - s.a GROUP BY 1, 2, s.a, s.b""")
def enclosing_parent(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem")
    s = s.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("string").alias("symbol"), (F.col("l_linenumber") * 2).cast("long").alias("start"), (F.col("l_linenumber") * 2 + F.col("l_quantity")).cast("long").alias("end")).distinct()
    return graph.enclosing(s).select("path", "symbol", "parent")


@query("""WITH s AS (SELECT d.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id = 5),
k AS (SELECT * FROM s ORDER BY score DESC, id DESC LIMIT 30), x AS (SELECT vec_id AS id FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 5)),
m AS (SELECT id, (score - (SELECT min(score) FROM k)) / greatest((SELECT max(score) - min(score) FROM k), 1e-9::DOUBLE) AS s FROM k)
SELECT coalesce(m.id, x.id) AS id, CASE WHEN x.id IS NULL THEN 'semantic' ELSE 'reference' END AS evidence, round(coalesce(m.s, 0) + CASE WHEN x.id IS NULL THEN 0 ELSE 0.4::DOUBLE END, 6) AS score FROM m FULL JOIN x ON m.id = x.id""")
def fusion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    s = _dense(spark, sf_dir, 30, "vec_id = 5")
    same = e.join(F.broadcast(e.filter("vec_id = 5").select("label")), "label")
    return graph.fuse(s.select(F.col("doc_id").alias("id"), "score"), same.select(F.col("vec_id").alias("id"), F.lit("reference").alias("evidence")), "mixed")
