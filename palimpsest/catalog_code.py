"""Catalogue queries over source files made of the driver's rows, and over what is kept of them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.catalog import query, table
from palimpsest.catalog_quality import QUERIES, SQL
from palimpsest.functions import text as X
from palimpsest.operators import chunking, graph, retrieval, scan

__all__ = ["QUERIES", "SQL"]

# A file for each conversation and turn; every fifth conversation's does not parse.

_PYTHON = '"""doc"""\nimport os\nfrom a import b\n\nclass C{n}(B):\n    x = {t}\n\n    def m(self):\n        y = {t}\n        return y\n\n    z = 1\n\nasync def f{n}(a):\n    return a\n\n\ndef g():\n    pass\n'
_BROKEN = "def (:\n  {n}\n{t}"
_SCRIPT = "import {{a}} from './m{t}';\nexport const k = 1;\nfunction f{n}(x) {{\n  return g{n}.h(x) + q(a);\n}}\nclass K {{\n  m() {{ f{n}(1); }}\n}}\n"


def _files(spark, sf_dir, language, good, bad=None):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    fill = lambda t: F.replace(F.replace(F.lit(t.replace("{{", "{").replace("}}", "}")), F.lit("{n}"), F.col("conv_id").cast("string")), F.lit("{t}"), F.col("turn").cast("string"))
    text = fill(good) if bad is None else F.when(F.col("conv_id") % 5 == 0, fill(bad)).otherwise(fill(good))
    return c.select(F.concat("conv_id", F.lit("/"), "turn").alias("path"), F.lit(language).alias("language"), text.alias("text"))


def _said(text):
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{n}", "' || n || '").replace("{t}", "' || t || '") + "'"


_ROWS = "SELECT DISTINCT conv_id || '/' || turn AS path, conv_id::VARCHAR AS n, turn::VARCHAR AS t, conv_id % 5 = 0 AS bad FROM conversations"
_PYTHON_CHUNKS = (
    ("imports", "<module_imports>", None, 2, 3, "import os\nfrom a import b"),
    ("class", "C{n}", None, 5, 12, "class C{n}(B):\n    x = {t}\n\n    def m(self):\n\n    z = 1"),
    ("method", "C{n}.m", "C{n}", 8, 10, "    def m(self):\n        y = {t}\n        return y"),
    ("async_function", "f{n}", None, 14, 15, "async def f{n}(a):\n    return a"),
    ("function", "g", None, 18, 19, "def g():\n    pass"),
)


def _chunk_sql(kind, symbol, parent, first, last, text, where):
    return f"SELECT path, '{kind}' AS chunk_type, {_said(symbol)} AS symbol, {_said(parent) if parent else 'NULL'} AS parent_symbol, {first} AS start_line, {last} AS end_line, sha256({_said(text)}) AS body FROM r WHERE {where}"


@query(f"WITH r AS ({_ROWS}) " + " UNION ALL ".join([*(_chunk_sql(*c, "NOT bad") for c in _PYTHON_CHUNKS), _chunk_sql("window", "window_0001", None, 1, 3, _BROKEN, "bad")]))
def python_chunks(spark, sf_dir):
    found = chunking.chunk_files(_files(spark, sf_dir, "python", _PYTHON, _BROKEN))
    return found.select("path", "chunk_type", "symbol", "parent_symbol", "start_line", "end_line", F.sha2("text", 256).alias("body"))


@query(f"""WITH r AS ({_ROWS}), c AS (SELECT path, 'import {{a}} from ''./m' || t || ''';' AS imports, 'export const k = 1;' AS exports, n FROM r)
SELECT path, 'function' AS chunk_type, 'f' || n AS symbol, 3 AS start_line, 5 AS end_line, 'g' || n || '.h@4:10 q@4:' || (19 + len(n)) AS calls, array_to_string(list_sort(['a', 'f' || n, 'g' || n, 'h', 'q', 'x']), ' ') AS identifiers, imports, exports FROM c
UNION ALL SELECT path, 'class', 'K', 6, 8, 'f' || n || '@7:9', array_to_string(list_sort(['K', 'f' || n, 'm']), ' '), imports, exports FROM c
UNION ALL SELECT path, 'method', 'm', 7, 7, 'f' || n || '@7:9', array_to_string(list_sort(['f' || n, 'm']), ' '), imports, exports FROM c""")
def javascript_chunks(spark, sf_dir):
    found = chunking.chunk_files(_files(spark, sf_dir, "javascript", _SCRIPT))
    calls = F.array_join(F.transform("calls", lambda c: F.concat(c["name"], F.lit("@"), c["line"], F.lit(":"), c["column"])), " ").alias("calls")
    return found.select("path", "chunk_type", "symbol", "start_line", "end_line", calls, F.array_join(F.sort_array("referenced_identifiers"), " ").alias("identifiers"), F.array_join("imports", "\n").alias("imports"), F.array_join("exports", "\n").alias("exports"))


@query(r"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN encode(text) || '\x00'::BLOB ELSE encode(repeat('é', (doc_id % 9 * 40)::INT) || text) END AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS h, regexp_extract_all(hex(b[1:4096]), '..') AS p FROM b)
SELECT doc_id, list_contains(regexp_extract_all(h, '..'), '00') OR coalesce(len(list_filter(p, lambda x: NOT (x IN ('07', '08', '09', '0A', '0C', '0D', '1B') OR x BETWEEN '20' AND '7E'))) / nullif(len(p), 0)::DOUBLE > 0.3, false) AS "binary" FROM h""")
def binary_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 17 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\x00"))).otherwise(F.concat(F.repeat(F.lit("é"), (F.col("doc_id") % 9 * 40).cast("int")), "text").cast("binary"))
    return d.select("doc_id", scan.is_binary(content).alias("binary"))


# Occurrences of contents in versions: an embedding is a content, a document's number tells which one it holds.


@query("""WITH o AS (SELECT d.doc_id % 3 AS commit, d.source AS path, d.lang AS symbol, 'v' || d.doc_id AS version_id, e.vec_id AS content_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % 97),
s AS (SELECT vec_id AS content_id, round(list_dot_product((SELECT embedding FROM embeddings WHERE vec_id = 11)::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM embeddings),
r AS (SELECT commit, path, symbol, version_id, content_id, score, row_number() OVER (PARTITION BY commit ORDER BY score DESC, path, symbol, version_id) AS rank FROM o JOIN s USING (content_id))
SELECT * FROM r WHERE rank <= 25""")
def occurrence_search(spark, sf_dir):
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    there = d.select((F.col("doc_id") % 3).alias("commit"), F.col("source").alias("path"), F.col("lang").alias("symbol"), F.concat(F.lit("v"), "doc_id").alias("version_id"), (F.col("doc_id") % 97).alias("content_id"))
    asked = e.filter("vec_id = 11").select("embedding").first()[0]
    got = retrieval.occurrence_top(e.select(F.col("vec_id").alias("content_id"), F.col("embedding").alias("vec")), there, asked, 25)
    return got.select("commit", "path", "symbol", "version_id", "content_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT sha256(lang || chr(10) || text) AS content_id, count(DISTINCT doc_id) AS changed_state_count, string_agg(doc_id % 3 || ':' || source || ':' || doc_id, ' ' ORDER BY doc_id % 3, source, doc_id) AS places FROM documents GROUP BY 1""")
def content_places(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("commit", F.col("doc_id") % 3)
    places = F.sort_array(F.collect_list(F.struct("commit", "source", "doc_id")))
    said = F.array_join(F.transform(places, lambda p: F.concat_ws(":", p["commit"], p["source"], p["doc_id"])), " ")
    return d.groupBy(X.content_id(F.col("lang"), F.col("text")).alias("content_id")).agg(F.countDistinct("doc_id").alias("changed_state_count"), said.alias("places"))


@query("""SELECT doc_id, sha256('r:c:' || source || ':window:' || CASE WHEN doc_id % 4 = 0 THEN '<anonymous>' ELSE lang END || ':' || 1 || '-' || n_chars || ':' || sha256(lang || chr(10) || text)) AS version_id, source || ':window:' || CASE WHEN doc_id % 4 = 0 THEN '<anonymous>' ELSE lang END AS occurrence_key, regexp_replace(source || '/' || lang || ' x', '[^A-Za-z0-9._-]', '_', 'g') AS slug FROM documents""")
def chunk_identities(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    symbol = F.when(F.col("doc_id") % 4 != 0, F.col("lang"))
    kind, path = F.lit("window"), F.col("source")
    version = X.version_id(F.lit("r"), F.lit("c"), path, kind, symbol, F.lit(1), F.col("n_chars"), X.content_id(F.col("lang"), F.col("text")))
    return d.select("doc_id", version.alias("version_id"), X.occurrence_key(path, kind, symbol).alias("occurrence_key"), X.slug(F.concat("source", F.lit("/"), "lang", F.lit(" x"))).alias("slug"))


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS name FROM pages), n AS (SELECT page_id, unnest(list_distinct([name, string_split(name, '.')[-1]])) AS name FROM h)
SELECT page_id, name, count(*) AS n FROM n GROUP BY 1, 2""")
def call_names(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    calls = F.transform(found, lambda x, i: F.struct(x.alias("name"), i.cast("int").alias("line"), F.lit(0).alias("column")))
    edges = graph.edges_of_calls(table(spark, sf_dir, "pages").select(F.col("page_id").alias("version_id"), calls.alias("calls")))
    return edges.groupBy(F.col("version_id").alias("page_id"), "name").agg(F.count("*").alias("n"))


@query("SELECT source, lang, count(*) AS n, round(avg(CASE WHEN doc_id % 3 = 0 THEN n_chars END), 6) AS mean_known FROM documents GROUP BY 1, 2")
def partition_counts(spark, sf_dir):
    known = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars"))
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg(known), 6).alias("mean_known"))


@query("""WITH s AS (SELECT vec_id, label, round(list_dot_product((SELECT embedding FROM embeddings WHERE vec_id = 21)::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM embeddings), k AS (SELECT * FROM s ORDER BY score DESC, vec_id DESC LIMIT 40),
x AS (SELECT vec_id FROM embeddings WHERE vec_id % 29 = 3), m AS (SELECT vec_id, (score - (SELECT min(score) FROM k)) / greatest((SELECT max(score) - min(score) FROM k), 1e-9::DOUBLE) AS s FROM k),
f AS (SELECT coalesce(m.vec_id, x.vec_id) AS id, round(coalesce(s, 0) + CASE WHEN x.vec_id IS NULL THEN 0 ELSE 0.95::DOUBLE END, 6) AS score, CASE WHEN x.vec_id IS NULL THEN 'semantic' ELSE 'structural' END AS evidence FROM m FULL JOIN x ON m.vec_id = x.vec_id),
p AS (SELECT f.*, 'p' || e.label AS path, e.vec_id % 11 AS start_line, CASE WHEN e.vec_id % 2 = 0 THEN 's' || e.vec_id END AS symbol FROM f JOIN embeddings e ON e.vec_id = f.id)
SELECT id, evidence, score, path, start_line, symbol, row_number() OVER (ORDER BY score DESC, path, start_line, coalesce(symbol, ''), id) AS rank FROM p""")
def fused_order(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 21").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    near = retrieval.dense_top(q, e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv")), 40)
    fused = graph.fuse(near.select(F.col("doc_id").alias("id"), "score"), e.filter("vec_id % 29 = 3").select(F.col("vec_id").alias("id"), F.lit("structural").alias("evidence")), "usage")
    places = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("p"), "label").alias("path"), (F.col("vec_id") % 11).alias("start_line"), F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("s"), "vec_id")).alias("symbol"))
    order = Window.orderBy(F.desc("score"), "path", "start_line", F.coalesce("symbol", F.lit("")), "id")
    return fused.join(places, "id").select("id", "evidence", "score", "path", "start_line", "symbol", F.row_number().over(order).cast("long").alias("rank"))
