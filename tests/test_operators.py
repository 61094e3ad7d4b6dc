"""Goldens and traps of operators that SQL cannot express."""

import random

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import chunking, diff, evolution, graph, javascript, retrieval, router, scan


def plain_normalize(t):
    lines = [x.rstrip() for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines) + "\n" if lines else ""


def test_normalize_random(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choice("ab \t\r\n\u00a0\u2003\x0b\x0c\x1c") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", X.normalize(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [plain_normalize(t) for t in rows]


def test_router_follows_its_rules(spark):
    asked = {
        "Where is openSettings used?": "usage", "Where is openSettings": "semantic", "Which methods call save before validate?": "structural", "explain the retry": "semantic",
        "a endpoint b": "mixed", "find users of x.callers": "semantic", "": "semantic",
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string").select("q", router.query_type(F.col("q")).alias("t"), router.terms(F.col("q")).alias("terms"))
    got = {r.q: r for r in df.collect()}
    assert {q: got[q].t for q in asked} == asked
    assert got["find users of x.callers"].terms[-2:] == ["x.callers", "callers"]


def test_python_chunks():
    code = '"""doc"""\nimport os\nfrom a import b\n\nx = 1\n\n@d\ndef f():\n    return 1\n\nclass C:\n    y = 2\n\n    async def m(self):\n        return 3\n'
    got = [c[:5] for c in chunking.python_chunks(code)]
    assert got == [("imports", "<module_imports>", None, 2, 3), ("function", "f", None, 8, 9), ("class", "C", None, 11, 15), ("async_method", "C.m", "C", 14, 15)]
    assert "return 3" not in chunking.python_chunks(code)[2][5]
    assert chunking.python_chunks("def (") == []


JS = r"""import a from 'a';
import { b,
  c } from "b";
function f() { return g('}'); }
class K extends Base {
  field = (x) => { this.go(x); };
  constructor() { super(); this.x(); }
  static async open(y) { if (y) { api.call(y); } return /[/}]{2}/.test(y); }
}
const h = async (z) => { f(z); }, k = x => x + m(x);
export const cfg = { run: function () { go(); }, alt(q) { q.a.b().c(1); }, n: 3 };
export default function main() { const s = `t ${f(`u ${k(1)}`)} }`; return s; }
function* gen() { yield 1; }
foo(function inner() { return 1; });
"""


def test_javascript_entities():
    got = {(e.kind, e.symbol, e.parent, e.start_line, e.end_line): [c[0] for c in e.calls] for e in javascript.Source(JS).entities()}
    assert got == {
        ("function", "f", None, 4, 4): ["g"],
        ("class", "K", None, 5, 9): ["this.go", "super", "this.x", "api.call", "/[/}]{2}/.test"],
        ("object_method", "field", "K", 6, 6): ["this.go"],
        ("constructor", "constructor", "K", 7, 7): ["super", "this.x"],
        ("method", "open", "K", 8, 8): ["api.call", "/[/}]{2}/.test"],
        ("arrow_function", "h", None, 10, 10): ["f"],
        ("arrow_function", "k", None, 10, 10): ["m"],
        ("object_method", "run", None, 11, 11): ["go"],
        ("method", "alt", None, 11, 11): ["q.a.b().c", "q.a.b"],
        ("function", "main", None, 12, 12): ["f", "k"],
    }
    file = javascript.Source(JS)
    assert file.statements("import") == ["import a from 'a';", 'import { b,\n  c } from "b";']
    assert [x[:17] for x in file.statements("export")] == ["export const cfg ", "export default fu"]
    assert file.entities()[0].identifiers == ["f", "g"]


def test_javascript_takes_any_text():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["{", "}", "(", ")", "`", "${", "'", "/", "=>", "=", ",", ";", "\n", "class ", "function ", "f", "é ", "const ", "\\"]) for _ in range(rng.randint(0, 40)))
        for e in javascript.Source(text).entities():
            assert 1 <= e.start_line <= e.end_line <= text.count("\n") + 1


def test_windows_agree(spark):
    text = "\n".join(f"l{i}" for i in range(190)) + "\n"
    df = chunking.windows(spark.createDataFrame([(1, text)], "id int, text string"))
    got = [(r.symbol, r.start_line, r.end_line) for r in df.orderBy("symbol").collect()]
    assert got == [(c[1], c[3], c[4]) for c in chunking.window_chunks(text)] and got[-1][2] == 190


def test_files_fall_back_to_windows(spark):
    files = spark.createDataFrame([("a.py", "python", "def f():\n  pass\n"), ("b.py", "python", "x ="), ("c.go", "go", None)], "path string, language string, text string")
    got = {(r.path, r.symbol) for r in chunking.chunk_files(files).collect()}
    assert got == {("a.py", "f"), ("b.py", "window_0001")}


def test_diff_leaves_out_moved_content(spark):
    cols = "occurrence_key string, content_id string, version_id string"
    old = spark.createDataFrame([("k1", "a", "1"), ("k2", "b", "2")], cols)
    new = spark.createDataFrame([("k1", "b", "3"), ("k3", "z", "4")], cols)
    got = {(r.version_id, r.status) for r in diff.chunk_diff(old, new).collect()}
    assert got == {("3", "reused"), ("4", "new")}
    assert {r.status for r in diff.chunk_diff(old, old).collect()} == {"reused"}


def test_transitions(spark):
    rows = [(1, 0, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "b")]
    occ = spark.createDataFrame(rows, "key int, ord long, content string")
    got = [(r.ord, r.transition) for r in evolution.transitions(occ, spark.range(7).select(F.col("id").alias("ord"))).orderBy("ord").collect()]
    assert got == [(0, "added"), (1, "deleted"), (2, "reintroduced"), (3, "modified"), (4, "unchanged"), (5, "deleted")]


def test_fusion(spark):
    sem = spark.createDataFrame([(1, 0.2), (2, 0.6)], "id int, score double")
    got = {r.id: (r.evidence, r.score) for r in graph.fuse(sem, spark.createDataFrame([(2, "structural"), (3, "reference"), (3, "structural")], "id int, evidence string"), "usage").collect()}
    assert got == {1: ("semantic", 0.0), 2: ("structural", 1.95), 3: ("mixed", 1.45)}


def test_measures_of_a_perfect_ranking(spark):
    r = retrieval.measures(spark.createDataFrame([(1, 1), (2, 1)], "query_id int, rank long")).first()
    assert (r.hit, r.mrr, r.ndcg, r.precision) == (1.0, 1.0, 1.0, 0.1)


def test_binary(spark):
    rows = [(1, b""), (2, b"plain\n"), (3, b"a\0"), (4, "éééé".encode())]
    got = {r.i: r.b for r in spark.createDataFrame(rows, "i int, c binary").select("i", scan.is_binary(F.col("c")).alias("b")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}


def test_enclosing_equals_brute_force(spark):
    import random

    from palimpsest.operators import graph

    rng = random.Random(3)
    rows = [(f"p{rng.randrange(9)}", f"s{i}", a := rng.randrange(30), a + rng.randrange(1, 25)) for i in range(400)] + [("one", None, 1, 2), ("none", "x", None, 3)]
    rows += [("big", f"n{i}", i, 4000 - i) for i in range(2000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = {(r.path, r.symbol): r.parent for r in graph.enclosing(spark.createDataFrame(rows, "path string, symbol string, start int, end int")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {}
    for p, s, a, b in rows[:401]:
        around = [(y[3] - y[2], y[2], y[1]) for y in rows[:401] if y[0] == p and y[2] <= a and y[3] >= b and y[3] - y[2] > b - a]
        want[p, s] = min(around)[2] if around else None
    want |= {("big", f"n{i}"): f"n{i - 1}" if i else None for i in range(2000)}
    assert got == want
    assert graph.enclosing(spark.createDataFrame([], "path string, symbol string, start int, end int")).count() == 0


def test_transitions_without_a_grid(spark):
    from palimpsest.operators import evolution

    rows = [("a", 10, "x"), ("a", 20, "x"), ("a", 40, "x"), ("b", 20, "y"), ("b", 30, "z"), ("c", 40, "w"), ("d", 20, None), ("e", 10, "p"), ("e", 30, "q")]
    commits = spark.createDataFrame([(x,) for x in (10, 20, 30, 40)], "ord long")
    got = sorted(map(tuple, evolution.transitions(spark.createDataFrame(rows, "key string, ord long, content string"), commits).collect()))
    want = [
        ("a", 10, None, "x", "added"), ("a", 20, "x", "x", "unchanged"), ("a", 30, "x", None, "deleted"), ("a", 40, None, "x", "reintroduced"),
        ("b", 20, None, "y", "added"), ("b", 30, "y", "z", "modified"), ("b", 40, "z", None, "deleted"), ("c", 40, None, "w", "added"),
        ("e", 10, None, "p", "added"), ("e", 20, "p", None, "deleted"), ("e", 30, None, "q", "added"), ("e", 40, "q", None, "deleted"),
    ]
    assert got == sorted(want, key=str) or sorted(map(str, got)) == sorted(map(str, want))
    empty = spark.createDataFrame([], "key string, ord long, content string")
    assert evolution.transitions(empty, commits).count() == 0 and evolution.transitions(empty, commits.limit(0)).count() == 0


def test_ranking_in_scans_equals_plain_scores(spark):
    import collections
    import math
    import random
    import re

    from palimpsest.operators import retrieval

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(700)] + [(700, None), (701, ""), (None, "w1 w2"), (702, "W1 é w1é _x " * 9)]
    asked = [(i, " ".join(rng.choices(words, k=6))) for i in range(12)] + [(12, "absent"), (13, None), (14, "w1 w1 w1"), (15, "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    toks = [(i, [x.lower() for x in re.findall("[A-Za-z0-9_]+", t or "")]) for i, t in docs]
    n, avg = len(toks), sum(len(t) for _, t in toks) / len(toks)
    df = collections.Counter(x for _, t in toks for x in set(t))
    want = {}
    for i, text in asked:
        scores = []
        for doc, t in toks:
            tf = collections.Counter(t)
            both = [x.lower() for x in re.findall("[A-Za-z0-9_]+", text or "") if x.lower() in tf]
            if both and doc is not None:
                scores.append((round(sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] / (tf[x] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for x in both), 6), doc))
        want |= {(i, r + 1): doc for r, (_, doc) in enumerate(sorted(scores, reverse=True)[:10])}
    got = retrieval.bm25_top(q, d, 10)
    assert {(r.query_id, r.rank): r.doc_id for r in got.collect()} == want
    plain = retrieval.top_k(retrieval.bm25_scores(q, d.filter("doc_id is not null or text is not null"), ), 10)
    assert plain.count() >= got.count()
    retrieval.QUERY_BLOCK, kept = 5, retrieval.QUERY_BLOCK
    assert {(r.query_id, r.rank): r.doc_id for r in retrieval.bm25_top(q, d, 10).collect()} == want
    held = {(r.query_id, r.doc_id) for r in retrieval.holding(q, d.filter("doc_id is not null")).collect()}
    retrieval.QUERY_BLOCK = kept
    assert held == {(i, doc) for i, t in asked for doc, text in docs if t is not None and text is not None and doc is not None and t in text}
    assert retrieval.bm25_top(q.limit(0), d, 3).count() == 0 and retrieval.bm25_top(q, d.limit(0), 3).count() == 0 and retrieval.holding(q, d.limit(0)).count() == 0
    e = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(50)] + [(50, None)], "doc_id long, dv array<float>")
    v = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [0.0, 0.0, 0.0]), (3, None)], "query_id long, qv array<float>")
    best = lambda f: sorted(((i % 7) + 2.0 * (i % 3) if f == 1 else 0.0, i) for i in range(50))[::-1][:8]
    assert {(r.query_id, r.rank): (r.score, r.doc_id) for r in retrieval.dense_top(v, e, 8).collect()} == {(f, k + 1): x for f in (1, 2) for k, x in enumerate(best(f))}
    assert retrieval.dense_top(v.limit(0), e, 3).count() == 0


def test_tokens_in_pieces(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from palimpsest.functions import postings

    rng = random.Random(3)
    texts = ["".join(rng.choices("aB_9 .\u00e9", (9, 9, 1, 3, 4, 1, 1), k=rng.randrange(0, 40))) for _ in range(3000)] + [None, "", "x" * 50, "y" * 49 + " ", None]
    got = lambda: [(lo + int(d), int(x)) for lo, _, h, doc in postings.tokens(pa.array(texts, pa.string()).slice(3)) for x, d in zip(h, doc, strict=True)]
    want = got()
    for piece in (1, 7, 48):
        monkeypatch.setattr(postings, "PIECE", piece)
        assert got() == want
    monkeypatch.undo()
    long = pa.array(["twelve_bytes " * 700_000], pa.string())
    tracemalloc.start()
    n = sum(len(h) for _, _, h, _ in postings.tokens(long))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 700_000 and peak < 70e6  # 8 bytes and more for each byte of the text before


def test_memory_of_bm25_does_not_grow_with_queries(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    q = spark.createDataFrame([(i, " ".join(rng.sample(words, 30))) for i in range(1000)], "query_id long, text string")
    docs = [(i, " ".join(rng.choices(words, k=150))) for i in range(256)]
    runs, plain = [], type(q).mapInArrow
    monkeypatch.setattr(type(q), "mapInArrow", lambda self, f, *a, **k: (runs.append(f), plain(self, f, *a, **k))[1])
    top = retrieval.bm25_top(q, spark.createDataFrame(docs, "doc_id long, text string"), 3)
    ids, texts = map(list, zip(*docs, strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    tracemalloc.start()
    one = retrieval_rows(runs[-1]([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all hits of 256 documents at once before
    monkeypatch.setattr(retrieval, "CELLS", 1)
    assert retrieval_rows(runs[-1]([batch])) == one == {(r.query_id, r.doc_id, r.score) for r in top.collect()}
    # No RDD that Python reads stands beside the scans: it would have a second set of workers.
    v = spark.range(3).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("qv"))
    d = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("w1 w2").alias("text"))
    for df in (retrieval.bm25_top(q, d, 3), retrieval.bm25_top(q.limit(0), d, 3), retrieval.dense_top(v, v.toDF("doc_id", "dv"), 2)):
        assert "RDD" not in df._jdf.queryExecution().toString() and df.columns == ["query_id", "doc_id", "score", "rank"]
        assert [x for _, x in df.dtypes] == ["bigint", "bigint", "double", "int"]


def retrieval_rows(batches):
    return {tuple(r.values()) for b in batches for r in b.to_pylist()}
