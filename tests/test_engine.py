"""The engine on a small repository of four commits: every method, isolation of versions, errors."""

import subprocess

import pytest
from pyspark.sql import functions as F

from palimpsest.engine import Engine, RequestError
from palimpsest.operators import evolution, graph
from palimpsest.sources import tables

WORDS = ["bluetooth", "validate", "save", "sign", "hash"]
SETTINGS = "export function openBluetooth() { return link('bluetooth'); }\n\nclass Panel {\n  open() { openBluetooth(); }\n}\n"
WORKFLOW = "function setup(x) {\n  validate(x);\n  store.save(x);\n}\n\nfunction late(x) {\n  save(x);\n  validate(x);\n}\n"
SIGNER = "def sign(x):\n    return hash(x)\n"


def encoder():
    """Made in a function, so that it travels to workers by value."""
    words = list(WORDS)
    return lambda texts: [[float(t.lower().count(w)) for w in words] + [0.1] for t in texts]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("git") / "demo"
    at.mkdir()
    run = lambda *w: subprocess.run(["git", "-C", at, "-c", "user.name=n", "-c", "user.email=e@example.org", *w], check=True, capture_output=True).stdout.decode().strip()
    run("init", "-q")

    def commit(files):
        for path, text in files.items():
            (at / path).write_text(text) if text is not None else (at / path).unlink()
        run("add", "-A")
        run("commit", "-qm", "m")
        return run("rev-parse", "HEAD")

    ids = [
        commit({"settings.js": SETTINGS, "workflow.js": WORKFLOW, "signer.py": SIGNER}),
        commit({"signer.py": None, "workflow.js": WORKFLOW.replace("  store.save(x);\n", "  store.save(x);\n  log(x);\n")}),
        commit({"signer.py": SIGNER}),
    ]
    engine = Engine(spark, str(tmp_path_factory.mktemp("engine")), encoder(), {"model": "counts"}, len(WORDS) + 1)
    reports = [engine.register(str(at), ids[0], "demo"), engine.update("demo", ids[1]), engine.update("demo", ids[2])]
    return engine, ids, reports, at


def test_reports(built):
    engine, ids, (first, second, third), _ = built
    assert (first["source_files"], first["chunks"], first["newly_generated_embeddings"]) == (3, 6, 6)
    assert first["symbols"] == 6 and first["loc"] == 5 + 9 + 2
    assert second["changed_files"] == {"unchanged": 1, "modified": 1, "added": 0, "deleted": 1}
    assert (second["vectors_newly_inserted"], second["vectors_tombstoned"], second["reusable_chunks"]) == (1, 2, 4)
    assert (third["newly_generated_embeddings"], third["vectors_newly_inserted"], third["added_occurrences"]) == (0, 0, 1)
    assert "message" in engine.update("demo", ids[2])
    assert engine.health() == {"status": "ok", "encoder_healthy": True, "registered_repository_count": 1}
    row = engine.metrics_summary().first()
    assert (row.commits, row.generated) == (3, 7) and row.average_embedding_reuse == pytest.approx((80 + 100) / 2)


def test_search_keeps_versions_apart(built):
    engine, ids, _, _ = built
    for commit, there in zip(ids, (True, False, True), strict=True):
        got = engine.search("demo", "sign hash", commit, 3).collect()
        assert [r["rank"] for r in got] == [1, 2, 3] and (got[0].path == "signer.py") == there
    assert engine.search("demo", "sign hash", k=1).first().preview == "def sign(x): return hash(x)"


def test_query(built):
    engine, ids, _, _ = built
    rows, trace = engine.query("demo", "Which functions call validate before save?")
    assert trace[0]["result"] == "structural" and trace[2] == {"stage": "semantic_search", "skipped": True}
    got = rows.collect()
    assert got[0].symbol == "setup" and got[0].evidence == "mixed" and got[0].score == pytest.approx(0.9 + 0.15 + 0.05)
    assert {r.symbol for r in got[1:]} == {"late"} and "log(x)" in got[0].snippet
    rows, trace = engine.query("demo", "where is openBluetooth used", ids[0])
    assert trace[0]["result"] == "usage" and {r.symbol for r in rows.collect()} == {"open", "Panel", "openBluetooth"}
    rows, trace = engine.query("demo", "hash", k=1)
    assert trace[2] == {"stage": "semantic_search", "candidates": 6} and rows.first().symbol == "sign"


def test_evolution(built):
    engine, ids, _, _ = built
    got = engine.search_evolution("demo", "sign hash", k=1).first()
    assert got.path == "signer.py" and [o.commit for o in got.occurrences] == [ids[0], ids[2]]
    assert (got.ords, got.introduced_by, got.removed_by, got.lines_added) == ([0, 2], "added", "deleted", 2)
    got = {r.content_id: r for r in engine.search_evolution("demo", "validate save", ids[0], ids[1], 5).collect() if r.symbol == "setup"}
    assert sorted((r.introduced_by, r.removed_by) for r in got.values()) == [("added", "modified"), ("modified", None)]
    old = next(r for r in got.values() if r.removed_by)
    assert old.successor in got and got[old.successor].predecessor == old.content_id and got[old.successor].lines_added == 1
    states, changes = engine.symbol_evolution("demo", "sign", "signer.py")
    assert [r.status for r in states.collect()] == ["present", "absent", "present"]
    assert [(r.transition, r.lines_added, r.lines_removed) for r in changes.collect()] == [("added", 2, 0), ("deleted", 0, 2), ("reintroduced", 2, 0)]


def test_errors(built, spark, tmp_path):
    engine, ids, _, at = built
    for status, ask in (
        (400, lambda: engine.register(str(tmp_path / "none"))), (400, lambda: engine.register(str(at), "nowhere")), (400, lambda: engine.search_evolution("demo", "x", ids[2], ids[0])),
        (404, lambda: engine.search("other", "x")), (404, lambda: engine.symbol_evolution("demo", "nothing")), (404, lambda: engine.symbol_evolution("demo", "sign", "x.py")),
    ):
        with pytest.raises(RequestError) as e:
            ask()
        assert e.value.status == status

    def broken(texts):
        raise OSError("no server")

    down = Engine(spark, engine.root, broken, engine.config, engine.dim)
    assert not down.health()["encoder_healthy"]
    with pytest.raises(RequestError) as e:
        down.search("demo", "x")
    assert e.value.status == 503


def test_incremental_equals_clean(built, spark, tmp_path):
    engine, ids, _, at = built
    clean = Engine(spark, str(tmp_path), encoder(), engine.config, engine.dim)
    clean.register(str(at), ids[2], "demo")
    for q in ("validate", "sign", "bluetooth panel"):
        a, b = (e.search("demo", q, ids[2], 6).select("version_id", "score").collect() for e in (engine, clean))
        assert a == b
    states = engine.chunks("demo").filter(F.col("commit") == ids[2]).select("version_id")
    assert states.exceptAll(clean.chunks("demo").select("version_id")).isEmpty()


def test_headers_and_reports(spark, tmp_path):
    files = spark.createDataFrame([("c", "python", 3), ("c", "go", 4), ("d", "go", 1)], "commit string, language string, size long")
    skipped = spark.createDataFrame([("c", "binary", 2), ("e", "excluded", 1)], "commit string, reason string, n long")
    got = {r.commit: r for r in tables.file_header(files, skipped).collect()}
    assert (got["c"].files, got["c"].bytes, got["c"].languages, got["c"].skipped) == (2, 7, {"go": 1, "python": 1}, {"binary": 2})
    assert (got["d"].skipped, got["e"].files, got["e"].skipped) == ({}, 0, {"excluded": 1})
    chunks = spark.createDataFrame([("c", "go", "window", "ab"), ("c", "go", "window", "abcd"), ("c", "python", None, "")], "commit string, language string, chunk_type string, text string")
    row = tables.chunk_header(chunks.fillna("none", ["chunk_type"])).first()
    assert (row.chunks, row.by_language, row.by_type, row.mean_chars, row.median_chars) == (3, {"go": 2, "python": 1}, {"none": 1, "window": 2}, 2.0, 2.0)
    tables.write_report(files, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 3


def test_edges_of_chunks_without_lists(spark):
    rows = spark.createDataFrame([("v", "p", "s", 1, 2, None, None, None), ("w", "p", None, 1, 2, ["i"], [("a.b", "a.b", 1, 2)], ["x"])], "version_id string, path string, symbol string, start_line int, end_line int, imports array<string>, calls array<struct<name:string,raw:string,line:int,column:int>>, referenced_identifiers array<string>")
    assert sorted((r.kind, r.name) for r in graph.structural_edges(rows).collect()) == [("calls", "a.b"), ("calls", "b"), ("imports", "i"), ("references", "x"), ("symbols", "s")]


def test_context_falls_back_to_another_chain(spark):
    occ = spark.createDataFrame([("k", 0, "a"), ("k", 1, "b")], "key string, ord long, content string")
    changes = evolution.transitions(occ, spark.range(3).select(F.col("id").alias("ord"))).withColumn("lines_added", F.lit(1).cast("long")).withColumn("lines_removed", F.lit(0).cast("long"))
    wanted = spark.createDataFrame([("b", "gone"), ("z", "gone")], "content string, key string")
    got = {r.content: r for r in evolution.context(wanted, occ, changes, 0, 2).collect()}
    assert (got["b"].chain, got["b"].predecessor, got["b"].introduced_by, got["b"].successor, got["b"].removed_by, got["b"].ords) == ("k", "a", "modified", None, "deleted", [1])
    assert (got["z"].chain, got["z"].first_ord, got["z"].ords, got["z"].lines_added) == (None, None, [], 0)
