"""Git source, vector store, line differ and streaming update on small inputs made here."""

import subprocess

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import lines
from palimpsest.sources import git, vectors
from palimpsest.streaming import update

FIRST = {"src/a.py": "def f(x):\n    return x\n", "src/ü b.js": "function g() { return 1; }\n", "notes.txt": "no code\n", "node_modules/x.js": "1\n", "bin.c": "a\0b", "empty.go": ""}


@pytest.fixture
def repo(tmp_path):
    at = tmp_path / "repo"

    def run(*words):
        return subprocess.run(["git", "-C", at, "-c", "user.name=n", "-c", "user.email=e@example.org", *words], check=True, capture_output=True).stdout.decode().strip()

    def commit(files):
        for path, text in files.items():
            (at / path).parent.mkdir(parents=True, exist_ok=True)
            (at / path).write_bytes(text if isinstance(text, bytes) else text.encode())
        run("add", "-A")
        run("commit", "-qm", "m")
        return run("rev-parse", "HEAD")

    at.mkdir()
    run("init", "-q")
    return str(at), commit(FIRST), commit({"src/a.py": "def f(x):\n    return x + 1\n", "src/latin.c": b"// \xe9 is not UTF-8, and this line is long enough\n"})


def test_scan_repository(spark, repo):
    at, one, two = repo
    files, skipped = git.scan_repository(spark, at, [one, two], "r")
    rows = {(r.commit, r.path): r for r in files.collect()}
    assert {p for c, p in rows if c == one} == {"src/a.py", "src/ü b.js", "empty.go"}
    assert {p for c, p in rows if c == two} == {"src/a.py", "src/ü b.js", "empty.go", "src/latin.c"}
    assert rows[one, "src/a.py"].last_modified_status == "A" and rows[two, "src/a.py"].last_modified_status == "M"
    assert rows[two, "src/ü b.js"].last_modified_status is None and rows[two, "src/latin.c"].text.startswith("// � is")
    assert rows[one, "src/a.py"].text == FIRST["src/a.py"] and rows[one, "empty.go"].text == ""
    want = {(c, "excluded"): 1 for c in (one, two)} | {(c, "unsupported_extension"): 1 for c in (one, two)} | {(c, "binary"): 1 for c in (one, two)}
    assert {(r.commit, r.reason): r.n for r in skipped.collect()} == want


def test_refs(repo):
    at, one, two = repo
    assert git.resolve(at, "HEAD~1") == one and git.is_ancestor(at, one, two) and not git.is_ancestor(at, two, one)
    with pytest.raises(ValueError):
        git.resolve(at, "nowhere")


def test_line_diff(spark):
    contents = spark.createDataFrame([("a", "x\ny\n"), ("b", "x\nz\nw\n"), ("e", "")], "content_id string, text string")
    changes = spark.createDataFrame([("k1", "a", "b"), ("k2", "a", "a"), ("k3", None, "b"), ("k4", "a", None), ("k5", None, None), ("k6", "a", "b"), ("k7", "e", "gone")], "key string, old string, new string")
    got = {r.key: (r.lines_added, r.lines_removed) for r in lines.line_diff(changes, contents).collect()}
    assert got == {"k1": (2, 1), "k2": (0, 0), "k3": (3, 0), "k4": (0, 2), "k5": (0, 0), "k6": (2, 1), "k7": (0, 0)}


def test_parse_response():
    for body in ("[1, 2]", '{"embedding": [1, 2]}', '{"data": [{"embedding": [1, 2]}]}', '{"value": [[1, 2]]}', '[{"embedding": [[1, 2]]}]'):
        assert vectors.parse_response(body) == [[1.0, 2.0]]
    for body in ("{}", "[]", '[{"embedding": "x"}]'):
        with pytest.raises(ValueError):
            vectors.parse_response(body)


def test_embed_missing_resumes(spark, tmp_path):
    path, log = str(tmp_path / "v"), tmp_path / "log"
    log.write_text("")

    def encode(texts):
        with log.open("a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return [[len(t), 1.0] for t in texts]

    some = spark.createDataFrame([("a", "aa"), ("b", "b"), ("a", "aa")], "content_id string, text string")
    assert vectors.embed_missing(some, encode, path, {"m": 1}, 2).count() == 2
    more = some.union(spark.createDataFrame([("c", "ccc")], some.schema))
    got = {r.content_id: r.vec for r in vectors.embed_missing(more, encode, path, {"m": 1}, 2).collect()}
    assert sorted(log.read_text().split()) == ["aa", "b", "ccc"]
    assert got["c"] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])
    assert vectors.read_vectors(spark, path, vectors.fingerprint({"m": 2})).count() == 0
    with pytest.raises(Exception, match="not 3 finite"):
        vectors.write_vectors(spark.createDataFrame([("z", [1.0, 2.0])], "content_id string, vec array<double>"), path, "x", 3)


def test_streaming_update_equals_batches(spark, tmp_path):
    land, root = str(tmp_path / "land"), str(tmp_path / "index")
    texts = {"c1": "def f():\n    return 1\n", "c2": "def f():\n    return 1\n\n\ndef g():\n    return 2\n"}
    want = set()
    for commit, text in texts.items():
        files = spark.createDataFrame([("r", commit, "a.py", "python", text)], update.FILES)
        files.write.mode("append").parquet(land)
        update.update_index(spark.readStream.schema(update.FILES).parquet(land), root, str(tmp_path / "cp")).awaitTermination()
        want |= {r.version_id for r in update.identified(files, "r", commit).collect()}
    assert {r.version_id for r in update.chunks(spark, root).collect()} == want
    held = update.contents(spark, root)
    assert held.count() == held.select("content_id").distinct().count() == update.chunks(spark, root).select("content_id").distinct().count()
    before = sorted(held.collect())
    last = spark.createDataFrame([("r", "c2", "a.py", "python", texts["c2"])], update.FILES)
    update.apply_batch(last, 1, root)
    assert sorted(update.contents(spark, root).collect()) == before
    assert update.contents(spark, root).filter(F.col("batch") == 1).count() >= 1
