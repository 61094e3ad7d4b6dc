"""Datasets, settings, encoders and reranking on small inputs, and measures on their edge cases."""

import json
import math

import numpy as np
import pytest

from palimpsest.functions import text as X
from palimpsest.operators import evaluation, rerank
from palimpsest.sources import config, datasets, encoders, tables, vectors

RANKED = "query_id string, doc_id string, score double"
JUDGED = "query_id string, doc_id string, label int"


def test_env_file(tmp_path):
    (tmp_path / ".env").write_text("# a\n\nA=1\n B = 'two' \nC=\"x=y\"\nnone\n=z\nD=\n")
    env = {"A": "kept"}
    assert config.load_env(tmp_path / ".env", env) == {"B": "two", "C": "x=y", "D": ""} and env["A"] == "kept"
    assert config.load_env(tmp_path / "no", env) == {}
    assert config.path_of("B", tmp_path, tmp_path, env) == tmp_path / "two" and config.path_of("D", tmp_path / "d", tmp_path, env) == tmp_path / "d"


def test_datasets(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": 1, "title": "t", "text": "x"}\n{"_id": "b", "text": null}\n')
    (tmp_path / "q.json").write_text('[{"id": "q1", "query": "what"}]')
    (tmp_path / "j.tsv").write_text("query-id\tcorpus-id\tscore\nq1\t1\t2\n")
    (tmp_path / "r.json").write_text(json.dumps({"metadata": {"k": 3}, "rankings": {"q1": {"1": 2, "b": 0.5}}}))
    (tmp_path / "o.json").write_text('{"a": 1}')
    at = lambda n: str(tmp_path / n)
    assert sorted(map(tuple, datasets.corpus(spark, at("c.jsonl")).collect())) == [("1", "t", "x"), ("b", None, None)]
    assert list(map(tuple, datasets.queries(spark, at("q.json")).collect())) == [("q1", "what")]
    assert list(map(tuple, datasets.judgements(spark, at("j.tsv")).collect())) == [("q1", "1", 2)]
    rows, said = datasets.rankings(spark, at("r.json"))
    assert sorted(map(tuple, rows.collect())) == [("q1", "1", 2.0), ("q1", "b", 0.5)] and said == {"k": 3}
    assert datasets.query_set(spark, at("q.json")).count() == 1
    with pytest.raises(ValueError):
        datasets.query_set(spark, at("o.json"))


def test_measures_of_edge_cases(spark):
    ranked = spark.createDataFrame([("a", "9", 1.0), ("a", "10", 1.0), ("a", "11", 0.5), ("b", "1", 0.1), ("x", "1", 1.0)], RANKED)
    judged = spark.createDataFrame([("a", "10", 2), ("a", "11", 1), ("b", "2", 1), ("c", "1", 0)], JUDGED)
    assert [r.doc_id for r in evaluation.ranked_items(ranked).filter("query_id = 'a'").orderBy("rank").collect()] == ["9", "10", "11"]
    got = evaluation.retrieval_measures(ranked, judged, (2,)).first()
    ndcg = (2 / math.log2(3)) / (2 + 1 / math.log2(3))
    assert (got.queries, got.ndcg, got.map, got.mrr, got.recall, got.precision, got.hit) == (3, round(ndcg / 3, 5), round(0.25 / 3, 5), round(0.5 / 3, 5), round(0.5 / 3, 5), round(0.5 / 3, 5), round(1 / 3, 5))
    assert {r.query_id: r.rank for r in evaluation.positive_ranks(ranked, judged, 10, unique=False).collect()} == {"a": 2, "b": None, "c": None}
    with pytest.raises(ValueError):
        evaluation.positive_ranks(ranked, judged, 10)
    with pytest.raises(ValueError, match="c"):
        evaluation.require_valid(ranked, judged)
    none = ranked.limit(0)
    assert evaluation.retrieval_measures(none, judged, (1,)).first().hit == 0 and evaluation.retrieval_measures(ranked, judged.limit(0)).count() == 0
    assert evaluation.ranking_problems(none, judged).count() == 3
    assert {r.check: r.passed for r in evaluation.submission_checks(evaluation.submission_problems(none, ranked.select("doc_id"), judged)).collect()} == {"no_duplicates": True, "known_documents": True, "finite_scores": True, "all_queries": False}


def test_metric_numbers():
    flat = evaluation.flat_numbers({"a": {"b": [1, True, {"ndcg-at_10": 0.5}]}, "c": "x", "mrr_at_10": 2})
    assert flat == {"a.b[0]": 1.0, "a.b[2].ndcg-at_10": 0.5, "mrr_at_10": 2.0}
    assert evaluation.pick(flat, ("ndcg_at_10",)) == ("a.b[2].ndcg-at_10", 0.5) and evaluation.pick(flat, ("no",)) is None
    told = evaluation.against_known(flat, {"M": ("mrr_at_10", 2.00005), "N": ("no", 1.0)})
    assert told["M"]["within"] and not told["N"]["within"] and told["N"]["difference"] is None


def test_reranking(spark):
    ranked = spark.createDataFrame([("q", str(i), 10.0 - i) for i in range(6)] + [("r", "1", 1.0)], RANKED)
    queries = spark.createDataFrame([("q", "ask"), ("r", None)], "query_id string, text string")
    corpus = spark.createDataFrame([(str(i), "x" * i) for i in range(6)], "doc_id string, text string")
    found = rerank.pairs(ranked, queries, corpus, 3)
    assert sorted(map(tuple, found.filter("query_id = 'q'").collect())) == [("q", str(i), i + 1, "ask", "x" * i) for i in range(3)]
    scored = rerank.score_pairs(found, lambda pairs: [len(d) % 2 for _, d in pairs], 2)
    got = rerank.with_new_heads(ranked, scored.filter("query_id = 'q'").select("query_id", "doc_id", "new_score"), 5, 3)
    rows = {(r.query_id, r.rank): (r.doc_id, r.score) for r in got.collect()}
    assert [rows["q", k][0] for k in range(1, 6)] == ["1", "2", "0", "3", "4"] and rows["q", 1][1] == 7.0 and rows["r", 1][0] == "1"
    with pytest.raises(Exception, match="no finite score"):
        none = spark.createDataFrame([], "doc_id string, dv array<float>")
        asked = spark.createDataFrame([("q", [1.0])], "query_id string, qv array<float>")
        rerank.selected_again(ranked, queries.limit(1), asked, none, 2).collect()


def test_encoder_parts(spark, tmp_path):
    states = np.arange(24.0).reshape(2, 4, 3)
    assert (encoders.last_token_pool(states, np.array([[1, 1, 0, 0], [1, 1, 1, 0]])) == states[[0, 1], [1, 2]]).all()
    assert (encoders.last_token_pool(states, np.array([[0, 1, 1, 1], [1, 1, 1, 1]])) == states[:, 3]).all()
    assert encoders.role_of("Query") == "query" and encoders.role_of(None) == "document"
    assert encoders.batch_of({"query": ["a", "b"], "text": ["c"]}, "query") == (["0", "1"], ["a", "b"])
    assert encoders.batch_of({"id": np.array([7]), "text": ("x",)}, "document") == (["7"], ["x"]) and encoders.batch_of(["t"], "document") == (["0"], ["t"])
    with pytest.raises(ValueError):
        encoders.unit(np.array([[np.nan, 1.0]]), 2)
    assert encoders.cut_by_words(2)(["a b c", "a  b"]) == ["a b", "a  b"]
    calls = str(tmp_path / "calls")

    def noted(texts, path=calls):
        with open(path, "a") as f:
            f.write("".join(json.dumps(t) + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    own = encoders.StoredEncoder(spark, noted, str(tmp_path / "store"), {"m": 1}, 2, encoders.cut_by_words(12))
    first = own.encode([{"id": ["a", "b"], "text": ["one", "one"]}, ["two words"]]).collect()
    assert [r.id for r in first] == ["a", "b", "0"] and first[0].vec == first[1].vec and own.events == [{"role": "document", "count": 3, "stored": False}]
    again = own.encode([["one"]], "document").collect()
    assert again[0].vec == first[0].vec and own.events[-1]["stored"]
    with open(calls) as f:
        assert sorted(map(json.loads, f)) == ["Candidate code snippet:\none", "Candidate code snippet:\ntwo words"]
    held = encoders.StoredEncoder(spark, noted, str(tmp_path / "store"), {"m": 1}, 2, only_stored=True)
    with pytest.raises(LookupError):
        held.encode([["never seen"]])
    assert not vectors.probe(spark, str(tmp_path / "store"), ["x"], {"m": 2})
    rows = spark.createDataFrame([("a", vectors.fingerprint({"m": 1}), [1.0, 2.0]), ("b", "z", [1.0, 2.0]), ("c", vectors.fingerprint({"m": 1}), [1.0]), ("d", None, None)], "content_id string, fingerprint string, vec array<float>")
    assert {r.content_id: r.usable for r in vectors.compatible(rows, {"m": 1}, 2).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_texts_and_storage(spark, tmp_path):
    row = spark.createDataFrame([(None, " a \n"), ("t", None)], "title string, text string")
    assert [tuple(r) for r in row.select(X.row_text(row.title, row.text), X.row_text(row.title, row.text, False), X.cache_key(row.text)).collect()] == [("a", "\n a \n", "a"), ("t", "t\n", None)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"x" * 7)
    (tmp_path / "d" / "b").write_bytes(b"x" * 5)
    assert evaluation.storage(spark, [str(tmp_path / "d")]).first().bytes == 12
    assert tables.path_part("a/b\\c:d") == "a_b_c_d"
    a = spark.createDataFrame([(1,), (1,)], "x int")
    assert evaluation.same_rows(a, a.limit(1)) and not evaluation.same_rows(a, a.limit(0))
