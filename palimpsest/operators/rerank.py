"""Reranking: the pairs a cross-encoder reads, its scores, and rankings with new heads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import dot
from palimpsest.operators.evaluation import ranked_items


class Scorer(Protocol):
    """A cross-encoder: scores of (query, document) texts. It is sent to tasks, so it loads its model on first use."""

    def __call__(self, pairs: Sequence[tuple[str, str]]) -> Sequence[float]: ...


class OnnxScorer:
    """A cross-encoder from a model file and a tokenizer file, both given by path; the first logit is the score."""

    def __init__(self, model: str, tokenizer: str, max_length: int = 512):
        self.model, self.tokenizer, self.max_length, self.session = model, tokenizer, max_length, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"session": None}

    def __call__(self, pairs: Sequence[tuple[str, str]]) -> list[float]:
        import numpy as np

        if self.session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            split = Tokenizer.from_file(self.tokenizer)
            split.enable_truncation(self.max_length)
            split.enable_padding()
            self.session = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"]), split
        run, split = self.session
        said = split.encode_batch(list(pairs))
        every = {"input_ids": [x.ids for x in said], "attention_mask": [x.attention_mask for x in said], "token_type_ids": [x.type_ids for x in said]}
        wanted = {x.name for x in run.get_inputs()}
        out = run.run(None, {k: np.array(v, np.int64) for k, v in every.items() if k in wanted})[0]
        return np.asarray(out, np.float32).reshape(len(pairs), -1)[:, 0].tolist()


def pairs(rankings: DataFrame, queries: DataFrame, corpus: DataFrame, depth: int = 20) -> DataFrame:
    """(query_id, doc_id, rank, query, document): texts of the first `depth` documents (doc_id, text) of each query."""
    top = ranked_items(rankings, depth).select("query_id", "doc_id", "rank")
    with_query = top.join(queries.select("query_id", F.coalesce("text", F.lit("")).alias("query")), "query_id")
    return with_query.join(corpus.select("doc_id", F.coalesce("text", F.lit("")).alias("document")), "doc_id").select("query_id", "doc_id", "rank", "query", "document")


def score_pairs(found: DataFrame, scorer: Scorer, batch: int = 4) -> DataFrame:
    """pairs() to (query_id, doc_id, rank, new_score), `batch` pairs a call, in the tasks that hold them."""
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, out = list(zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), strict=True)), []
            for lo in range(0, len(texts), batch):
                out += [float(x) for x in scorer(texts[lo : lo + batch])]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(out, pa.float64())], ["query_id", "doc_id", "rank", "new_score"])

    return found.mapInArrow(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, rank {kinds['rank']}, new_score double")


def with_new_heads(rankings: DataFrame, scored: DataFrame, top: int = 100, depth: int = 20, start: float | None = None) -> DataFrame:
    """(query_id, doc_id, rank, score): scored documents (query_id, doc_id, new_score) first, by score and larger doc_id as
    text, then all others in their order, `top` a query in all. Scores only tell the order: start - rank, top + depth
    being the default start. Queries without scored documents keep their order.
    """
    old = ranked_items(rankings, top).select("query_id", "doc_id", F.col("rank").alias("_old"))
    both = old.join(scored.select("query_id", "doc_id", "new_score"), ["query_id", "doc_id"], "left")
    order = [F.col("new_score").isNull(), F.desc("new_score"), F.when(F.col("new_score").isNull(), F.col("_old")), F.desc(F.col("doc_id").cast("string"))]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")
    return both.select("query_id", "doc_id", rank.alias("rank")).withColumn("score", F.lit(float(top + depth if start is None else start)) - F.col("rank"))


def selected_again(rankings: DataFrame, selected: DataFrame, queries: DataFrame, documents: DataFrame, depth: int = 5, top: int = 100) -> DataFrame:
    """Rankings in which the selected queries (query_id) have their first `depth` documents ordered by new vectors.

    queries (query_id, qv) and documents (doc_id, dv) are the vectors of a second encoder, needed for the selected
    queries and their first documents only. A vector that is missing or not finite is an error.
    """
    head = ranked_items(rankings, depth).join(selected.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "doc_id")
    score = head.join(queries, "query_id", "left").join(documents, "doc_id", "left").select("query_id", "doc_id", F.round(dot(F.col("qv"), F.col("dv")), 6).alias("new_score"))
    fine = F.col("new_score").isNotNull() & ~F.isnan("new_score") & (F.abs("new_score") < float("inf"))
    checked = F.when(fine, F.col("new_score")).otherwise(F.raise_error(F.concat(F.lit("no finite score for query "), F.col("query_id").cast("string"))))
    return with_new_heads(rankings, score.select("query_id", "doc_id", checked.alias("new_score")), top, depth, 1001.0)
