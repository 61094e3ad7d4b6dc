"""What encoders need around a model: prompts cut to length, pooled states, batches in one shape, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import DOCUMENT_PROMPT, QUERY_PROMPT
from palimpsest.sources import vectors


class Cutter:
    """Texts cut to a number of tokens by a tokenizer file, given by path; it is sent to tasks and loaded there."""

    def __init__(self, path: str, most: int):
        self.path, self.most, self._own = path, most, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_own": None}

    @property
    def tokenizer(self):
        if self._own is None:
            from tokenizers import Tokenizer

            self._own = Tokenizer.from_file(self.path)
        return self._own

    def lengths(self, texts: Sequence[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch(list(texts))]

    def __call__(self, texts: Sequence[str]) -> list[str]:
        found = self.tokenizer.encode_batch(list(texts))
        return [self.tokenizer.decode(x.ids[: self.most], skip_special_tokens=True) for x in found]


def cut_by_words(most: int) -> Callable[[Sequence[str]], list[str]]:
    """A cutter that takes words for tokens, where there is no tokenizer."""
    return lambda texts: [" ".join(t.split()[:most]) if len(t.split()) > most else t for t in texts]


def prompts(rows: DataFrame, role: str, cut: Callable[[Sequence[str]], list[str]]) -> DataFrame:
    """rows (content_id, text) with the instruction of their role, query or document, before the text, cut to length."""
    start = {"query": QUERY_PROMPT, "document": DOCUMENT_PROMPT}[role]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut([start + (t or "") for t in batch.column(1).to_pylist()]), pa.string())], ["content_id", "text"])

    return rows.select(F.col("content_id").cast("string").alias("content_id"), "text").mapInArrow(run, "content_id string, text string")


def token_lengths(rows: DataFrame, cutter: Cutter, start: str = "") -> DataFrame:
    """One row (count, median, p75, p90, p95, max) of the lengths in tokens of rows (text) after an instruction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cutter.lengths([start + (t or "") for t in batch.column(0).to_pylist()]), pa.int64())], ["n"])

    p = lambda q, name: F.percentile("n", q).alias(name)
    return rows.select("text").mapInArrow(run, "n long").agg(F.count("*").alias("count"), p(0.5, "median"), p(0.75, "p75"), p(0.9, "p90"), p(0.95, "p95"), F.max("n").alias("max"))


def last_token_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The state (text, token, number) of each text's last token, where mask marks its tokens, padded on either side."""
    if not len(states):
        return states[:, 0]
    last = mask.shape[1] - 1 if mask[:, -1].all() else mask.sum(1) - 1
    return states[np.arange(len(states)), last]


def unit(x: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of unit length, or an error for other than dim finite numbers each."""
    if x.ndim != 2 or x.shape[1] != dim or not np.isfinite(x).all():
        raise ValueError(f"an encoder must give {dim} finite numbers a text")
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def role_of(kind: object) -> str:
    """query if a prompt's kind says so anywhere, else document."""
    return "query" if "query" in str(getattr(kind, "value", kind) or "").lower() else "document"


def as_list(value: object) -> list:
    """None as nothing, sequences and arrays as lists, any other value as a list of itself."""
    if value is None:
        return []
    if hasattr(value, "tolist"):
        value = value.tolist()
    return list(value) if isinstance(value, list | tuple) else [value]


def batch_of(batch: object, role: str) -> tuple[list[str], list[str]]:
    """(ids, texts) of a batch: a mapping with id and text, query for queries, or texts alone; missing ids count up."""
    if not isinstance(batch, Mapping):
        texts, ids = [str(x) for x in batch], []
    else:
        texts = [str(x) for x in as_list(batch["query"] if role == "query" and "query" in batch else batch.get("text"))]
        ids = [str(x) for x in as_list(batch.get("id"))]
    return ids or [str(i) for i in range(len(texts))], texts


class StoredEncoder:
    """An encoder of batches whose vectors are kept by content: what the store holds is never encoded again.

    Texts go through the role's prompt and cutter; the key of a vector is the hash of what is encoded, so a changed
    prompt or cut never finds an old vector. events tells, for each call, the role, texts and whether all were stored.
    """

    def __init__(self, spark, encode: vectors.Encoder, path: str, config: dict, dim: int, cut: Callable | None = None, only_stored: bool = False):
        self.spark, self.encode_texts, self.path, self.config, self.dim = spark, encode, path, config, dim
        self.cut, self.only_stored, self.events = cut or (lambda texts: list(texts)), only_stored, []

    def encode(self, batches, kind: object = None) -> DataFrame:
        """(id, place, vec) of all batches, place counting their texts."""
        role, rows = role_of(kind), []
        for batch in batches:
            rows += zip(*batch_of(batch, role), strict=True)
        table = self.spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(rows)], "id string, place long, text string")
        ready = prompts(table.select(F.col("place").alias("content_id"), "text"), role, self.cut)
        keyed = ready.select(F.col("content_id").cast("long").alias("place"), F.sha2("text", 256).alias("content_id"), "text")
        held = vectors.read_vectors(self.spark, self.path, vectors.fingerprint(self.config))
        lacking = keyed.join(held.select("content_id"), "content_id", "left_anti").limit(1).count()
        if lacking and self.only_stored:
            raise LookupError(f"the store lacks vectors of {role} texts")
        found = vectors.embed_missing(keyed.select("content_id", "text"), self.encode_texts, self.path, self.config, self.dim)
        self.events.append({"role": role, "count": len(rows), "stored": not lacking})
        return table.select("id", "place").join(keyed.select("place", "content_id"), "place").join(found, "content_id").select("id", "place", "vec").orderBy("place")
