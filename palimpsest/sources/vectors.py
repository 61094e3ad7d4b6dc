"""Embedding vectors: their store, and the encoder calls that fill it."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list]
SCHEMA = "content_id string, vec array<float>, fingerprint string"
#: Texts of one request to an encoder.
BATCH = 8


def fingerprint(config: dict) -> str:
    """Identity of a model and its settings."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def checked(vec: Column, dim: int) -> Column:
    """vec, or an error in the job where it has other than dim components or one that is not finite."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vec.isNull() | (F.size(vec) != dim) | odd, F.raise_error(F.lit(f"a vector is not {dim} finite numbers"))).otherwise(vec)


def write_vectors(vectors: DataFrame, path: str, mark: str, dim: int) -> None:
    """Appends (content_id, vec) as Parquet in a folder of the model's fingerprint."""
    vectors.select("content_id", checked(F.col("vec").cast("array<float>"), dim).alias("vec"), F.lit(mark).alias("fingerprint")).write.mode("append").partitionBy("fingerprint").parquet(path)


def read_vectors(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(content_id, vec) of one fingerprint; none where nothing has been written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA).select("content_id", "vec")
    return spark.read.schema(SCHEMA).parquet(path).filter(F.col("fingerprint") == mark).select("content_id", "vec")


def parse_response(body: str) -> list[list[float]]:
    """Vectors in a reply: a list, or one under embedding, data or value; a list of one vector is that vector."""

    def vector(x):
        while isinstance(x, dict):
            x = next((x[k] for k in ("embedding", "data", "value") if k in x), None)
        while isinstance(x, list) and len(x) == 1 and isinstance(x[0], list):
            x = x[0]
        if not isinstance(x, list) or not all(isinstance(v, (int, float)) for v in x):
            raise ValueError("a reply holds something other than vectors")
        return [float(v) for v in x]

    found = json.loads(body)
    while isinstance(found, dict):
        found = next((found[k] for k in ("data", "value", "embedding") if k in found), None)
    if not isinstance(found, list) or not found:
        raise ValueError("a reply holds no vectors")
    return [vector(found)] if isinstance(found[0], (int, float)) else [vector(x) for x in found]


def http_encoder(url: str, timeout: float = 120.0) -> Encoder:
    """An encoder that posts texts as JSON to a server and reads its reply."""

    def encode(texts: list[str]) -> list:
        ask = urllib.request.Request(url, json.dumps({"content": texts}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(ask, timeout=timeout) as reply:
            return parse_response(reply.read().decode())

    return encode


def embed(contents: DataFrame, encode: Encoder, batch: int = BATCH) -> DataFrame:
    """(content_id, vec): vectors of unit length for each row of contents (content_id, text), batch texts a request."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                got = np.asarray(encode(part["text"].fillna("").tolist()), np.float64)
                if got.ndim != 2 or len(got) != len(part) or not np.isfinite(got).all():
                    raise ValueError("an encoder must give one finite vector a text")
                got /= np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"content_id": part["content_id"].to_numpy(), "vec": list(got.astype(np.float32))})

    return contents.select("content_id", "text").mapInPandas(run, "content_id string, vec array<float>")


def embed_missing(contents: DataFrame, encode: Encoder, path: str, config: dict, dim: int) -> DataFrame:
    """All vectors of contents after encoding those that the store lacks.

    Each content is encoded once, however often it occurs. A run that broke off resumes from what it wrote, since
    written keys are left out; a task's rows appear only with its job.
    """
    spark, mark = contents.sparkSession, fingerprint(config)
    known = read_vectors(spark, path, mark)
    missing = contents.dropDuplicates(["content_id"]).join(known.select("content_id"), "content_id", "left_anti")
    write_vectors(embed(missing, encode), path, mark, dim)
    return read_vectors(spark, path, mark).join(contents.select("content_id").distinct(), "content_id", "left_semi")


def compatible(entries: DataFrame, config: dict, dim: int) -> DataFrame:
    """entries (content_id, fingerprint, vec) with usable: of this model and its settings, of dim finite numbers."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = (F.col("fingerprint") == fingerprint(config)) & (F.size("vec") == dim) & fine
    return entries.withColumn("usable", F.coalesce(ok, F.lit(False)))


def probe(spark: SparkSession, path: str, content_ids: list[str], other: dict) -> bool:
    """Whether the store would give vectors of another model or settings for these contents; it must not."""
    return not read_vectors(spark, path, fingerprint(other)).filter(F.col("content_id").isin(content_ids)).isEmpty()
