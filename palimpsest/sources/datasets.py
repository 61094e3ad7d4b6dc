"""Retrieval datasets, rankings and query sets from files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """A table by its ending: Parquet, CSV with a header, or JSON, one value a line or one list a file."""
    if path.endswith((".parquet", "/")):
        return spark.read.parquet(path)
    if path.endswith((".csv", ".tsv")):
        return spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",")
    return spark.read.option("multiLine", path.endswith(".json")).json(path)


def _column(df: DataFrame, kind: str, *names: str):
    found = next((n for n in names if n in df.columns), None)
    return (F.col(found) if found else F.lit(None)).cast(kind)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text); ids are texts whatever the file says, a missing title is null."""
    df = _rows(spark, path)
    return df.select(_column(df, "string", "doc_id", "_id", "id").alias("doc_id"), _column(df, "string", "title").alias("title"), _column(df, "string", "text").alias("text"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text)."""
    df = _rows(spark, path)
    return df.select(_column(df, "string", "query_id", "_id", "id").alias("query_id"), _column(df, "string", "text", "query").alias("text"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, label)."""
    df = _rows(spark, path)
    return df.select(
        _column(df, "string", "query_id", "query-id").alias("query_id"), _column(df, "string", "doc_id", "corpus-id").alias("doc_id"), _column(df, "int", "label", "score").alias("label")
    )


def rankings(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """((query_id, doc_id, score), metadata) of a JSON file that maps queries to documents to scores under "rankings".

    The file is read and parsed by tasks; ids become texts and scores doubles.
    """
    raw = spark.read.option("wholetext", "true").text(path)
    nested = F.from_json(F.get_json_object("value", "$.rankings"), "map<string,map<string,double>>")
    per = raw.select(F.explode(nested).alias("query_id", "docs"))
    said = raw.select(F.get_json_object("value", "$.metadata")).first()
    return per.select("query_id", F.explode("docs").alias("doc_id", "score")), json.loads(said[0]) if said and said[0] else {}


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON file that must hold a list; other files are an error."""
    head = spark.read.option("wholetext", "true").text(path).select(F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1)).first()
    if not head or head[0] != "[":
        raise ValueError(f"{path} must hold a JSON list")
    return spark.read.option("multiLine", "true").json(path)
