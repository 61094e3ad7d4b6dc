"""Exact deduplication by 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.storage import checked_join, join_groups, numbered, stage

BLANKS = " \t\n\x0b\x0c\r"


def normal(text: Column) -> Column:
    """The text without its ASCII white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _classes(base: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """base (doc_id, t, and id_ if another column) to its light rows and one row a class of equal texts.

    Rows carry class, sha (SHA-256) and id_; classes have class, group_size, keep_id, and keep, the id_ that stays.
    """
    cols = list(dict.fromkeys((id_, "doc_id")))
    base = base.withColumn("norm", normal(F.col("t")))
    n, h = F.char_length("t").cast("long").alias("n"), F.unhex(F.md5("norm")).alias("h")
    light = stage(base.select(*cols, n, h, F.unhex(F.sha2("norm", 256)).alias("sha")), "hashes")
    size = F.count("*").alias("group_size")
    best = F.max_by(F.struct(F.col("doc_id").alias("keep_id"), F.col(id_).alias("keep")), F.struct("n", (-F.col("doc_id")).alias("k"), (-F.col(id_)).alias("i"))).alias("best")
    groups = light.groupBy("h").agg(size, best)
    several = groups.filter("group_size > 1").select("h")
    same = checked_join(base.select(*cols, n, h, "norm"), several, "h", "left_semi", 64)
    exact = same.groupBy("h", "norm").agg(size, best).select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", "best")
    singles = groups.filter("group_size = 1").join(light.select("h", "sha").distinct(), "h").select("h", "sha", "group_size", "best")
    named = exact.union(singles).select(F.concat("h", "sha").alias("class"), "group_size", "best.keep_id", "best.keep")
    return light.select(*cols, "sha", F.concat("h", "sha").alias("class")), named


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs (doc_id, text).

    Rows whose texts are equal without white space form a group under the MD5 of that text. Inside every group of
    two or more, the bytes themselves are grouped (identical copies collapse before the shuffle), so rows that
    collide without being equal get groups of their own. The row with the longest original text stays, of these
    the smallest doc_id. Null and empty texts are one group; repeated rows share a doc_id and so a fate; a null
    doc_id loses every tie and is kept only alone. An empty table gives an empty one.
    """
    rows, named = _classes(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id")
    out = join_groups(rows, named.drop("keep"), "class", "group_size", F.col("doc_id"), max(rows.count(), 1))
    kept = F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_exact(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, with its columns.

    Rows are told apart by a number of their own, so repeated rows, null ids and ids that several texts share are
    rows like others: exactly one row of a group stays, the longest, of these the smallest doc_id, nulls last.
    """
    rows = numbered(docs, "numbered")
    light, named = _classes(rows.select("_uid", "_row.doc_id", F.coalesce("_row.text", F.lit("")).alias("t")), "_uid")
    several = named.filter("group_size > 1").drop("keep_id")
    gone = join_groups(light, several, "class", "group_size", F.col("_uid"), max(light.count(), 1)).filter("keep <> _uid").select("_uid")
    return checked_join(rows, stage(gone, "gone"), "_uid", "left_anti", 16).select("_row.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
