"""Differences between two versions: files, chunks, index entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, sha256) of both versions to (path, status); a full outer join on the path."""
    both = old.select("path", F.col("sha256").alias("a")).join(new.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def last_of_key(chunks: DataFrame) -> DataFrame:
    """One chunk an occurrence key: the one with the largest version_id."""
    w = Window.partitionBy("occurrence_key").orderBy(F.desc("version_id"))
    return chunks.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status of each new chunk (reused, modified_replaced, new) and of old ones that are deleted.

    Content decides before place: a new chunk whose content exists is reused wherever it stood. An old chunk whose
    place survives with content that existed elsewhere is in no bucket.
    """
    contents = old.select("content_id").distinct().withColumn("_c", F.lit(1))
    places = old.select("occurrence_key").distinct().withColumn("_k", F.lit(1))
    status = F.when(F.col("_c").isNotNull(), "reused").when(F.col("_k").isNotNull(), "modified_replaced").otherwise("new")
    now = new.join(contents, "content_id", "left").join(places, "occurrence_key", "left").select("version_id", "occurrence_key", status.alias("status"))
    gone = old.join(new.select("content_id"), "content_id", "left_anti").join(new.select("occurrence_key"), "occurrence_key", "left_anti")
    return now.unionByName(gone.select("version_id", "occurrence_key", F.lit("deleted").alias("status")))


def index_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(occurrence_key, status) of an index update; last entry of a key wins on both sides."""
    a = last_of_key(old).select("occurrence_key", F.col("content_id").alias("a"))
    b = last_of_key(new).select("occurrence_key", F.col("content_id").alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("modified")
    return a.join(b, "occurrence_key", "full_outer").select("occurrence_key", status.alias("status"))


def index_update(old: DataFrame, new: DataFrame, indexed: DataFrame) -> DataFrame:
    """Counts of an index update from occurrences old to new, over contents that were indexed before it.

    A modified place counts as added and as removed. Vectors are counted by distinct content.
    """
    places = index_diff(old, new)
    n = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    moved = places.agg(
        n("unchanged").alias("unchanged_occurrences"), n("modified").alias("modified_replaced_occurrences"),
        n("added", "modified").alias("added_occurrences"), n("removed", "modified").alias("removed_occurrences"),
    )
    side = lambda df, name: df.select("content_id").distinct().withColumn(name, F.lit(1))
    every = side(old, "_o").join(side(new, "_n"), "content_id", "full_outer").join(side(indexed, "_i"), "content_id", "left")
    has = lambda name: F.col(name).isNotNull()
    vectors = every.agg(
        F.count_if(has("_n") & has("_i")).alias("reused_vectors"),
        F.count_if(has("_n") & ~has("_i")).alias("vectors_newly_inserted"),
        F.count_if(has("_o") & ~has("_n")).alias("vectors_tombstoned"),
        F.count("_n").alias("active_vectors_after_update"),
    )
    return moved.crossJoin(vectors)


def reuse_report(cached: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits and misses count occurrences, generated counts distinct contents."""
    hit = chunks.join(cached.select("content_id").distinct().withColumn("_h", F.lit(1)), "content_id", "left")
    agg = hit.agg(
        F.count("*").alias("total"),
        F.count("_h").alias("hits"),
        F.count_if(F.col("_h").isNull()).alias("misses"),
        F.countDistinct(F.when(F.col("_h").isNull(), F.col("content_id"))).alias("generated"),
    )
    return agg.select(
        "*",
        F.greatest(F.lit(0).cast("long"), F.col("misses") - F.col("generated")).alias("duplicate_avoided"),
        F.round(F.coalesce(F.col("hits") * 100.0 / F.nullif("total", F.lit(0)), F.lit(0.0)), 6).alias("reuse_percentage"),
        F.round(F.coalesce(1 - F.col("generated") / F.nullif("total", F.lit(0)), F.lit(0.0)), 6).alias("work_reduction"),
    )
