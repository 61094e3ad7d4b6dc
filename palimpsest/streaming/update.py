"""An index that grows with a stream of files: chunks of each commit, each content stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions import text as X
from palimpsest.operators.chunking import chunk_files

FILES = "repo_id string, commit string, path string, language string, text string"
CHUNKS = "repo string, commit string, path string, language string, chunk_type string, symbol string, parent_symbol string, start_line int, end_line int, content_id string, version_id string, occurrence_key string, imports array<string>, calls array<struct<name:string,raw:string,line:int,column:int>>, referenced_identifiers array<string>"
CONTENTS = "content_id string, language string, text string"


def identified(files: DataFrame, repo: str, commit: str) -> DataFrame:
    """Chunks of one commit's files (path, language, text) with their normal text and identities."""
    rows = chunk_files(files).withColumn("text", X.normalize(F.col("text"))).filter("length(text) > 0").withColumn("content_id", X.content_id(F.col("language"), F.col("text")))
    who, when = F.lit(repo), F.lit(commit)
    version = X.version_id(who, when, F.col("path"), F.col("chunk_type"), F.col("symbol"), F.col("start_line"), F.col("end_line"), F.col("content_id"))
    key = X.occurrence_key(F.col("path"), F.col("chunk_type"), F.col("symbol"))
    return rows.select(who.alias("repo"), when.alias("commit"), *rows.columns, version.alias("version_id"), key.alias("occurrence_key"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches written below path; an empty table before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def chunks(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, f"{root}/chunks", CHUNKS)


def contents(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, f"{root}/contents", CONTENTS)


def apply_batch(files: DataFrame, batch: int, root: str) -> None:
    """Writes the chunks of a batch of files and the contents that no earlier batch holds.

    A batch owns the folder of its number and overwrites it, and only earlier batches count as known, so a batch
    that is run again after a failure leaves the same tables. The commits of a batch are few and looped over.
    """
    spark = files.sparkSession
    at = f"{root}/chunks/batch={batch}"
    names = files.select("repo_id", "commit").distinct().collect()
    found = [identified(files.filter((F.col("repo_id") == r.repo_id) & (F.col("commit") == r.commit)), r.repo_id, r.commit) for r in names]
    if not found:
        return
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every.write.mode("overwrite").parquet(at)
    own = spark.read.parquet(at)
    known = contents(spark, root).filter(F.col("batch") < batch).select("content_id")
    fresh = own.dropDuplicates(["content_id"]).join(known, "content_id", "left_anti").select("content_id", "language", "text")
    fresh.write.mode("overwrite").parquet(f"{root}/contents/batch={batch}")


def update_index(files: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Starts the update from a streaming DataFrame of files; it ends when all that is there has been taken in."""
    return files.writeStream.foreachBatch(lambda df, batch: apply_batch(df, batch, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
