"""Tables in folders: partitioned Parquet, JSON headers and logs, CSV reports, all through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path with this schema; an empty one where nothing has been written."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_log(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> None:
    """Appends a few rows as JSON lines, one file a call, so that writers never share a file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with its header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def file_header(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """(commit, files, bytes, languages, skipped) of each commit: what was listed, and why the rest was not."""
    by = files.groupBy("commit", "language").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n"))))
    listed = by.groupBy("commit").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), pairs.alias("languages"))
    why = skipped.groupBy("commit").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("skipped"))
    none = F.create_map().cast("map<string,long>")
    zero = F.lit(0).cast("long")
    both = listed.join(why, "commit", "full_outer")
    return both.select("commit", F.coalesce("files", zero).alias("files"), F.coalesce("bytes", zero).alias("bytes"), F.coalesce("languages", none).alias("languages"), F.coalesce("skipped", none).alias("skipped"))


def chunk_header(chunks: DataFrame) -> DataFrame:
    """(commit, chunks, by_language, by_type, mean_chars, median_chars) of each commit."""
    size = F.length("text")
    sets = chunks.withColumn("n", size).groupingSets([["commit"], ["commit", "language"], ["commit", "chunk_type"]], "commit", "language", "chunk_type").agg(
        F.count("*").alias("c"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.grouping("language").alias("gl"), F.grouping("chunk_type").alias("gt")
    )
    part = lambda key, on: F.map_from_entries(F.sort_array(F.collect_list(F.when(on, F.struct(key, "c")))))
    whole = (F.col("gl") == 1) & (F.col("gt") == 1)
    return sets.groupBy("commit").agg(
        F.max(F.when(whole, F.col("c"))).alias("chunks"),
        part("language", (F.col("gl") == 0)).alias("by_language"),
        part("chunk_type", (F.col("gt") == 0)).alias("by_type"),
        F.max(F.when(whole, F.col("mean"))).alias("mean_chars"),
        F.max(F.when(whole, F.col("median"))).alias("median_chars"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Files by path; chunks by path, first line and version_id: the order in which lists of them are written."""
    return rows.orderBy(*[c for c in ("commit", "path", "start_line", "version_id") if c in rows.columns])


def path_part(name: str) -> str:
    """A name as one part of a path: separators and colons become underscores, all else stays."""
    return name.translate(str.maketrans("\\/:", "___"))
