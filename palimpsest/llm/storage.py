"""Shared working storage, checked broadcasts and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after counting it: rows times bytes a row must stay below this.
BROADCAST_BYTES = 48 << 20
#: Keys holding more than 1/HOT_SHARE of all rows are hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 2000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is named and all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, root[7:], True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cut lineage that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*staged: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in staged:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(_uid, _row): the rows of docs, each under a number of its own that is written with it and so never changes."""
    return stage(docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct("*").alias("_row")), name)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, counted, is certain to fit a broadcast; counting stops just above the bound."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def checked_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str, row_bytes: int) -> DataFrame:
    """Broadcasts right when its counted size is within the bound and shuffles both sides beyond it."""
    return left.join(F.broadcast(right) if small(right, row_bytes) else right, on, how)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, total: int) -> DataFrame:
    """Left join of rows to one row a key, dealing hot keys evenly.

    groups: one row for each key, with its number of rows in column size. Keys above total/HOT_SHARE are fewer
    than HOT_SHARE, so they are broadcast; their rows travel under a spread key that matches nothing, and all
    other keys are shuffled. Null keys match nothing.
    """
    cols = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > total / HOT_SHARE).select(F.col(key).alias("_hk"), F.struct(*cols).alias("_hot"))
    cold = groups.filter(F.col(size) <= total / HOT_SHARE).select(F.col(key).alias("_ck"), F.lit(0).alias("_cs"), F.struct(*cols).alias("_cold"))
    there = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    there = there.withColumn("_s", F.when(F.col("_hk").isNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int")))
    both = there.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_s") == F.col("_cs")), "left")
    out = both.withColumn("_g", F.coalesce("_hot", "_cold"))
    return out.select(*rows.columns, *[F.col("_g")[c].alias(c) for c in cols])
