"""Differences between two versions as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(n: Column, whole: Column) -> Column:
    return F.coalesce(n * 100.0 / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _lines(df: DataFrame, lines: list[Column]) -> DataFrame:
    return df.select(F.array_join(F.array(*lines), "\n").alias("report"))


def _count(*kinds: str) -> Column:
    return F.count_if(F.col("status").isin(*kinds))


def file_report(changes: DataFrame, old: str, new: str) -> DataFrame:
    """(report): file_diff() in words; shares are of all paths of either version."""
    n = changes.agg(
        F.count("*").alias("all"), _count("unchanged").alias("u"), _count("modified").alias("m"), _count("added").alias("a"), _count("deleted").alias("d")
    )
    kinds = (("Unchanged", "u"), ("Modified", "m"), ("Added", "a"), ("Deleted", "d"))
    heads = [F.format_string(f"Old commit: {old} (%d files)", F.col("all") - F.col("a")), F.format_string(f"New commit: {new} (%d files)", F.col("all") - F.col("d"))]
    return _lines(n, heads + [F.format_string(f"{name}: %d (%.2f%%)", F.col(c), _share(F.col(c), F.col("all"))) for name, c in kinds])


def chunk_report(changes: DataFrame, old_chunks: int, old: str, new: str) -> DataFrame:
    """(report): chunk_diff() in words; the share of reused chunks is of the new version's."""
    n = changes.agg(_count("reused").alias("r"), _count("modified_replaced").alias("m"), _count("new").alias("n"), _count("deleted").alias("d"))
    here = F.col("r") + F.col("m") + F.col("n")
    number = lambda text, x: F.format_string(f"{text}: %d", x)
    return _lines(n, [
        F.lit(f"Old commit: {old} ({old_chunks} chunks)"),
        F.format_string(f"New commit: {new} (%d chunks)", here),
        F.format_string("Reused chunks: %d (%.2f%% of new chunks)", F.col("r"), _share(F.col("r"), here)),
        number("Modified/replaced chunks", F.col("m")),
        number("New chunks", F.col("n")),
        number("New chunks requiring future embeddings", F.col("m") + F.col("n")),
        number("Deleted chunks", F.col("d")),
    ])
