"""Lines added and removed between two texts."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_counts(old: str | None, new: str | None) -> tuple[int, int]:
    """(added, removed) lines as a line differ marks them; null is empty."""
    marks = [x[:2] for x in difflib.ndiff((old or "").splitlines(), (new or "").splitlines())]
    return marks.count("+ "), marks.count("- ")


def line_diff(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """changes (old, new, ...) with lines_added and lines_removed; contents (content_id, text) holds the texts.

    Only distinct pairs that differ are compared. Without an old content all lines of the new one are added, the
    other way round removed; equal contents give zeros, unknown ones are empty.
    """
    pairs = changes.select("old", "new").distinct().filter(~F.col("old").eqNullSafe(F.col("new")))
    side = lambda x: contents.dropDuplicates(["content_id"]).select(F.col("content_id").alias(x), F.col("text").alias(f"{x}_text"))
    texts = pairs.join(side("old"), "old", "left").join(side("new"), "new", "left").select("old", "new", "old_text", "new_text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [line_counts(a, b) for a, b in zip(f["old_text"], f["new_text"], strict=True)]
            yield pd.DataFrame({"o": f["old"], "n": f["new"], "a": [x for x, _ in got], "r": [x for _, x in got]})

    counts = texts.mapInPandas(run, "o string, n string, a long, r long")
    there = changes.join(counts, F.col("old").eqNullSafe(F.col("o")) & F.col("new").eqNullSafe(F.col("n")), "left")
    zero = F.lit(0).cast("long")
    return there.select(*changes.columns, F.coalesce("a", zero).alias("lines_added"), F.coalesce("r", zero).alias("lines_removed"))
