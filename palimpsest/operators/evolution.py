"""Content through commits: chains of states, transitions, lineage, search across versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def states(occurrences: DataFrame, commits: DataFrame) -> DataFrame:
    """occurrences (key, ord, content) on the grid of all keys and commits (ord); absent where content is null."""
    grid = occurrences.select("key").distinct().crossJoin(F.broadcast(commits.select("ord")))
    return grid.join(occurrences, ["key", "ord"], "left")


def transitions(occurrences: DataFrame, commits: DataFrame) -> DataFrame:
    """(key, ord, old, new, transition): one row a change or continuation, a single deleted row a gap.

    occurrences (key, ord, content) have one row a key and commit, commits (ord) number the versions. A key that is
    back after a gap is reintroduced if this very content was there before, else added. Only what is there is sorted:
    a key's rows meet their neighbours, and a gap is a step of more than one commit; no grid of keys and commits.
    """
    place = commits.select("ord", (F.row_number().over(Window.orderBy("ord")) - 1).alias("_at"))
    last = F.coalesce(F.max("_at"), F.lit(-1)).alias("_last")
    here = occurrences.filter("content is not null").join(place, "ord").crossJoin(F.broadcast(place.agg(last)))
    w = Window.partitionBy("key").orderBy("_at")
    same = Window.partitionBy("key", "content").orderBy("_at")
    rows = here.withColumn("_seen", F.row_number().over(same) > 1).withColumn("_before", F.lag("_at").over(w)).withColumn("_old", F.lag("content").over(w)).withColumn("_after", F.lead("_at").over(w))
    joins = F.col("_before") == F.col("_at") - 1
    old = F.when(joins, F.col("_old"))
    kind = F.when(old.isNull() & F.col("_seen"), "reintroduced").when(old.isNull(), "added").when(old == F.col("content"), "unchanged").otherwise("modified")
    stays = F.struct(F.col("_at").alias("at"), old.alias("old"), F.col("content").alias("new"), kind.alias("transition"))
    goes = F.struct((F.col("_at") + 1).alias("at"), F.col("content").alias("old"), F.lit(None).cast(occurrences.schema["content"].dataType).alias("new"), F.lit("deleted").alias("transition"))
    leaves = (F.col("_at") < F.col("_last")) & (F.col("_after").isNull() | (F.col("_after") > F.col("_at") + 1))
    out = rows.select("key", F.explode(F.when(leaves, F.array(stays, goes)).otherwise(F.array(stays))).alias("t"))
    # Commits are few beside occurrences; Spark broadcasts their numbers by size.
    return out.join(place, F.col("t.at") == F.col("_at")).select("key", "ord", "t.old", "t.new", "t.transition")


def interesting(changes: DataFrame, limit: int = 5) -> DataFrame:
    n = lambda x: F.count_if(F.col("transition") == x)
    score = 4 * n("modified") + 3 * n("deleted") + 3 * n("reintroduced") + n("added")
    return changes.groupBy("key").agg(score.cast("long").alias("score")).filter("score > 1").orderBy(F.desc("score"), "key").limit(limit)


def best_states(hits: DataFrame, k: int, *tie: Column) -> DataFrame:
    """hits (content, score, ord, ...) to the best hit of each content, the earliest of equals; the best k contents."""
    w = Window.partitionBy("content").orderBy(F.desc("score"), *tie)
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").orderBy(F.desc("score"), "content").limit(k)


def context(wanted: DataFrame, occurrences: DataFrame, changes: DataFrame, lo: int, hi: int) -> DataFrame:
    """wanted (content, key) with what happened to each content from commit lo to commit hi.

    The chain is that of key, or the first one that holds the content where key has none. changes are transitions
    with lines_added and lines_removed, commits are numbered without gaps. first_ord, last_ord and ords are where the
    content stands in the chain; predecessor and introduced_by tell the first change to it, successor and removed_by
    the first one away from it. What does not occur is null; ords is then empty and line counts are zero.
    """
    chains = occurrences.select("key").distinct().withColumn("_known", F.lit(True))
    least = occurrences.groupBy("content").agg(F.min("key").alias("_least"))
    asked = wanted.select("content", "key").distinct().join(chains, "key", "left").join(least, "content", "left")
    asked = asked.select("content", "key", F.when(F.col("_known"), F.col("key")).otherwise(F.col("_least")).alias("chain"))
    at = ["chain", "content"]
    there = occurrences.filter(F.col("ord").between(lo, hi)).select(F.col("key").alias("chain"), "content", "ord")
    seen = there.groupBy(at).agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.sort_array(F.collect_list("ord")).alias("ords"))
    moves = changes.filter(~F.col("old").eqNullSafe(F.col("new"))).withColumnRenamed("key", "chain")
    into = F.struct("ord", "old", "transition", "lines_added", "lines_removed")
    came = moves.filter(F.col("ord").between(lo, hi) & F.col("new").isNotNull()).groupBy("chain", F.col("new").alias("content")).agg(F.min_by(into, "ord").alias("came"))
    left = moves.filter((F.col("ord") - 1).between(lo, hi) & F.col("old").isNotNull()).groupBy("chain", F.col("old").alias("content")).agg(F.min_by(F.struct("new", "transition"), "ord").alias("went"))
    out = asked.join(seen, at, "left").join(came, at, "left").join(left, at, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "content",
        "key",
        "chain",
        "first_ord",
        "last_ord",
        F.coalesce("ords", F.array().cast("array<long>")).alias("ords"),
        F.col("came.old").alias("predecessor"),
        F.col("went.new").alias("successor"),
        F.col("came.transition").alias("introduced_by"),
        F.col("went.transition").alias("removed_by"),
        F.coalesce("came.lines_added", zero).alias("lines_added"),
        F.coalesce("came.lines_removed", zero).alias("lines_removed"),
    )
