"""Checks and measures of rankings, results, runs and submissions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rankings (query_id, doc_id, score) and judgements (query_id, doc_id, label)


def ranked_items(rankings: DataFrame, limit: int | None = None) -> DataFrame:
    """rankings with rank: by score, then by the larger doc_id as text; the first `limit` of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.col("doc_id").cast("string")))
    out = rankings.withColumn("rank", F.row_number().over(w).cast("long"))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def ranking_problems(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, problem, n) of what keeps rankings from being judged: missing, empty (no document), non_finite scores."""
    asked = qrels.select("query_id").distinct()
    score = F.col("score").cast("double")
    bad = F.col("doc_id").isNotNull() & (score.isNull() | F.isnan(score) | (F.abs(score) == F.lit(math.inf)))
    seen = rankings.groupBy("query_id").agg(F.count("doc_id").alias("docs"), F.count_if(bad).alias("bad"))
    both = asked.join(seen, "query_id", "left")
    problem = F.when(F.col("docs").isNull(), "missing").when(F.col("docs") == 0, "empty").when(F.col("bad") > 0, "non_finite")
    return both.select("query_id", problem.alias("problem"), F.when(F.col("bad") > 0, F.col("bad")).otherwise(F.lit(1)).cast("long").alias("n")).filter("problem is not null")


def require_valid(rankings: DataFrame, qrels: DataFrame) -> None:
    found = ranking_problems(rankings, qrels).orderBy("query_id").limit(5).collect()
    if found:
        raise ValueError("rankings cannot be judged, for instance " + ", ".join(f"{r.query_id} ({r.problem})" for r in found))


def positive_ranks(rankings: DataFrame, qrels: DataFrame, k: int, unique: bool = True) -> DataFrame:
    """(query_id, rank) of each query's positive within the first k, else null; the first one if there may be several.

    unique: a query whose number of positives is not one is an error.
    """
    good = qrels.filter("label > 0").select("query_id", "doc_id")
    asked = qrels.select("query_id").distinct()
    if unique:
        wrong = asked.join(good.groupBy("query_id").count(), "query_id", "left").filter("coalesce(count, 0) <> 1").limit(1).collect()
        if wrong:
            raise ValueError(f"query {wrong[0].query_id} has {wrong[0]['count'] or 0} positives")
    hit = ranked_items(rankings, k).join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return asked.join(hit, "query_id", "left")


def retrieval_measures(rankings: DataFrame, qrels: DataFrame, ks: Iterable[int] = (1, 3, 5, 10, 20, 100)) -> DataFrame:
    """(k, queries, ndcg, map, mrr, recall, precision, hit): means over all judged queries at each cutoff, to 5 decimals.

    Any number of positives: a label is its gain, discounted by log2(1 + rank) and held against the best order of the
    query's labels; map divides by all positives, precision by k. A query without positives or results has zeros.
    """
    ks = sorted(set(ks))
    good = qrels.filter("label > 0").select("query_id", "doc_id", "label")
    asked = qrels.select("query_id").distinct()
    cut = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    gain = lambda place: F.col("label") / F.log2(1.0 + F.col(place))
    best = good.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("label"))))
    per = Window.partitionBy("query_id")
    best = best.withColumn("positives", F.count("*").over(per)).filter(F.col("place") <= ks[-1])
    ideal = best.select("query_id", "positives", "place", gain("place").alias("g"), cut).groupBy("query_id", "k").agg(F.sum(F.when(F.col("place") <= F.col("k"), F.col("g"))).alias("ideal"), F.max("positives").alias("positives"))
    hits = ranked_items(rankings, ks[-1]).join(good, ["query_id", "doc_id"])
    hits = hits.withColumn("nth", F.row_number().over(per.orderBy("rank")))
    inside = lambda x: F.sum(F.when(F.col("rank") <= F.col("k"), x))
    got = hits.select("query_id", "rank", "nth", gain("rank").alias("g"), cut).groupBy("query_id", "k").agg(
        inside(F.col("g")).alias("dcg"), inside(F.col("nth") / F.col("rank")).alias("ap"), inside(F.lit(1.0)).alias("found"), F.min("rank").alias("first")
    )
    rows = asked.select("query_id", cut).join(ideal, ["query_id", "k"], "left").join(got, ["query_id", "k"], "left")
    mean = lambda x, name: F.round(F.avg(F.coalesce(x, F.lit(0.0))), 5).alias(name)
    return rows.groupBy("k").agg(
        F.count("*").alias("queries"),
        mean(F.col("dcg") / F.col("ideal"), "ndcg"),
        mean(F.col("ap") / F.col("positives"), "map"),
        mean(F.when(F.col("first") <= F.col("k"), 1.0 / F.col("first")), "mrr"),
        mean(F.col("found") / F.col("positives"), "recall"),
        mean(F.col("found") / F.col("k"), "precision"),
        mean(F.when(F.col("found") > 0, 1.0), "hit"),
    )


def sanity_checks(rankings: DataFrame, qrels: DataFrame, measures: DataFrame) -> DataFrame:
    """(check, passed): one positive a query, and mrr and hit at 10 as the positives' ranks alone give them."""
    single = qrels.groupBy("query_id").agg(F.count_if(F.col("label") > 0).alias("n")).agg(F.coalesce(F.bool_and(F.col("n") == 1), F.lit(True)).alias("one"))
    ranks = positive_ranks(rankings, qrels, 10, unique=False)
    told = ranks.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("m"), F.avg(F.col("rank").isNotNull().cast("double")).alias("h"))
    row = single.crossJoin(told).crossJoin(measures.filter("k = 10").select("mrr", "hit"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 5e-6
    return row.select(F.explode(F.create_map(F.lit("one_positive"), F.col("one"), F.lit("mrr_at_10"), near("mrr", "m"), F.lit("hit_at_10"), near("hit", "h"))).alias("check", "passed"))


def movement_counts(before: DataFrame, after: DataFrame, high: int = 10) -> DataFrame:
    """Positives that moved from rank 2 to `high` up to 1, and from 1 down, with how many are first before and after.

    before and after are (query_id, rank), null where a positive is not ranked; the queries of before count.
    """
    both = before.select("query_id", F.col("rank").alias("a")).join(after.select("query_id", F.col("rank").alias("b")), "query_id", "left")
    first = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return both.agg(
        F.count_if(F.col("a").between(2, high) & first("b")).alias("moved_to_first"), F.count_if(first("a") & ~first("b")).alias("moved_down"),
        F.count_if(first("a")).alias("first_before"), F.count_if(first("b")).alias("first_after"), (F.count_if(first("b")) - F.count_if(first("a"))).alias("net_change"),
    )


def unique_top_docs(rankings: DataFrame, selected: DataFrame, depth: int) -> DataFrame:
    """(doc_id, place): distinct documents among the first `depth` of the selected queries (query_id, position), in order of appearance."""
    top = ranked_items(rankings, depth).join(selected.select("query_id", "position"), "query_id")
    return top.groupBy("doc_id").agg(F.min(F.struct("position", "rank")).alias("at")).select("doc_id", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


def sample_queries(queries: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """n queries (query_id) to show, the same ones for the same seed wherever rows are stored."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("query_id").cast("string")))
    return queries.orderBy(key, "query_id").limit(n)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of like columns hold the same set of rows."""
    return a.distinct().exceptAll(b.distinct()).isEmpty() and b.distinct().exceptAll(a.distinct()).isEmpty()


# Results (query_id, rank, path, symbol, start_line, end_line) against what was expected


def path_or_symbol(files: Column, symbols: Column) -> Column:
    """Whether a result's path is among the expected files or its symbol among the expected symbols."""
    return F.coalesce(F.array_contains(files, F.col("path")), F.lit(False)) | F.coalesce(F.array_contains(symbols, F.col("symbol")), F.lit(False))


def matches_entry(e: Column) -> Column:
    """Whether a result is the expected entry e (path, symbol, start_line, end_line): all that e names must agree.

    Lines are bounds: a result may not begin before the first nor end after the last. Null and empty names say nothing.
    """
    same = lambda f: e[f].isNull() | (e[f] == "") | e[f].eqNullSafe(F.col(f))
    begins = e["start_line"].isNull() | (e["start_line"] == 0) | (F.coalesce("start_line", F.lit(0)) >= e["start_line"])
    ends = e["end_line"].isNull() | (e["end_line"] == 0) | (F.coalesce("end_line", F.lit(0)) <= e["end_line"])
    return same("path") & same("symbol") & begins & ends


def quality_by_files(results: DataFrame, expected: DataFrame, precision_at: Iterable[int] = (1, 5), recall_at: Iterable[int] = (5, 10)) -> DataFrame:
    """(query_id, precision_at_k..., recall_at_k..., mrr) for expected (query_id, files, symbols).

    Precision is over the results there are, k at most; recall is of distinct expected files. No results: zeros.
    """
    both = expected.join(results, "query_id", "left").withColumn("_ok", path_or_symbol(F.col("files"), F.col("symbols")) & F.col("rank").isNotNull())
    there = lambda k: F.col("rank") <= k
    file = F.when(F.array_contains("files", F.col("path")), F.col("path"))
    p = [F.round(F.coalesce(F.count_if(there(k) & F.col("_ok")) / F.nullif(F.count_if(there(k)), F.lit(0)), F.lit(0.0)), 6).alias(f"precision_at_{k}") for k in precision_at]
    r = [F.round(F.count_distinct(F.when(there(k), file)) / F.greatest(F.lit(1), F.max(F.size(F.array_distinct("files")))), 6).alias(f"recall_at_{k}") for k in recall_at]
    return both.groupBy("query_id").agg(*p, *r, F.round(F.coalesce(1.0 / F.min(F.when(F.col("_ok"), F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


def quality_by_entries(results: DataFrame, expected: DataFrame, precision_at: Iterable[int] = (1, 5), recall_at: Iterable[int] = (5, 10)) -> DataFrame:
    """Like quality_by_files() for expected (query_id, entries): recall is the share of entries that some result matches."""
    ok = F.exists("entries", matches_entry)
    both = expected.join(results, "query_id", "left").withColumn("_ok", F.coalesce(ok, F.lit(False)) & F.col("rank").isNotNull())
    which = F.transform("entries", lambda e, i: F.when(matches_entry(e), i))
    both = both.withColumn("_hit", F.filter(which, lambda x: x.isNotNull()))
    there = lambda k: F.col("rank") <= k
    p = [F.round(F.coalesce(F.count_if(there(k) & F.col("_ok")) / F.nullif(F.count_if(there(k)), F.lit(0)), F.lit(0.0)), 6).alias(f"precision_at_{k}") for k in precision_at]
    found = lambda k: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(there(k), F.col("_hit"))))))
    r = [F.round(F.coalesce(found(k) / F.nullif(F.max(F.size("entries")), F.lit(0)), F.lit(0.0)), 6).alias(f"recall_at_{k}") for k in recall_at]
    return both.groupBy("query_id").agg(*p, *r, F.round(F.coalesce(1.0 / F.min(F.when(F.col("_ok"), F.col("rank"))), F.lit(0.0)), 6).alias("mrr"))


def version_summaries(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results (query_id, rank, content_id) against expected (query_id, content_id): one row an expected query.

    First relevant rank, whether it is within 1, 3 and 5, its reciprocal, and how many results repeat a content.
    """
    good = expected.select("query_id", "content_id").distinct().withColumn("_good", F.lit(True))
    rows = expected.select("query_id").distinct().join(results.join(good, ["query_id", "content_id"], "left"), "query_id", "left")
    first = F.min(F.when(F.col("_good"), F.col("rank"))).alias("first_relevant_rank")
    out = rows.groupBy("query_id").agg(first, F.count("content_id").alias("result_count"), F.count_distinct("content_id").alias("unique_content_ids"))
    hit = [F.coalesce(F.col("first_relevant_rank") <= k, F.lit(False)).alias(f"hit_at_{k}") for k in (1, 3, 5)]
    rr = F.coalesce(1.0 / F.col("first_relevant_rank"), F.lit(0.0)).alias("reciprocal_rank")
    return out.select("query_id", "first_relevant_rank", *hit, rr, "result_count", "unique_content_ids", (F.col("result_count") - F.col("unique_content_ids")).alias("duplicate_results"))


def version_means(summaries: DataFrame) -> DataFrame:
    share = lambda k: F.round(F.avg(F.col(f"hit_at_{k}").cast("double")), 6).alias(f"hit_rate_at_{k}")
    return summaries.agg(F.count("*").alias("queries"), *[share(k) for k in (1, 3, 5)], F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.sum("duplicate_results").alias("duplicate_results"), F.sum("unique_content_ids").alias("unique_states"))


def unknown_states(expected: DataFrame, contents: DataFrame) -> DataFrame:
    """Expected contents (query_id, content_id) that no version holds; there must be none."""
    return expected.join(contents.select("content_id").distinct(), "content_id", "left_anti")


# Runs


def parity(incremental: DataFrame, clean: DataFrame) -> DataFrame:
    """(commit, query_id, passed, max_score_delta) of two result lists (commit, query_id, rank, version_id, score).

    Passed: the same versions in the same order. Scores may drift; the largest difference at one rank is told.
    """
    side = lambda df, x: df.select("commit", "query_id", "rank", F.col("version_id").alias(f"v{x}"), F.col("score").alias(f"s{x}"))
    both = side(incremental, "a").join(side(clean, "b"), ["commit", "query_id", "rank"], "full_outer")
    delta = F.coalesce(F.max(F.abs(F.col("sa") - F.col("sb"))), F.lit(0.0))
    return both.groupBy("commit", "query_id").agg(F.bool_and(F.col("va").eqNullSafe(F.col("vb"))).alias("passed"), F.round(delta, 6).alias("max_score_delta"))


def nearest_rank(x: str, p: float) -> Column:
    """The value at place ceil(p n) of n in order."""
    return F.expr(f"percentile_disc({p}) within group (order by {x})")


def latency_by_type(rows: DataFrame) -> DataFrame:
    """(type, queries, median_ms, p95_ms) of rows (type, total_ms)."""
    return rows.groupBy("type").agg(F.count("*").alias("queries"), F.round(F.median("total_ms"), 6).alias("median_ms"), F.round(nearest_rank("total_ms", 0.95), 6).alias("p95_ms"))


def run_means(commits: DataFrame, rebuilds: DataFrame) -> DataFrame:
    """One row over commits (ord, commit, file_reuse, chunk_reuse, embedding_reuse, seconds, generated, hits, chunks, inserted) and rebuilds (commit, seconds, contents).

    Means are over commits after the first, or the first if it is alone. A speed-up is a rebuild's seconds by those of
    the same commit's update; work saved is the share of the rebuilds' contents that updates did not embed.
    """
    n = commits.agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    marked = commits.crossJoin(F.broadcast(n)).withColumn("later", (F.col("ord") > F.col("first")) | (F.col("n") == 1)).withColumn("after", F.col("ord") > F.col("first"))
    mean = lambda c, name: F.round(F.avg(F.when(F.col("later"), F.col(c))), 6).alias(name)
    own = marked.agg(
        mean("file_reuse", "average_file_reuse"), mean("chunk_reuse", "average_chunk_reuse"), mean("embedding_reuse", "average_embedding_reuse"), mean("seconds", "average_update_seconds"),
        F.coalesce(F.sum(F.when(F.col("after"), F.col("hits"))), F.lit(0)).alias("embeddings_avoided"), F.sum(F.greatest(F.lit(0), F.col("chunks") - F.col("inserted"))).alias("insertions_avoided"),
    )
    both = rebuilds.select("commit", F.col("seconds").alias("full"), "contents").join(commits.select("commit", "seconds", "generated"), "commit")
    speed = F.when(F.col("seconds") == 0, F.lit(math.inf)).otherwise(F.col("full") / F.col("seconds"))
    total, made = F.sum("contents"), F.sum("generated")
    against = both.agg(
        F.round(F.avg("full"), 6).alias("average_rebuild_seconds"), F.round(F.median(speed), 6).alias("median_speedup"), F.round(F.max(speed), 6).alias("maximum_speedup"),
        F.round(F.greatest(F.lit(0), total - made) / F.nullif(total, F.lit(0)), 6).alias("work_saved"),
    )
    return own.crossJoin(against)


def storage(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path, bytes): what the files under each path take, from their listing alone."""
    one = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select(F.lit(p).alias("path"), "length")
    return reduce(DataFrame.union, map(one, paths)).groupBy("path").agg(F.sum("length").alias("bytes"))


# Submissions


def submission_problems(predictions: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, duplicates, unknown_docs, non_finite, answered) for each query of either predictions or queries.

    predictions: (query_id, doc_id, score). A query is right when it is asked, answered and has none of the others.
    """
    score = F.col("score").cast("double")
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == F.lit(math.inf))
    known = corpus.select("doc_id").distinct().withColumn("_known", F.lit(True))
    rows = predictions.join(known, "doc_id", "left")
    per = rows.groupBy("query_id").agg(
        (F.count("doc_id") - F.count_distinct("doc_id")).alias("duplicates"), F.count_if(F.col("_known").isNull()).alias("unknown_docs"), F.count_if(bad).alias("non_finite")
    )
    asked = queries.select("query_id").distinct().withColumn("_asked", F.lit(True))
    out = asked.join(per, "query_id", "full_outer")
    none = F.lit(0).cast("long")
    answered = F.when(F.col("_asked").isNull(), "not_asked").when(F.col("duplicates").isNull(), "missing").otherwise("yes")
    return out.select("query_id", *[F.coalesce(c, none).alias(c) for c in ("duplicates", "unknown_docs", "non_finite")], answered.alias("answered"))


def submission_checks(problems: DataFrame) -> DataFrame:
    """(check, passed) of submission_problems()."""
    none = lambda x: F.coalesce(F.bool_and(x), F.lit(True))
    row = problems.agg(
        none(F.col("duplicates") == 0).alias("no_duplicates"), none(F.col("unknown_docs") == 0).alias("known_documents"),
        none(F.col("non_finite") == 0).alias("finite_scores"), none(F.col("answered") == "yes").alias("all_queries"),
    )
    return row.select(F.explode(F.create_map(*[x for c in row.columns for x in (F.lit(c), F.col(c))])).alias("check", "passed"))


def flat_numbers(value: object, name: str = "") -> dict[str, float]:
    """Numbers within nested maps and lists under names such as a.b[0]; truth values and texts are left out."""
    if isinstance(value, Mapping):
        parts = [(f"{name}.{k}" if name else str(k), v) for k, v in value.items()]
    elif isinstance(value, list):
        parts = [(f"{name}[{i}]", v) for i, v in enumerate(value)]
    else:
        return {} if isinstance(value, bool) or not isinstance(value, int | float) else {name: float(value)}
    return {k: x for n, v in parts for k, x in flat_numbers(v, n).items()}


def pick(numbers: Mapping[str, float], parts: Iterable[str]) -> tuple[str, float] | None:
    """The first number whose name, in small letters and with - as _, holds one of the parts."""
    return next(((k, v) for k, v in numbers.items() if any(p in k.lower().replace("-", "_") for p in parts)), None)


def against_known(numbers: Mapping[str, float], known: Mapping[str, tuple[str, float]], most: float = 1e-4) -> dict[str, dict]:
    """For each label of known (part of a name, value): what was found, how far off it is, and whether within `most`."""
    out = {}
    for label, (part, value) in known.items():
        found = pick(numbers, (part,))
        off = abs(found[1] - value) if found else None
        out[label] = {"field": found and found[0], "observed": found and found[1], "expected": value, "difference": off, "within": off is not None and off <= most}
    return out
