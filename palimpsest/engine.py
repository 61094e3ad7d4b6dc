"""The public methods: repositories registered and updated by commit, searched, questioned and followed through versions."""

from __future__ import annotations

import os
from collections import OrderedDict
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text as X
from palimpsest.operators import diff, evolution, graph, lines, retrieval, router
from palimpsest.sources import git, tables, vectors
from palimpsest.streaming.update import CHUNKS, CONTENTS, identified

FILES = (
    "repo_id string, commit string, path string, stable_id string, language string, extension string, size long, sha256 string, "
    "git_blob_sha string, last_modified_status string, binary boolean, indexable boolean"
)
EDGES = "commit string, kind string, name string, version_id string, path string, symbol string, start_line int, end_line int, line int, column int"
EVENTS = "repo_id string, repo_path string, commit string, seq long, at string"
REPORTS = "repo_id string, commit string, reuse_percentage double, work_reduction double, generated long, at string"
COUNTS = (
    "unchanged_occurrences", "modified_replaced_occurrences", "added_occurrences", "removed_occurrences", "reused_vectors", "vectors_newly_inserted", "vectors_tombstoned", "active_vectors_after_update",
)
INDEX_REPORTS = f"repo_id string, before string, commit string, {', '.join(f'{c} long' for c in COUNTS)}, at string"
#: Questions whose vectors are remembered, and how deep each version is searched at least.
REMEMBERED, DEPTH = 128, 20


class RequestError(Exception):
    """status: 400 for what cannot be done, 404 for what is not there, 503 where the encoder fails."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Engine:
    """Repositories below one folder that driver and executors share.

    Each commit owns its partition of files, chunks, edges and contents, written anew when it is indexed again. A
    content is stored, and encoded, with the first commit that has it. The registry is a log of events, of which the
    last one of a repository names its active commit. encode maps texts to vectors of dim numbers.
    """

    def __init__(self, spark: SparkSession, root: str, encode: vectors.Encoder, config: dict, dim: int):
        self.spark, self.root, self.encode, self.config, self.dim = spark, root.rstrip("/"), encode, config, dim
        self._asked: OrderedDict[str, np.ndarray] = OrderedDict()

    def _at(self, repo_id: str, name: str) -> str:
        safe = "".join(c if c.isalnum() or c in "._-" else "_" for c in repo_id)
        return f"{self.root}/repos/{safe}/{name}"

    def _now(self) -> str:
        return datetime.now(UTC).isoformat()

    # What is stored

    def chunks(self, repo_id: str) -> DataFrame:
        return tables.read(self.spark, self._at(repo_id, "chunks"), CHUNKS)

    def contents(self, repo_id: str) -> DataFrame:
        return tables.read(self.spark, self._at(repo_id, "contents"), f"{CONTENTS}, commit string")

    def edges(self, repo_id: str) -> DataFrame:
        return tables.read(self.spark, self._at(repo_id, "edges"), EDGES)

    def files(self, repo_id: str) -> DataFrame:
        return tables.read(self.spark, self._at(repo_id, "files"), FILES)

    def _events(self) -> DataFrame:
        return tables.read_log(self.spark, f"{self.root}/registry", EVENTS)

    def _record(self, repo_id: str) -> tuple[str, list[str], str]:
        """(path, commits in the order they came, active commit); a repository has few events."""
        rows = self._events().filter(F.col("repo_id") == repo_id).orderBy("seq").collect()
        if not rows:
            raise RequestError(404, f"no repository {repo_id}")
        return rows[-1].repo_path, list(dict.fromkeys(r.commit for r in rows)), rows[-1].commit

    def _resolve(self, path: str, ref: str) -> str:
        try:
            return git.resolve(path, ref)
        except ValueError as e:
            raise RequestError(400, f"no commit {ref}") from e

    def _indexed(self, repo_id: str, ref: str | None) -> tuple[str, list[str]]:
        path, commits, active = self._record(repo_id)
        commit = self._resolve(path, ref) if ref else active
        if commit not in commits:
            raise RequestError(404, f"commit {commit} of {repo_id} is not indexed")
        return commit, commits

    def _vector(self, question: str) -> np.ndarray:
        """The question's vector of unit length; the latest ones are kept, by their exact text."""
        if question not in self._asked:
            try:
                v = np.asarray(self.encode([question])[0], np.float64)
            except Exception as e:
                raise RequestError(503, f"the encoder failed: {e}") from e
            if v.shape != (self.dim,) or not np.isfinite(v).all():
                raise RequestError(503, f"the encoder gave other than {self.dim} finite numbers")
            self._asked[question] = (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)
            if len(self._asked) > REMEMBERED:
                self._asked.popitem(last=False)
        self._asked.move_to_end(question)
        return self._asked[question]

    # Indexing

    def _index(self, repo_id: str, path: str, commit: str) -> dict:
        """Writes all tables of one commit and the vectors it lacks; the counts that a report needs."""
        files, skipped = git.scan_repository(self.spark, path, [commit], repo_id)
        put = lambda df, name: df.drop("commit").write.mode("overwrite").parquet(f"{self._at(repo_id, name)}/commit={commit}")
        put(files, "texts")
        texts = self.spark.read.parquet(f"{self._at(repo_id, 'texts')}/commit={commit}")
        if texts.isEmpty():
            raise RequestError(400, f"no file of commit {commit} can be indexed")
        put(texts.drop("text"), "files")
        tables.file_header(texts.withColumn("commit", F.lit(commit)), skipped).write.mode("overwrite").json(f"{self._at(repo_id, 'file_headers')}/commit={commit}")
        indexed = self.contents(repo_id).filter(F.col("commit") != commit).select("content_id")
        put(identified(texts, repo_id, commit), "chunks")
        own = self.spark.read.parquet(f"{self._at(repo_id, 'chunks')}/commit={commit}")
        if own.isEmpty():
            raise RequestError(400, f"commit {commit} has no chunks")
        tables.chunk_header(own.withColumn("commit", F.lit(commit))).write.mode("overwrite").json(f"{self._at(repo_id, 'chunk_headers')}/commit={commit}")
        put(graph.structural_edges(own), "edges")
        report = diff.reuse_report(vectors.read_vectors(self.spark, self._at(repo_id, "vectors"), vectors.fingerprint(self.config)), own).first().asDict()
        put(own.dropDuplicates(["content_id"]).join(indexed, "content_id", "left_anti").select("content_id", "language", "text"), "contents")
        try:
            vectors.embed_missing(own.select("content_id", "text"), self.encode, self._at(repo_id, "vectors"), self.config, self.dim)
        except Exception as e:
            raise RequestError(503, f"the encoder failed: {e}") from e
        kinds = {r.kind: r.n for r in self.edges(repo_id).filter(F.col("commit") == commit).groupBy("kind").agg(F.count("*").alias("n")).collect()}
        sizes = own.groupBy("path").agg(F.max("end_line").alias("m"), F.count("*").alias("c"), F.collect_set("content_id").alias("ids"))
        loc = sizes.agg(F.sum("m").alias("loc"), F.sum("c").alias("chunks")).first()
        tables.append_log(self.spark, f"{self.root}/reports", [(repo_id, commit, report["reuse_percentage"], report["work_reduction"], report["generated"], self._now())], REPORTS)
        return {
            "source_files": texts.count(), "chunks": loc.chunks, "loc": loc.loc, "symbols": kinds.get("symbols", 0), "call_edges": kinds.get("calls", 0), "reference_edges": kinds.get("references", 0),
            "reused_embeddings": report["hits"], "newly_generated_embeddings": report["generated"], "embedding_reuse_percent": report["reuse_percentage"],
        }

    def _note(self, repo_id: str, path: str, commit: str) -> None:
        last = self._events().agg(F.max("seq")).first()[0]
        tables.append_log(self.spark, f"{self.root}/registry", [(repo_id, path, commit, (last or 0) + 1, self._now())], EVENTS)

    def register(self, repo_path: str, commit: str = "HEAD", repo_id: str | None = None) -> dict:
        """Indexes a commit and makes it the active one; commits indexed before stay."""
        if not os.path.isdir(repo_path):
            raise RequestError(400, f"no folder {repo_path}")
        repo_id = repo_id or os.path.basename(os.path.abspath(repo_path))
        commit = self._resolve(repo_path, commit)
        got = self._index(repo_id, repo_path, commit)
        self._note(repo_id, repo_path, commit)
        return {"repo": repo_id, "commit": commit} | got

    def update(self, repo_id: str, commit: str) -> dict:
        """Indexes a commit after the active one, with what changed between them; nothing is done if it is active."""
        path, _, before = self._record(repo_id)
        commit = self._resolve(path, commit)
        if commit == before:
            return {"repo": repo_id, "previous_commit": before, "new_commit": commit, "message": "already indexed at this commit"}
        known = self.contents(repo_id).filter(F.col("commit") != commit).select("content_id").distinct()
        got = self._index(repo_id, path, commit)
        of = lambda df, c: df.filter(F.col("commit") == c)
        old, new = of(self.chunks(repo_id), before), of(self.chunks(repo_id), commit)
        changed = {r.status: r.n for r in diff.file_diff(of(self.files(repo_id), before), of(self.files(repo_id), commit)).groupBy("status").agg(F.count("*").alias("n")).collect()}
        chunk = {r.status: r.n for r in diff.chunk_diff(old, new).groupBy("status").agg(F.count("*").alias("n")).collect()}
        counts = diff.index_update(old, new, known).first().asDict()
        self._note(repo_id, path, commit)
        tables.append_log(self.spark, f"{self.root}/index_reports", [(repo_id, before, commit, *(counts[c] for c in COUNTS), self._now())], INDEX_REPORTS)
        return {
            "repo": repo_id, "previous_commit": before, "new_commit": commit, "changed_files": {k: changed.get(k, 0) for k in ("unchanged", "modified", "added", "deleted")},
            "reusable_chunks": chunk.get("reused", 0), "chunk_reuse_percent": 100.0 * chunk.get("reused", 0) / max(got["chunks"], 1),
        } | got | counts

    # Asking

    def _hits(self, repo_id: str, vector: np.ndarray, commits: list[str], k: int) -> DataFrame:
        """The best k occurrences of each commit; every distinct content of them is scored once."""
        there = self.chunks(repo_id).filter(F.col("commit").isin(commits))
        held = vectors.read_vectors(self.spark, self._at(repo_id, "vectors"), vectors.fingerprint(self.config))
        return retrieval.occurrence_top(held, there, vector, k)

    def search(self, repo_id: str, question: str, commit: str | None = None, k: int = 5) -> DataFrame:
        """The k occurrences of a commit that are nearest to the question, with previews of their contents."""
        commit, _ = self._indexed(repo_id, commit)
        hits = self._hits(repo_id, self._vector(question), [commit], k)
        shown = hits.join(self.contents(repo_id).select("content_id", X.preview(F.col("text")).alias("preview")), "content_id", "left")
        return shown.select("rank", "score", "path", "symbol", "chunk_type", "preview", "commit", "content_id", "version_id").orderBy("rank")

    def query(self, repo_id: str, question: str, commit: str | None = None, k: int = 5) -> tuple[DataFrame, list[dict]]:
        """(results, trace): structural evidence first, semantic search only where that does not settle the question."""
        commit, _ = self._indexed(repo_id, commit)
        q = F.lit(question)
        plan = self.spark.range(1).select(router.query_type(q).alias("kind"), router.terms(F.trim(q)).alias("terms"), router.order_pair(F.trim(q)).alias("pair")).first()
        deep = max(5 * k, 25)
        edges = self.edges(repo_id).filter(F.col("commit") == commit)
        none = self.spark.createDataFrame([], "version_id string, evidence string, referenced string")
        found = none
        if plan.pair:
            calls = graph.call_order(edges.filter("kind = 'calls'"), *plan.pair).orderBy("version_id").limit(deep)
            found = found.unionByName(calls.select("version_id", F.lit("structural").alias("evidence"), F.lit(" before ".join(plan.pair)).alias("referenced")))
        if plan.terms and plan.kind in ("usage", "structural", "mixed"):
            found = found.unionByName(graph.references(edges, plan.terms, deep).select("version_id", "evidence", F.col("name").alias("referenced")))
        # Two limits bound these rows, so they are held once for the steps below.
        rows = found.collect()
        found = self.spark.createDataFrame(rows, none.schema)
        trace = [{"stage": "classify", "result": plan.kind, "terms": plan.terms}, {"stage": "structural_search", "matches": len(rows)}]
        if plan.kind in ("usage", "structural") and rows:
            semantic = self.spark.createDataFrame([], "id string, score double")
            trace.append({"stage": "semantic_search", "skipped": True})
        else:
            near = self._hits(repo_id, self._vector(question), [commit], max(3 * k, 30)).select(F.col("version_id").alias("id"), "score").collect()
            semantic = self.spark.createDataFrame(near, "id string, score double")
            trace.append({"stage": "semantic_search", "candidates": len(near)})
        fused = graph.fuse(semantic, found.select(F.col("version_id").alias("id"), "evidence"), plan.kind).withColumnRenamed("id", "version_id")
        told = found.groupBy("version_id").agg(F.array_sort(F.collect_set("referenced")).alias("referenced"))
        places = self.chunks(repo_id).filter(F.col("commit") == commit).select("version_id", "path", "symbol", "chunk_type", "start_line", "end_line", "content_id", "commit")
        every = places.join(F.broadcast(fused), "version_id").join(F.broadcast(told), "version_id", "left")
        order = [F.desc("score"), F.col("path"), F.col("start_line"), F.coalesce("symbol", F.lit("")), F.col("version_id")]
        top = every.orderBy(*order).limit(k)
        top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        shown = top.join(self.contents(repo_id).select("content_id", F.col("text").alias("snippet")), "content_id", "left")
        trace += [{"stage": "refine", "remaining_candidates": fused.count()}, {"stage": "rank", "returned": top.count()}]
        return shown.select("rank", "score", "path", "start_line", "end_line", "symbol", "chunk_type", "commit", "snippet", "evidence", "content_id", "version_id", "referenced").orderBy("rank"), trace

    def query_commits(self, repo_id: str, question: str, commits: list[str], k: int = 5) -> dict[str, tuple[DataFrame, list[dict]]]:
        """query() of the same question on several commits; its vector is made once."""
        return {commit: self.query(repo_id, question, commit, k) for commit in dict.fromkeys(commits)}

    def search_commits(self, repo_id: str, question: str, commits: list[str], k: int = 5) -> DataFrame:
        """The k occurrences nearest to the question in each of several commits, scored in one job."""
        wanted = list(dict.fromkeys(self._indexed(repo_id, c)[0] for c in commits))
        hits = self._hits(repo_id, self._vector(question), wanted, k)
        return hits.select("commit", "rank", "score", "path", "symbol", "chunk_type", "content_id", "version_id").orderBy("commit", "rank")

    # Through versions

    def _chains(self, repo_id: str, commits: list[str]) -> tuple[DataFrame, DataFrame]:
        """(occurrences by key and commit number, transitions with their lines); the last entry of a key counts."""
        number = F.array_position(F.lit(commits), F.col("commit")) - 1
        rows = self.chunks(repo_id).filter(F.col("commit").isin(commits)).withColumn("ord", number.cast("long"))
        w = Window.partitionBy("ord", "occurrence_key").orderBy(F.desc("version_id"))
        last = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
        states = last.select(F.col("occurrence_key").alias("key"), "ord", F.col("content_id").alias("content"), "path", "symbol", "version_id")
        order = self.spark.range(len(commits)).select(F.col("id").alias("ord"))
        changes = evolution.transitions(states.select("key", "ord", "content"), order)
        return states, lines.line_diff(changes, self.contents(repo_id))

    def search_evolution(self, repo_id: str, question: str, start: str | None = None, end: str | None = None, k: int = 5) -> DataFrame:
        """The k contents nearest to the question in any commit from start to end, with where they stood and what became of them."""
        path, commits, _ = self._record(repo_id)
        places = [self._resolve(path, c) if c else d for c, d in ((start, commits[0]), (end, commits[-1]))]
        if any(c not in commits for c in places) or commits.index(places[0]) > commits.index(places[1]):
            raise RequestError(400, "start must be an indexed commit that does not come after end")
        lo, hi = (commits.index(c) for c in places)
        number = (F.array_position(F.lit(commits), F.col("commit")) - 1).cast("long")
        hits = self._hits(repo_id, self._vector(question), commits[lo : hi + 1], max(k, DEPTH)).withColumn("ord", number).withColumnRenamed("content_id", "content")
        best = evolution.best_states(hits.select("content", "score", "ord", "path", "symbol", "version_id", "occurrence_key"), k, F.col("ord"), F.col("path"), F.col("symbol"), F.col("version_id"))
        states, changes = self._chains(repo_id, commits)
        stood = self.chunks(repo_id).filter(F.col("commit").isin(commits[lo : hi + 1])).withColumn("ord", number)
        stood = stood.withColumnRenamed("content_id", "content").join(F.broadcast(best.select("content")), "content", "left_semi")
        place = F.sort_array(F.collect_list(F.struct("ord", "path", "symbol", "commit", "version_id")))
        stood = stood.groupBy("content").agg(place.alias("occurrences"), F.countDistinct("version_id").alias("changed_state_count"))
        told = evolution.context(best.select("content", F.col("occurrence_key").alias("key")), states.select("key", "ord", "content"), changes, lo, hi).drop("key")
        out = best.drop("ord", "version_id").join(stood, "content", "left").join(told, "content", "left")
        out = out.join(self.contents(repo_id).select(F.col("content_id").alias("content"), "text", X.preview(F.col("text")).alias("preview")), "content", "left")
        return out.withColumnRenamed("content", "content_id").orderBy(F.desc("score"), "content_id")

    def symbol_evolution(self, repo_id: str, symbol: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(states, transitions) of the first chain, by key, that ever held the symbol, in that file if one is named."""
        _, commits, _ = self._record(repo_id)
        states, changes = self._chains(repo_id, commits)
        found = states.filter(F.col("symbol") == symbol)
        key = (found.filter(F.col("path") == path) if path else found).agg(F.min("key")).first()[0]
        if key is None:
            raise RequestError(404, f"no chain of symbol {symbol}")
        names = F.element_at(F.lit(commits), (F.col("ord") + 1).cast("int")).alias("commit")
        one = states.filter(F.col("key") == key)
        grid = self.spark.range(len(commits)).select(F.col("id").alias("ord")).join(one, "ord", "left")
        status = F.when(F.col("content").isNull(), "absent").otherwise("present").alias("status")
        return grid.select("ord", names, status, "path", "symbol", F.col("content").alias("content_id"), "version_id").orderBy("ord"), changes.filter(F.col("key") == key).select("ord", names, "transition", "old", "new", "lines_added", "lines_removed").orderBy("ord")

    def write_evolution(self, repo_id: str) -> str:
        """Writes the repository's states and transitions as tables beside it, numbered by commit; where they are."""
        _, commits, _ = self._record(repo_id)
        states, changes = self._chains(repo_id, commits)
        names = F.element_at(F.lit(commits), (F.col("ord") + 1).cast("int")).alias("commit")
        for df, name in ((states, "states"), (changes, "transitions")):
            df.withColumn("commit", names).write.mode("overwrite").parquet(f"{self._at(repo_id, 'evolution')}/{name}")
        return self._at(repo_id, "evolution")

    # About the engine

    def health(self) -> dict:
        try:
            self.encode(["ready"])
            ready = True
        except Exception:
            ready = False
        return {"status": "ok", "encoder_healthy": ready, "registered_repository_count": self._events().select("repo_id").distinct().count()}

    def metrics_summary(self) -> DataFrame:
        """(repo_id, commits, average_embedding_reuse, average_work_reduction, generated): means over commits after the first."""
        log = tables.read_log(self.spark, f"{self.root}/reports", REPORTS)
        first = F.row_number().over(Window.partitionBy("repo_id").orderBy("at")) == 1
        later = lambda c: F.when(~F.col("first"), F.col(c))
        return log.withColumn("first", first).groupBy("repo_id").agg(
            F.count("*").alias("commits"), F.avg(later("reuse_percentage")).alias("average_embedding_reuse"), F.avg(later("work_reduction")).alias("average_work_reduction"), F.sum("generated").alias("generated")
        )
