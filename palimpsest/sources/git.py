"""Git trees, changes and file contents as DataFrames, read without a checkout; the repository lies on shared storage."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.operators import scan
from palimpsest.plans.spread import spread

TREE = "commit string, mode string, object_type string, object_sha string, size long, path string"
CHANGES = "commit string, status string, path string"
READ = 1 << 16


def git(repo: str, *words: str) -> bytes:
    done = subprocess.run(["git", "-C", repo, *words], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {words[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def resolve(repo: str, ref: str) -> str:
    """The full id of the commit that a ref names; ValueError where it names none."""
    return git(repo, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{ref}^{{commit}}").decode().strip()


def is_ancestor(repo: str, old: str, new: str) -> bool:
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", old, new], capture_output=True, check=False).returncode == 0


def _fields(repo: str, *words: str) -> Iterator[str]:
    """The NUL-ended fields of a git command's output, as they arrive."""
    with subprocess.Popen(["git", "-C", repo, *words], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        rest = b""
        while data := run.stdout.read(READ):
            *whole, rest = (rest + data).split(b"\0")
            yield from (x.decode("utf-8", "replace") for x in whole)
    if run.returncode:
        raise ValueError(f"git {' '.join(words)} failed in {repo}")


class GitSource(DataSource):
    """format("git"): options repo, commits (ids, comma-separated) and what, `tree` or `changes`; a partition a commit."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return CHANGES if self.options.get("what") == "changes" else TREE

    def reader(self, schema) -> GitReader:
        return GitReader(self.options["repo"], self.options["commits"].split(","), self.options.get("what", "tree"))


class GitReader(DataSourceReader):
    def __init__(self, repo: str, commits: list[str], what: str):
        self.repo, self.commits, self.what = repo, commits, what

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.commits]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        commit = partition.value
        return self._changes(commit) if self.what == "changes" else self._tree(commit)

    def _tree(self, commit: str) -> Iterator[tuple]:
        for entry in _fields(self.repo, "ls-tree", "-r", "-l", "-z", "--full-tree", commit):
            head, path = entry.split("\t", 1)
            mode, kind, sha, size = head.split()
            yield commit, mode, kind, sha, 0 if size == "-" else int(size), path

    def _changes(self, commit: str) -> Iterator[tuple]:
        fields = _fields(self.repo, "diff-tree", "--root", "--no-commit-id", "--name-status", "-r", "-z", commit)
        for status in fields:
            path = next(fields)
            yield commit, status, next(fields) if status[0] in "RC" else path


def read_git(spark: SparkSession, repo: str, commits: list[str], what: str = "tree") -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("git").option("repo", repo).option("commits", ",".join(commits)).option("what", what).load()


def blobs(objects: DataFrame, repo: str) -> DataFrame:
    """(object_sha, content) of each distinct object_sha; one git process a partition answers all its requests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as ask:
            for batch in batches:
                for sha in batch.column(0).to_pylist():
                    ask.stdin.write(sha.encode() + b"\n")
                    ask.stdin.flush()
                    head = ask.stdout.readline().split()
                    if len(head) != 3:
                        raise ValueError(f"no object {sha} in {repo}")
                    content = ask.stdout.read(int(head[2]))
                    ask.stdout.read(1)
                    yield pa.RecordBatch.from_arrays([pa.array([sha]), pa.array([content], pa.binary())], ["object_sha", "content"])
            ask.stdin.close()

    return spread(objects.select("object_sha").distinct()).mapInArrow(run, "object_sha string, content binary")


def scan_repository(spark: SparkSession, repo: str, commits: list[str], repo_id: str) -> tuple[DataFrame, DataFrame]:
    """Files to index, with their contents, and (commit, reason, n) of those that are not.

    Each distinct blob of all commits is read once. Only candidates by path, size and language are read at all;
    binary ones among them are counted, not listed. The order of rows is not defined.
    """
    tree = read_git(spark, repo, commits).filter("object_type = 'blob'")
    tree = tree.withColumn("reason", scan.scan_reason(F.col("path"), F.col("size")))
    wanted = tree.filter("reason = 'candidate'")
    held = wanted.join(blobs(wanted, repo), "object_sha").withColumn("binary", scan.is_binary(F.col("content")))
    changed = read_git(spark, repo, commits, "changes").withColumnRenamed("status", "last_modified_status")
    files = held.filter("not binary").join(changed, ["commit", "path"], "left").select(
        F.lit(repo_id).alias("repo_id"),
        "commit",
        "path",
        F.concat_ws(":", F.lit(repo_id), "commit", "path").alias("stable_id"),
        scan.language(F.col("path")).alias("language"),
        scan.extension(F.col("path")).alias("extension"),
        "size",
        F.sha2("content", 256).alias("sha256"),
        F.col("object_sha").alias("git_blob_sha"),
        "last_modified_status",
        "binary",
        F.lit(True).alias("indexable"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )
    reasons = tree.filter("reason <> 'candidate'").select("commit", "reason").unionByName(held.filter("binary").select("commit", F.lit("binary").alias("reason")))
    return files, reasons.groupBy("commit", "reason").agg(F.count("*").alias("n"))
