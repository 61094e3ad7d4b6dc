"""Near-duplicates: bottom-k sketches from one hash, inverted lists, union-sketch filter, exact Jaccard."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.bytesops import shingles, texts
from palimpsest.llm.components import components
from palimpsest.llm.storage import checked_join, join_groups, numbered, stage, unstage

#: Retained values of a sketch.
K = 128
#: At a similarity of 0.75 each of the K least values of a union is common with probability 0.75. SLACK
#: standard deviations below the mean, a true pair falls with a probability of about 1e-9.
SLACK = 6.0
#: Lists of at most this many documents give their pairs across components; longer ones are compared in place.
LIST = 64
HEAD = 16
NUM, DEN = 3, 4


def _least_common() -> int:
    p = NUM / DEN
    return int(K * p - SLACK * (K * p * (1 - p)) ** 0.5)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, sketch): number of distinct 5-word shingles, 128-bit digest of their set, its K least hashes."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offs in texts(batch.column(1)):
                key, at = shingles(buf, offs)
                n = np.bincount(at, minlength=hi - lo)
                first = np.concatenate(([0], np.cumsum(n)))
                mem = np.ascontiguousarray(key)
                digest = [hashlib.blake2b(mem[first[i] : first[i + 1]], digest_size=16).digest() for i in range(hi - lo)]
                took = np.minimum(n, K)
                keep = np.arange(len(key)) - first[:-1].repeat(n) < K
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(took))).astype(np.int32)), pa.array(key[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(digest, pa.binary()), lists], ["doc_id", "n", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, digest binary, sketch array<long>")


def _overlaps(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ta, tb) to those (a, b) whose full shingle sets have a Jaccard similarity of NUM/DEN or more."""

    def run(batches):
        for batch in batches:
            at = 0
            size = np.asarray(pa.compute.add(pa.compute.binary_length(batch.column(2)), pa.compute.binary_length(batch.column(3))))
            ends = np.cumsum(size)
            while at < len(size):
                base = ends[at] - size[at]
                hi = max(at + 1, int(np.searchsorted(ends, base + (1 << 21), "right")))
                part = batch.slice(at, hi - at)
                both = pa.concat_arrays([part.column(2), part.column(3)])
                key, pair, total = [], [], np.zeros(hi - at, np.int64)
                for lo, _, buf, offs in texts(both, 1 << 22):
                    k, d = shingles(buf, offs)
                    key.append(k)
                    pair.append((d + lo) % (hi - at))
                key, pair = np.concatenate(key), np.concatenate(pair)
                total = np.bincount(pair, minlength=hi - at)
                order = np.lexsort((key, pair))
                key, pair = key[order], pair[order]
                twice = (key[1:] == key[:-1]) & (pair[1:] == pair[:-1])
                common = np.bincount(pair[1:][twice], minlength=hi - at)
                ok = (common * DEN >= (total - common) * NUM) & (common > 0)
                yield part.filter(pa.array(ok)).select([0, 1])
                at = hi

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sketch: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct candidate pairs (a, b), those that the union sketch lets pass and the full sets confirm."""
    side = lambda x: sketch.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM)
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
    both = both.withColumn("u", union).withColumn("c", F.size(F.array_intersect("u", F.array_intersect("sa", "sb"))))
    whole = (F.size("sa") == F.col("na")) & (F.size("sb") == F.col("nb")) & (F.size("u") < K)
    near = both.filter(F.when(whole, F.col("c") * DEN >= F.size("u") * NUM).otherwise(F.col("c") >= _least_common()))
    near = stage(near.select("a", "b"), "near")
    wanted = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
    held = stage(checked_join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), wanted, "doc_id", "left_semi", 16), "texts")
    text = lambda x: held.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    links = stage(_overlaps(near.join(text("a"), "a").join(text("b"), "b")).distinct(), "links")
    unstage(near, held)
    return links


def _lists(reps: DataFrame) -> DataFrame:
    """Inverted lists (v, doc_id, n) of the values under which a pair that is similar enough must meet.

    A sketch that is the whole set meets a similar one in ceil(0.75 n) values, a full one in _least_common() of K;
    so a pair meets among the rarest size - least + 1 values of both, with rarity counted over all documents.
    Values that one document holds need no list but take their place among the rarest. A list is split by size
    class, so that only sizes within 4:3 meet, each document standing in its class and the next.
    """
    size = F.size("sketch")
    least = F.when(F.col("n") > size, F.lit(_least_common())).otherwise(F.least(F.ceil(F.col("n") * NUM / DEN), F.when(F.col("n") * DEN > K * NUM, F.lit(_least_common())).otherwise(F.lit(K))))
    flat = reps.select("doc_id", "n", (size - least + 1).cast("int").alias("places"), size.alias("size"), F.explode("sketch").alias("v"))
    often = flat.groupBy("v").agg(F.count("*").alias("f")).filter("f > 1")
    often = stage(often, "often")
    total = reps.count()
    shared = join_groups(flat, often, "v", "f", F.col("doc_id"), max(total, 1)).filter("f is not null")
    per = Window.partitionBy("doc_id")
    at = F.row_number().over(per.orderBy("f", "v"))
    shared = shared.withColumn("at", at).withColumn("common", F.count("*").over(per)).filter("at + size - common <= places")
    shared = shared.withColumn("rank", F.col("common") * K / F.col("size"))
    kind = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int")
    return shared.select(F.explode(F.array(kind, kind + 1)).alias("kind"), "v", "doc_id", "n", "rank").select(F.xxhash64("v", "kind").alias("v"), "doc_id", "n", "rank")


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, set): the whole shingle set of each document, ascending."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(1)):
                key, at = shingles(buf, offs)
                ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=hi - lo)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))], ["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set array<long>")


def _dense_links(docs: DataFrame, dense: DataFrame) -> DataFrame:
    """Links across components among documents of long lists, dense (doc_id, c).

    These share most values with many others, so rarity does not part them. They meet under the HEAD least hashes
    of their whole sets (a similar pair shares none with a probability of 0.25 to the power HEAD) and are compared
    exactly there, once a pair, under the least hash they share; only confirmed links leave the join.
    """
    there = checked_join(docs, dense.select("doc_id"), "doc_id", "left_semi", 16)
    full = _sets(there).join(dense, "doc_id").withColumn("head", F.slice("set", 1, HEAD))
    flat = stage(full.select("doc_id", "c", "head", "set", F.explode("head").alias("v")), "dense")
    x, y = flat.alias("x"), flat.alias("y")
    meet = "x.v = y.v and x.doc_id < y.doc_id and x.c <> y.c and least(size(x.set), size(y.set)) * 4 >= greatest(size(x.set), size(y.set)) * 3"
    once = "array_min(array_intersect(x.head, y.head)) = x.v"
    near = "size(array_intersect(x.set, y.set)) * 7 >= (size(x.set) + size(y.set)) * 3"
    return x.join(y.hint("merge"), F.expr(f"{meet} and {once} and {near}")).select(F.expr("x.doc_id as a"), F.expr("y.doc_id as b"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs (doc_id, text).

    Documents with equal shingle sets are one class, represented by its smallest doc_id; only representatives are
    compared. In each inverted list all members first meet its most central one, which shares most of its values
    with others. Where a list then still spans several components, its members meet across them, so no link between
    components is left untried. Each pair passes the union-sketch estimate, then an exact comparison of full sets. Null and empty texts have no
    shingles and link with nothing; repeated rows fall in one class; a null doc_id forms its own component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stage(sketches(docs), "sketch")
    classes = sketch.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    member = stage(join_groups(sketch.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")), classes, "digest", "size", F.col("doc_id"), max(sketch.count(), 1)).select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "member")
    copies = member.filter("doc_id <> rep").select("doc_id").distinct()
    reps = checked_join(sketch.filter("n > 0 and doc_id is not null").select("doc_id", "n", "sketch"), copies, "doc_id", "left_anti", 16)
    lists = stage(_lists(reps), "lists")
    lead = lists.groupBy("v").agg(F.max_by("doc_id", F.struct("rank", (-F.col("doc_id")).alias("k"))).alias("lead"), F.count("*").alias("size")).filter("size > 1")
    met = join_groups(lists.select("v", "doc_id"), lead, "v", "size", F.col("doc_id"), max(lists.count(), 1)).filter("lead <> doc_id")
    tried = stage(met.select(F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b")).distinct(), "tried")
    links = [_linked(tried, reps, docs)]
    comp = stage(components(links[0]), "comp")
    named = lists.join(comp, lists.doc_id == comp.id, "left").select("v", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    named = stage(named, "named")
    split = named.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    rest = join_groups(named, split, "v", "size", F.col("doc_id"), max(lists.count(), 1)).filter("lo is not null").select("v", "doc_id", "n", "c", "size")
    rest = stage(rest, "rest")
    few = rest.filter(F.col("size") <= LIST)
    x, y = few.alias("x"), few.alias("y")
    more = x.join(y, F.expr("x.v = y.v and x.c <> y.c and x.doc_id < y.doc_id and least(x.n, y.n) * 4 >= greatest(x.n, y.n) * 3"))
    more = more.select(F.expr("x.doc_id as a"), F.expr("y.doc_id as b")).distinct().join(tried, ["a", "b"], "left_anti")
    if not rest.isEmpty():
        links.append(_linked(stage(more, "more"), reps, docs))
        dense = rest.filter(F.col("size") > LIST).select("doc_id", "c").distinct()
        links.append(stage(_dense_links(docs, stage(dense, "dense")), "links"))
        comp = stage(components(reduce(DataFrame.union, links)), "comp")
    unstage(lists, tried, named, rest)
    far = comp.filter("id <> component").withColumnRenamed("id", "rep")
    out = checked_join(member, far, "rep", "left", 32)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(False)))


def keep_near(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates, with its columns: the smallest doc_id, nulls last.

    Rows are told apart by a number of their own, so repeated rows, null ids and ids that several texts share are
    rows like others.
    """
    rows = numbered(docs, "numbered")
    groups = near_groups(rows.select(F.col("_uid").alias("doc_id"), "_row.text")).select(F.col("doc_id").alias("_uid"), F.col("component_id").alias("c"))
    sizes = stage(groups.groupBy("c").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    total = max(rows.count(), 1)
    member = join_groups(groups, sizes, "c", "size", F.col("_uid"), total).filter("size is not null")
    member = stage(checked_join(rows.select("_uid", F.col("_row.doc_id").alias("id")), member, "_uid", "inner", 32), "groups")
    best = member.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_uid")).alias("best"), F.count("*").alias("many"))
    gone = join_groups(member.select("_uid", "c"), best, "c", "many", F.col("_uid"), total).filter("best._uid <> _uid").select("_uid")
    return checked_join(rows, stage(gone, "gone"), "_uid", "left_anti", 16).select("_row.*")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n
"""
