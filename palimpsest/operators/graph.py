"""Call and reference edges: lookup, call order, enclosing symbols; fusion with semantic results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

EDGES = "array<struct<kind:string,name:string,line:int,column:int>>"


def edges_of_calls(chunks: DataFrame) -> DataFrame:
    """chunks (version_id, calls array<struct<name,line,column>>) to call edges by full and, where it differs, short name."""
    flat = chunks.select("version_id", F.explode("calls").alias("c"))
    short = F.element_at(F.split(F.col("c.name"), r"\."), -1)
    names = F.array_distinct(F.array(F.col("c.name"), short))
    return flat.select("version_id", F.explode(names).alias("name"), F.col("c.line").alias("line"), F.col("c.column").alias("column"))


def structural_edges(chunks: DataFrame) -> DataFrame:
    """chunks to (kind, name, version_id, path, symbol, start_line, end_line, line, column): symbols, imports, references, calls.

    Each call gives an edge under its full name and, where that differs, one under its last part. Null lists give none.
    """
    none = F.lit(None).cast("int")
    edge = lambda kind, name, line=none, column=none: F.struct(F.lit(kind).alias("kind"), name.alias("name"), line.alias("line"), column.alias("column"))
    own = F.filter(F.array(edge("symbols", F.col("symbol"))), lambda x: x["name"].isNotNull())
    lists = lambda name, kind: F.coalesce(F.transform(name, lambda x: edge(kind, x)), F.array().cast(EDGES))
    named = lambda c: F.array_distinct(F.array(c["name"], F.element_at(F.split(c["name"], r"\."), -1)))
    called = F.flatten(F.transform("calls", lambda c: F.transform(named(c), lambda n: edge("calls", n, c["line"], c["column"]))))
    every = F.concat(own, lists("imports", "imports"), lists("referenced_identifiers", "references"), F.coalesce(called, F.array().cast(EDGES)))
    flat = chunks.select("version_id", "path", "symbol", "start_line", "end_line", F.explode(every).alias("e"))
    return flat.select("e.kind", "e.name", "version_id", "path", "symbol", "start_line", "end_line", "e.line", "e.column")


def call_order(edges: DataFrame, first: str, second: str) -> DataFrame:
    """The chunks where first comes before second: the earliest first, then the earliest second behind it.

    Names are told apart by letters alone, not case; a call of a.b.c is one of c, b.c and a.b.c.
    """
    place = F.struct("line", "column")
    low = F.lower("name")
    named = lambda term: (low == term.lower()) | F.endswith(low, F.lit(f".{term.lower()}"))
    a = edges.filter(named(first)).groupBy("version_id").agg(F.min(place).alias("a"))
    b = edges.filter(named(second)).select("version_id", place.alias("b"))
    return a.join(b, "version_id").filter("b > a").groupBy("version_id").agg(F.first("a").alias("a"), F.min("b").alias("b"))


def references(edges: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """edges (name, kind, place...) of the terms, by term, then kind (calls, references, symbols), first of a place wins."""
    order = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("name"))
    bucket = F.array_position(F.array(F.lit("calls"), F.lit("references"), F.lit("symbols")), F.col("kind"))
    found = edges.filter(F.col("name").isin(terms)).withColumn("_t", order).withColumn("_b", bucket)
    w = Window.partitionBy("path", "symbol", "start_line").orderBy("_t", "_b", "version_id")
    kept = found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").orderBy("_t", "_b", "version_id").limit(limit)
    return kept.withColumn("evidence", F.when(F.col("kind") == "symbols", "definition").otherwise("reference")).drop("_t", "_b", "_r")


def _parents(rows: list[tuple]) -> list[str | None]:
    """For spans (start, end, symbol) in order of start and falling end, the symbol of the shortest strictly longer one around each.

    A tree over ends holds, for each end and beyond, the shortest span so far; spans with one start and end see what
    came before all of them.
    """
    ends = sorted({e for _, e, _ in rows}, reverse=True)
    place = {e: i + 1 for i, e in enumerate(ends)}
    tree: list[tuple | None] = [None] * (len(ends) + 1)
    out, held, at = [], [], None
    for start, end, symbol in rows:
        if (start, end) != at:
            for s, e, x in held:
                new, i = (e - s, s, x), place[e]
                while i < len(tree):
                    if tree[i] is None or new < tree[i]:
                        tree[i] = new
                    i += i & -i
            held, at = [], (start, end)
        held.append((start, end, symbol))
        best, i = None, place[end]
        while i:
            if tree[i] is not None and (best is None or tree[i] < best):
                best = tree[i]
            i -= i & -i
        out.append(best[2] if best else None)
    return out


def enclosing(spans: DataFrame) -> DataFrame:
    """spans (path, symbol, start, end) with parent, the symbol of the shortest strictly longer span around each.

    Of equals the first one by start, then symbol. A path's spans are read once in order of their starts, so the work
    of a file of n spans is n log n, and no pairs are made. Null symbols are empty here; rows without both ends are
    left out.
    """
    own = spans.filter("start is not null and end is not null").select(F.col("path").cast("string").alias("_p"), F.col("start").cast("long").alias("_s"), F.col("end").cast("long").alias("_e"), F.coalesce("symbol", F.lit("")).alias("_y"), F.struct("*").alias("_row"))
    kind = own.schema["_row"].dataType

    def run(batches):
        held: list[tuple] = []
        parts: list[pa.Array] = []
        found: list[str | None] = []
        at = None
        for batch in batches:
            paths, starts, ends, names = (batch.column(i).to_pylist() for i in range(4))
            closed = 0
            for i, path in enumerate(paths):
                if path != at:
                    found += _parents(held)
                    held, at, closed = [], path, i
                held.append((starts[i], ends[i], names[i]))
            if found:
                rows = pa.concat_arrays([*parts, batch.column(4).slice(0, closed)])
                yield pa.RecordBatch.from_arrays([rows, pa.array(found, pa.string())], ["row", "parent"])
                found, parts = [], []
                parts.append(batch.column(4).slice(closed))
            else:
                parts.append(batch.column(4))
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(parts), pa.array(_parents(held), pa.string())], ["row", "parent"])

    sort = own.repartition("_p").sortWithinPartitions("_p", "_s", F.desc("_e"))
    out = sort.mapInArrow(run, StructType([StructField("row", kind), StructField("parent", StringType())]))
    return out.select("row.*", "parent")


def fuse(semantic: DataFrame, structural: DataFrame, query_type: str) -> DataFrame:
    """semantic (id, score) and structural (id, evidence) in one order.

    Scores are scaled to their range; evidence adds its boost; what both found is mixed.
    """
    range_ = semantic.agg(F.min("score").alias("_lo"), F.greatest(F.max("score") - F.min("score"), F.lit(1e-9)).alias("_span"))
    sem = semantic.crossJoin(F.broadcast(range_)).select("id", ((F.col("score") - F.col("_lo")) / F.col("_span")).alias("s"))
    boost = F.when(F.col("evidence") == "structural", 0.90).when(F.lit(query_type == "structural"), 0.15).otherwise(0.35)
    bonus = F.when(F.lit(query_type == "usage") & F.col("evidence").isin("reference", "call", "definition"), 0.15).otherwise(0.0)
    kinds = structural.groupBy("id").agg(F.sum(boost + bonus).alias("b"), F.countDistinct("evidence").alias("k"), F.max("evidence").alias("e"))
    both = sem.join(kinds, "id", "full_outer")
    evidence = F.when(F.col("e").isNull(), "semantic").when(F.col("k") > 1, "mixed").otherwise(F.col("e"))
    both = both.withColumn("evidence", evidence)
    extra = F.when(F.col("evidence").isin("reference", "structural", "mixed"), 0.05).otherwise(0.0)
    return both.select("id", "evidence", F.round(F.coalesce("s", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)) + extra, 6).alias("score"))
