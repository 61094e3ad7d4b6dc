"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.storage import BROADCAST_BYTES, new_path, stage

#: Rows of a block, and blocks of a source whose slots are one row of the schedule.
BLOCK, PERIOD = 32, 1024
#: Slots of a frame, which one call plans, at least, and for each of its sources; the longest window is such a bound too.
FRAME, PER_SOURCE = 8192, 64
#: Slots that executed() looks at together, and numbers of phases that the driver holds before it writes them.
SPAN, HELD = 1 << 20, 1 << 20

PHASE = "at long, slots long, step long, sources array<string>, whole array<string>, first array<long>, blocks array<long>"


def _exact(numbers: list[int], t: int) -> np.ndarray:
    """The numbers as an array in which products with t stay exact."""
    safe = max(numbers) * (t + 1) + 2 * sum(numbers) < 1 << 62
    return np.array(numbers, np.int64 if safe else object)


def executed(whole: list[int], t: int, blocks: list[int] | None = None) -> np.ndarray:
    """Blocks that each source has placed after t slots of earliest-deadline-first, without running them.

    Source s has the share whole[s] / sum(whole): its block k is released at floor(k / share) and due at
    ceil((k + 1) / share). By t each source has placed all blocks due by then, and of the sources within a block's
    window some have placed that block too. With unit blocks, these are what a greedy choice by deadline (ties by
    source) takes, which passes over a block only if the slots since some release cannot hold it beside what is due.
    The work is in proportion to the longest window that is open at t.
    """
    w, total = _exact(whole, t), sum(whole)
    done = w * t // total
    part = np.flatnonzero(w * t % total)
    if blocks is not None:
        part = part[done[part] < np.array(blocks)[part]]
    free = t - int(done.sum())
    if not free or not len(part):
        return done
    release, due = (done[part] * total // w[part]).astype(np.int64), -(-(done[part] + 1) * total // w[part])
    starts = np.unique(release)
    room, hi, held = np.full(len(starts), t), t, 0
    while hi > starts[0]:
        lo = max(int(starts[0]), hi - SPAN)
        first = -(-w * lo // total)
        n = np.maximum(np.minimum(done, -(-w * hi // total)) - first, 0).astype(np.int64)
        s = np.repeat(np.arange(len(w)), n)
        k = first[s] + (np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n))
        due_by = held + np.cumsum(np.bincount((k * total // w[s] - lo).astype(np.int64), minlength=hi - lo)[::-1])[::-1]
        u = np.arange(lo, min(hi, int(starts[-1]) + 1))
        if len(u):
            j = np.searchsorted(starts, u)
            go = np.flatnonzero(np.diff(j, prepend=-1))
            room[j[go]] = np.minimum(room[j[go]], np.minimum.reduceat(t - u - due_by[: len(u)], go))
        hi, held = lo, int(due_by[0])
    at = np.searchsorted(starts, release)
    for i in sorted(range(len(part)), key=lambda i: (due[i], i)):
        if room[: at[i] + 1].min() > 0:
            room[: at[i] + 1] -= 1
            done[part[i]] += 1
            free -= 1
            if not free:
                break
    return done


def frame(whole: list[int], lo: int, hi: int, blocks: list[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of slots lo to hi, earliest deadline first among the released; ties by source.

    Frames can be planned in any order: what came before lo follows from executed().
    """
    total = sum(whole)
    later = []
    for s, k in enumerate(executed(whole, lo).tolist()):
        if blocks is None or k < blocks[s]:
            later.append((k * total // whole[s], -(-(k + 1) * total // whole[s]), s, k))
    heapq.heapify(later)
    ready = []
    for t in range(lo, hi):
        while later and later[0][0] <= t:
            _, due, s, k = heapq.heappop(later)
            heapq.heappush(ready, (due, s, k))
        if not ready:
            return
        _, s, k = heapq.heappop(ready)
        yield s, k, t
        k += 1
        if blocks is None or k < blocks[s]:
            heapq.heappush(later, (k * total // whole[s], -(-(k + 1) * total // whole[s]), s, k))


def phases(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(first slot, slots, sources, whole, first blocks, blocks left) of each phase.

    A phase runs until the first source has placed its last block, at that block's deadline; the next one plans the
    others with their weights scaled up. Weights are taken as they are: within a phase a source is less than one
    block away from its share of the slots, however long the phase. There are at most as many phases as sources.
    """
    names = sorted((s for s, n in blocks.items() if n), key=lambda s: (str(s), s is None))
    exact = {s: Fraction(weights[s]) for s in names}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    left, first, at = {s: blocks[s] for s in names}, dict.fromkeys(names, 0), 0
    while names:
        whole = [int(exact[s] * scale) for s in names]
        total, rest = sum(whole), [left[s] for s in names]
        end = min(-(-n * total // w) for n, w in zip(rest, whole, strict=True))
        done = executed(whole, end, rest).tolist()
        yield at, end, names, whole, [first[s] for s in names], rest
        at += sum(done)
        for s, n in zip(names, done, strict=True):
            left[s] -= n
            first[s] += n
        names = [s for s in names if left[s]]


def schedule(spark: SparkSession, blocks: dict, weights: dict, period: int = PERIOD) -> DataFrame:
    """(_s, _part, _slots): the slots of each source's blocks, `period` blocks a row.

    The driver computes the phases, a number or two a source and phase, and writes them as it goes; tasks plan the
    frames of the phases independently of each other, each from the state that executed() gives for its start.
    """
    path, held, numbers = new_path(spark, "phases"), [], 0

    def write():
        spark.createDataFrame(held, PHASE).write.mode("append").parquet(path)

    for at, slots, names, whole, first, rest in phases(blocks, weights):
        step = min(slots, max(FRAME, PER_SOURCE * len(names), -(-sum(whole) // min(whole))))
        held.append((at, slots, step, names, [str(w) for w in whole], first, rest))
        numbers += 4 * len(names)
        if numbers > HELD:
            write()
            held, numbers = [], 0
    if held:
        write()

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                whole = [int(w) for w in r["whole"]]
                got = np.array(list(frame(whole, r["lo"], min(r["lo"] + r["step"], r["slots"]), r["blocks"])), np.int64).reshape(-1, 3)
                k = got[:, 1] + np.array(r["first"], np.int64)[got[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(r["sources"], pa.string()).take(pa.array(got[:, 0])), pa.array(k), pa.array(got[:, 2] + r["at"])], ["s", "k", "slot"])

    frames = spark.read.schema(PHASE).parquet(path).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.col("step"))))
    tasks = min(max(spark.sparkContext.defaultParallelism, frames.count()), 10_000)
    flat = frames.repartition(tasks, "at", "lo").mapInArrow(run, "s string, k long, slot long")
    part = F.floor(F.col("k") / period)
    slots = F.transform(F.sort_array(F.collect_list(F.struct("k", "slot"))), lambda x: x["slot"])
    return flat.groupBy(F.col("s").alias("_s"), part.alias("_part")).agg(slots.alias("_slots"))


def tempered(counts: dict, power: float = 0.5) -> dict:
    """Weights that flatten the sources' sizes."""
    return {s: Fraction(round(n**power * 1000) or 1) for s, n in counts.items()}


def mix_sources(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """docs with columns mix_block, mix_slot and mix_position, which orders the mixed corpus.

    Rows of a source are shuffled by the MD5 of doc_id (ties by doc_id), cut into blocks, and each block gets its
    slot. weights: by source, any positive numbers; a source without one, and by default all, has the square root
    of its rows. All rows stay: sources that run out leave their share to the others. A null source is a source of
    its own; a null doc_id sorts by the MD5 of the empty text; repeated rows are rows. The driver holds the sources
    and a bounded part of the phases; blocks are planned in tasks (schedule), `period` of them a row. Ranks are found
    by buckets of hashes, so no source meets in one task. Columns of docs keep their values whatever their names, but
    for the three added here, which are replaced.
    """
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    keyed = docs.select(F.struct("*").alias("_row"), "source", "doc_id", h.alias("_h"))
    light = keyed.select("source", F.substring("_h", 1, 4).alias("_p"))
    per = stage(light.groupBy("source", "_p").agg(F.count("*").alias("n")).withColumn("_q", F.substring("_p", 1, 2)), "prefixes")
    counts = {r.source: r.n for r in per.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return docs.select("*", F.lit(0).cast("long").alias("mix_block"), F.lit(0).cast("long").alias("mix_slot"), F.lit(0).cast("long").alias("mix_position"))
    weights = tempered(counts) | {s: Fraction(w) for s, w in (weights or {}).items() if s in counts}
    blocks = {s: -(-n // block) for s, n in counts.items()}
    below = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell = lambda p: F.concat(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), F.lit("|"), p)
    wide = per.groupBy("source", "_q").agg(F.sum("n").alias("n"))
    wide = wide.select(cell("_q").alias("_wide"), below(Window.partitionBy("source").orderBy("_q")).alias("_a"))
    fine = per.select(cell("_p").alias("_cell"), cell("_q").alias("_wide"), below(Window.partitionBy("source", "_q").orderBy("_p")).alias("_b"))
    before = stage(fine.join(wide, "_wide").select("_cell", (F.col("_a") + F.col("_b")).alias("_before")), "before")
    keyed = keyed.withColumn("_cell", cell(F.substring("_h", 1, 4)))
    ranked = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "doc_id")) - 1).join(before, "_cell")
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in")).withColumn("mix_block", F.floor(F.col("_rank") / block))
    table = stage(schedule(docs.sparkSession, blocks, weights, period), "schedule")
    held = F.broadcast(table) if 8 * sum(blocks.values()) <= BROADCAST_BYTES else table
    placed = ranked.join(held, F.col("source").eqNullSafe(F.col("_s")) & (F.floor(F.col("mix_block") / period) == F.col("_part")))
    slot = F.get("_slots", (F.col("mix_block") % period).cast("int"))
    return placed.withColumn("mix_slot", slot).withColumn("mix_position", slot * block + F.col("_rank") % block).select("_row.*", "mix_block", "mix_slot", "mix_position")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs.select("doc_id", "source")).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")
