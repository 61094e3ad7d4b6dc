"""Hashed n-gram indicators of whole texts, and bounded samples to train on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytesops import LOWER, U, mix, prefix, spans, texts, words
from palimpsest.llm.storage import checked_join

Rows = tuple[np.ndarray, np.ndarray]

_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?\"'()[]{}")] = True


def byte_grams(buf: np.ndarray, offs: np.ndarray, bits: int = 15, n: int = 3) -> Rows:
    """(text, feature) of the distinct byte n-grams of each text, by text."""
    size = len(offs) - 1
    m = max(0, len(buf) - n + 1)
    doc = np.repeat(np.arange(size), np.diff(offs))
    inside = doc[:m] == doc[n - 1 :] if m else np.zeros(0, bool)
    code = np.zeros(m, np.uint32)
    for i in range(n):
        code = code * np.uint32(256) + buf[i : i + m]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    seen = np.zeros(size << bits, bool)
    seen[(doc[:m][inside] << bits) + code[inside]] = True
    at = np.flatnonzero(seen)
    return at >> bits, at & ((1 << bits) - 1)


def _firsts(x: np.ndarray) -> np.ndarray:
    """Which of sorted values are the first of their kind."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def word_grams(buf: np.ndarray, offs: np.ndarray, bits: int = 20, heads: tuple[int, ...] = (4, 5, 6, 7)) -> Rows:
    """(text, feature) of the distinct lower-cased words of each text, without marks, and of their beginnings.

    A beginning is one feature where a word of the text has it and one more where two different words have it.
    """
    clean = LOWER[buf]
    clean[_MARKS[clean]] = 32
    start, end, doc = words(clean, offs)
    pre = prefix(clean)
    h = spans(pre, start, end)
    order = np.argsort((doc.astype(U) << U(48)) | (h >> U(16)))
    one = order[_firsts(((doc.astype(U) << U(48)) | (h >> U(16)))[order])]
    start, end, h, text = start[one], end[one], h[one], doc[one].astype(U) << U(bits)
    head, size, mask = [], end - start, U((1 << bits) - 1)
    for n in heads:
        long = np.flatnonzero(size > n)
        head.append(text[long] | (mix(spans(pre, start[long], start[long] + n) + U(n)) >> U(64 - bits)))
    head = np.sort(np.concatenate(head))
    first = _firsts(head)
    again = head[first & np.append(~first[1:], False)]
    again = (again & ~mask) | (mix((again & mask) + U(1)) >> U(64 - bits))
    key = np.sort(np.concatenate((text | (mix(h) >> U(64 - bits)), head[first], again)))
    key = key[_firsts(key)]
    return (key >> U(bits)).astype(np.int64), (key & mask).astype(np.int64)


def sample(docs: DataFrame, rows: DataFrame, most: int, grams: Callable, seed: int, kind: type = np.int32) -> tuple[list[np.ndarray], np.ndarray]:
    """Features, as numbers of a kind, and label of at most `most` of rows (doc_id, y), those with the least hash of doc_id.

    The driver holds `most` rows of at most as many features as the hash has values, whatever the size of docs;
    the arrays are views of what was received, in order of doc_id and label.
    """
    order = F.xxhash64("doc_id", F.lit(seed))
    picked = rows.orderBy(order, "doc_id", "y").limit(most)
    width = np.dtype(kind).itemsize

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(1)):
                at, f = grams(buf, offs)
                ends = (np.searchsorted(at, np.arange(hi - lo + 1)) * width).astype(np.int32)
                raw = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(f.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), raw], ["doc_id", "y", "f"])

    got = checked_join(docs.select("doc_id", "text"), picked, "doc_id", "inner", 24).select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, f binary")
    table = got.toArrow()
    y, ids = table.column("y").to_numpy(), table.column("doc_id").to_numpy()
    raw = [x.as_buffer() for chunk in table.column("f").chunks for x in chunk]
    first = np.lexsort((y, ids))
    return [np.frombuffer(raw[i], kind) if raw[i].size else np.zeros(0, kind) for i in first], y[first]


def scores(docs: DataFrame, grams: Callable, score: Callable[[Rows, int], np.ndarray]) -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score(grams(buf, offs), hi - lo))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def passing(docs: DataFrame, test: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """The rows of docs whose whole text (null is empty) passes test(bytes, offsets, rows), in one pass without a join."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(test(buf, offs, hi - lo)))

    return docs.mapInArrow(run, docs.schema)


def remainder(modulus: int):
    """crc32 of doc_id as text modulo a number; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus
