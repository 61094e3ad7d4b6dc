"""Substring dedup by sliding spans of consecutive sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytesops import U, mix, texts, word_hashes, words
from palimpsest.llm.storage import BROADCAST_BYTES, join_groups, stage, unstage

#: Sentences of a span at least.
RUN = 3
#: Words of a span at least: one of shorter sentences takes in more of them until it has as many.
LEAST_WORDS = 12
#: A sentence without an end mark ends after this many words, counted from the last end; so does a piece.
LONGEST = 16
#: A long sentence is cut after each word whose hash is below those of LEAST_OF words on either side, if it is neither
#: among the NO_END words on either side nor one of them is an end: so equal passages are cut alike wherever they begin.
LEAST_OF, NO_END = 2, 6

_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def _low(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words that end a piece of a long sentence by their hash; they depend on NO_END words on either side only."""
    n = np.arange(len(h))
    ends = np.concatenate(([0], np.cumsum(last)))
    low = (n >= NO_END) & (ends[np.minimum(n + NO_END + 1, len(h))] == ends[np.maximum(n - NO_END, 0)])
    v = mix(h)
    for i in range(1, NO_END + 1):
        low[i:] &= v[i:] < v[:-i] if i <= LEAST_OF else v[i:] != v[:-i]
        low[:-i] &= v[:-i] < v[i:] if i <= LEAST_OF else v[:-i] != v[i:]
    return low


def _limited(last: np.ndarray) -> np.ndarray:
    """Ends, and one more after every LONGEST words without."""
    n = np.arange(len(last))
    since = n - np.maximum.accumulate(np.where(np.concatenate(([True], last[:-1])), n, 0))
    return last | (since % LONGEST == LONGEST - 1)


def _sentences(buf: np.ndarray, offs: np.ndarray):
    """First byte, end byte, text number, words, two hashes, first and last sentence of every piece; text number of every sentence.

    A sentence ends with a word whose last byte is . ! or ?, at a line's end, at the text's end, and after LONGEST
    words. A piece ends there too, but where a sentence is long its words decide (LEAST_OF), and LONGEST counts from
    the last end of a piece; so a piece may reach over the end of a sentence that LONGEST words make. Hashes are of
    the lower-cased words, so spacing does not matter.
    """
    start, end, doc = words(buf, offs)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U), none.astype(U), none, none, none
    last = _END[buf[end - 1]]
    lines = np.concatenate(([0], np.cumsum(buf == 10)))
    last[:-1] |= (lines[start[1:]] > lines[end[:-1]]) | (doc[1:] != doc[:-1])
    last[-1] = True
    n = np.arange(len(start))
    h, _ = word_hashes(buf, offs)
    whole = _limited(last)
    sentence = np.cumsum(whole) - whole
    stop = np.flatnonzero(_limited(last | _low(h, last)))
    go = np.concatenate(([0], stop[:-1] + 1))
    both = []
    for salt in (1, 2):
        x = mix(h + U(salt)) * (U(2) * (n - np.repeat(go, stop - go + 1)).astype(U) + U(1))
        both.append(mix(np.add.reduceat(x, go)))
    return start[go], end[stop], doc[stop], stop - go + 1, *both, sentence[go], sentence[stop], doc[whole]


def _runs(doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of the span that begins at each piece; 0 where the text ends before it is whole."""
    n = np.arange(len(doc))
    total = np.concatenate(([0], np.cumsum(size)))
    end = np.maximum(n + RUN, np.searchsorted(total, total[:-1] + LEAST_WORDS))
    last = np.searchsorted(doc, doc, "right")
    return np.where(end <= last, end - n, 0)


def _spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, at, key): each shortest run of RUN pieces or more that has LEAST_WORDS words or more."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in texts(batch.column(2)):
                _, _, doc, size, h1, h2, *_ = _sentences(buf, offs)
                length = _runs(doc, size)
                pick = np.flatnonzero(length)
                key = []
                for h in (h1, h2):
                    k = np.zeros(len(pick), U)
                    for i in range(length.max(initial=0)):
                        there = length[pick] > i
                        k[there] += h[pick[there] + i] * U(2 * i + 3)
                    key.append(mix(k + length[pick].astype(U)))
                first = np.searchsorted(doc, doc[pick])
                raw = np.stack(key, axis=1).astype(">u8").tobytes()
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(pick), [None, pa.py_buffer(raw)]).cast(pa.binary())
                at = pa.array(doc[pick] + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((pick - first).astype(np.int32)), keys], ["row", "doc_id", "at", "key"])

    return docs.mapInArrow(run, "row long, doc_id long, at int, key binary")


def span_dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_sentences, n_removed, kept_text), a row for each row.

    Sentences are the pieces, but for long ones, which are cut into several by their words. At every piece the
    shortest run of RUN consecutive ones or more that has LEAST_WORDS words or more is hashed to 128 bits and joined
    over all documents. The run with the smallest (doc_id, row hash, position) is the first of its key; pieces that
    any other run of the key covers are removed, and the text that stays is what lies outside them. n_removed counts
    the sentences that lose a piece or part of one. Texts that are shorter than such a run are left alone. A row is
    known by its doc_id and a 64-bit hash of its text together. Null and empty texts have no sentences and stay empty; a null
    doc_id comes last; repeated rows are one row and keep or lose the same sentences.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # A repeated row gives the same places again; none of them differs from the first of its key, so none goes.
    spans = stage(_spans(rows), "spans")
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "row", "at")
    groups = spans.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("size")).filter("size > 1")
    again = join_groups(spans, stage(groups, "groups"), "key", "size", F.struct("row", "at"), max(spans.count(), 1)).filter(F.col("first").isNotNull() & (F.col("first") != place))
    gone = stage(again.groupBy("row", "doc_id").agg(F.sort_array(F.collect_set("at")).alias("ats")), "gone")
    unstage(spans)

    def cut(batches):
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for lo, hi, buf, offs in texts(batch.column(1)):
                begin, end, doc, size, _, _, head, tail, whole = _sentences(buf, offs)
                length = _runs(doc, size)
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                firsts = np.searchsorted(whole, np.arange(hi - lo + 1))
                n, out, lost = np.diff(firsts), [], []
                for i in range(hi - lo):
                    body = buf[offs[i] : offs[i + 1]].tobytes()
                    drop, hit = np.zeros(bounds[i + 1] - bounds[i], bool), np.zeros(n[i], bool)
                    for k in lists[lo + i] or ():
                        drop[k : k + length[bounds[i] + k]] = True
                        hit[head[bounds[i] + k] - firsts[i] : tail[bounds[i] + k + length[bounds[i] + k] - 1] - firsts[i] + 1] = True
                    lost.append(int(hit.sum()))
                    if lost[-1]:
                        parts, at = [], 0
                        for k in np.flatnonzero(drop):
                            b, e = int(begin[bounds[i] + k] - offs[i]), int(end[bounds[i] + k] - offs[i])
                            parts.append(body[at:b])
                            at = e
                        body = b"".join([*parts, body[at:]]).strip()
                    out.append(body.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(lost, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_sentences", "n_removed", "kept_text"])

    weight = gone.agg(F.sum(F.lit(64) + 4 * F.size("ats"))).first()[0] or 0
    gone = gone.select(F.col("row").alias("r"), F.col("doc_id").alias("d"), "ats")
    same = (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))
    held = rows.join(F.broadcast(gone) if weight <= BROADCAST_BYTES else gone, same, "left").select("doc_id", "text", "ats")
    return held.mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, kept_text string")


def op8_span_dedup(spark, sf_dir: str) -> DataFrame:
    """What span_dedup leaves of each document, as a digest of the text and the counts."""
    out = span_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", F.octet_length("kept_text").cast("long").alias("kept_bytes"), F.sha2("kept_text", 256).alias("kept_sha256"))
