"""Benchmark decontamination: BM25 inverted index with block-max WAND, then overlap of question and answer."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytesops import LOWER, prefix, spans, texts, words
from palimpsest.llm.features import passing
from palimpsest.llm.storage import stage

K1, B = 1.2, 0.75
#: Items of a block of the index, and of an index: a larger benchmark is searched index by index.
BLOCK, SHARD = 4, 100_000
#: A passage has twice as many words as the longest item of its class, and starts at its middle again. The classes are
#: items of up to SHORT words and then of up to twice as many each, so an item's passages depend on its own length.
SHORT = 64
#: Share of an item's own BM25 score that a passage must reach, and of both halves' 3-word shingles it must hold.
SCORE, OVERLAP = 0.5, 0.5

_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?\"'()[]{}|*#%&$")] = True


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each lower-cased word without marks."""
    clean = LOWER[buf]
    clean[_MARKS[clean]] = 32
    start, end, doc = words(clean, offs)
    return spans(prefix(clean), start, end).view(np.int64), doc


def halves(text: str) -> int:
    """Byte at which an item's answer begins: after the last question mark, else after half of its words."""
    cut = text.rfind("?") + 1
    if 0 < cut < len(text.rstrip()):
        return len(text[:cut].encode())
    parts = text.encode().split()
    return len(b" ".join(parts[: (len(parts) + 1) // 2])) if parts else 0


def _grams(h: np.ndarray) -> set:
    x = h.tolist()
    return {tuple(x[i : i + 3]) for i in range(len(x) - 2)} or ({tuple(x)} if x else set())


def _words(items: list[str]) -> list[np.ndarray]:
    """Hashes of each item's words."""
    out = [np.zeros(0, np.int64)] * len(items)
    for lo, hi, buf, offs in texts(pa.array(items, pa.string())):
        h, doc = _tokens(buf, offs)
        ends = np.searchsorted(doc, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            out[lo + i] = h[ends[i] : ends[i + 1]]
    return out


def _class(words_: int) -> int:
    """Words of the longest item in the class of an item of so many words."""
    size = SHORT
    while size < words_:
        size *= 2
    return size


class Index:
    """Postings (item, impact) by term, with each block's largest impact; impacts are shares of an item's own score.

    n items of mean words, df of which hold a term, are those of the whole benchmark, whatever part of it is indexed
    here; left out, they are this part's. window: words of a passage, twice those of the longest item.
    """

    def __init__(self, ids: list, items: list[str], n: int | None = None, mean: float | None = None, df: dict | None = None):
        toks = _words(items)
        self.ids, self.length = ids, np.array([len(t) for t in toks])
        self.window = 2 * _class(int(self.length.max(initial=0)))
        tf = [tuple(x.tolist() for x in np.unique(t, return_counts=True)) for t in toks]
        if df is None:
            df, n, mean = {}, len(items), self.length.mean() if len(items) else 1.0
            for u, _ in tf:
                for x in u:
                    df[x] = df.get(x, 0) + 1
        self.terms = np.array(sorted({x for u, _ in tf for x in u}), np.int64)
        number = {t: i for i, t in enumerate(self.terms.tolist())}
        self.items = [[] for _ in number]
        self.impacts = [[] for _ in number]
        for i, (u, c) in enumerate(tf):
            w = [math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * k * (K1 + 1) / (k + K1 * (1 - B + B * self.length[i] / mean)) for x, k in zip(u, c, strict=True)]
            own = sum(w)
            for x, y in zip(u, w, strict=True):
                self.items[number[x]].append(i)
                self.impacts[number[x]].append(y / own)
        self.best = np.array([max(x) for x in self.impacts]) if number else np.zeros(0)
        self.blocks = [{} for _ in number]
        for t, (at, w) in enumerate(zip(self.items, self.impacts, strict=True)):
            for i, x in zip(at, w, strict=True):
                self.blocks[t][i // BLOCK] = max(x, self.blocks[t].get(i // BLOCK, 0.0))
        self.runs = np.concatenate(([0], np.cumsum([len(x) for x in self.blocks]))).astype(np.int64)
        self.run_block = np.array([b for x in self.blocks for b in x], np.int64)
        self.run_best = np.array([w for x in self.blocks for w in x.values()])
        self.question, self.answer = [], []
        for text in items:
            raw = (text or "").encode()
            cut = halves(text or "")
            part = []
            for x in (raw[:cut], raw[cut:]):
                b = np.frombuffer(x, np.uint8)
                part.append(_grams(_tokens(b, np.array([0, len(b)]))[0]) if len(b) else set())
            self.question.append(part[0])
            self.answer.append(part[1])

    def wand(self, terms: list[int], least: float = SCORE) -> list[tuple[int, float]]:
        """(item, score) of every item whose score reaches least, skipping blocks whose bound does not."""
        lists = [[self.items[t][0], 0, t] for t in terms]
        out, last = [], len(self.ids)
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.best[t]
                if bound >= least - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.blocks[t].get(block, 0.0) for _, _, t in lists[: pivot + 1]) >= least - 1e-12:
                if lists[0][0] == item:
                    score = sum(self.impacts[t][p] for i, p, t in lists[: pivot + 1] if i == item)
                    if score >= least - 1e-12:
                        out.append((item, score))
                    to = item + 1
                else:
                    to = item
            else:
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = max(item + 1, min(to, lists[pivot + 1][0]))
            for entry in lists[: pivot + 1]:
                if entry[0] < to:
                    at = self.items[entry[2]]
                    entry[1] = bisect_left(at, to, entry[1])
                    entry[0] = at[entry[1]] if entry[1] < len(at) else last
            lists = [entry for entry in lists if entry[0] < last]
        return out

    def _block_reach(self, owner: np.ndarray, term: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """Of the passages whose terms' bounds reach SCORE, which reach it in some block; terms are by passage."""
        some = np.flatnonzero(distinct >= SCORE - 1e-9)
        number = np.full(len(distinct), -1)
        number[some] = np.arange(len(some))
        mine = number[owner] >= 0
        who, what = number[owner[mine]], term[mine]
        out = np.zeros(len(some), bool)
        if not len(some):
            return out
        blocks = len(self.ids) // BLOCK + 1
        cuts = np.searchsorted(who, np.arange(0, len(some), max(1, 4_000_000 // blocks)))
        for lo, hi in zip(cuts, [*cuts[1:], len(who)], strict=True):
            if lo == hi:
                continue
            n = np.diff(self.runs)[what[lo:hi]]
            at = np.repeat(self.runs[what[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat(who[lo:hi] - who[lo], n) * blocks + self.run_block[at]
            top = np.bincount(cell, weights=self.run_best[at], minlength=(who[hi - 1] - who[lo] + 1) * blocks)
            out[who[lo] : who[hi - 1] + 1] = top.reshape(-1, blocks).max(1) >= SCORE - 1e-9
        return out

    def search(self, h: np.ndarray, doc: np.ndarray, rows: int) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question share, answer share) of each verified passage of the texts."""
        if not len(self.terms) or not len(h):
            return []
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[at] == h
        bound = np.concatenate(([0.0], np.cumsum(np.where(hit, self.best[at], 0.0))))
        first = np.searchsorted(doc, np.arange(rows + 1))
        step = self.window // 2
        count = np.maximum(1, -(-(np.diff(first) - step) // step))
        text = np.repeat(np.arange(rows), count)
        begin = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
        end = np.minimum(begin + self.window, first[text + 1])
        found = []
        some = np.flatnonzero(bound[end] - bound[begin] >= SCORE - 1e-9)
        size = end[some] - begin[some]
        where = np.repeat(begin[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
        key = np.unique((np.repeat(np.arange(len(some)), size) * len(self.terms) + at[where])[hit[where]])
        owner, term = key // len(self.terms), key % len(self.terms)
        distinct = np.bincount(owner, weights=self.best[term], minlength=len(some))
        for j in np.flatnonzero(distinct >= SCORE - 1e-9)[self._block_reach(owner, term, distinct)]:
            i = some[j]
            lo, hi = begin[i], end[i]
            got = self.wand(term[np.searchsorted(owner, j) : np.searchsorted(owner, j, "right")].tolist())
            if got:
                grams = _grams(h[lo:hi])
                short = grams | {(x,) for x in h[lo:hi].tolist()} | {(x, y) for x, y in zip(h[lo : hi - 1].tolist(), h[lo + 1 : hi].tolist(), strict=True)}
                for item, score in got:
                    q, a = (len(part & short) / len(part) if part else 1.0 for part in (self.question[item], self.answer[item]))
                    if q >= OVERLAP and a >= OVERLAP:
                        found.append((int(text[i]), item, score, q, a))
        return found


def _statistics(items: DataFrame) -> tuple[DataFrame, int, float]:
    """(h, df) of every term of the benchmark, staged, the number of items and their mean words."""

    def run(batches):
        for batch in batches:
            toks = _words(batch.column(0).to_pylist())
            u = [np.unique(t) for t in toks]
            h, c = np.unique(np.concatenate([*u, np.zeros(0, np.int64)]), return_counts=True)
            size = np.array([sum(map(len, toks)), len(toks)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h, [0, 1])), pa.array(np.append(c, size)), pa.array(np.append(np.zeros(len(h), bool), [True, True]))], ["h", "c", "size"])

    found = stage(items.select("text").mapInArrow(run, "h long, c long, size boolean").groupBy("size", "h").agg(F.sum("c").alias("df")), "terms")
    size = {r.h: r.df for r in found.filter("size").collect()}
    return found.filter("not size").select("h", "df"), size.get(1, 0), size.get(0, 0) / max(size.get(1, 0), 1) or 1.0


def indexes(benchmark: DataFrame, shard: int | None = None) -> Iterator[Index]:
    """The benchmark's indexes, one after another: of each class of lengths, of `shard` items at most or so.

    All use the statistics of the whole benchmark, so neither the split nor other items' lengths change a result.
    """
    shard = shard or SHARD
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    terms, n, mean = _statistics(items)
    parts = max(1, -(-n // shard))
    split = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        rows = sorted(map(tuple, (items.filter(split == k) if parts > 1 else items).collect()), key=lambda r: (r[0] is None, r))
        toks = _words([r[1] for r in rows])
        mine = pa.table({"h": np.unique(np.concatenate([*toks, np.zeros(0, np.int64)]))})
        wanted = terms if parts == 1 else terms.join(benchmark.sparkSession.createDataFrame(mine.to_pandas()), "h", "left_semi")
        found = wanted.toArrow()
        df = dict(zip(found.column("h").to_pylist(), found.column("df").to_pylist(), strict=True))
        by = {}
        for r, t in zip(rows, toks, strict=True):
            by.setdefault(_class(len(t)), []).append(r)
        for size in sorted(by):
            yield Index([r[0] for r in by[size]], [r[1] for r in by[size]], n, mean, df)


def leaks(docs: DataFrame, benchmark: DataFrame, shard: int | None = None) -> DataFrame:
    """(doc_id, item_id, n_passages, score, question_overlap, answer_overlap) of each item that a document leaks.

    Every passage of every whole text queries the index; block-max WAND returns all items of which it reaches SCORE
    of the item's own BM25 score; an item is leaked where the passage then holds OVERLAP of the 3-word shingles of
    both its question and its answer. Passages overlap by half, so any stretch as long as an item lies within one;
    their length is that of the item's class. Items are indexed SHARD at a time, so a task holds one bounded index at
    once, with the statistics of the whole benchmark. Null and empty texts and items match nothing; repeated rows
    count their passages together; repeated items are items.
    """
    out = None
    for built in indexes(benchmark, shard):
        index = docs.sparkSession.sparkContext.broadcast(built)

        def run(batches, index=index):
            found = index.value
            for batch in batches:
                for lo, hi, buf, offs in texts(batch.column(1)):
                    got = found.search(*_tokens(buf, offs), hi - lo)
                    if got:
                        cols = list(zip(*got, strict=True))
                        at = pa.array(np.array(cols[0]) + lo)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([found.ids[i] for i in cols[1]], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]], ["doc_id", "item_id", "score", "q", "a"])

        hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, score double, q double, a double")
        out = hits if out is None else out.union(hits)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, q double, a double")
    return out.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_passages"), F.max("score").alias("score"), F.max("q").alias("question_overlap"), F.max("a").alias("answer_overlap"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, shard: int | None = None) -> DataFrame:
    """The rows of docs that leak no item, with their columns; each row is judged by its own text, whatever its id."""
    for built in indexes(benchmark, shard):
        index = docs.sparkSession.sparkContext.broadcast(built)

        def test(buf, offs, n, index=index):
            keep = np.ones(n, bool)
            keep[[r[0] for r in index.value.search(*_tokens(buf, offs), n)]] = False
            return keep

        docs = passing(docs, test)
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
