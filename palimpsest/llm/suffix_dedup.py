"""Suffix-array dedup: column-wise construction of a collection's Burrows-Wheeler transform and common prefixes."""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.bytesops import U, _power, mix, prefix, spans, texts
from palimpsest.llm.storage import checked_join, join_groups, small, stage, unstage

#: Bytes of a repeated string, of an anchor within it, and windows on one side of an anchor.
LENGTH, GRAM = 400, 64
PLACES = LENGTH - GRAM + 1
HALF = PLACES // 2
#: Bytes of a symbol. A string of LENGTH bytes is LENGTH/WORD symbols in one of WORD phases.
WORD = 100
DEPTH = LENGTH // WORD
#: Bytes of pieces that one construction takes, windows of a narrowed piece, and pieces beyond which a key is narrowed.
BUCKET, NARROW, MANY = 512 << 10, 16, 400
#: Rows of a file that a construction holds at once.
BLOCK = 1 << 17
CHUNK = 1 << 20


def anchored(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of the texts: (first byte, windows, key, anchor - first byte).

    Every window of LENGTH bytes is anchored at its least-hashed GRAM bytes, the first of equals, so equal windows
    are anchored alike wherever they are. A piece is a run of windows with one anchor on one side of its middle;
    all its windows contain a core of more than half of LENGTH, whose hash is the key. Equal windows thus lie in
    pieces of one key, and a piece is at most LENGTH + HALF bytes long.
    """
    none = np.zeros(0, np.int64)
    n = len(buf)
    if n < LENGTH:
        return none, none, none, none
    pre = prefix(buf, 3)
    h = mix((pre[GRAM:] - pre[:-GRAM]) * _power("down", n + 1)[: n - GRAM + 1])
    low = U((1 << 21) - 1)
    h = (h & ~low) | np.arange(len(h), dtype=U)
    m = n - LENGTH + 1
    pad = np.concatenate((h, np.full(-len(h) % PLACES, ~U(0))))
    grid = pad.reshape(-1, PLACES)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:m], ahead[PLACES - 1 : PLACES - 1 + m]) & low).astype(np.int64)
    long = np.diff(offs) >= LENGTH
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, offs[:-1][long], 1)
    np.add.at(mark, offs[1:][long] - LENGTH + 1, -1)
    i = np.flatnonzero(np.cumsum(mark)[:m])
    if not len(i):
        return none, none, none, none
    p = at[i]
    left = p - i >= HALF
    new = np.ones(len(i), bool)
    new[1:] = (p[1:] != p[:-1]) | (left[1:] != left[:-1]) | (i[1:] != i[:-1] + 1)
    go = np.flatnonzero(new)
    size = np.diff(np.append(go, len(i)))
    first, p, left = i[go], p[go], left[go]
    begin = np.where(left, p - HALF, p)
    end = np.where(left, p + LENGTH - PLACES + 1, p + LENGTH - HALF + 1)
    key = spans(pre, begin, end) ^ np.where(left, U(0x9E3779B97F4A7C15), U(0))
    return first, size, key.view(np.int64), p - first


def _cut(col, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, byte within the row's text, bytes, offsets) like texts(), with very long texts in overlapping parts."""
    for lo, _, buf, offs in texts(col, limit):
        if len(offs) > 2 or len(buf) <= limit:
            yield lo, 0, buf, offs
            continue
        for at in range(0, max(1, len(buf) - LENGTH + 1), limit):
            part = buf[at : at + limit + LENGTH - 1]
            yield lo, at, part, np.array([0, len(part)])


def _pieces(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, at, buf, offs in _cut(batch.column(1)):
                first, size, key, ahead = anchored(buf, offs)
                doc = np.searchsorted(offs, first, "right") - 1
                place = (first - offs[doc] + at).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + lo)), pa.array(key), pa.array(place), pa.array(size.astype(np.int16)), pa.array(ahead.astype(np.int16))], ["row", "key", "at", "windows", "ahead"])

    return rows.select("row", "text").mapInArrow(run, "row binary, key long, at long, windows short, ahead short")


def _bodies(rows: DataFrame) -> DataFrame:
    """rows (row, text, spots) to the bytes of each spot."""

    def run(batches):
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            for i in range(batch.num_rows):
                body = text[i].as_py()
                spots = batch.column(2)[i].values
                key, at, windows, ahead = (spots.field(k).to_numpy() for k in range(4))
                part = [body[a : a + w + LENGTH - 1] for a, w in zip(at.tolist(), windows.tolist(), strict=True)]
                digest = [hashlib.blake2b(x, digest_size=16).digest() for x in part]
                row = pa.array([batch.column(0)[i].as_py()] * len(at), pa.binary())
                yield pa.RecordBatch.from_arrays([row, *map(pa.array, (key, at, windows, ahead)), pa.array(digest, pa.binary()), pa.array(part, pa.binary())], ["row", "key", "at", "windows", "ahead", "digest", "body"])

    return rows.select("row", "text", "spots").mapInArrow(run, "row binary, key long, at long, windows short, ahead short, digest binary, body binary")


def _narrowed(pieces: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct pieces of keys (key, n) under the key they are sorted by; those of crowded keys in runs of NARROW windows.

    A run's windows lie at the same places from the anchor in all pieces and share LENGTH - NARROW + 1 bytes, whose
    hash is its key; a crowd of variants of one passage is so dealt out by what they have in common.
    """
    marked = checked_join(pieces, keys.select("key", (F.col("n") > MANY).alias("crowd")), "key", "inner", 24)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key, n, ahead, body = row["key"], row["windows"], row["ahead"], row["body"]
                if not row["crowd"]:
                    out.append((key, key, row["digest"], 0, n, body))
                    continue
                w = 0
                while w < n:
                    top = (ahead - w) // NARROW * NARROW
                    size = min(n - w, ahead - w - top + 1)
                    core = body[w + (ahead - w - top) : w + (ahead - w - top) + LENGTH - NARROW + 1]
                    sub = int.from_bytes(hashlib.blake2b(core, digest_size=8, person=b"narrow").digest(), "big", signed=True)
                    out.append((sub, key, row["digest"], w, size, body[w : w + size + LENGTH - 1]))
                    w += size
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["sort", "key", "digest", "w", "windows", "body"])

    return marked.select("key", "windows", "ahead", "digest", "body", "crowd").mapInArrow(run, "sort long, key long, digest binary, w int, windows int, body binary")


def _symbols(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the WORD bytes at each place, equal for equal bytes; their hashes are checked against the bytes."""
    names = spans(prefix(data, 5), at, at + WORD)
    _, first, symbol = np.unique(names, return_index=True, return_inverse=True)
    symbol = symbol.astype(np.int64)
    wide = np.zeros(len(data) - 7, U)
    for i in range(8):
        wide |= data[i : i + len(wide)].astype(U) << U(8 * i)
    same, like = np.ones(len(at), bool), at[first[symbol]]
    for i in [*range(0, WORD - 7, 8), WORD - 8]:
        same &= wide[at + i] == wide[like + i]
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same):
        symbol[i] = len(first) + others.setdefault(data[at[i] : at[i] + WORD].tobytes(), len(others))
    return symbol


def _blocks(path: str, kind) -> Iterator[np.ndarray]:
    with open(path, "rb") as f:
        while len(x := np.fromfile(f, kind, BLOCK)):
            yield x


def transform(bodies: list[bytes], windows: list[int] | np.ndarray, folder: str) -> list[np.ndarray]:
    """For each body, which of its windows also occur elsewhere in the bodies.

    Each body is a text of symbols of WORD bytes in each of WORD phases. The texts are read from their ends, one
    symbol of each a round. After a round, three files hold all suffixes so far in order: the suffix, the common
    prefix with the one before it (DEPTH at most), and its first symbol with the place of the suffix that follows the
    symbol. That last file is the transform, sorted: a new suffix's place follows from its symbol and the place of
    the one that it extends. Neighbours that begin alike share one symbol more than the suffixes that they extend,
    which share the least of the prefixes between their places. Each round reads the files from start to end, BLOCK
    rows at a time, and writes them anew with the new suffixes merged in.
    """
    data = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies], np.int64)
    start = np.cumsum(size) - size
    windows = np.array(windows, np.int64)
    count = np.minimum(WORD, windows)
    body = np.repeat(np.arange(len(bodies)), count)
    phase = np.arange(len(body)) - np.repeat(np.cumsum(count) - count, count)
    length = (size[body] - phase) // WORD
    base = np.cumsum(length) - length
    at = np.arange(length.sum()) - np.repeat(base, length)
    byte = np.repeat(start[body] + phase, length) + at * WORD
    flat = np.zeros(windows.sum(), bool)
    first = np.concatenate(([0], np.cumsum(windows)))
    if not len(byte):
        return [flat[first[i] : first[i + 1]] for i in range(len(windows))]
    symbol = _symbols(data, byte)
    ends, n, mask = base + length, len(length), 0xFFFFFFFF
    name = {x: os.path.join(folder, x) for x in ("suffix", "prefix", "order")}
    kinds = {"suffix": np.int32, "prefix": np.uint8, "order": np.int64}
    for x, kind in kinds.items():
        np.zeros(0, kind).tofile(name[x])
    place = np.arange(n) - n
    for turn in range(int(length.max())):
        live = np.flatnonzero(length > turn)
        new = ends[live] - 1 - turn
        key = (symbol[new] << 32) + (place[live] + n)
        sort = np.argsort(key, kind="stable")
        key, new, live = key[sort], new[sort], live[sort]
        spot = np.zeros(len(key), np.int64)
        for x in _blocks(name["order"], np.int64):
            spot += np.searchsorted(x, key)
        put = place[live] = spot + np.arange(len(spot))
        low, seen = [[] for _ in range(DEPTH - 1)], 0
        for x in _blocks(name["prefix"], np.uint8):
            for d in range(1, DEPTH):
                low[d - 1].append(np.flatnonzero(x < d) + seen)
            seen += len(x)
        low = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in low]

        def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Common symbols of neighbours, from their keys and the prefixes of the round before."""
            ok, p, q = a >> 32 == b >> 32, (a & mask) - n, (b & mask) - n
            out = ok.astype(np.uint8)
            ok &= p >= 0
            for least in low:
                ok &= np.searchsorted(least, p, "right") == np.searchsorted(least, q, "right")
                out += ok
            return out

        def moved(p: np.ndarray) -> np.ndarray:
            return np.where(p < n, p, p + np.searchsorted(spot, p - n, "right"))

        files = {x: open(name[x] + ".new", "wb") for x in kinds}
        lo = done = 0
        last, fresh = -1, False
        none = tuple(np.zeros(0, k) for k in kinds.values())
        for rows, near, order in itertools.chain(zip(*(_blocks(name[x], k) for x, k in kinds.items()), strict=True), [none]):
            to = int(np.searchsorted(spot, lo + len(rows))) if len(rows) else len(spot)
            total = len(rows) + to - done
            if not total:
                continue
            added = np.zeros(total, bool)
            added[put[done:to] - lo - done] = True
            keys, out, common = np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total, np.uint8)
            keys[added], keys[~added] = key[done:to], order
            out[added], out[~added] = new[done:to], rows
            common[~added] = near
            touched = added.copy()
            touched[1:] |= added[:-1]
            touched[0] |= fresh
            common[touched] = shared(np.concatenate(([last], keys[:-1]))[touched], keys[touched])
            last, fresh = keys[-1], added[-1]
            lo, done = lo + len(rows), to
            for x, value in (("suffix", out), ("prefix", common), ("order", (keys & ~mask) | moved(keys & mask))):
                value.tofile(files[x])
        for x, f in files.items():
            f.close()
            os.replace(name[x] + ".new", name[x])
    text = np.repeat(np.arange(n), length)
    before = np.zeros(0, np.int32)
    for rows, near in zip(_blocks(name["suffix"], np.int32), _blocks(name["prefix"], np.uint8), strict=True):
        rows, near = np.concatenate((before, rows)), np.concatenate((np.zeros(len(before), np.uint8), near))
        full = near >= DEPTH
        full[:-1] |= full[1:]
        again, before = rows[full], rows[-1:]
        owner = body[text[again]]
        offset = byte[again] - start[owner]
        ok = offset < windows[owner]
        flat[first[owner[ok]] + offset[ok]] = True
    return [flat[first[i] : first[i + 1]] for i in range(len(windows))]


def _repeats(pieces: DataFrame) -> DataFrame:
    """(key, digest, runs) of the pieces' runs (window, windows) that occur in another piece too."""

    def run(batches):
        def flush(held):
            with tempfile.TemporaryDirectory() as folder:
                found = transform([r["body"] for r in held], [r["windows"] for r in held], folder)
            out = []
            for r, flags in zip(held, found, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
                out += [(r["key"], r["digest"], r["w"] + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["key", "digest", "w", "windows"])

        held, bytes_ = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if bytes_ > BUCKET and row["sort"] != held[-1]["sort"]:
                    yield flush(held)
                    held, bytes_ = [], 0
                held.append(row)
                bytes_ += len(row["body"])
        if held:
            yield flush(held)

    return pieces.mapInArrow(run, "key long, digest binary, w int, windows int")


def _single(crowd: DataFrame) -> DataFrame:
    """Like _repeats() for pieces whose key stays crowded after narrowing: every window of theirs on its own.

    Such pieces share all but a few bytes, so one text's many variants would meet in one construction. Their windows
    are counted under 128-bit hashes instead, however many there are.
    """

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += [(r["key"], r["digest"], r["w"] + i, hashlib.blake2b(r["body"][i : i + LENGTH], digest_size=16).digest()) for i in range(r["windows"])]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["key", "digest", "w", "window"])

    single = stage(crowd.select("key", "digest", "w", "windows", "body").mapInArrow(run, "key long, digest binary, w int, window binary"), "windows")
    again = stage(single.groupBy("window").agg(F.count("*").alias("size")).filter("size > 1"), "again")
    hit = join_groups(single, again, "window", "size", F.struct("key", "digest", "w"), max(single.count(), 1)).filter("size is not null")
    return hit.select("key", "digest", "w", F.lit(1).alias("windows"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), a row for each row of docs (doc_id, text).

    Removes every byte covered by a LENGTH-byte string that also starts elsewhere in any text, judged on the input.
    Texts are whole, as UTF-8; null is empty; strings do not cross texts. Windows are dealt out by the anchors they
    contain (see anchored); only pieces whose key occurs twice can repeat. Equal pieces are one with a count;
    one that occurs twice repeats whole. The distinct pieces of a key that has several are sorted by transform(), MANY of them at
    most in one task: crowded keys are narrowed, and what stays crowded is counted window by window. Repeated rows repeat each other and lose all that is
    long enough; a null doc_id is a doc_id like others.
    """
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    rows = docs.select(F.unhex(F.md5(name)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = stage(_pieces(rows), "pieces")
    often = stage(pieces.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "often")
    total = max(pieces.count(), 1)
    spots = join_groups(pieces, often, "key", "size", F.struct("row", "at"), total).filter("size is not null")
    spots = stage(spots.groupBy("row").agg(F.collect_set(F.struct("key", "at", "windows", "ahead")).alias("spots")), "spots")
    unstage(pieces, often)
    there = checked_join(rows, spots.select("row"), "row", "left_semi", 16)
    bodies = stage(_bodies(there.join(spots, "row")), "bodies")
    unstage(spots)
    distinct = bodies.groupBy("key", "digest").agg(F.count("*").alias("size"), F.first("windows").alias("windows"), F.first("ahead").alias("ahead"), F.first("body").alias("body"))
    distinct = stage(distinct, "distinct")
    keys = distinct.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes")).filter("n > 1")
    keys = stage(keys, "keys")
    amount = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(1, -(-amount // (8 * BUCKET)))
    narrow, crowds = _narrowed(distinct, keys), None
    if not keys.filter(F.col("n") > MANY).isEmpty():
        narrow = stage(narrow, "narrow")
        crowds = stage(narrow.groupBy("sort").agg(F.count("*").alias("n")).filter(F.col("n") > MANY), "crowds")
        if crowds.isEmpty():
            crowds = None
        else:
            held = narrow.join(F.broadcast(crowds), "sort", "left") if small(crowds, 24) else join_groups(narrow, crowds, "sort", "n", F.struct("key", "digest", "w"), narrow.count())
            crowds, narrow = held.filter("n is not null"), held.filter("n is null")
    alone = _repeats(narrow.drop("n").repartition(int(parts), "sort").sortWithinPartitions("sort"))
    if crowds is not None:
        alone = alone.union(_single(crowds))
    copies = distinct.filter("size > 1").select("key", "digest", F.lit(0).alias("w"), F.col("windows").cast("int").alias("windows"))
    runs = alone.union(copies).groupBy("key", "digest").agg(F.collect_list(F.struct("w", "windows")).alias("runs"))
    runs = stage(runs.join(distinct.select("key", "digest", "size"), ["key", "digest"]).select(F.concat(F.col("key").cast("string").cast("binary"), "digest").alias("piece"), "size", "runs"), "runs")
    seen = bodies.select("row", "at", F.concat(F.col("key").cast("string").cast("binary"), "digest").alias("piece"))
    hit = join_groups(seen, runs, "piece", "size", F.struct("row", "at"), total).filter("size is not null")
    begin = F.col("at") + F.col("r.w")
    hit = hit.select("row", "at", F.explode("runs").alias("r")).select("row", F.struct(begin.alias("a"), (begin + F.col("r.windows") + F.lit(LENGTH - 1)).alias("b")).alias("s"))
    hit = hit.groupBy("row").agg(F.sort_array(F.collect_set("s")).alias("spans"))

    def merge(batches):
        for batch in batches:
            col = batch.column(1)
            n = np.diff(col.offsets.to_numpy())
            flat = col.flatten()
            who = np.repeat(np.arange(len(n)), n)
            a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            reach = np.maximum.accumulate(b + (who << 40)) - (who << 40)
            new = np.ones(len(a), bool)
            new[1:] = (who[1:] != who[:-1]) | (a[1:] > reach[:-1])
            go = np.flatnonzero(new)
            stop = np.append(go[1:], len(a)) - 1
            pairs = np.stack((a[go], reach[stop]), axis=1).ravel()
            ends = np.concatenate(([0], np.cumsum(2 * np.bincount(who[go], minlength=len(n))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(pairs))], ["row", "cuts"])

    cuts = stage(hit.mapInArrow(merge, "row binary, cuts array<long>"), "cuts")
    unstage(bodies, distinct, runs)

    def keep(batches):
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            for i in range(batch.num_rows):
                body, cut = text[i].as_py(), batch.column(2)[i].as_py() or []
                kept, at = [], 0
                for a, b in zip(cut[::2], cut[1::2], strict=True):
                    kept.append(body[at:a])
                    at = b
                kept.append(body[at:])
                kept = b"".join(kept)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, 1), "n_bytes": pa.array([len(body)]), "n_removed": pa.array([len(body) - len(kept)]), "n_spans": pa.array([len(cut) // 2]), "kept": pa.array([kept], pa.binary())})

    held = checked_join(rows, cuts, "row", "left", 256)
    return held.select("doc_id", "text", "cuts").mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH h AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
p AS (SELECT r, unnest(range(0, octet_length(t) - 399)) AS i, t FROM h WHERE octet_length(t) >= 400),
w AS (SELECT r, i, md5(t[i + 1:i + 400]) AS k FROM p),
g AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
x AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM w WHERE k IN (FROM g)),
y AS (SELECT r, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS s FROM x),
z AS (SELECT r, s, min(i) AS a, max(i) + 400 AS b FROM y GROUP BY 1, 2),
c AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM z),
k AS (SELECT r, string_agg(hex(t[before + 1:a]), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans
  FROM c JOIN h USING (r) GROUP BY r)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(t[coalesce(tail, 0) + 1:octet_length(t)]))) AS kept_sha256
FROM h LEFT JOIN k USING (r)
"""
