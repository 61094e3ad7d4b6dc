"""Each operator against a brute-force version, and on nulls, blanks, ties, repeats and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import decontaminate, exact_dedup, hmm, mixing, near_dedup, quality, span_dedup, suffix_dedup, toxicity, warc
from palimpsest.llm.storage import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMA_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = [a + b for a in "th on er st wh re in an ed ha".split() for b in "ing ble tion ly es ou".split()]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def body(rng, n):
    return " ".join(sentence(rng, rng.randint(4, 12)) for _ in range(n))


def rows():
    rng = random.Random(7)
    base = [body(rng, rng.randint(2, 14)) for _ in range(60)]
    shared = body(rng, 8)
    texts = list(base)
    texts += [base[0], base[0] + " ", base[1].upper(), base[2] + " " + shared, shared + " " + base[3], shared]
    for k in range(6):
        w = base[4 + k].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n", "one two", "one two", "ONE two", "same " * 400]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[0], (None, "no id at all here but five words", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups(docs, none):
    by = collections.defaultdict(list)
    for d, t, *_ in rows():
        by[strip(t)].append((d, t or ""))
    want = []
    for norm, members in by.items():
        known = [m for m in members if m[0] is not None] or members
        keep = min(known, key=lambda m: (-len(m[1]), m[0] or 0))[0]
        want += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    got = [tuple(r) for r in exact_dedup.exact_groups(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert exact_dedup.exact_groups(none).count() == 0


def shingle_set(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_brute(table):
    sets = {d: shingle_set(t) for d, t, *_ in table if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_groups(docs, none):
    got = near_dedup.near_groups(docs).collect()
    want = near_brute(rows())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows()) and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_groups(none).count() == 0


def test_near_groups_compares_long_lists(spark, monkeypatch):
    rng = random.Random(3)
    base = body(rng, 9).split()
    table = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        table.append((i, " ".join(w), "en", "s", 1))
    monkeypatch.setattr(near_dedup, "LIST", 8)
    got = near_dedup.near_groups(spark.createDataFrame(table, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(table)


def suffix_brute(table, length=400):
    raw = [(t or "").encode() for _, t, *_ in table]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, *_), b in zip(table, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 3])
def test_transform_equals_brute_force(tmp_path, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(6)
    for _ in range(6 if block > 3 else 2):
        base = [bytes(rng.choices(b"ab", k=rng.randint(400, 900))) for _ in range(3)]
        bodies = list(base)
        for _ in range(6):
            b = rng.choice(base)
            lo = rng.randint(0, len(b) - 400)
            part = bytearray(b[lo : rng.randint(lo + 400, len(b))])
            if rng.random() < 0.7:
                part[rng.randrange(len(part))] = 99
            bodies.append(bytes(rng.choices(b"ab", k=rng.randint(0, 90))) + bytes(part))
        count = collections.Counter(b[i : i + 400] for b in bodies for i in range(len(b) - 399))
        want = [[count[b[i : i + 400]] > 1 for i in range(len(b) - 399)] for b in bodies]
        got = suffix_dedup.transform(bodies, [len(b) - 399 for b in bodies], str(tmp_path))
        assert [g.tolist() for g in got] == want and any(map(any, want))
    assert suffix_dedup.transform([], [], str(tmp_path)) == []


def test_symbols_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "spans", lambda pre, a, b: np.zeros(len(a), np.uint64))
    data = np.frombuffer(bytes(random.Random(1).choices(b"abc", k=300)) * 2, np.uint8)
    at = np.arange(len(data) - 99)
    got = suffix_dedup._symbols(data, at)
    words = [data[i : i + 100].tobytes() for i in at]
    assert len(set(got.tolist())) == len(set(words)) and all(got[i] == got[words.index(w)] for i, w in enumerate(words))


def test_suffix_dedup_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    rng = random.Random(8)
    shared = body(rng, 14)
    table = [(i, f"{rng.random()} " * rng.randint(0, 3) + shared + f" {rng.random()} {body(rng, 3)}", "en", "s", 1) for i in range(24)]
    table.append((24, shared[30:-20], "en", "s", 1))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(table, SCHEMA)).collect()]
    assert sorted(map(repr, got)) == suffix_brute(table)


@pytest.mark.parametrize("many", [2000, 1])
def test_suffix_dedup(spark, docs, none, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.suffix_dedup(docs).collect()]
    assert sorted(map(repr, got)) == suffix_brute(rows())
    assert any(g[2] for g in got)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_transform_finds_repeats(tmp_path):
    rng = random.Random(2)
    x, y = (bytes(rng.randrange(97, 101) for _ in range(700)) for _ in range(2))
    bodies = [x, y, x[37:620], y[:399]]
    windows = [max(0, len(b) - 399) for b in bodies[:3]] + [0]
    found = suffix_dedup.transform(bodies, windows, str(tmp_path))
    assert found[0].tolist() == [37 <= i <= 220 for i in range(301)] and not found[1].any() and found[2].all()


def test_parts_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 900)
    monkeypatch.setattr(suffix_dedup._cut, "__defaults__", (900,))
    import pyarrow as pa

    text = body(random.Random(5), 60)
    whole = np.frombuffer(text.encode(), np.uint8)
    first, size, key, _ = suffix_dedup.anchored(whole, np.array([0, len(whole)]))
    want = {(int(f) + i, 0) for f, n in zip(first, size, strict=True) for i in range(n)}
    got = collections.Counter()
    for _, at, buf, offs in suffix_dedup._cut(pa.array([text])):
        f, n, _, _ = suffix_dedup.anchored(buf, offs)
        got.update((int(a) + at + i, 0) for a, k in zip(f, n, strict=True) for i in range(k))
    assert set(got) == want and set(got.values()) == {1}


def test_span_dedup(spark, docs, none):
    rng = random.Random(11)
    shared = [sentence(rng, 12) for _ in range(5)]
    table = [(1, " ".join([sentence(rng, 9), *shared, sentence(rng, 8)]), "en", "s", 1), (2, " ".join([sentence(rng, 7), *shared]), "en", "s", 1), (3, body(rng, 6), "en", "s", 1), (4, " ".join(shared[:2]), "en", "s", 1)]
    got = {r.doc_id: r for r in span_dedup.span_dedup(spark.createDataFrame(table, SCHEMA)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [0, 5, 0, 0]
    assert got[1].kept_text == table[0][1] and got[2].kept_text == table[1][1].split(". ")[0] + "."
    assert span_dedup.span_dedup(docs).count() == len(rows()) and span_dedup.span_dedup(none).count() == 0


def span_brute(table):
    """doc_id to (sentences, removed) by comparing word lists, for rows with distinct ids and texts."""
    runs, cut = collections.defaultdict(list), {}
    for d, text, *_ in table:
        parts = [[]]
        for line in (text or "").split("\n"):
            for w in line.split():
                parts[-1].append("".join(c.lower() if c.isascii() else c for c in w))
                if w[-1] in ".!?" or len(parts[-1]) == 16:
                    parts.append([])
            if parts[-1]:
                parts.append([])
        parts.pop()
        cut[d] = parts
        for i in range(len(parts)):
            n = next((n for n in range(3, len(parts) - i + 1) if sum(map(len, parts[i : i + n])) >= 12), None)
            if n:
                runs[tuple(map(tuple, parts[i : i + n]))].append((d, i, n))
    gone = {(d, i + j) for at in runs.values() for d, i, n in sorted(at)[1:] for j in range(n)}
    return {d: (len(parts), sum((d, i) in gone for i in range(len(parts)))) for d, parts in cut.items()}


@pytest.mark.parametrize("most", [span_dedup.BROADCAST_BYTES, 0])
def test_span_dedup_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(span_dedup, "BROADCAST_BYTES", most)
    rng = random.Random(13)
    loud = " ".join(f"{rng.choice(WORDS)}!!" for _ in range(40))
    texts = [body(rng, rng.randint(2, 12)) for _ in range(40)]
    texts += [texts[0] + " More here.", texts[1].upper() + " No.", "A b. " + texts[2], loud, f"Before. {loud} {loud}", "no " * 5 + loud[::-1], "Ha. " * 40, "one two three " * 30, "x.\ny\n\nz? " * 9, None, "", " "]
    table = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in span_dedup.span_dedup(spark.createDataFrame(table, SCHEMA)).collect()}
    assert got == span_brute(table)
    assert got[44][1] >= 40 and got[46][1] > 20 and got[1][1] == 0


@pytest.mark.parametrize("every", [0, 20, 30])
def test_span_dedup_cuts_long_sentences_alike(spark, every):
    rng = random.Random(17)
    many = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    table, shared = [], []
    for k in range(16):
        passage = many(51)
        for i in range(every // 2, 51, every or 51):
            passage[i] += "." if every else ""
        shared.append(passage)
        table += [(2 * k, " ".join(many(5) + passage + many(9)), "en", "s", 1), (2 * k + 1, " ".join(many(6 + k) + passage + many(3)), "en", "s", 1)]
    got = {r.doc_id: r for r in span_dedup.span_dedup(spark.createDataFrame(table, SCHEMA)).collect()}
    for k, passage in enumerate(shared):
        a, b = got[2 * k], got[2 * k + 1]
        assert a.n_removed == 0 and a.kept_text == table[2 * k][1] and b.n_removed > 0
        left = b.kept_text.split()
        assert left[: 6 + k] == table[2 * k + 1][1].split()[: 6 + k] and left[-3:] == table[2 * k + 1][1].split()[-3:]
        assert len(left) <= 6 + k + 3 + 51 - 12


@pytest.mark.parametrize("kind", [lambda r: r.randint(1, 50), lambda r: r.choice([1, 5000]), lambda r: 10 ** r.randint(0, 20)])
def test_frames_follow_from_the_weights_alone(kind):
    rng = random.Random(1)
    for _ in range(40):
        whole = [kind(rng) for _ in range(rng.randint(1, 12))]
        total, n = sum(whole), rng.randint(1, 500)
        run = list(mixing.frame(whole, 0, n))
        assert [t for *_, t in run] == list(range(n))
        got, cut = [0] * len(whole), rng.randint(0, n)
        for s, k, t in run:
            if t == cut:
                assert mixing.executed(whole, cut).tolist() == got
            assert k == got[s]
            got[s] += 1
            assert all(abs(g * total - w * (t + 1)) < total for g, w in zip(got, whole, strict=True))
        assert list(mixing.frame(whole, cut, n)) == run[cut:]


def test_frames_of_many_sources_stay_within_a_block():
    rng = random.Random(2)
    whole = [rng.randint(1, 1000) for _ in range(2000)]
    total, lo = sum(whole), 200 * 2000
    got = mixing.executed(whole, lo)
    assert got.sum() == lo
    for s, k, t in mixing.frame(whole, lo, lo + 2000):
        assert k == got[s]
        got[s] += 1
        if t % 97 == 0:
            assert max(abs(int(g) * total - w * (t + 1)) for g, w in zip(got, whole, strict=True)) < total


@pytest.mark.parametrize("weights", [{f"s{i}": 1 for i in range(20)}, {"s0": 0.99} | {f"s{i}": 0.01 / 255 for i in range(1, 256)}, {"s0": 1e-4, "s1": 2 / 3, "s2": 0.1, None: 7}])
def test_phases_keep_the_given_weights(weights):
    total = sum(map(Fraction, weights.values()))
    share = {s: Fraction(w) / total for s, w in weights.items()}
    blocks = {s: math.ceil(20_000 * w) + 1 for s, w in share.items()}
    seen, parts = {}, list(mixing.phases(blocks, weights))
    for at, slots, names, whole, first, rest in parts:
        for s, k, t in mixing.frame(whole, 0, slots, rest):
            assert at + t not in seen
            seen[at + t] = names[s], first[s] + k
    assert sorted(seen) == list(range(sum(blocks.values()))) and len(set(seen.values())) == len(seen) and len(parts) <= len(weights)
    first = parts[0][1]
    assert first > 10_000
    for t in range(first):
        s, k = seen[t]
        assert k > share[s] * t - 1 and k + 1 < share[s] * (t + 1) + 1


def test_schedule_equals_one_run(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FRAME", 8)
    monkeypatch.setattr(mixing, "PER_SOURCE", 1)
    monkeypatch.setattr(mixing, "HELD", 20)
    blocks, weights = {"a": 90, "b": 31, None: 7, "c": 1}, {"a": 3, "b": Fraction(1, 7), None: 0.5, "c": 1}
    want = {}
    for at, slots, names, whole, first, rest in mixing.phases(blocks, weights):
        want |= {(names[s], first[s] + k): at + t for s, k, t in mixing.frame(whole, 0, slots, rest)}
    got = {(r._s, r._part * 16 + i): t for r in mixing.schedule(spark, blocks, weights, 16).collect() for i, t in enumerate(r._slots)}
    assert got == want


def test_mix_sources(docs, none):
    got = mixing.mix_sources(docs, {"s1": 3, "s2": 1}, block=4, period=16).collect()
    assert len(got) == len(rows()) and len({r.mix_position for r in got}) == len(got)
    per = collections.defaultdict(set)
    for r in got:
        per[r.mix_slot].add((r.source, r.mix_block))
    assert all(len(x) == 1 for x in per.values()) and sorted(per) == list(range(len(per)))
    sizes = collections.Counter(r.source for r in got)
    want = {}
    for at, slots, names, whole, first, rest in mixing.phases({s: -(-n // 4) for s, n in sizes.items()}, mixing.tempered(sizes) | {"s1": 3, "s2": 1}):
        want |= {(names[s], first[s] + k): at + t for s, k, t in mixing.frame(whole, 0, slots, rest)}
    order = sorted(rows(), key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), r[0] or 0))
    place = collections.Counter()
    for d, _, _, source, _ in order:
        k, at = divmod(place[source], 4)
        place[source] += 1
        assert any((r.doc_id, r.source, r.mix_block, r.mix_position) == (d, source, k, want[source, k] * 4 + at) for r in got)
    assert mixing.mix_sources(none).count() == 0


def test_mix_sources_keeps_clashing_columns(docs):
    odd = docs.select("*", docs.text.alias("_h"), docs.lang.alias("_rank"), docs.n_chars.alias("_at"), docs.n_chars.alias("mix_slot"))
    got = mixing.mix_sources(odd, block=4, period=16)
    assert got.columns == [*docs.columns, "_h", "_rank", "_at", "mix_block", "mix_slot", "mix_position"]
    found = got.collect()
    assert len(found) == len(rows()) and all((r._h, r._rank, r._at) == (r.text, r.lang, r.n_chars) for r in found)


def test_warc_round_trip(spark):
    warc.register(spark)
    big = "<p>" + "x" * 1200
    table = [(1, "http://a/1", big), (2, None, big), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, "http://b/5", None), (6, "u", "é" * 800), (None, "v", big), (6, "u", "é" * 800)]
    path = new_path(spark, "warc")
    warc.archive(spark.createDataFrame(table, "page_id long, url string, html string"), path)
    read = lambda **o: spark.read.format("warc").options(path=path, **o).load()
    back = read().collect()
    assert sorted((r.headers.get("X-Page-Id") or "-", r.warc_type, len(r.payload)) for r in back) == sorted(
        [("1", "revisit", 0), ("2", "response", 1203), ("3", "response", 5), ("4", "response", 5), ("5", "response", 0), ("6", "response", 1600), ("6", "response", 1600), ("-", "revisit", 0)]
    )
    heads = read(payload="false").filter("warc_type = 'revisit'").collect()
    assert len(heads) == 2 and all(r.payload is None for r in heads) and len({r.refers_to for r in heads}) == 1
    assert read().filter("target_uri like 'http://a/%'").count() == 3
    assert "PythonScan" in read()._jdf.queryExecution().toString() or read().count() == 8


def test_warc_append_overwrite_and_retries(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "archive")
    pages = lambda *ids: spark.createDataFrame([(i, f"u{i}", "text") for i in ids], "page_id long, url string, html string")
    ids = lambda: sorted(int(r.headers["X-Page-Id"]) for r in spark.read.format("warc").load(path).select("headers").collect())
    warc.archive(pages(1, 2), path)
    warc.archive(pages(3), path)
    assert ids() == [1, 2, 3]
    spark.read.format("warc").load(path).filter("target_uri = 'u3'").limit(0).write.format("warc").mode("append").save(path)
    assert ids() == [1, 2, 3]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive(empty, str(tmp_path / "none"))
    assert spark.read.format("warc").load(str(tmp_path / "none")).count() == 0
    import pyarrow as pa

    writer = warc.WarcWriter({"path": path}, False)
    row = pa.RecordBatch.from_pylist([{"record_id": "<x>", "warc_type": "response", "payload": b"p", "headers": [("X-Page-Id", "9")]}])
    lost, good = writer.write(iter([row])), writer.write(iter([row]))
    assert lost.paths != good.paths and ids() == [1, 2, 3, 9, 9]
    writer.commit([good])
    assert ids() == [1, 2, 3, 9]
    failed = warc.WarcWriter({"path": path}, True)
    failed.abort([failed.write(iter([row]))])
    assert ids() == [1, 2, 3, 9]
    again = warc.WarcWriter({"path": path}, True)
    again.commit([again.write(iter([row]))])
    assert ids() == [9]


def test_warc_round_trip_of_no_pages_and_long_ones(spark, tmp_path):
    page = "page_id long, url string, html string, record_id string"
    long = "<p>" + "xy " * 1_500_000
    table = [(1, "a", long, "clash"), (2, "b", long, None), (3, "c", None, None), (None, None, "", None)]
    for name, rows_, want in (("none", [], set()), ("long", table, {(1, len(long), "revisit", 2), (2, len(long), "response", None), (3, 0, "response", None), (None, 0, "response", None)})):
        spark.createDataFrame(rows_, page).write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got = warc.op2_warc_roundtrip(spark, f"{tmp_path}/{name}").collect()
        assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got} == want and len(got) == len(want)


def test_warc_reads_foreign_archives(tmp_path):
    import gzip

    import pyarrow.fs as pafs

    one = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<a>"}, b"hello")
    two = warc.record({"WARC-Type": "request", "WARC-Record-ID": "<b>"}, b"x" * 9000)
    (tmp_path / "a.warc").write_bytes(one + two + one)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + warc.gzip_member(one))
    for name in ("a.warc", "b.warc.gz"):
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / name)) as f:
            assert [(h["WARC-Record-ID"], p) for h, p in warc.records(f, lambda h: True, True)] == [("<a>", b"hello"), ("<b>", b"x" * 9000), ("<a>", b"hello")]
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / name)) as f:
            assert [(h["WARC-Record-ID"], p) for h, p in warc.records(f, lambda h: h["WARC-Type"] == "request", False)] == [("<b>", None)]


def test_warc_reads_large_archives_in_parts(spark, tmp_path):
    import gzip

    import pyarrow.fs as pafs

    rng = random.Random(2)
    made = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>"}, b"x\r\n\r\ny" * rng.choice([0, 3, 400, 40_000])) for i in range(40)]
    (tmp_path / "a.warc").write_bytes(b"".join(made))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(m) if i % 2 else warc.gzip_member(m) for i, m in enumerate(made)))
    for name in ("a.warc", "b.warc.gz"):
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / name)) as f:
            whole = [h["WARC-Record-ID"] for h, _ in warc.records(f, lambda h: True, True)]
            assert whole == [f"<{i}>" for i in range(40)]
            for step in (100, 777, f.size() // 3, f.size() + 1):
                got = [h["WARC-Record-ID"] for lo in range(0, f.size(), step) for h, _ in warc.records(f, lambda h: True, False, lo, min(lo + step, f.size()))]
                assert got == whole
    nested = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<in>"}, b"inner" * 50)
    (tmp_path / "c.warc").write_bytes(warc.record({"WARC-Type": "response", "WARC-Record-ID": "<out>"}, b"-" * 300 + b"\r\n\r\n" + nested) + made[0])
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "c.warc")) as f, pytest.raises(ValueError, match="split=0"):
        [list(warc.records(f, lambda h: True, False, lo, min(lo + 150, f.size()))) for lo in range(0, f.size(), 150)]
    warc.register(spark)
    read = lambda n: sorted(r.record_id for r in spark.read.format("warc").option("split", n).load(str(tmp_path / "b.warc.gz")).collect())
    assert read(500) == read(0) == sorted(f"<{i}>" for i in range(40))


def test_wand_equals_exhaustive_scores():
    rng = random.Random(4)
    items = [body(rng, 3) for _ in range(60)]
    index = decontaminate.Index(list(range(60)), items)
    for _ in range(60):
        i = rng.randrange(60)
        terms = set(rng.sample(range(len(index.terms)), 20)) | {t for t in range(len(index.terms)) if i in index.items[t] and rng.random() < 0.7}
        scores = collections.Counter()
        for t in terms:
            for item, w in zip(index.items[t], index.impacts[t], strict=True):
                scores[item] += w
        for least in (0.2, 0.5):
            want = {k for k, v in scores.items() if v >= least}
            assert {k for k, _ in index.wand(sorted(terms), least)} == want


def test_leaks(spark, docs, none):
    rng = random.Random(9)
    items = [(i, "What " + body(rng, 2) + "? " + sentence(rng, 9)) for i in range(30)] + [(30, None), (31, "")]
    table = [(i, body(rng, 9) + (" " + items[i][1] + " " if i % 3 == 0 and i < 30 else " ") + body(rng, 7), "en", "s", 1) for i in range(45)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(table, SCHEMA), bench).collect()}
    assert got == {(i, i) for i in range(0, 30, 3)}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def leak_brute(docs, items):
    """(doc, item, passages) by scoring every item against every passage."""
    mark = re.compile(r"""[.,;:!?"'()\[\]{}|*#%&$]""")
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in mark.sub(" ", t)).split()
    toks = {i: low(t) for i, t in items if t is not None}
    n, mean = len(toks), sum(map(len, toks.values())) / max(len(toks), 1)
    df = collections.Counter(w for t in toks.values() for w in set(t))
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    impact, halves = {}, {}
    for i, text in items:
        if text is None or not toks[i]:
            continue
        tf = collections.Counter(toks[i])
        w = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(toks[i]) / mean)) for x, c in tf.items()}
        impact[i] = {x: y / sum(w.values()) for x, y in w.items()}
        raw, cut = text.encode(), decontaminate.halves(text)
        halves[i] = [grams(low(x.decode("utf-8", "replace"))) for x in (raw[:cut], raw[cut:])]
    out = collections.Counter()
    for d, text in docs:
        words = low(text or "")
        for i, w in impact.items():
            size = decontaminate._class(len(toks[i]))
            for lo in range(0, max(1, -(-(len(words) - size) // size)) * size, size):
                part = words[lo : lo + 2 * size]
                if sum(w.get(x, 0) for x in set(part)) < 0.5 - 1e-12:
                    continue
                have = {tuple(part[k : k + m]) for m in (1, 2, 3) for k in range(len(part) - m + 1)}
                if all(len(h & have) >= 0.5 * len(h) for h in halves[i]):
                    out[d, i] += 1
    return dict(out)


@pytest.mark.parametrize("shard", [100_000, 7])
def test_leaks_equal_brute_force(spark, shard):
    rng = random.Random(12)
    items = [(i, (f"{body(rng, rng.randint(1, 3))}? " if i % 2 else "") + body(rng, rng.choice([1, 2, 12, 30]))) for i in range(40)] + [(40, None), (41, ""), (42, "one")]
    table = []
    for d in range(60):
        words = body(rng, rng.randint(0, 30)).split()
        for _ in range(rng.randint(0, 2)):
            item = items[rng.randrange(40)][1].split()
            drop = rng.random() * 0.7
            at = rng.randint(0, len(words))
            words[at:at] = [w for w in item if rng.random() > drop]
        table.append((d, " ".join(words), "en", "s", 1))
    table += [(60, None, "en", "s", 1), (61, "", "en", "s", 1)]
    docs, bench = spark.createDataFrame(table, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    want = leak_brute([r[:2] for r in table], items)
    got = {(r.doc_id, r.item_id): r.n_passages for r in decontaminate.leaks(docs, bench, shard).collect()}
    assert got == want and len(want) > 10
    assert {r.doc_id for r in decontaminate.keep_clean(docs, bench, shard).collect()} == {r[0] for r in table} - {d for d, _ in want}


def test_hmm_base_scores(docs, none):
    token = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    fold = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7
    c = collections.Counter(x for d, t, *_ in rows() if fold(d) != 2 for x in token(t))
    n, v = sum(c.values()), len(c)
    want = sorted((repr(d), fold(d) == 2, len(token(t)), sum(c[x] > 0 for x in token(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in token(t)), 6)) for d, t, *_ in rows())
    got = hmm.hmm_scores(docs).collect()
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert hmm.hmm_scores(none).count() == 0


def test_forward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.random((5, 3))
    seqs = [np.array([0, 3, 1]), np.array([4]), np.array([2, 2, 1, 0])]
    want = []
    for s in seqs:
        p = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            q = start[path[0]] * emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                q *= move[a, b] * emit[x, b]
            p += q
        want.append(math.log10(p))
    assert np.allclose(hmm.forward(seqs, start, move, emit), want)


@pytest.mark.parametrize("piece", [1024, 2])
def test_expected_counts_equal_enumeration(monkeypatch, piece):
    import itertools

    monkeypatch.setattr(hmm, "PIECE", piece)
    monkeypatch.setattr(hmm, "TOKENS", 5)
    rng = np.random.default_rng(1)
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.random((5, 3))
    rest = hmm.settled(move)
    assert np.allclose(rest @ move, rest)
    seqs = [np.array([0, 3, 1]), np.array([4]), np.array([2, 2, 1, 0])]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        for lo in range(0, len(s), piece):
            x, begin = s[lo : lo + piece], start if lo == 0 else rest
            ways = []
            for path in itertools.product(range(3), repeat=len(x)):
                q = begin[path[0]] * emit[x[0], path[0]]
                for a, b, e in zip(path, path[1:], x[1:], strict=False):
                    q *= move[a, b] * emit[e, b]
                ways.append((q, path))
            whole = sum(q for q, _ in ways)
            for q, path in ways:
                starts[path[0]] += q / whole if lo == 0 else 0
                for a, b in zip(path, path[1:], strict=False):
                    moves[a, b] += q / whole
                for e, a in zip(x, path, strict=True):
                    emits[e, a] += q / whole
    assert np.allclose(hmm.expected(seqs, start, move, emit), np.concatenate((starts, moves.ravel(), emits.ravel())))


def test_hmm_scores_do_not_depend_on_partitions(spark, docs):
    key = lambda df: sorted((repr(r.doc_id), r.n_tokens, round(r.score, 6)) for r in hmm.hmm_scores(df).collect())
    assert key(docs.coalesce(1)) == key(docs.orderBy("text").repartition(5))


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_hold_out(spark, docs, none, kind):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    run = quality.quality_scores if kind == "quality" else toxicity.toxicity_scores
    got = {r.doc_id: r for r in run(d, lab).filter("held_out").collect()}
    pairs = [(got[r.doc_id].predicted, r[kind]) for r in lab.collect() if r.doc_id in got]
    right = sum(p == y for p, y in pairs) / len(pairs)
    assert right > 0.94
    by = sorted((got[r.doc_id].score, r[kind]) for r in lab.collect() if r.doc_id in got)
    up = [i for i, (_, y) in enumerate(by) if y == 1]
    auc = (sum(up) - len(up) * (len(up) - 1) / 2) / (len(up) * (len(by) - len(up)))
    recall = sum(p for p, y in pairs if y == 1) / len(up)
    wrong = sum(p for p, y in pairs if y == 0) / (len(by) - len(up))
    assert auc > 0.95 and recall > 0.85 and wrong < (0.02 if kind == "toxic" else 0.2), (auc, recall, wrong)
    empty = lab.limit(0)
    assert run(docs, empty).count() == len(rows()) and run(none, empty).count() == 0
    assert all(0 <= r.score <= 1 for r in run(docs, empty).collect())


def test_unlabelled_sums_equal_one_pass(spark):
    rng = np.random.default_rng(4)
    sets = [np.flatnonzero(rng.random(9) < 0.3).astype(np.int32) for _ in range(50)]
    table = [(bytearray(s.tobytes()), int(rng.integers(1, 5))) for s in sets]
    w = rng.normal(size=10)
    got = toxicity._unlabelled(spark.createDataFrame(table, "cols binary, n long"), w)
    want = np.zeros(11)
    for s, (_, n) in zip(sets, table, strict=True):
        p = 1 / (1 + math.exp(-(w[s].sum() + w[-1])))
        want[s] += n * p
        want[9] += n * p
        want[10] += n * math.log(1 - p + 1e-12)
    assert np.allclose(got, want)


def test_word_grams_equal_plain_sets():
    from palimpsest.llm.bytesops import mix
    from palimpsest.llm.bytesops import texts as chunks
    from palimpsest.llm.features import word_grams

    def number(word, n=None):
        b = np.frombuffer(word, np.uint8)
        from palimpsest.llm.bytesops import prefix, spans

        h = spans(prefix(b), np.array([0]), np.array([len(b) if n is None else n]))
        return int((mix(h) if n is None else mix(h + np.uint64(n)))[0] >> np.uint64(44))

    import pyarrow as pa

    table = [t for _, t, *_ in rows()] + ["", "réeuxment réeuxpa (réeuxment) réeux", "x" * 9]
    got = []
    for lo, hi, buf, offs in chunks(pa.array(table, pa.string())):
        at, f = word_grams(buf, offs)
        got += [set(f[at == i].tolist()) for i in range(hi - lo)]
    for t, g in zip(table, got, strict=True):
        marked = bytes(32 if chr(b) in ".,;:!?\"'()[]{}" else b for b in (t or "").encode().lower())
        words = set(re.findall(rb"[^\x20\x09-\x0D]+", marked))
        heads = collections.Counter(number(w, n) for n in (4, 5, 6, 7) for w in words if len(w) > n)
        twice = {int(mix(np.array([h], np.uint64) + np.uint64(1))[0] >> np.uint64(44)) for h, c in heads.items() if c > 1}
        assert g == {number(w) for w in words} | set(heads) | twice


def test_features_are_counted_over_all_texts(spark, docs):
    from palimpsest.llm.features import word_grams

    per = [set(word_grams(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[1].tolist()) for _, t, *_ in rows()]
    every = np.array(sorted(set().union(*per)))
    n, counts = toxicity._frequencies(docs, every)
    assert n == len(rows()) and counts.tolist() == [sum(f in p for p in per) for f in every.tolist()]
    column = np.full(1 << toxicity.BITS, -1, np.int32)
    column[every[::3]] = np.arange(len(every[::3]))
    want = collections.Counter(tuple(sorted(int(column[f]) for f in p if column[f] >= 0)) for p in per)
    got = {tuple(np.frombuffer(r.cols, np.int32).tolist()): r.n for r in toxicity._vectors(docs, column).collect()}
    assert {tuple(sorted(k)): v for k, v in got.items()} == want


ODD = [(2, "same id first text of its own and more words here"), (2, "the id two again with quite another text beside it"), (None, "no id but text that stands twice in this table now"), (5, "no id but text that stands twice in this table now "), (None, "no id but text that stands twice in this table now")]
ODD += [(7, "repeated row with its words one two three four"), (7, "repeated row with its words one two three four"), (None, None), (None, ""), (8, None), (9, "alone " * 3)]
ODD += [(20 + i, " ".join(f"w{j}" for j in range(60)) + f" x{i}") for i in range(3)] + [(None, " ".join(f"w{j}" for j in range(60)) + " y"), (20, " ".join(f"v{j}" for j in range(30)))]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, and columns named like those that stages work with."""
    table = [(d, t, "en", "s", len(t or ""), i, f"r{i}", t, i) for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(table, SCHEMA + ", _uid int, _row string, norm string, h int")


def kept_by(groups):
    return {min(g, key=lambda i: (ODD[i][0] is None, ODD[i][0] or 0, i)) for g in groups}


def test_keep_exact_judges_rows(odd):
    out = exact_dedup.keep_exact(odd)
    assert out.columns == odd.columns
    groups = collections.defaultdict(list)
    for i, (_, t) in enumerate(ODD):
        groups[strip(t)].append(i)
    want = set()
    for g in groups.values():
        longest = max(len(ODD[i][1] or "") for i in g)
        want |= kept_by([[i for i in g if len(ODD[i][1] or "") == longest]])
    rows_ = out.collect()
    assert len(rows_) == len(groups)
    same = lambda i: (ODD[i][0], strip(ODD[i][1]))
    assert sorted(map(repr, (same(r.h) for r in rows_))) == sorted(map(repr, map(same, want)))
    assert all((r.doc_id, r.text) == ODD[r.h] and r._uid == r.h and r._row == f"r{r.h}" for r in rows_)


def test_keep_near_judges_rows(odd):
    out = near_dedup.keep_near(odd)
    assert out.columns == odd.columns
    brute = near_brute([(i, t, "en", "s", 0) for i, (_, t) in enumerate(ODD)])
    groups = collections.defaultdict(list)
    for i, (_, root) in brute.items():
        groups[root].append(i)
    rows_ = out.collect()
    assert len(rows_) == len(groups)
    name = lambda i: (ODD[i][0], brute[i][1])
    assert sorted(map(repr, (name(r.h) for r in rows_))) == sorted(map(repr, map(name, kept_by(groups.values()))))


def test_keep_quality_and_clean_judge_rows(spark, odd):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    both = d.withColumn("h", d.doc_id).unionByName(odd.select(*SCHEMA_NAMES, "h").withColumn("h", odd.h + 10**6), allowMissingColumns=True)
    from palimpsest.llm.features import byte_grams

    score, want = quality._scorer(both, lab, quality.SAMPLE), []
    for r in both.select("h", "text").collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        want += [r.h] if score(byte_grams(raw, np.array([0, len(raw)])), 1)[0] >= 0.3 else []
    kept = [r.h for r in quality.keep_quality(both, lab).collect()]
    assert sorted(kept) == sorted(want) and 0 < len(kept) < both.count()
    bench = spark.createDataFrame([(1, ODD[2][1] + " "), (2, None)], "item_id long, text string")
    assert {r.h for r in decontaminate.keep_clean(odd, bench).collect()} == set(range(len(ODD))) - {2, 3, 4}


def test_stages_of_no_rows(spark, odd):
    none = odd.limit(0)
    lab, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, "what is this? it is that")], "item_id long, text string")
    for out in (exact_dedup.keep_exact(none), near_dedup.keep_near(none), quality.keep_quality(none, lab), decontaminate.keep_clean(none, bench), decontaminate.keep_clean(none, bench.limit(0))):
        assert out.count() == 0 and out.columns == odd.columns
    assert decontaminate.keep_clean(odd, bench.limit(0)).count() == len(ODD)


def test_hinge_reaches_the_optimum():
    rng = np.random.default_rng(3)
    y = np.where(rng.random(60) < 0.4, 1, -1)
    rows_ = [np.flatnonzero(rng.random(12) < (0.5 if label > 0 and rng.random() < 0.7 else 0.25)) for label in y]
    r = quality.ratios(rows_, y, 12)
    p, q = np.ones(12), np.ones(12)
    for f, label in zip(rows_, y, strict=True):
        for k in f:
            (p if label > 0 else q)[k] += 1
    assert np.allclose(r, np.log(p / p.sum()) - np.log(q / q.sum()))
    x = np.zeros((60, 13))
    for i, f in enumerate(rows_):
        x[i, f], x[i, 12] = r[f], 1
        x[i] /= np.linalg.norm(x[i])
    cost = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    value = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w, best = np.zeros(13), np.inf
    for t in range(1, 40_000):
        w = w - (w - ((cost * y * (y * (x @ w) < 1))[:, None] * x).sum(0)) / (t + 10)
        best = min(best, value(w)) if t % 50 == 0 else best
    got = quality.hinge(rows_, y, r, epochs=500)
    assert value(got) <= best * 1.005
    m = quality.margins((np.repeat(np.arange(60), [len(f) for f in rows_]), np.concatenate(rows_)), 60, got, r)
    assert np.allclose(m, x @ got)


def test_very_long_texts(spark):
    rng = random.Random(21)
    long = " ".join(sentence(rng, 9) for _ in range(6_000))
    table = [(1, long, "en", "s", 1), (2, long.upper(), "en", "s", 1), (3, "short text of only a few words", "en", "s", 1), (4, long + " tail", "en", "s", 1)]
    big = spark.createDataFrame(table, SCHEMA)
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(big).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(big).collect()} == {1: (len(long), len(long)), 2: (len(long), 0), 3: (30, 0), 4: (len(long) + 5, len(long))}
    assert {r.doc_id: r.group_size for r in exact_dedup.exact_groups(big).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    spans = {r.doc_id: r for r in span_dedup.span_dedup(big).collect()}
    assert spans[1].n_removed == 0 and spans[2].n_removed == spans[2].n_sentences and spans[3].n_removed == 0
    item = " ".join(long.split()[40_000:40_040])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(big, bench).collect()} == {1, 2, 4}
    scores_ = {r.doc_id: r for r in hmm.hmm_scores(big).collect()}
    assert scores_[1].n_tokens == len(long.split()) + 1 and scores_[1].score < scores_[3].score
    lab = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(big, lab).count() == 4 and toxicity.toxicity_scores(big, lab).count() == 4


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    start = docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf)
        sizes.append(docs.count())
        assert docs.columns[: len(start.columns)] == start.columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 100
    texts = [strip(r.text) for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in docs.collect() for i in items)
