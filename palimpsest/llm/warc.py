"""WARC archives as a Python data source: planned partitions, pushed predicates, headers before payloads."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from palimpsest.llm.storage import join_groups, new_path, small

SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, refers_to string, payload_digest string, block_length long, headers map<string,string>, payload binary"
#: Columns that come from a header of the record.
FIELDS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a task starts its next archive, of small archives that one reading task takes, and of a part of a large one.
ROLL, GROUP, SPLIT = 64 << 20, 32 << 20, 256 << 20
PROBE = 4096


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member whose extra field 'sl' holds its compressed and plain lengths, so readers can skip it.

    A member that 32 bits cannot measure goes without the field; readers then inflate it to find its end.
    """
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    total = 10 + 2 + 12 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data)) if max(total, len(data)) < 1 << 32 else b""
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Named fields of a record's head; continued lines are joined and names get their usual spelling."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = _USUAL.get(name.strip().lower(), name.strip())
            out[name] = value.strip()
    return out


_USUAL = {v.lower(): v for v in [*FIELDS.values(), "Content-Length", "Content-Type"]}


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a block: what follows the HTTP head, where there is one."""
    if headers.get("Content-Type", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class Files(InputPartition):
    """Whole archives, or the records of one that begin at byte lo or later and before hi."""

    paths: tuple
    lo: int = 0
    hi: int | None = None


@dataclass
class Written(WriterCommitMessage):
    paths: tuple


def _begins(f, at: int, plain: bool) -> bool:
    f.seek(at)
    head = f.read(PROBE)
    if plain:
        return head.startswith(b"WARC/") and b"content-length:" in head.lower()
    try:
        return zlib.decompressobj(31).decompress(head).startswith(b"WARC/")
    except zlib.error:
        return False


def first_record(f, at: int) -> int:
    """Where the first record begins at byte at or later, told by its looks; the archive's size if there is none."""
    size = f.size()
    f.seek(0)
    plain = f.read(2) != b"\x1f\x8b"
    mark = b"\r\n\r\nWARC/" if plain else b"\x1f\x8b\x08"
    skip = 4 if plain else 0
    at -= min(skip, at)
    while at < size:
        f.seek(at)
        block = f.read(1 << 20)
        found = block.find(mark)
        while found >= 0:
            if _begins(f, at + found + skip, plain):
                return at + found + skip
            found = block.find(mark, found + 1)
        if at + len(block) >= size:
            break
        at += len(block) - len(mark) + 1
    return size


def records(f, wanted, payload: bool, lo: int = 0, hi: int | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the wanted records of an archive, plain or one gzip member a record.

    lo and hi limit them to those that begin between these bytes. The first one is then told by its looks; whoever
    reads up to hi knows where the next record really begins and fails if it would be told otherwise, as an archive
    within an archive may cause.

    Heads are read first. A record that is not wanted, or whose payload is not, is passed over by its length: by
    Content-Length in a plain archive, by the 'sl' extra field in a compressed one; a member without that field
    has to be inflated to find its end, a buffer at a time.
    """
    size = f.size()
    at = first_record(f, lo) if lo else 0
    while at < (size if hi is None else hi):
        f.seek(at)
        first = f.read(PROBE)
        if first[:2] != b"\x1f\x8b":
            skip = len(first) - len(first.lstrip(b"\r\n"))
            if skip:
                at += skip
                continue
            while b"\r\n\r\n" not in first and (more := f.read(PROBE)):
                first += more
            cut = first.find(b"\r\n\r\n")
            if cut < 0:
                raise ValueError("archive ends within a record's head")
            headers = parse_head(first[:cut])
            length = int(headers.get("Content-Length", 0))
            if wanted(headers):
                block = None
                if payload:
                    f.seek(at + cut + 4)
                    block = payload_of(headers, f.read(length))
                yield headers, block
            at += cut + 4 + length + 4
            continue
        total = None
        if first[3] & 4:
            n = struct.unpack("<H", first[10:12])[0]
            extra = first[12 : 12 + n]
            while len(extra) >= 4:
                k = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and k == 8:
                    total = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + k :]
        inflate = zlib.decompressobj(31)
        text, read = inflate.decompress(first), len(first)
        while b"\r\n\r\n" not in text and not inflate.eof and (more := f.read(PROBE)):
            text += inflate.decompress(more)
            read += len(more)
        cut = text.find(b"\r\n\r\n")
        headers = parse_head(text[: max(cut, 0)])
        take = wanted(headers)
        if take and payload or total is None:
            parts, got = [text[cut + 4 :]], len(text)
            while not inflate.eof and (more := f.read(1 << 16)):
                piece = inflate.decompress(more)
                got += len(piece)
                read += len(more)
                if take and payload:
                    parts.append(piece)
            total = total or read - len(inflate.unused_data)
        if take:
            block = None
            if payload:
                block = payload_of(headers, b"".join(parts)[: int(headers.get("Content-Length", 0))])
            yield headers, block
        at += total
    if hi is not None and hi < size:
        f.seek(at)
        between = f.read(PROBE)
        at += len(between) - len(between.lstrip(b"\r\n"))
        if first_record(f, hi) != at:
            raise ValueError(f"a record seems to begin at byte {first_record(f, hi)} and begins at {at}: read with split=0")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true") != "false"
        self.split = int(options.get("split", SPLIT))
        self.tests: list[tuple[str, str, object]] = []
        if types := options.get("types"):
            self.tests.append(("warc_type", "in", tuple(x.strip() for x in types.split(","))))

    def pushFilters(self, filters: list[Filter]):
        for x in filters:
            name = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if name in FIELDS and isinstance(x, EqualTo):
                self.tests.append((name, "in", (x.value,)))
            elif name in FIELDS and isinstance(x, In):
                self.tests.append((name, "in", tuple(x.value)))
            elif name in FIELDS and isinstance(x, StringStartsWith):
                self.tests.append((name, "starts", x.value))
            elif name in FIELDS and isinstance(x, IsNotNull):
                self.tests.append((name, "there", None))
            else:
                yield x

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            got = headers.get(FIELDS[name])
            if got is None or kind == "in" and got not in value or kind == "starts" and not got.startswith(value):
                return False
        return True

    def partitions(self):
        store, root = _store(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
        out, group, size = [], [], 0
        for x in sorted((x for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")) and x.size), key=lambda x: x.path):
            if self.split and x.size > self.split:
                out += [Files((x.path,), lo, min(lo + self.split, x.size)) for lo in range(0, x.size, self.split)]
                continue
            if group and size + x.size > GROUP:
                out.append(Files(tuple(group)))
                group, size = [], 0
            group.append(x.path)
            size += x.size
        return [*out, Files(tuple(group))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        schema = pa.schema([*[(c, pa.string()) for c in FIELDS], ("block_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as f:
                for headers, payload in records(f, self.wanted, self.payload, partition.lo, partition.hi):
                    rows.append({c: headers.get(h) for c, h in FIELDS.items()} | {"block_length": int(headers.get("Content-Length", 0)), "headers": list(headers.items()), "payload": payload})
                    held += len(payload or b"") + 512
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    """Writes (record_id, warc_type, target_uri, warc_date, refers_to, payload_digest, headers, payload) rows.

    A file's name tells the job that wrote it. Committing deletes what failed attempts of this job left; other
    archives stay where they are, but for an overwrite, which deletes them once its own are written.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        paths, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() > ROLL:
                        if out is not None:
                            out.close()
                        paths.append(f"{root}/part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                        out = store.open_output_stream(paths[-1], compression=None)
                    out.write(gzip_member(self.render(row)))
        finally:
            if out is not None:
                out.close()
        return Written(tuple(paths))

    def render(self, row: dict) -> bytes:
        payload = row.get("payload") or b""
        headers = {h: row.get(c) for c, h in FIELDS.items()} | {"Content-Type": "application/http;msgtype=response"}
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        if row["warc_type"] == "revisit":
            headers["WARC-Profile"], payload = PROFILE, b""
        return record(headers | dict(row.get("headers") or ()), http + payload)

    def _clear(self, kept: set, every: bool) -> None:
        store, root = _store(self.path)
        for x in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            ours = x.base_name.startswith(f"part-{self.job}-")
            if x.is_file and x.path not in kept and (ours or every and x.base_name.endswith((".warc", ".warc.gz"))):
                store.delete_file(x.path)

    def commit(self, messages: list[Written | None]) -> None:
        self._clear({p for m in messages if m for p in m.paths}, self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(set(), False)


class WarcSource(DataSource):
    """Options: path; payload=false leaves payloads undecoded; types limits the record types; archives of more than
    split bytes are read in parts of so many, 0 for none."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Writes a record for each row of pages (page_id, url, html) under path.

    Of payloads of at least `least` bytes that are equal (by length and SHA-1), the row with the largest page_id is
    the response and the others revisit it; rows that repeat that page_id are responses too, as are groups of null
    ids only. A null html is an empty payload, a null url leaves its field out.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("n", F.octet_length("payload")).withColumn("sha", F.sha1("payload"))
    large = rows.filter(F.col("n") >= least)
    groups = large.groupBy("sha").agg(F.max("page_id").alias("best"), F.count("*").alias("size")).filter("size > 1")
    if small(groups, 64):
        joined = rows.join(F.broadcast(groups), "sha", "left")
    else:
        joined = join_groups(rows, groups, "sha", "size", F.col("page_id"), large.count())
    name = lambda c: F.concat(F.lit("<urn:md5:"), F.md5(F.concat(F.lit("page "), F.coalesce(c.cast("string"), F.lit("-")))), F.lit(">"))
    again = (F.col("n") >= least) & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    extra = F.map_from_arrays(F.array(F.lit("X-Page-Id")), F.array(F.col("page_id").cast("string")))
    out = joined.select(
        name(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.when(again, name(F.col("best"))).alias("refers_to"), F.concat(F.lit("sha1:"), "sha").alias("payload_digest"), extra.alias("headers"), F.when(again, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def op2_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back: responses with their payloads, revisits by their heads alone."""
    register(spark)
    path = new_path(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    read = lambda **o: spark.read.format("warc").options(path=path, **o).load()
    page = F.col("headers")["X-Page-Id"].cast("long")
    full = read().filter("warc_type = 'response'").select("record_id", page.alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    first = full.groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    seen = read(payload="false").filter("warc_type = 'revisit'").select(page.alias("page_id"), F.col("refers_to").alias("target"), F.substring("payload_digest", 6, 40).alias("said"))
    wanted = seen.groupBy("target").agg(F.count("*").alias("size"))
    first = first.join(wanted, F.col("record_id") == F.col("target")).select("target", "size", "refers_to", "payload_bytes", "payload_digest")
    later = join_groups(seen, first, "target", "size", F.col("page_id"), max(seen.count(), 1))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    a = full.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")).select(cols)
    return a.union(later.withColumn("record_type", F.lit("revisit")).select(cols))


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS best FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to
FROM g
"""
