"""Operator 5, WARC: a deterministic sharded writer, and a reader.

Shards are ranges of the page id that hold about SHARD_BYTES of payload each, cut at multiples of that in the prefix sums of sizes in the
order of the id, so they depend on the data alone, however ids are spread. Records go to their shard in one shuffle, one task a shard, sorted
by page id, together with one small row for each page whose payload is not unique; the writer thus needs no join with payloads. A shard's files roll when their
compressed size reaches ROLL_BYTES. Every record is a gzip member of its own; headers and digests are
made anew from the payload, and dates are a parameter, so equal input gives equal files.

Commit: a task writes under temporary names and returns its files as manifest rows; Spark commits the manifest of the
attempts that count; a second job renames the files it lists (again without harm after a failure);
what other attempts left is deleted and a marker closes the folder. Readers take only what the manifest lists.

Equal payloads (of at least min_revisit bytes): the smallest page id's record is a response, others are revisits that refer to it.
A revisit has the response's HTTP head alone, so its full payload's length and digest stay readable.

Cases: null html is the empty payload; null urls give the record's own id as target; repeated rows are records of their own,
the first a response or revisit like its page, later ones revisits of it; rows with a null id are responses,
dealt to all shards by their hash; an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, stage, table

SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Tasks that rename or read archives at once; each takes a share of the files.
MOST_TASKS = 10_000

_FILES = "name string, temporary string, bytes long, records long, sha256 string"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _file_system(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


# --- shards ---


def shard_starts(sizes: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """First page ids of all shards but the first. sizes: page_id, n (bytes). Gathers one number a range partition and one a shard."""
    ids = sizes.where("page_id IS NOT NULL").select("page_id", "n")
    ranged = stage(ids.repartitionByRange("page_id").select("page_id", "n", F.spark_partition_id().alias("part")), "warc-order")
    base, total = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        base[part], total = total, total + n
    if total <= shard_bytes:
        return []
    before = spark_map(base)
    upto = F.sum("n").over(W.partitionBy("part").orderBy("page_id")) + F.try_element_at(before, F.col("part"))
    cut = ranged.select("page_id", F.floor((upto - 1) / shard_bytes).alias("shard")).groupBy("shard").agg(F.min("page_id").alias("first"))
    firsts = cut.select("first").toArrow().column("first").to_numpy()
    return np.unique(firsts)[1:].tolist()


def spark_map(numbers: dict[int, int]) -> Column:
    return F.create_map(*(F.lit(x).cast(t) for k, v in numbers.items() for x, t in ((k, "int"), (v, "long"))))


def _shard_of(page_id: Column, other: Column, starts: list[int]) -> Column:
    """A page's shard; where the id is null, one by other's hash."""
    at = np.array(starts, np.int64)

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, ids.to_numpy(np.int64), side="right").astype(np.int32))

    spread = F.pmod(F.xxhash64(other), F.lit(len(starts) + 1)).cast("int")
    return F.when(page_id.isNull(), spread).otherwise(shard(F.coalesce(page_id, F.lit(0))))


# --- records ---


def _record(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # 31: a gzip member without name or time
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _page_record(page_id: int | None, copy: int | str, url: str | None, payload: bytes, refers_to: tuple[int, int] | None, date: str) -> bytes:
    name = f"urn:page:{'' if page_id is None else page_id}:{copy}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else name)]
    if refers_to:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to[0]}:{refers_to[1]}>")]
    head += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", "application/http;msgtype=response")]
    return _record(head, block)


class _Rolling:
    """The files of one shard after another."""

    def __init__(self, uri: str, roll_bytes: int, date: str):
        self.fs, self.dir = _file_system(uri)
        self.roll, self.date, self.attempt = roll_bytes, date, uuid.uuid4().hex
        self.shard, self.number, self.out, self.done = None, 0, None, []

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.done.append((self.name, self.temporary, self.bytes, self.records, self.hash.hexdigest()))
            self.out = None

    def put(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if not self.out:
            self.name = f"pages-{shard:06d}-{self.number:05d}.warc.gz"
            self.temporary, self.number = f".{self.attempt}.{self.name}", self.number + 1
            self.fs.create_dir(self.dir, recursive=True)
            self.out, self.bytes, self.records, self.hash = self.fs.open_output_stream(f"{self.dir}/{self.temporary}", compression=None), 0, 0, hashlib.sha256()
            info = f"software: permulocus\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
            self._write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._write(record)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.bytes += len(data)


def write_archives(pages: DataFrame, uri: str, min_revisit: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) below uri and gives the committed manifest."""
    spark = pages.sparkSession
    archive = f"{uri}/archive"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    sizes = stage(rows.select("page_id", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest")), "warc-sizes")
    starts = shard_starts(sizes, shard_bytes)

    once = sizes.where((F.col("n") >= min_revisit) & F.col("page_id").isNotNull())
    firsts = once.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    told = once.join(firsts, "digest").select("page_id", "digest", "first").distinct()

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        have = set(df.columns)
        return df.select("page_id", F.lit(kind).alias("kind"), *(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("url", "string"), ("payload", "binary"), ("digest", "string"), ("first", "long"))))

    both = shaped(told, 0).unionByName(shaped(rows.withColumn("digest", F.sha1("payload")), 1))
    shards = len(starts) + 1
    dealt = both.withColumn("shard", _shard_of(F.col("page_id"), F.col("digest"), starts)).repartitionById(shards, "shard").sortWithinPartitions("page_id", "kind", "digest", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Rolling(archive, roll_bytes, date)
        page, known, copies, done = object(), {}, 0, {}
        for b in batches:
            for page_id, kind, url, payload, digest, first, shard in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if page_id != page:
                    page, known, copies, done = page_id, {}, 0, {}
                if not kind:
                    known[digest] = first
                    continue
                refers = None
                if page_id is not None and digest in known:
                    refers = (known[digest], 0) if known[digest] != page_id else (page_id, done[digest]) if digest in done else None
                done.setdefault(digest, copies)
                files.put(shard, _page_record(page_id, copies if page_id is not None else f"{shard}.{copies}", url, payload, refers, date))
                copies += 1
        files.close()
        cols = list(zip(*files.done, strict=True)) or [[]] * 5
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _FILES.split(", ")])

    dealt.mapInArrow(write, _FILES).write.parquet(f"{uri}/manifest")
    manifest = spark.read.schema(_FILES).parquet(f"{uri}/manifest")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(archive)
        for b in batches:
            for name, temporary in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if fs.get_file_info(f"{folder}/{temporary}").is_file:
                    fs.move(f"{folder}/{temporary}", f"{folder}/{name}")
            yield b.select(["name"])

    manifest.select("name", "temporary").repartition(min(MOST_TASKS, shards), "name").mapInArrow(rename, "name string").count()
    _close(archive)
    return manifest


def _close(archive: str) -> None:
    from pyarrow.fs import FileSelector

    fs, folder = _file_system(archive)
    for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
        if f.base_name.startswith(".") and f.base_name.endswith(".warc.gz"):
            fs.delete_file(f.path)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/_COMMITTED") as out:
        out.write(json.dumps({"format": "WARC/1.1"}).encode())


# --- reading ---


def records_of(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; holds one record at a time."""
    unpack, data, rest = zlib.decompressobj(31), [], b""
    while rest or (rest := stream.read(chunk)):
        data.append(unpack.decompress(rest))
        rest = unpack.unused_data
        if unpack.eof:
            head, _, body = b"".join(data).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield fields, body[: int(fields["Content-Length"])]
            unpack, data = zlib.decompressobj(31), []


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    """One row a response or revisit record of the files that the manifest lists."""
    archive = f"{uri}/archive"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(archive)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for head, block in records_of(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        page = head["WARC-Record-ID"].split(":")[2]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        told, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if kind == "response" and (len(payload) != n or digest_of(payload) != told):
                            raise ValueError(f"{name}: the record of page {page} is damaged")
                        refers = int(head["WARC-Refers-To"].split(":")[2]) if kind == "revisit" else None
                        rows.append((int(page) if page else None, n, told, kind, refers))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _RECORDS.split(", ")])

    manifest = spark.read.schema(_FILES).parquet(f"{uri}/manifest").select("name")
    # A numbered repartition is not coalesced: rows here are only names.
    return manifest.repartition(max(1, min(MOST_TASKS, manifest.count())), "name").mapInArrow(read, _RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), uri)
    return read_archives(spark, uri)


def _base32_sql(digest_hex: str) -> str:
    """Base32 of 20 bytes in SQL: 32 groups of five bits."""
    bits = f"CAST({digest_hex} AS BIT)"
    return f"array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda k: get_bit({bits}, CAST(i * 5 + k AS INTEGER)) * (16 >> k))) AS INTEGER), 1)), '')"


OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, unhex(sha1(coalesce(html, ''))) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT p.page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_base32_sql('p.d')} AS payload_digest,
       CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f ON p.d = f.d
"""
