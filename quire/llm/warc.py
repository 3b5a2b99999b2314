"""WARC archives: a deterministic sharded writer and a reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, lean, own_partitions
from .shards import shard_of, splitters

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs, RFC 4122
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, file string"


#: Files whose names and digests are sent to all executors, at most (about 200 bytes each).
BROADCAST_FILES = 100_000


def open_folder(uri: str):
    """File system and path of a folder, by the scheme of its uri; it must be one that all machines share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if urlsplit(uri).scheme else "file://" + uri)


def records_of(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Columns page_id, url, payload, payload_bytes, payload_digest; null pages have an empty payload."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))


def revisits(keys: DataFrame, least: int = 1000) -> DataFrame:
    """Which records revisit which: page_id, payload_digest, refers_to.

    keys: page_id, payload_bytes, payload_digest of all records. Of records with
    equal payloads of at least ``least`` bytes, those with the largest page_id
    are responses and others revisit it. Null ids are below all others. The
    largest ids are combined before the exchange, and payloads take no part.
    """
    big = keys.where(F.col("payload_bytes") >= least)
    first = big.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    out = big.join(first, "payload_digest").where("refers_to is not null and not page_id <=> refers_to")
    return out.select("page_id", "payload_digest", "refers_to").distinct()


def _record(row: dict, date: str) -> bytes:
    """One record as a gzip member of its own; headers and digests are made anew from the payload."""
    payload = row["payload"]
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()]
    block = head[0] + (payload if row["record_type"] == "response" else b"")
    name = lambda i: f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{i}')}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {name(row['page_id'])}",
        f"WARC-Date: {date}",
        f"Content-Length: {len(block)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(row['refers_to'])}", f"X-Refers-To-Page-Id: {row['refers_to']}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip without name or time
    return z.compress(raw) + z.flush()


def write(pages: DataFrame, folder: str, scratch: Scratch, ident: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, file_bytes: int = 64 << 20, shard_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every page as .warc.gz files under folder and returns the manifest, a row a file.

    Records are range-sorted by page_id into shards whose boundaries come from
    exact byte counts, so equal input gives equal files, byte for byte. In a
    shard a new file begins when the compressed size reaches file_bytes. Files
    lie in a folder of this run, so none of another run is met. A task writes
    under a temporary name and renames the whole file; a task that runs again
    after a lost executor has the same bytes for the same name and leaves a file
    that is there already. The manifest is written last, by temporary name and
    rename: without it the folder isn't committed, and a reader sees the files
    that it lists and no others.

    Payloads are exchanged once. Which records are revisits is found on ids and
    digests alone and sent to the shard, where it stands before its record.
    Null urls and ids leave out their header; rows that repeat an id are records
    of their own, ordered by digest and url; no pages make no file, but a
    manifest; other columns are not read.
    """
    order = F.coalesce(F.col("page_id"), F.lit(-(1 << 63)))
    rows = records_of(pages, ident, url, html)
    keys = scratch.keep(rows.select("page_id", "payload_bytes", "payload_digest", order.alias("_key"), (F.col("payload_bytes") + F.lit(512)).alias("_w")), "keys")
    total = keys.agg(F.sum("_w")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    cuts = splitters(keys, "_key", "_w", shards, 0.05)[0] if shards > 1 else []
    known = revisits(keys, least)
    sized = rows.withColumn("refers_to", F.lit(None).cast("long")).withColumn("_is", F.lit(1)).unionByName(known.withColumn("_is", F.lit(0)), allowMissingColumns=True).withColumn("_shard", _position(order, cuts))
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    part = f"run-{uuid.uuid4().hex}"
    # Up to so many shards each has a task of its own; of more, a hash of small numbers is even enough.
    dealt = F.element_at(F.array(*map(F.lit, own_partitions(scratch.spark, shards))), F.col("_shard") + 1) if shards <= 1024 else F.col("_shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        fs, root = open_folder(folder)
        root = f"{root}/{part}"
        fs.create_dir(root, recursive=True)
        out: list[dict] = []
        now: dict | None = None
        stream = temp = digest = None

        def close() -> None:
            nonlocal now
            if now is not None:
                stream.close()
                if fs.get_file_info(name := f"{root}/{now['file']}").type.name == "File":
                    fs.delete_file(temp)
                else:
                    fs.move(temp, name)
                out.append(now | {"sha256": digest.hexdigest()})
                now = None

        again = None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["_is"]:
                    again = row
                    continue
                same = again is not None and all(again[c] == row[c] for c in ("page_id", "payload_digest"))
                row |= {"record_type": "revisit", "refers_to": again["refers_to"]} if same else {"record_type": "response"}
                if now is not None and (now["shard"] != row["_shard"] or now["bytes"] >= file_bytes):
                    serial = serial + 1 if now["shard"] == row["_shard"] else 0  # noqa: F821
                    close()
                elif now is None:
                    serial = 0
                if now is None:
                    now = {"shard": row["_shard"], "file": f"pages-{row['_shard']:06d}-{serial:05d}.warc.gz", "records": 0, "bytes": 0, "first_id": row["page_id"]}
                    temp = f"{root}/.{now['file']}.{uuid.uuid4().hex}.tmp"
                    stream, digest = fs.open_output_stream(temp, compression=None), hashlib.sha256()
                stream.write(data := _record(row, date))
                digest.update(data)
                now |= {"records": now["records"] + 1, "bytes": now["bytes"] + len(data), "last_id": row["page_id"]}
        close()
        if out:
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in out], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())]))

    dealt = sized.withColumn("_part", dealt).repartition(shards, "_part").drop("_part").sortWithinPartitions("_shard", order, "payload_digest", "_is", "url")
    made = scratch.keep(dealt.mapInArrow(run, MANIFEST), "manifest").orderBy("shard", "file")
    commit(made, folder, part)
    return made


def _position(key, cuts: list):
    """shard_of by halving, so that thousands of shards cost a dozen comparisons."""
    cuts = [c for c in cuts if c is not None]

    def half(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(cuts)) if len(cuts) > 64 else shard_of(key, cuts)


def commit(manifest: DataFrame, folder: str, part: str) -> None:
    """Writes manifest.jsonl, the run's folder and then a line a file (as many as files, not records), under a temporary name, and renames it."""
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    temp = f"{root}/.manifest.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp, compression=None) as f:
        f.write((json.dumps({"run": part}) + "\n").encode())
        for r in manifest.toLocalIterator():
            f.write((json.dumps(r.asDict(), sort_keys=True) + "\n").encode())
    fs.move(temp, f"{root}/manifest.jsonl")


def parse(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a .warc.gz file, open for reading."""
    with gzip.GzipFile(fileobj=data) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a record: {line[:40]!r}")
            head: dict[str, str] = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            yield head, f.read(int(head["content-length"]))


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all archives that the folder's manifest lists; other files there are not looked at.

    A file that is missing or has other bytes than the manifest says raises, and
    so does a digest that differs from the bytes read. Files are read by Spark,
    one a task at most; payloads False leaves the payload column null. A manifest
    without files gives no records; a folder without one raises.
    """
    fs, root = open_folder(folder)
    if fs.get_file_info(f"{root}/manifest.jsonl").type.name != "File":
        raise FileNotFoundError(f"{folder} has no manifest, so it isn't committed")
    with fs.open_input_stream(f"{root}/manifest.jsonl", compression=None) as f:
        part = json.loads(f.read().split(b"\n", 1)[0])["run"]
    listed = spark.read.schema("file string, sha256 string").json(f"{folder}/manifest.jsonl").where("file is not null")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/{part}").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content") if fs.get_file_info(f"{root}/{part}").type.name == "Directory" else spark.createDataFrame([], "file string, content binary")
    if not listed.join(there.select("file"), "file", "left_anti").isEmpty():
        raise FileNotFoundError(f"{folder}: files of the manifest are not there")
    files = there.join(F.broadcast(listed) if listed.count() <= BROADCAST_FILES else listed, "file")
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))], names)

        lean()
        for batch in batches:
            for path, content, digest in zip(batch.column("file"), batch.column("content"), batch.column("sha256").to_pylist(), strict=True):
                if hashlib.sha256(content.as_buffer()).hexdigest() != digest:
                    raise ValueError(f"{path}: not as the manifest has it")
                rows, held = [], 0
                for head, block in parse(pa.BufferReader(content.as_buffer())):
                    if base64.b32encode(hashlib.sha1(block).digest()).decode() != head["warc-block-digest"].removeprefix("sha1:"):
                        raise ValueError(f"{path}: {head['warc-record-id']} has another block digest")
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    payload, size = None, int(head["x-payload-length"])
                    if head["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"{path}: {head['warc-record-id']} has another payload digest")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    rows.append((number("x-page-id"), head.get("warc-target-uri"), payload if payloads else None, size, digest, head["warc-type"], number("x-refers-to-page-id"), head["warc-record-id"], path.as_py()))
                    held += len(payload or b"") if payloads else 64
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, RECORD)
