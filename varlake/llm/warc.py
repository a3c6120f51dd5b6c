"""Deterministic sharded WARC writer and reader.

Records are sorted by key and rolled into files by compressed size. Ranges are cut at exact
running sizes, so that files don't depend on how Spark deals the rows out. The html moves once:
the rows that name a duplicate's first record travel with it, next to their page.
Headers and digests are made anew from the payload; ids and dates follow from the content, so
the same input gives the same bytes. A task writes under names of its own attempt; the manifest
lists the files of the attempts that succeeded, and only these are renamed into place, by tasks,
before the manifest appears. Rerunning the commit is harmless.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varlake.llm.store import stored
from varlake.session import ship_package

DATE = "2020-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, key)}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(key: str, uri: str, payload: bytes, refers_to: str | None, digest: str | None = None) -> bytes:
    """One gzip member: a response, or a revisit without the payload where ``refers_to`` is set."""
    digest = digest or payload_digest(payload)
    if refers_to is None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        block, kind = http + payload, "response"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        kind = "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(uri)}",
        f"X-Key: {key}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as z:
        z.write("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    return out.getvalue()


class _Roller:
    """Files of one task, a new one whenever the last has reached ``most`` bytes."""

    def __init__(self, target: str, shard: int, attempt: str, most: int):
        self.fs, self.root = _open(target)
        self.shard, self.attempt, self.most = shard, attempt, most
        self.out, self.done = None, []

    def write(self, data: bytes) -> None:
        if self.out is None:
            name = f"part-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.fs.create_dir(f"{self.root}/_tmp", recursive=True)
            self.temp = f"_tmp/{name}.{self.attempt}"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temp}", compression=None)
            self.name, self.size, self.records, self.hash = name, 0, 0, hashlib.sha256()
        self.out.write(data)
        self.size += len(data)
        self.records += 1
        self.hash.update(data)
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.temp, self.name, self.records, self.size, self.hash.hexdigest()))
            self.out = None


def first_records(keyed: DataFrame, least: int) -> DataFrame:
    """(key, digest, refers_to) of every payload that an earlier key has too.

    ``keyed`` is (key, digest, size); digests are counted with partial sums before the join.
    """
    big = keyed.where(F.col("size") >= least)
    firsts = big.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return big.join(firsts, "digest").where("key > first").select("key", "digest", F.col("first").alias("refers_to")).distinct()


def _cuts(narrow: DataFrame, shard_bytes: int) -> list[tuple]:
    """First (key, digest) of every shard but the first, by the exact running size of the payloads.

    The sort that adds the sizes up may be cut anywhere; sums, and so the cuts, are the same.
    """
    laid = narrow.repartitionByRange("key", "digest").sortWithinPartitions("key", "digest")
    laid = stored(laid.withColumn("at", F.monotonically_increasing_id()), "warc-order").withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy("part").agg(F.sum("size").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    upto = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = laid.withColumn("upto", F.sum("size").over(upto)).join(parts, "part")
    shard = F.floor((F.col("before") + F.col("upto") - F.col("size")) / shard_bytes)
    firsts = ends.groupBy(shard.alias("shard")).agg(F.min(F.struct("key", "digest")).alias("first")).where("shard > 0")
    return sorted(_place(r["first"]["key"], r["first"]["digest"]) for r in firsts.collect())


def _place(key: int | None, digest: str) -> tuple:
    """Sorts as the records do: null keys first, then keys, then digests."""
    return key is not None, key or 0, digest


def write_warc(pages: DataFrame, target: str, key_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0, file_bytes: int = 64 << 20, shards: int = 64) -> DataFrame:
    """Write a record per row under ``target`` and return the manifest.

    The payload is the text in UTF-8 (null: empty). Of records with equal payloads of at least
    ``least`` bytes the one of smallest key is a response and the others revisit it; smaller ones
    are all responses. Keys are integers; rows of a null key come first and are responses, a null
    uri is empty, and rows that repeat a key are written each, by its own payload a response or a
    revisit. Records are in the order of key, payload digest, uri. ``target`` must be new and
    reachable from every executor by a file system that Arrow knows. Manifest: (name, records,
    bytes, sha256), also stored as ``manifest`` and, last, ``_SUCCESS``.

    The same rows give the same files, however they are dealt out: shards are cut where the
    payloads in order come to a ``shards``-th of all bytes, or eight times ``file_bytes`` if that
    is less, and a shard's files roll at ``file_bytes``. The driver holds a key and digest per shard.
    """
    spark = pages.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key_col).cast("long").alias("key"), F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("uri"), text.alias("payload"))
    narrow = stored(rows.select("key", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size")), "warc-digests")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    cuts = _cuts(narrow, max(1, min(8 * file_bytes, -(-total // shards))))
    repeats = first_records(narrow, least)
    blank = F.lit(None).cast("string").alias("uri"), F.lit(None).cast("binary").alias("payload")
    notes = repeats.select("key", "digest", F.lit(0).alias("kind"), *blank, "refers_to")
    whole = rows.select("key", F.sha1("payload").alias("digest"), F.lit(1).alias("kind"), "uri", "payload", F.lit(None).cast("long").alias("refers_to"))
    both = whole.unionByName(notes)

    def deal(batches):
        for batch in batches:
            keys, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shard = [bisect_right(cuts, _place(k, d)) for k, d in zip(keys, digests, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *batch.columns], ["shard", *batch.schema.names])

    dealt = both.mapInArrow(deal, "shard long, key long, digest string, kind int, uri string, payload binary, refers_to long")
    laid = dealt.repartition(len(cuts) + 1, "shard").sortWithinPartitions("shard", "key", "digest", "kind", "uri")

    def write(batches):
        attempt = uuid.uuid4().hex
        roller, done, noted, refers = None, [], None, None
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for shard, key, digest, kind, uri, payload, to in zip(*cols, strict=True):
                if kind == 0:
                    noted, refers = (key, digest), to
                    continue
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller = _Roller(target, shard, attempt, file_bytes)
                roller.write(record("" if key is None else str(key), uri, payload, str(refers) if (key, digest) == noted else None))
        if roller is not None:
            roller.close()
            done += roller.done
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["temp", "name", "records", "bytes", "sha256"])

    written = stored(laid.mapInArrow(write, "temp string, name string, records long, bytes long, sha256 string"), "warc-manifest")

    def rename(batches):
        fs, root = _open(target)
        for batch in batches:
            for temp, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fs.get_file_info(f"{root}/{temp}").type == pafs.FileType.File:
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").type != pafs.FileType.File:
                    raise FileNotFoundError(name)
            yield batch

    moved = stored(written.mapInArrow(rename, written.schema), "warc-moved")
    manifest = moved.select("name", "records", "bytes", "sha256")
    manifest.coalesce(1).sortWithinPartitions("name").write.parquet(f"{target}/manifest")
    fs, root = _open(target)
    fs.delete_dir(f"{root}/_tmp") if fs.get_file_info(f"{root}/_tmp").type == pafs.FileType.Directory else None
    totals = manifest.agg(F.count("*"), F.sum("records"), F.sum("bytes")).first()
    with fs.open_output_stream(f"{root}/_SUCCESS") as out:
        out.write(json.dumps({"files": totals[0], "records": totals[1] or 0, "bytes": totals[2] or 0}).encode())
    return spark.read.parquet(f"{target}/manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(size)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data = z.unused_data or stream.read(size)
            z, parts = zlib.decompressobj(31), []
        else:
            data = stream.read(size)
    if any(parts):
        raise EOFError("a record is cut short")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; both digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
    return headers, block


def read_warc(spark: SparkSession, target: str) -> DataFrame:
    """Records of a committed archive: key, uri, record_type, payload_bytes, payload_digest,
    refers_to, payload (null for revisits).

    Files are dealt to tasks by the manifest, each one streamed record by record. Raises where a
    digest doesn't match, or a file differs from the manifest.
    """
    ship_package(spark)
    manifest = spark.read.parquet(f"{target}/manifest")
    files = manifest.select("name", "bytes", "records").repartition(max(1, manifest.count()), "name")

    def rows(batches):
        fs, root = _open(target)
        names = ["key", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for name, size, records in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if fs.get_file_info(f"{root}/{name}").size != size:
                    raise ValueError(f"{name} differs from the manifest")
                out, held, seen = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        h, block = parse(data)
                        seen += 1
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = h["WARC-Type"] == "revisit"
                        if not revisit and payload_digest(payload) != digest:
                            raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        to = h.get("X-Refers-To-Key")
                        out.append((int(h["X-Key"]) if h["X-Key"] else None, h["WARC-Target-URI"], h["WARC-Type"], n, digest, int(to) if to else None, None if revisit else payload))
                        held += len(payload)
                        if held > 4 << 20 or len(out) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                if seen != records:
                    raise ValueError(f"{name} holds {seen} records, not {records}")

    return files.mapInArrow(rows, "key long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
