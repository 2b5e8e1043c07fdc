"""WARC archives: a deterministic sharded writer and a reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove_folder, shared_dir, ship, slices

#: Records with equal payloads of at least so many bytes are written once and revisited.
REVISIT = 1000
#: Compressed bytes after which a file is closed, and records of a shard.
ROLL, SHARD = 8 << 20, 4_000
#: From so many shards on, a shard has SHARD_BYTES of payload instead, if that is more.
SHARDS, SHARD_BYTES = 20_000, 256 << 20
#: Keys that are drawn for each shard to place its borders, and in all: 8 MB on the driver.
DRAWN, DRAWN_IN_ALL = 16, 1 << 20
#: All records' date, so that the same pages give the same bytes.
DATE = "2026-01-01T00:00:00Z"
MANIFEST = "manifest"


def shards_for(rows: int, payload_bytes: int, shard_rows: int) -> int:
    """As many shards as there are ``shard_rows``; beyond SHARDS of them, as many as there are SHARD_BYTES if that is fewer."""
    by_rows = max(1, -(-rows // shard_rows))
    return by_rows if by_rows <= SHARDS else min(by_rows, max(SHARDS, -(-payload_bytes // SHARD_BYTES)))


def borders(keys: DataFrame, shards: int) -> list[int]:
    """``shards - 1`` keys between shards, from the rows (key, digest) whose hashes are smallest: bounded and repeatable.

    A key that many rows have, as the null ids' key may be, is the border of several shards; they share its rows.
    """
    if shards < 2:
        return []
    order = [F.xxhash64("key", "digest"), "key"]
    drawn = keys.orderBy(*order).limit(min(DRAWN * shards, DRAWN_IN_ALL)).select("key").toArrow()
    ids = sorted(drawn.column("key").to_pylist())
    return [ids[i * len(ids) // shards] for i in range(1, shards)] if ids else []


def number_of_shard(key: Column, digest: Column, edges: list[int]) -> Column:
    """How many edges are below the key, and for a key that is an edge: one more, or by digest one of as many as are equal to it."""
    m = max(1, round(len(edges) ** 0.5))
    longs = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>") if v else F.array().cast("array<bigint>")
    all_, every = longs(edges), longs(edges[m - 1 :: m])

    def count(test) -> Column:  # among every m-th edge, then among the m edges after those
        coarse = F.size(F.filter(every, test)) * m
        return coarse + F.size(F.filter(F.slice(all_, coarse + 1, m), test))

    below, upto = count(lambda e: e < key), count(lambda e: e <= key)
    return F.when(upto == below, below).otherwise(below + 1 + F.pmod(F.xxhash64(digest), upto - below)).cast("int")


def safe(value: str) -> str:
    """A header's value on one line: controls and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; digests and lengths are made anew from the payload."""
    sha = hashlib.sha1(payload)
    b32 = base64.b32encode(sha.digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha.hexdigest())}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {safe(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{b32}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha.hexdigest())}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """A gzip member without time or name, so equal records give equal bytes."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Roller:
    """Writes members into files ``shard-part`` of a folder that all executors share.

    A file grows under a name of its attempt and gets its final name only when it is whole, so a lost
    executor leaves nothing that a reader takes for an archive, and a repeated task writes the same again.
    """

    def __init__(self, folder: str, attempt: str, roll: int):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.attempt, self.roll, self.out, self.part, self.shard = attempt, roll, None, 0, -1

    def add(self, shard: int, data: bytes) -> Iterator[dict]:
        if self.out is not None and (shard != self.shard or self.size + len(data) > self.roll):
            yield self.close()
        if shard != self.shard:
            self.shard, self.part = shard, 0
        if self.out is None:
            self.name = f"records-{shard:06d}-{self.part:05d}.warc.gz"
            self.temp = f"{self.path}/.{self.name}.{self.attempt}.tmp"
            self.out, self.size, self.count, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha1()
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.count += 1

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temp, f"{self.path}/{self.name}")
        self.out, self.part = None, self.part + 1
        return {"file": self.name, "records": self.count, "bytes": self.size, "sha1": self.sha.hexdigest()}


def write_warc(pages: DataFrame, folder: str, roll: int = ROLL, shard_rows: int = SHARD, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes one record a row into ``folder`` (a URI all executors reach) and returns the manifest it commits.

    Records are in the order of page_id, in shards whose borders depend on page ids and payloads alone. Files
    are closed before they would pass ``roll`` compressed bytes. The manifest (file, records, bytes,
    sha1), written last, names what belongs to the archive; without it there is none.

    Of records with equal payloads of at least REVISIT bytes that with the largest page_id is a response
    and the others revisit it. A null payload is empty. A null page_id counts as the smallest. Rows equal
    in page_id and payload: the first is what one alone would be, the others revisit it. Null urls have
    no target. What is no UTF-8 is written as U+FFFD. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    ship(spark)
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.make_valid_utf8(F.col(url)).alias("url"), F.coalesce(F.make_valid_utf8(F.col(html)), F.lit("")).alias("html"))
    keyed = base.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("n"))
    # Only ids and digests travel to find equal payloads; the payloads themselves move once, to their shard.
    groups = keyed.where(F.col("n") >= REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).where("c > 1").select("digest", "last")
    notes = keyed.where(F.col("n") >= REVISIT).join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("last")))
    notes = notes.groupBy("page_id", "digest").agg(F.min("last").alias("last"))
    key = F.coalesce(F.col("page_id"), F.lit(-(1 << 63)))
    rows = pages.count()
    size = keyed.agg(F.sum("n")).first()[0] if rows > SHARDS * shard_rows else 0
    edges = borders(keyed.select(key.alias("key"), "digest"), shards_for(rows, size, shard_rows))
    empty = F.lit(None).cast("string")
    digest = F.sha1(F.col("html").cast("binary"))
    both = base.select("page_id", F.lit(1).alias("kind"), "url", "html", digest.alias("digest"), F.lit(None).cast("long").alias("last")).union(
        notes.select("page_id", F.lit(0), empty, empty, "digest", "last")
    )
    both = both.withColumn("shard", number_of_shard(key, F.col("digest"), edges))
    dealt = both.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = TaskContext.get()
        roller = Roller(folder, f"{t.stageId()}-{t.taskAttemptId()}", roll)
        done: list[dict] = []
        at, refers, seen = None, {}, set()
        for b in slices(batches, "html"):
            for r in b.to_pylist():
                if (r["shard"], r["page_id"]) != at:
                    at, refers, seen = (r["shard"], r["page_id"]), {}, set()
                if not r["kind"]:
                    refers[r["digest"]] = r["last"]
                    continue
                payload = r["html"].encode()
                digest = r["digest"]
                revisit, to = digest in refers, refers.get(digest)
                if not revisit and len(payload) >= REVISIT:
                    revisit, to = digest in seen, r["page_id"]
                    seen.add(digest)
                done += roller.add(r["shard"], packed(record(r["page_id"], r["url"], payload, to if revisit else None, revisit)))
        if roller.out is not None:
            done.append(roller.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    manifest = dealt.mapInArrow(run, "file string, records long, bytes long, sha1 string")
    manifest.write.mode("errorifexists").parquet(f"{folder}/{MANIFEST}")
    return spark.read.parquet(f"{folder}/{MANIFEST}")


def parse(member: bytes) -> dict:
    """Headers and the facts of one record; raises if a digest does not match."""
    head, _, rest = member.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    if h["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"block digest of {h['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    b32 = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and b32 != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    as_int = lambda k: int(h[k]) if k in h else None
    return {
        "page_id": as_int("X-Page-ID"), "url": h.get("WARC-Target-URI"), "record_type": h["WARC-Type"], "payload_bytes": length, "payload_digest": base64.b32decode(b32).hex(),
        "refers_to": as_int("X-Refers-To-Page-ID"), "payload": payload if h["WARC-Type"] == "response" else None,
    }


def members(content: pa.BinaryScalar) -> Iterator[bytes]:
    """The gzip members of an archive, one at a time."""
    data = memoryview(content.as_buffer())
    at = 0
    while at < len(data):
        z, step, out = zlib.decompressobj(31), 1 << 16, []
        while not z.eof:
            if at >= len(data):
                raise ValueError("archive cut short")
            piece = data[at : at + step]
            out.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        yield b"".join(out)


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of a committed archive: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    Only files that the manifest names are read, each as a whole by one task (a file's size is bounded by
    the writer) and from any store that Spark reads. Digests are checked. With ``payloads`` each response
    has its payload too.
    """
    ship(spark)
    listed = spark.read.parquet(f"{folder}/{MANIFEST}").select("file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "records-*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                held: list[dict] = []
                size = 0
                for m in members(content):
                    r = parse(m)
                    held.append({k: r[k] for k in names})
                    size += len(m) if payloads else 100
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return files.join(listed, "file", "left_semi").select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, **names: str) -> DataFrame:
    """Writes the pages to a new archive and reads it back.

    Without a folder the archive is in the shared folder, until its records have been read.
    """
    spark = pages.sparkSession
    own = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, own, **names)
    if folder:
        return read_warc(spark, own)
    read = cut(read_warc(spark, own))
    remove_folder(spark, own)
    return read


WARC_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
g AS (SELECT digest, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND n >= 1000
"""
