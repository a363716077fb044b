"""WARC archives: a deterministic sharded writer and its reader.

Records are range-sorted by page id. The bytes of equal intervals of the ids
are summed exactly, neighbouring intervals make up a shard of about
``SHARD_BYTES`` payload bytes, and one that exceeds a shard (crowded ids, an id
that fills much of the table, ids that are no numbers) is dealt to several by a
hash of id and digest, so the same table always gives the same files. Within a
shard, records follow (page id, digest) and files roll when their compressed
size passes ``ROLL_BYTES``. Headers, HTTP lengths and digests are generated
anew. Every file is written under a temporary name and renamed when complete;
the files that count are those of the manifest, a Parquet table that Spark
commits last. A retried or repeated task writes the same bytes under the same
final name.

Of records with equal payloads of at least ``REVISIT_BYTES``, the one with
the largest page id is the response and the others are revisits of it
(records without a block payload). Only digests are grouped, never payloads.
Null html is an empty payload; null urls are written as an opaque URI. Rows
with a null id never become the original of an id-bearing copy, and if no
copy has an id, all are responses. Of rows that repeat the original's id, the
first in url order is the response.

The output folder must be on a file system that pyarrow opens (file, hdfs,
s3, gs) and that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices

REVISIT_BYTES = 1000
SHARD_BYTES = 32 << 20       # payload bytes of a shard
MOST_SHARDS = 50_000         # beyond, shards grow with the input
BUCKETS = 1 << 13            # intervals of page ids that shards are put together from
ROLL_BYTES = 8 << 20         # compressed bytes after which a file is closed
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20


def open_folder(folder: str):
    """(file system, path) of a folder given as URI or plain path."""
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    return pafs.FileSystem.from_uri(folder)


RECORD = "urn:page-record:"


def _quoted(page_id) -> str:
    """An id as part of a URI: null is a hyphen, everything else is quoted (a hyphen of its own too)."""
    text = "-" if page_id is None else quote(str(page_id).encode("utf-8", "surrogatepass"), safe="")
    return "%2D" if page_id == "-" else text


def _unquoted(record_id: str) -> str | None:
    text = record_id.strip("<>").removeprefix(RECORD).split(":")[0]
    return None if text == "-" else unquote_to_bytes(text).decode("utf-8", "surrogatepass")


def _record_id(page_id, digest: str, copy: int) -> str:
    return f"{RECORD}{_quoted(page_id)}:{digest[:16]}:{copy}"


def _headers(lines: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines).encode()


def build_record(page_id, url: str | None, payload: bytes, original, copy: int) -> bytes:
    """One compressed record: a response, or a revisit of the page id ``original``."""
    sha = hashlib.sha1(payload)
    digest, revisit = sha.hexdigest(), original is not None
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"),
                                               ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if revisit else http + payload
    target = quote(url.encode("utf-8", "surrogatepass"), safe=":/?#[]@!$&'()*+,;=%-._~") if url else "about:blank"
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<{_record_id(page_id, digest, copy)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha.digest()).decode()),
            ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<{_record_id(original, digest, 0)}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + _headers(head) + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Roller:
    """Writes the records of one shard into files that roll by compressed size."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.root = open_folder(folder)
        self.shard, self.roll, self.seq, self.out, self.done = shard, roll, 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, hashlib.sha256()
            self.size = 0
        self.out.write(record)
        self.sha.update(record)
        self.size += len(record)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size, self.sha.hexdigest()))
            self.seq, self.out = self.seq + 1, None


def originals(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, original): the records whose payload others share, from digests alone."""
    narrow = pages.filter(F.col("bytes") >= least).select("page_id", "digest")
    # written, so that the join has a plain shuffle on either side and a hot payload's rows can be split
    shared = cut_lineage(narrow.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter(
        "n > 1 and original is not null").select("digest", "original"), "warc-originals")
    return narrow.join(shared, "digest").select("page_id", "digest", "original").distinct()


def ranges(rows: DataFrame, shard_bytes: int):
    """Shards as ranges of the page id: the bucket of an id, (bucket, first, parts) for every bucket that has rows, and the
    number of shards.

    Ids are laid out over ``BUCKETS`` equal intervals of their range (numbers; other types share one bucket) and the
    exact bytes of each are summed, so shards do not depend on the partitioning. Neighbouring buckets make up a shard; one that
    exceeds a shard is dealt to ``parts`` shards by hash. Null ids come last.
    """
    numeric = dict(rows.dtypes)["page_id"] in ("tinyint", "smallint", "int", "bigint")
    low, high = rows.agg(F.min("page_id"), F.max("page_id")).first() if numeric else (None, None)

    def bucket(page_id):
        if low is None:
            return F.when(page_id.isNull(), BUCKETS).otherwise(0).cast("int")
        at = F.floor((page_id.cast("double") - float(low)) / (float(high) - float(low) + 1.0) * BUCKETS)
        return F.when(page_id.isNull(), BUCKETS).otherwise(F.greatest(F.least(at, F.lit(BUCKETS - 1)), F.lit(0))).cast("int")

    # at most BUCKETS + 1 rows
    sums = rows.groupBy(bucket(F.col("page_id")).alias("bucket")).agg(F.sum(F.col("bytes").cast("long") + 512).alias("b")).collect()
    # a large input gets larger shards, not more than MOST_SHARDS of them
    size = max(shard_bytes, sum(r["b"] for r in sums) // MOST_SHARDS)
    out, shard, held = [], 0, 0
    for r in sorted(sums):
        if held and held + r["b"] > size:
            shard, held = shard + 1, 0
        parts = max(1, -(-r["b"] // size))
        out.append((r["bucket"], shard, parts))
        if parts > 1:
            shard, held = shard + parts, 0
        else:
            held += r["b"]
    return bucket, rows.sparkSession.createDataFrame(out, "bucket int, first int, parts int"), max([1, *(f + p for _, f, p in out)])


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages (page_id, url, html)`` to ``folder`` and return its manifest (also left at ``folder/manifest``)."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    marks = originals(rows)
    kind = dict(pages.dtypes)["page_id"]
    # a mark sorts directly before the records that it is about; one shuffle moves both
    both = (rows.select("page_id", "digest", F.lit(1).alias("is_record"), "url", "html",
                        F.lit(None).cast(kind).alias("original"))
            .union(marks.select("page_id", "digest", F.lit(0), F.lit(None), F.lit(None), "original")))
    dealt, shards, count = ranges(rows, shard_bytes)
    bucket = dealt(both["page_id"]).alias("bucket")
    shard = F.col("first") + F.pmod(F.xxhash64(F.col("page_id").cast("string"), "digest"), F.col("parts"))
    placed = (both.select("*", bucket).join(F.broadcast(shards), "bucket").withColumn("shard", shard.cast("int")).drop("bucket", "first", "parts")
              .repartitionById(count, "shard")
              .sortWithinPartitions("shard", F.asc_nulls_last("page_id"), "digest", "is_record", "url"))
    root, base = open_folder(folder)
    root.create_dir(base, recursive=True)

    def run(batches):
        roller, mark, copy, last, done = None, None, 0, None, []
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                for r in part.to_pylist():
                    if roller is None or roller.shard != r["shard"]:
                        if roller:
                            roller.close()
                            done += roller.done
                        roller = _Roller(folder, r["shard"], roll_bytes)
                    here = (r["page_id"], r["digest"])
                    if here != last:
                        last, mark, copy = here, None, 0
                    if not r["is_record"]:
                        mark = r["original"]
                        continue
                    revisit = mark is not None and (r["page_id"] != mark or copy > 0)
                    data = (r["html"] or "").encode("utf-8", "surrogatepass")
                    roller.add(build_record(r["page_id"], r["url"], data, mark if revisit else None, copy))
                    copy += 1
        if roller:
            roller.close()
            done += roller.done
        if done:
            yield pa.RecordBatch.from_pydict({
                "file": [d[0] for d in done], "shard": pa.array([d[1] for d in done], pa.int32()),
                "records": pa.array([d[2] for d in done], pa.int64()),
                "bytes": pa.array([d[3] for d in done], pa.int64()), "sha256": [d[4] for d in done]})

    manifest = os.path.join(folder, "manifest")
    (placed.select("shard", "page_id", "digest", "is_record", "url", "html", "original")
     .mapInArrow(run, "file string, shard int, records long, bytes long, sha256 string").write.parquet(manifest))
    return spark.read.parquet(manifest)


def parse_record(raw: bytes) -> dict:
    """Fields of one uncompressed record; digests of responses are recomputed and must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = _unquoted(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": _unquoted(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind,
            "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest,
            "refers_to": refers}


def records(stream):
    """Raw records of a compressed archive, one at a time (each record is a member of its own)."""
    pending = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            data = pending or stream.read(CHUNK)
            if not data:
                if parts:
                    raise ValueError("truncated archive")
                return
            parts.append(unpack.decompress(data))
            pending = unpack.unused_data
        yield b"".join(parts)


def read(spark: SparkSession, folder: str, with_payload: bool = True, id_type: str = "bigint") -> DataFrame:
    """One row per record of the files in the folder's manifest."""
    files = spark.read.parquet(os.path.join(folder, "manifest")).select("file")
    names = ["page_id", "url", "record_type", *["payload"] * with_payload, "payload_bytes", "payload_digest", "refers_to"]
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}

    def run(batches):
        root, base = open_folder(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with root.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for raw in records(stream):
                        rows.append(parse_record(raw))
                        size += len(raw) if with_payload else 256
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names})

    schema = ", ".join(f"{n} " + {"payload": "binary", "payload_bytes": "long"}.get(n, "string") for n in names)
    spread = files.repartition(max(1, files.count()), "file")
    found = spread.mapInArrow(run, schema)
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
