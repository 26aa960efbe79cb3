"""WARC archives, written and read as a chunked record table.

Writing: a payload travels as rows (record, chunk number, bytes of at most
``CHUNK`` ), so neither the writer nor the reader holds a whole record; each
task writes one archive below ``spark.checkpoint.dir`` and reports it in a
manifest.  A retried task writes a new file, and only files named in the
manifest are read, so a lost executor leaves no half-written archive behind.

Reading: each archive is streamed; the record headers are parsed and the payload
is handed on as rows (record, chunk number, bytes so far, SHA-256 of the prefix,
last or not) with an incremental digest, so the last chunk of a record carries
the digest of the whole payload.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes (SHA-256 and
length) the one with the smallest id is a ``response``; the others are
``revisit`` records without a body that refer to it.

Edge cases: null payloads are empty; a null URL gives a record without target;
line breaks in URLs are escaped; payloads may hold anything, also record
headers, since records are framed by their lengths; repeated ids: rows of one id
and equal payloads are one response and revisits of it; null ids are kept and
are referred to only if every id of the group is null (then all are responses);
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knightshift.plans.joins import bounded_broadcast
from knightshift.session import cut_lineage, scratch_path

CHUNK = 64 * 1024
MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"      # fixed, so that archives repeat byte for byte

CHUNK_SCHEMA = ("page_id long, record_id string, record_type string, refers_to long, payload_digest string, "
                "chunk int, bytes_so_far long, running_digest string, last boolean, data binary")


def decide(pages: DataFrame, id_col: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Rows (id, url, body, payload_bytes, payload_digest, record_type, refers_to)."""
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"),
                       F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("body"))
    own = own.select("*", F.octet_length("body").cast("long").alias("payload_bytes"), F.sha2("body", 256).alias("payload_digest"))
    facts = own.where(F.col("payload_bytes") >= MIN_REVISIT)
    first = (facts.groupBy("payload_digest", "payload_bytes").agg(F.min("id").alias("first"), F.count("*").alias("n"))
             .where("n > 1 and first is not null").select("payload_digest", "payload_bytes", "first"))
    # repeated payloads only: broadcast if they measure small, so that the payloads are not shuffled
    first = bounded_broadcast(cut_lineage(first, "repeated-payloads"))
    joined = own.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select("id", "url", "body", "payload_bytes", "payload_digest",
                         F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def single_response(records: DataFrame) -> DataFrame:
    """Of several responses of one repeated id and payload that revisits refer to, all but one become revisits."""
    twin = records.where(F.col("record_type") == "response").where(F.col("payload_bytes") >= MIN_REVISIT)
    many = twin.groupBy("id", "payload_digest").count().where("count > 1").select("id", "payload_digest")
    if many.where(F.col("id").isNotNull()).limit(1).count() == 0:
        return records
    order = Window.partitionBy("id", "payload_digest", "record_type").orderBy("url")
    late = (F.row_number().over(order) > 1) & (F.col("record_type") == "response") & (F.col("payload_bytes") >= MIN_REVISIT) \
        & F.col("id").isNotNull()
    return (records.withColumn("__late", late).withColumn("record_type", F.when(F.col("__late"), "revisit").otherwise(F.col("record_type")))
            .withColumn("refers_to", F.when(F.col("__late"), F.col("id")).otherwise(F.col("refers_to"))).drop("__late"))


def chunked(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per chunk of a record, in order; a revisit or an empty body is one row without bytes."""
    body = F.when(F.col("record_type") == "response", F.col("body")).otherwise(F.lit(b""))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("own") / size)).cast("int")
    return (records.withColumn("own", body).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
            .select("id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk", (F.col("chunk") == n - 1).alias("last"),
                    F.substring("own", F.col("chunk") * size + 1, F.lit(size)).alias("data")))


def record_id(page_id: int | None) -> str:
    return "<urn:knightshift:page:" + ("none" if page_id is None else str(page_id)) + ">"


def _head(row: dict) -> bytes:
    """Record header and, for responses, the HTTP header that opens the block."""
    http = b""
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['id'])}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha256:{row['payload_digest']}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: {record_id(row['refers_to'])}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
        lines.append("Content-Type: application/http; msgtype=response")
    size = len(http) + (row["payload_bytes"] if row["record_type"] == "response" else 0)
    return "\r\n".join([*lines, f"Content-Length: {size}", "", ""]).encode("utf-8") + http


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write one archive per task below ``folder``; returns the manifest (path, records, bytes), already written."""
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk", "last"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records_written = None, f"{folder}/{uuid.uuid4().hex}.warc", 0
        for batch in batches:
            if out is None:
                fs, own = _open(path)
                fs.create_dir(own.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(own)
            data = batch.column("data")
            for i, row in enumerate(batch.select(names).to_pylist()):
                if row["chunk"] == 0:
                    out.write(_head(row))
                    records_written += 1
                out.write(data[i].as_buffer())
                if row["last"]:
                    out.write(b"\r\n\r\n")
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records_written], pa.int64()), pa.array([size], pa.int64())],
                                             names=["path", "records", "bytes"])

    return cut_lineage(chunked(records).mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def _header(stream) -> dict[str, str] | None:
    """The header lines up to the blank line, names in lower case; None at the end of the archive."""
    line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a record header: {line[:60]!r}")
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("the archive ends inside a record header")
        name, _, value = line.decode("utf-8").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _page(name: str | None) -> int | None:
    number = (name or "").rpartition(":")[2].rstrip(">")
    return int(number) if number.lstrip("-").isdigit() else None


def stream_records(stream, size: int = CHUNK, with_data: bool = True) -> Iterator[tuple]:
    """Rows of the chunk table for one archive."""
    while (head := _header(stream)) is not None:
        left, kind = int(head["content-length"]), head["warc-type"]
        if kind == "response" and head.get("content-type", "").startswith("application/http"):
            while left > 0:
                line = stream.readline()
                left -= len(line)
                if line in (b"\r\n", b"\n", b""):
                    break
        name, digest = head["warc-record-id"], head.get("warc-payload-digest", "").removeprefix("sha256:")
        refers = _page(head.get("warc-refers-to"))
        sha, so_far, chunk = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(size, left))
            if left and not data:
                raise ValueError("the archive ends inside a record")
            left -= len(data)
            so_far += len(data)
            sha.update(data)
            yield (_page(name), name, kind, refers, digest, chunk, so_far, sha.hexdigest(), left == 0, data if with_data else None)
            chunk += 1
            if left == 0:
                break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line breaks")


def read_archives(spark: SparkSession, manifest: DataFrame, size: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in the manifest, an archive a task."""
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, own = _open(path)
                with fs.open_input_stream(own, buffer_size=1 << 20) as raw:
                    rows, held = [], 0
                    for row in stream_records(_Lines(raw), size, with_data):
                        rows.append(row)
                        held += len(row[-1] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files, "path").mapInArrow(read, CHUNK_SCHEMA)


class _Lines:
    """Line and block reads over a stream that only reads blocks."""

    def __init__(self, raw, block: int = 1 << 20):
        self.raw, self.block, self.held, self.at = raw, block, b"", 0

    def _fill(self) -> bool:
        more = self.raw.read(self.block)
        self.held, self.at = self.held[self.at:] + more, 0
        return bool(more)

    def readline(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._fill():
                end = len(self.held) - 1
                break
        line, self.at = self.held[self.at:end + 1], end + 1
        return line

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._fill():
            pass
        data = self.held[self.at:self.at + n]
        self.at += len(data)
        return data


def round_trip(pages: DataFrame, id_col: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Write the archives, read them back, and give one row per record: id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are those of the bytes read; a revisit takes the size of the response it refers to.
    """
    spark = pages.sparkSession
    records = single_response(decide(pages, id_col, payload, url))
    manifest = write_archives(records, scratch_path(spark, "warc"))
    chunks = read_archives(spark, manifest, with_data=False)
    own = cut_lineage(chunks.where("last").select("page_id", "record_type", "refers_to", "payload_digest", "bytes_so_far", "running_digest"), "warc-records")
    wrong = own.where((F.col("record_type") == "response") & (F.col("payload_digest") != F.col("running_digest"))).limit(1).count()
    if wrong:
        raise ValueError("a payload read back does not have the digest in its header")
    full = own.where("record_type = 'response'").select("page_id", "bytes_so_far", "running_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = own.where("record_type = 'revisit'").select("page_id", "refers_to", "payload_digest")
    cited = full.select(F.col("page_id").alias("cited"), F.col("running_digest").alias("payload_digest"), "bytes_so_far")
    resolved = again.join(cited, (F.col("cited") == F.col("refers_to")) & (again["payload_digest"] == cited["payload_digest"]), "left").select(
        "page_id", "bytes_so_far", again["payload_digest"].alias("running_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return full.unionByName(resolved).select(F.col("page_id").alias(id_col), F.col("bytes_so_far").alias("payload_bytes"),
                                             F.col("running_digest").alias("payload_digest"), "record_type", "refers_to")


DIGEST_SQL = f"""WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to FROM f"""
