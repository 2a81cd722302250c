"""WARC (8): archives of one gzip member a record, and a sequential reader of them."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import shared_dir, stored, table

#: Payloads of fewer bytes are stored again rather than revisited.
MIN_REVISIT = 100
#: A task begins a new archive after so many bytes.
ARCHIVE_BYTES = 1 << 30
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16


def _clean(value: str) -> str:
    """A header value: percent-encodes line breaks and what UTF-8 can't hold."""
    return "".join(c if c not in "\r\n%" else f"%{ord(c):02X}" for c in value).encode("utf-8", "replace").decode()


def _plain(value: str) -> str:
    return value.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """A WARC/1.1 record as one gzip member; a revisit carries no payload."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def read_records(stream):
    """(headers, block) of each record of a stream of gzip members, in order.

    Reads a chunk at a time; a member's end is where zlib says it is, the block's length is
    Content-Length. A cut member, wrong framing or a block that doesn't match its digest is a
    ValueError.
    """
    left = b""
    while True:
        left = left or stream.read(_CHUNK)
        if not left:
            return
        unpack, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpack.decompress(left))
            if unpack.eof:
                left = unpack.unused_data
                break
            left = stream.read(_CHUNK)
            if not left:
                raise ValueError("the archive ends within a record")
        raw = b"".join(parts)
        cut = raw.find(b"\r\n\r\n")
        lines = raw[:cut].decode().split("\r\n")
        if cut < 0 or lines[0] != "WARC/1.1":
            raise ValueError("no WARC record here")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = raw[cut + 4 : -4]
        if len(block) != int(head["Content-Length"]) or raw[-4:] != b"\r\n\r\n":
            raise ValueError("the record's length isn't its Content-Length")
        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError("the block doesn't match its digest")
        yield head, block


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per page to archives in `folder`; returns (path, n_records) of each.

    Equal payloads of MIN_REVISIT bytes or more: the rows with the smallest page_id are
    responses (all of them, if that id is repeated), others revisit it; a null id is larger
    than any. Null html is an empty payload; a page of any size is one record, which a task
    holds in memory. Each task attempt writes files of its own name
    and only those of the attempts that end well are returned, so a lost executor costs a
    repeated task. `folder` can be any file system that pyarrow opens.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    # only digests that occur again are joined back, so a table without copies isn't shuffled twice
    again = (
        rows.where(F.octet_length("html") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", "first")
    )
    ref = F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("ref")
    marked = rows.where(F.octet_length("html") >= MIN_REVISIT).join(again, "digest", "left").select("id", "url", "html", "digest", ref)
    # short payloads, of which the empty one may be that of very many pages, never revisit: no join
    marked = marked.union(rows.where(F.octet_length("html") < MIN_REVISIT).select("id", "url", "html", "digest", F.lit(None).cast("long")))

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, done = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None or done[-1][2] >= archive_bytes:
                    if out is not None:
                        out.close()
                    done.append([f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0])
                    out = system.open_output_stream(f"{base}/{done[-1][0].rpartition('/')[2]}", compression=None)
                data = record_bytes(r["id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["digest"], "response" if r["ref"] is None else "revisit", r["ref"])
                out.write(data)
                done[-1][1] += 1
                done[-1][2] += len(data)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "n_records"])

    return marked.mapInArrow(run, "path string, n_records long")


def read_warc(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives named in column path, one task an archive at most.

    Columns page_id, url, payload_bytes, payload_digest, record_type, refers_to and, with
    with_payload, payload (null for a revisit). Payload digests of responses are verified.
    """
    n = max(1, archives.count())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for head, block in read_records(stream):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind = head["WARC-Type"]
                        if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"a payload in {path} doesn't match its digest")
                        ids = [int(head[k]) if k in head else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                        url = head.get("WARC-Target-URI")
                        rows.append([ids[0], None if url is None else _plain(url), int(head["X-Payload-Length"]), digest, kind, ids[1]] + [block if kind == "response" else None] * with_payload)
                        size += len(block) * with_payload + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return archives.select("path").repartition(n).mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    archives = stored(write_warc(table(spark, sf_dir, "pages"), folder), "archives")
    return read_warc(archives, with_payload=False).drop("url")


QUERIES = {"op8_warc": op8_warc}
ORACLES = {
    "op8_warc": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (digest)"""
}
