"""Operator 3: WARC archives, written one gzip member per record and read back sequentially.

The writer groups equal payloads by SHA-1: of those of at least ``min_bytes`` bytes, the one with the largest id is a
response and the others are revisit records that refer to it and carry no payload. The reader inflates a member at a
time from a stream, frames the block by Content-Length and verifies block and payload digests.

Archives go to the shared folder, one file per task attempt. A table of the files of the attempts that Spark has
committed, also in the shared folder, says which are read, so a lost executor or a second attempt leaves nothing double.

Defined results: a null html is an empty payload; a null url is an empty target; a null id sorts below all others and is read
back as null; rows that share the largest id of their group are all responses; a very long payload is one record, which a task
holds whole; an empty table writes no file and gives an empty result. Further columns of the input are left out, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_path, table

CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_SQL_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """An archive that can't be framed, or whose digests don't match."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _id(uri: str):
    tail = uri[10:-1]
    return None if tail == "none" else int(tail)


def clean_uri(url: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member of its own."""
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean_uri(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def members(stream, chunk: int = CHUNK):
    """The inflated gzip members of a stream, one at a time."""
    held = b""
    while True:
        held = held or stream.read(chunk)
        if not held:
            return
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not held and not (held := stream.read(chunk)):
                raise WarcError("the archive ends inside a member")
            try:
                out.append(z.decompress(held))
            except zlib.error as e:
                raise WarcError(f"a member can't be inflated: {e}") from e
            held = z.unused_data
        yield b"".join(out)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of a member that holds one record; digests are verified."""
    end = member.find(b"\r\n\r\n")
    if not member.startswith(b"WARC/") or end < 0:
        raise WarcError("no record header")
    head = {}
    for line in member[:end].decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"no field: {line!r}")
        head[name.lower()] = value.strip()
    try:
        n = int(head["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    block = member[end + 4 : end + 4 + n]
    if len(block) != n or member[end + 4 + n :] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't frame the record")
    for field in ("warc-block-digest", *(["warc-payload-digest"] if head.get("warc-type") == "response" else [])):
        if field in head and head[field] != f"sha1:{base32_sha1(block)}":
            raise WarcError(f"{field} doesn't match")
    return head, block


def read_archive(stream):
    """(header fields, block) of each record of an archive."""
    for member in members(stream):
        yield parse(member)


def _open(uri: str, write: bool = False):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if write:
        system.create_dir(path.rpartition("/")[0])
        return system.open_output_stream(path, compression=None)
    return system.open_input_stream(path, compression=None)


def classified(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit. Only groups of two and more are joined; the small side is a saved table, so a hot group stays splittable."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    large = rows.filter(F.length("payload") >= min_bytes)
    groups = saved(large.groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("sha").alias("_sha"), "first_id"), "warc-groups")
    joined = rows.join(groups, F.col("sha") == F.col("_sha"), "left")
    revisit = F.col("_sha").isNotNull() & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "sha", F.when(revisit, F.col("first_id")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives; a saved table of path, records."""
    root = shared_path(pages.sparkSession, "warc")

    def task(batches):
        path, out, n = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for page, url, payload, sha, refers, revisit in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                out = out or _open(path, write=True)
                out.write(record(page, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), refers, revisit))
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return saved(classified(pages, **options).mapInArrow(task, "path string, records long"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. A task reads whole files in sequence."""

    def task(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with _open(path) as stream:
                    for head, _ in read_archive(stream):
                        kind = head["warc-type"]
                        rows.append((_id(head["warc-record-id"]), int(head["warc-payload-length"]), head["warc-payload-digest"].partition(":")[2], kind, _id(head["warc-refers-to"]) if kind == "revisit" else None))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r, strict=True)) for r in rows], schema=_SCHEMA)
                            rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, r, strict=True)) for r in rows], schema=_SCHEMA)

    spark = files.sparkSession
    n = max(1, min(files.count(), 16 * spark.sparkContext.defaultParallelism))
    return files.select("path").repartition(n).mapInArrow(task, _SQL_SCHEMA)


def op3_warc(spark, sf_dir):
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


OP3_SQL = r"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as sha from p),
g as (select *, max(page_id) over (partition by sha) as first_id from h)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, (i // 4 * 5 + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), 'string_agg', '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from g
"""
