"""Content-addressed web archive.

An archive is two tables in one folder. ``payloads`` holds each distinct payload once, compressed, under its SHA-256;
``headers`` holds for every record its exact header bytes and the digest of its payload. A record is header, payload and
two line ends, and comes back by a join on the digest. Equal payloads are found by digest, length and SHA-1 together, and
a payload is hashed again when it is read: one that doesn't fit its digest fails the job.
"""

from __future__ import annotations

import base64
import hashlib
import re

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import map_batches
from tallyloom.operators.lookup import hot_key_join
from tallyloom.session import scratch_path

DATE = "1970-01-01T00:00:00Z"
MIN_PAYLOAD = 0
# fixed values: the format's version line, profile and digits of base 32
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits as four times 40 bits, so that nothing needs padding."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def page_headers(pages: DataFrame, min_payload: int = MIN_PAYLOAD, date: str = DATE) -> DataFrame:
    """record_key, header, digest, size: the headers of one record per page.

    Of pages with equal payloads of at least ``min_payload`` bytes the one with the smallest page_id is a response, the
    others are revisits of it. A repeated row is a record of its own, of the same type. A page without id is a response
    only if no page with an id has its payload. A null html is an empty payload.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    narrow = pages.select(
        "page_id",
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A").alias("url"),
        F.sha2(payload, 256).alias("digest"),
        base32_sha1(payload).alias("sha1"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    firsts = narrow.groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.min(F.struct("sha1", "size")).alias("_lo"), F.max(F.struct("sha1", "size")).alias("_hi")
    )
    one = F.when(F.col("_lo") == F.col("_hi"), F.col("first_id")).otherwise(F.raise_error(F.lit("two payloads under one SHA-256")).cast("long"))
    firsts = firsts.select("digest", one.alias("first_id"))
    joined = hot_key_join(narrow, firsts, ["digest"], "inner")
    revisit = (F.col("size") >= min_payload) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size"), F.lit(END * 2))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}{END}WARC-Refers-To: "), record_id(F.col("first_id")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block),
    ]
    header = F.concat(F.concat_ws(END, *lines), F.lit(END * 2), http)
    return joined.select(F.col("page_id").alias("record_key"), F.encode(header, "UTF-8").alias("header"), "digest", "size")


def page_payloads(pages: DataFrame) -> DataFrame:
    """digest, size, packed: each distinct payload once. Payloads are compressed before they are shuffled, and each task sends one of a digest."""

    def step(batch):
        squeeze = zstandard.ZstdCompressor(level=3)
        raw = [b"" if t is None else t.encode() for t in batch.column(0).to_pylist()]
        yield {"digest": [hashlib.sha256(r).hexdigest() for r in raw], "size": list(map(len, raw)), "packed": list(map(squeeze.compress, raw))}

    packed = map_batches(pages.select("html"), step, "digest string, size long, packed binary")
    one = Window.partitionBy("digest").orderBy("size")
    return packed.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")


def write_archive(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD) -> None:
    """Archive of all pages (page_id, url, html) below ``path``; other columns are not archived."""
    page_headers(pages, min_payload).write.parquet(f"{path}/headers")
    page_payloads(pages).write.option("compression", "none").parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record_key, header, digest, size, packed: every record with the payload it has or refers to, still compressed."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    return hot_key_join(headers, payloads.select("digest", "packed"), ["digest"], "left")


def _unpacked(packed: bytes | None, size: int, digest: str) -> bytes:
    if packed is None:
        raise ValueError(f"archive holds no payload {digest}")
    payload = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(size, 1)) if size else b""
    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload doesn't fit its digest {digest}")
    return payload


def restore(records: DataFrame) -> DataFrame:
    """record_key, record, payload: the exact bytes of each record, and the payload (that of the response for a revisit)."""

    def step(batch):
        out = {"record_key": batch.column(0), "record": [], "payload": []}
        for header, digest, size, packed in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            payload = _unpacked(packed, size, digest)
            own = b"" if b"\r\nWARC-Type: revisit\r\n" in header.split(b"\r\n\r\n", 1)[0] + b"\r\n" else payload
            out["record"].append(header + own + b"\r\n\r\n")
            out["payload"].append(payload)
        yield out

    return map_batches(records.select("record_key", "header", "digest", "size", "packed"), step, "record_key long, record binary, payload binary")


REFERS = re.compile(rb"\r\nWARC-Refers-To: <urn:page:(-?\d+)>\r\n")
TYPE = re.compile(rb"\r\nWARC-Type: (\w+)\r\n")
STATED = re.compile(rb"\r\nWARC-Payload-Digest: sha1:(\w+)\r\n")


def described(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, from its header and its payload.

    The digest is taken from the payload and must be the one the header states.
    """

    def step(batch):
        out: dict[str, list] = {n: [] for n in ("payload_bytes", "payload_digest", "record_type", "refers_to")}
        for header, digest, size, packed in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
            head = header.split(b"\r\n\r\n", 1)[0] + b"\r\n"
            payload = _unpacked(packed, size, digest)
            sha1 = base64.b32encode(hashlib.sha1(payload).digest())
            if STATED.search(head)[1] != sha1:
                raise ValueError("payload doesn't fit the digest in its header")
            refers = REFERS.search(head)
            out["payload_bytes"].append(len(payload))
            out["payload_digest"].append(sha1.decode())
            out["record_type"].append(TYPE.search(head)[1].decode())
            out["refers_to"].append(int(refers[1]) if refers else None)
        yield {"page_id": batch.column(0), **out}

    return map_batches(
        records.select("record_key", "header", "digest", "size", "packed"),
        step,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages to an archive (in the shared scratch folder unless a path is given) and describe what is read back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archive")
    write_archive(pages, path)
    return described(read_records(spark, path))
