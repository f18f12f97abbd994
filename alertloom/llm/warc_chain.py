"""WARC archives: writing with revisit records, and reading back by boundary chains.

Records are written by Spark's text writer with the record separator as line separator, so they reach any file system Spark
writes to; files hold a bounded number of records. Readers do not trust the magic line: each task emits every candidate record
with the offset where its successor must stand, and pointer jumping from the start of each file keeps the reachable ones. A
magic line inside a payload is a candidate that nothing reaches.

Defined cases: a null html is an empty payload; payloads of ``least`` bytes and more are compared, smaller ones are always
responses; the smallest page_id of equal payloads is the response, also when rows repeat that id; a null page_id revisits any
known one; a null url is a urn; control signs and spaces in a url are percent-coded; a truncated record ends its chain.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.common import folder, stored

END = "\r\n\r\n"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
DATE = "2024-01-01T00:00:00Z"
FIELDS = pa.schema([("path", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("digest_ok", pa.bool_())])
ROW = ("path string, at long, next long, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
       "payload_digest string, digest_ok boolean")


def base32(hex40: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: five hex digits are four base32 digits."""
    part = [F.lpad(F.conv(F.substring(hex40, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*part)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def name(page_id: Column) -> Column:
    return F.concat(F.lit("urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")))


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One record text per page, without its separator."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.octet_length("html").alias("size"), F.sha1("html").alias("digest"))
    same = (rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
            .where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    # written first, so that its real size decides how it is joined and the payloads are not shuffled for a small one
    joined = rows.join(stored(same, "copies"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)) & (F.col("size") >= least)
    uri = F.coalesce(F.regexp_replace(F.regexp_replace("url", "[\\x00-\\x20\\x7F]+", "%20"), "^$", "urn:x-page:empty"), name(F.col("page_id")))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(again, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("size"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), name(F.col("page_id")), F.lit(">"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                               line("WARC-Refers-To", F.concat(F.lit("<"), name(F.col("first")), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit("\r\n"))
    return joined.select(F.concat(head, http, F.when(again, "").otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, out: str | None = None, least: int = 0, per_file: int = 2048) -> str:
    """Write the archives and return their folder."""
    out = out or folder(pages.sparkSession, "warc")
    records(pages, least).write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "none").text(out)
    return out


def parse(path: str, data: bytes) -> Iterator[tuple]:
    """Every candidate record of one file."""
    for found in MAGIC.finditer(data):
        at = found.start()
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            continue
        lines = [line.partition(b":") for line in data[found.end():stop].split(b"\r\n")]
        head = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in lines}
        size = head.get(b"content-length", "")
        if not size.isascii() or not size.isdigit() or len(size) > 18:
            continue
        begin, end = stop + 4, stop + 4 + int(size)
        if data[end:end + 4] != b"\r\n\r\n":
            continue
        block = data[begin:end]
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, told = head.get(b"warc-type", ""), head.get(b"warc-payload-digest", "").removeprefix("sha1:")
        digest, n = told, len(payload)
        if kind == "revisit":
            length = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", http)
            n = int(length[1]) if length else None
        else:
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        number = lambda key: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", head.get(key, ""))) else None
        yield (path, at, end + 4, number(b"warc-record-id"), head.get(b"warc-target-uri"), kind, number(b"warc-refers-to"), n, digest, digest == told)


def candidates(spark: SparkSession, where: str) -> DataFrame:
    """Candidate records of all files of a folder, with the offset where the successor of each must stand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(parse(path, content.as_py() or b""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FIELDS.types)], schema=FIELDS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(where)
    return files.select("path", "content").mapInArrow(run, ROW)


def reachable(jumps: DataFrame) -> DataFrame:
    """``(path, at)`` of the records that the chain from each file's start visits, from ``path, at, next``.

    Jumps double each round, so the rounds are the logarithm of the records in a file."""
    marks = jumps.select("path", F.col("at").alias("next"))
    jumps = stored(jumps.select("path", "at", "next").join(marks, ["path", "next"], "left_semi"), "jumps")
    known = [stored(marks.where("next = 0").select("path", F.col("next").alias("at")), "reached")]
    while True:
        so_far = known[0] if len(known) == 1 else known[0].unionByName(known[1])
        more = stored(so_far.join(jumps, ["path", "at"]).select("path", F.col("next").alias("at")), "reached")
        if more.isEmpty():
            return so_far
        known = [stored(so_far.unionByName(more), "reached")]
        twice = jumps.select("path", F.col("at").alias("from"), F.col("next").alias("at"))
        jumps = stored(twice.join(jumps, ["path", "at"]).select("path", F.col("from").alias("at"), "next"), "jumps")


def read(spark: SparkSession, where: str) -> DataFrame:
    """The records of all archives of a folder."""
    found = stored(candidates(spark, where), "candidates")
    return found.join(reachable(found), ["path", "at"], "left_semi")
