"""WARC archives with revisit resolution.

Headers (page, payload digest, payload size) are shuffled by digest; in each group of equal payloads of
at least MIN_BYTES bytes the record of smallest page_id is the response, the others become revisit
records that refer to it. Archives are written without the repeated payloads and with fresh headers:
plain WARC/1.1 records, a gzip file a task, through Spark's text writer (so on any file system, and a
lost executor's half-written file never counts). Records hold only UTF-8 text, and each ends in a blank
line whose last line end is the writer's line separator.

Null html counts as an empty payload, always a response. Each row gives a record, also where a page_id
repeats, with the same payload or with another one: revisits are told by page_id and digest. A row without
page_id is always a response, has no WARC-Page field and reads back as null. Empty tables give empty archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cytolake.llm.common import materialise, new_path

MIN_BYTES = 100
#: Records and payload bytes of one archive file at most, but for a single longer page: readers take a file at a time.
FILE_RECORDS, FILE_BYTES = 2_000, 1 << 29
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

HEADERS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest and payload_bytes of each page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes"))


def resolve(found: DataFrame) -> DataFrame:
    """page_id, payload_digest and the response that it refers to, for every page that revisits another.

    The aggregate combines before its shuffle, and the join has the digest alone as its key on both
    sides, so a digest with very many pages is split by adaptive execution.
    """
    long = found.where(F.col("payload_bytes") >= MIN_BYTES)
    originals = long.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return long.join(originals, "payload_digest").where("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", page.cast("string"), digest))
    return _lines("<urn:uuid:", F.substring(h, 1, 8), "-", F.substring(h, 9, 4), "-", F.substring(h, 13, 4), "-", F.substring(h, 17, 4), "-", F.substring(h, 21, 12), ">")


def records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """One string column: the record of each page, without its last line end."""
    payload = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", payload.alias("payload"), F.sha2(F.encode(payload, "UTF-8"), 256).alias("payload_digest"))
    known = known.join(revisits, ["page_id", "payload_digest"], "left")
    size = F.octet_length(F.encode("payload", "UTF-8"))
    page, digest, revisit = F.col("page_id"), F.col("payload_digest"), F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    http = _lines("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", size.cast("string"), "\r\n\r\n")
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    refers = _lines("\r\nWARC-Profile: " + PROFILE + "\r\nWARC-Refers-To: ", _record_id(F.col("refers_to"), digest), "\r\nWARC-Refers-To-Page: ", F.col("refers_to").cast("string"))
    head = _lines(
        "WARC/1.1\r\nWARC-Type: ", F.when(revisit, "revisit").otherwise("response"),
        "\r\nWARC-Record-ID: ", _record_id(page, digest), "\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: ", uri,
        "\r\nWARC-Payload-Digest: sha256:", digest,
        F.when(page.isNull(), "").otherwise(_lines("\r\nWARC-Page: ", page.cast("string"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length(F.encode(block, "UTF-8")).cast("string"), "\r\n\r\n",
    )
    return known.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Archives under path. Pages go by classes of their size, longer ones with fewer records a file, so files stay bounded in bytes."""
    revisits = materialise(resolve(headers(pages)), "warc-revisits")
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    longest = pages.agg(F.max(size)).first()[0] or 0
    least, most = -1, FILE_BYTES // FILE_RECORDS
    while least < longest or least < 0:
        few = pages.where((size > least) & (size <= most)) if least >= 0 or most < longest else pages
        out = records(few, revisits).write.mode("append").option("compression", "gzip").option("lineSep", "\n")
        out.option("maxRecordsPerFile", max(1, FILE_BYTES // most)).text(path)
        least, most = most, 16 * most


_HEAD = re.compile(rb"WARC/1\.[01]\r\n")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower-case names) and block of each record of one archive."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not _HEAD.fullmatch(line):
            raise ValueError("a record must begin with its version")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.strip().decode()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        yield fields, block


def http_payload(block: bytes) -> tuple[int, bytes]:
    """Declared length and body of an HTTP response message."""
    head, _, body = block.partition(b"\r\n\r\n")
    declared = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return declared, body


def read(spark: SparkSession, path: str) -> DataFrame:
    """HEADERS for each record of the archives; responses are checked against their digest and length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                with gzip.open(io.BytesIO(content.as_py())) as stream:
                    for fields, block in parse(stream):
                        declared, body = http_payload(block)
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        kind = fields["warc-type"]
                        if kind == "response" and (len(body) != declared or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError(f"record {fields['warc-record-id']} differs from its digest")
                        page, target = (None if x is None else int(x) for x in (fields.get("warc-page"), fields.get("warc-refers-to-page")))
                        out.append((page, declared, digest, kind, target))
                columns = list(zip(*out)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return materialise(files.mapInArrow(rows, HEADERS), "warc-read")


def resolved(found: DataFrame) -> DataFrame:
    """Revisit records joined to their original responses by digest: payload_bytes comes from the response, and a revisit without one is an error."""
    originals = found.where("record_type = 'response'").select("payload_digest", F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("original_bytes"))
    long = originals.where(F.col("original_bytes") >= MIN_BYTES).distinct()
    joined = found.where("record_type = 'revisit'").join(long, ["payload_digest", "refers_to"], "left")
    checked = joined.withColumn("payload_bytes", F.when(F.col("original_bytes").isNull(), F.raise_error(F.lit("a revisit has no original"))).otherwise(F.col("original_bytes")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.where("record_type = 'response'").select(columns).unionByName(checked.select(columns))


def write_and_read(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    return resolved(read(spark, path))


SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), o AS (SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""
