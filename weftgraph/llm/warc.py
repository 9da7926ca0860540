"""WARC archives with revisit records for payloads that were captured before.

Archives are written by Spark's text writer, whose commit drops what lost tasks have left: a file is
one gzip member, without the optional warcinfo record.
"""

from __future__ import annotations

import gzip
import io
import math
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.shared import group_facts, mapped, salt_of, shared_dir

#: Fixed values of the record format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "WARC-Page-ID"  # an extension field: the page's number
END = "\r\n"
#: The bytes of records, before compression, that a file is to hold at most, as a reader takes a whole file; and the records.
FILE_BYTES, RECORDS_A_FILE = 128 << 20, 4000


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string's UTF-8 bytes: each 10 hex digits are 8 base32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null html: empty), payload_bytes and payload_digest."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})


def responses(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The page of the largest page_id of each payload, from headers alone (page_id, url, payload_bytes, payload_digest).

    One row for each (payload_digest, salt) with the response (page_id, url): joined on both columns,
    a payload of a third of all pages is spread over the salts.  Payloads under least_bytes and
    null ids have none.
    """
    keyed = headers.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("payload_digest", F.struct("page_id", "url").alias("page"), salt_of("page_id").alias("salt"))
    return group_facts(keyed, "payload_digest", {"first": (F.max, "page")})


def resolved(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """with_digest's columns, record_type, refers_to and refers_to_url, and copy, a number among repeated rows, of every page.

    Headers are shuffled by payload digest and joined to their payload's response; payloads move
    once, to meet their decision.  Of repeated rows of the response (same page_id and payload) one
    is the response and the others revisit it.  Rows of null page_id are responses.
    """
    full = with_digest(pages)
    found = responses(full.select("page_id", "url", "payload_bytes", "payload_digest"), least_bytes)
    both = full.withColumn("salt", salt_of("page_id")).join(found, ["payload_digest", "salt"], "left")
    decided = both.withColumn("copy", F.row_number().over(Window.partitionBy("payload_digest", "salt", "page_id").orderBy(F.desc("url"))))
    revisit = F.col("first").isNotNull() & ((F.col("page_id") != F.col("first.page_id")) | (F.col("copy") > 1))
    return decided.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "copy", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.col("first.url")).alias("refers_to_url"))


def record_id(page_id: Column, copy: Column) -> Column:
    """A record's own identifier: a UUID made of the page, the payload and the number among repeated rows."""
    x = F.sha1(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), F.col("payload_digest"), copy.cast("string")))
    part = lambda at, n: F.substring(x, at, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def record(date: str) -> Column:
    """The text of a record but for the line ends that close it; a revisit holds HTTP headers and no payload."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = lambda c: F.regexp_replace(F.col(c), r"[\x00-\x20\x7f]", "%20")
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("copy"))),
        F.concat(F.lit(f"{PAGE}: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Target-URI: "), uri("url")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.lit(1)))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), uri("refers_to_url"))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), block)


def records_a_file(pages: DataFrame, most: int = RECORDS_A_FILE, size: int = FILE_BYTES) -> int:
    """How many records fill a file to size at most: records come in hashed order, so six deviations of their sum are allowed for, and the longest."""
    n = F.octet_length(F.col("html").cast("string")).cast("double")
    mean, deviation, longest = (x or 0.0 for x in pages.agg(F.avg(F.coalesce(n, F.lit(0.0))), F.stddev_pop(F.coalesce(n, F.lit(0.0))), F.max(n)).first())
    while most > 1 and most * (mean + 1000) + 6 * math.sqrt(most) * deviation + longest > size:
        most //= 2
    return most


def write_archives(decided: DataFrame, path: str, records: int = RECORDS_A_FILE) -> None:
    """Gzipped archives of resolved's rows under path, with Spark's own commit of finished tasks."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    writer = decided.select(record(date).alias("value")).write.option("lineSep", END + END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records).text(path)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers (names in lower case) and the block of each record of a gzipped archive, one at a time."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:40]!r}")
            headers = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode("utf-8").partition(":")
                headers[name.strip().lower()] = value.strip()
            block = f.read(int(headers["content-length"]))
            if len(block) < int(headers["content-length"]):
                raise ValueError("a record ends early")
            yield headers, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits).

    A response's digest is checked against its payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import base64
        import hashlib

        number = lambda x: None if x is None else int(x)
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                for headers, block in records_of(content.as_buffer()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(y.split(b":")[1] for y in http.split(b"\r\n") if y.lower().startswith(b"content-length:")))
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{headers['warc-record-id']}: the payload is not the one of its digest")
                    rows.append((number(headers.get(PAGE.lower())), headers.get("warc-target-uri"), kind, size, digest, number(headers.get("warc-refers-to-page-id")), payload.decode("utf-8") if kind == "response" else None))
                    held += len(payload)
                    if len(rows) == 500 or held > 4 << 20:
                        yield dict(zip(names, map(list, zip(*rows))))
                        rows, held = [], 0
                if rows:
                    yield dict(zip(names, map(list, zip(*rows))))

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"
    return mapped(spark.read.format("binaryFile").load(path).select("content"), read, schema)


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as deduplicated archives and reads them back (read_archives' columns).

    Null html is an empty payload; null ids are responses; repeated rows are records of their own;
    an empty table gives no record; further columns are not read.
    """
    path = path or shared_dir(pages.sparkSession)
    write_archives(resolved(pages, least_bytes), path, records_a_file(pages))
    return read_archives(pages.sparkSession, path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every page, read back from the archives."""
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CHUNKS = " || ".join(f"to_base(CAST('0x' || substr(x, {1 + 10 * i}, 10) AS BIGINT), 32, 8)" for i in range(4))
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, translate({CHUNKS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM r
"""
