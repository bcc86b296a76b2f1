"""WARC archives with resolved revisits.

Headers (page id, url, digest) are shuffled by payload digest, pre-aggregated to the largest page id of
each, and joined back; payloads go straight from the pages to the writer. The rows that revisit another are broadcast to it if they are few
(checked), and joined by page id otherwise. Originals become response records,
the others revisit records that refer to them, all with fresh headers.
Archives are gzip files of WARC records through Spark's own committer (so retried or
lost tasks leave no halves) in the shared folder; each begins with a warcinfo record. The reader parses them as streams and resolves
revisits by a join with the responses they refer to, of headers alone.

Defined results: null html is an empty payload; rows with equal page ids and payloads (repeated
rows) are all responses if theirs is the largest id of the payload, and have one record id; a null page id is written as
the empty string and is the smallest; a null url becomes a urn; extra columns are ignored; empty tables give empty archives;
a revisit whose response is not in the archives has null payload_bytes and refers_to; a damaged response raises.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, ensure_checkpoint_dir, steps, table

#: Pages of one file, besides its warcinfo; rows of revisits that are broadcast (about 200 bytes each).
PER_FILE, FEW = 10_000, 200_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADS = "record_id string, page_id long, record_type string, refers_to_record string, payload_bytes long, payload_digest string"


def record(pairs: list[tuple[str, str]], block: str) -> str:
    """A WARC record without the line ends behind it."""
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + f"Content-Length: {len(block.encode())}{END}{block}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(x: str) -> str:
    return x.replace("\r", " ").replace("\n", " ")


def _uuid(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _keyed(pages: DataFrame) -> DataFrame:
    page = F.col("page_id").cast("long")
    name = F.coalesce(page.cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), name))
    html = F.coalesce("html", F.lit(""))
    return pages.select(page.alias("page_id"), name.alias("name"), url.alias("url"), html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha"))


def records(pages: DataFrame, date: str | None = None) -> DataFrame:
    """record (string): one for each row of pages (page_id, url, html), and a warcinfo before each PER_FILE of a task. date: the capture's, now if not given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = _keyed(pages)
    heads = checkpointed(rows.select("name", "page_id", "url", "sha"))
    first = heads.groupBy("sha").agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("original_url"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    revisits = heads.select("name", "page_id", "sha").join(first, "sha").where("original is not null and not page_id <=> original")
    revisits = checkpointed(revisits.select("name", "sha", "original", "original_url").distinct())
    marked = rows.join(F.broadcast(revisits) if revisits.count() <= FEW else revisits, ["name", "sha"], "left").select("name", "url", "html", "original", "original_url")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in steps(batches, "html"):
            out = []
            for name, url, html, original, original_url in zip(*(batch.column(c).to_pylist() for c in ("name", "url", "html", "original", "original_url")), strict=True):
                if n % PER_FILE == 0:
                    out.append(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], "software: rinkframe\r\nformat: WARC File Format 1.1\r\n"))
                n += 1
                payload = html.encode()
                code = digest(payload)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}"
                pairs = [("WARC-Record-ID", _uuid(name, code)), ("WARC-Date", date), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{code}"), ("X-Page-ID", name), ("Content-Type", "application/http; msgtype=response")]
                if original is None:
                    out.append(record([("WARC-Type", "response"), *pairs], head + html))
                else:
                    refer = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uuid(original, code)), ("WARC-Refers-To-Target-URI", _clean(original_url)), ("WARC-Refers-To-Date", date)]
                    out.append(record([("WARC-Type", "revisit"), *pairs, *refer], head))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])

    return arrow_map(marked, write, "record string")


def write_archives(pages: DataFrame, path: str, date: str | None = None) -> str:
    """Files of at most PER_FILE pages, each a gzip stream of records."""
    records(pages, date).write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", PER_FILE + 1).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """WARC headers and block of each record of a gzip file, read as a stream."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        while line := f.readline():
            if line == b"\r\n":
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("no WARC record where one should begin")
            fields = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                fields[key] = value
            yield fields, f.read(int(fields["Content-Length"]))


def heads(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, record_type, refers_to_record, payload_bytes (of responses) and payload_digest of the archives' responses and revisits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in HEADS.split(", ")]
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for fields, block in parse(data.as_py()):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload, code = block.partition(b"\r\n\r\n")[2], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != code:
                        raise ValueError(f"damaged record of page {fields['X-Page-ID']}")
                    rows.append((fields["WARC-Record-ID"], int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, kind, fields.get("WARC-Refers-To"), len(payload) if kind == "response" else None, code))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return arrow_map(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content"), run, HEADS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the archives in a folder: page_id, record_type, payload_bytes, payload_digest, refers_to."""
    found = checkpointed(heads(spark, path))
    responses = found.where("record_type = 'response'")
    known = responses.select(F.col("record_id").alias("refers_to_record"), F.col("payload_bytes").alias("bytes"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_to_record"])
    resolved = found.where("record_type = 'revisit'").join(known, "refers_to_record", "left")
    columns = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(resolved.drop("payload_bytes").withColumnRenamed("bytes", "payload_bytes").select(*columns))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read(spark, write_archives(table(spark, sf_dir, "pages"), path))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS x FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS original FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
FROM g
"""
