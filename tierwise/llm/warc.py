"""WARC archives: written as text, read back, and assembled into one nested row per capture.

Writing. Only digests meet to find equal payloads: the table of digests that occur more than once is broadcast if it
has at most ``broadcast_rows`` rows, else joined, where Spark splits a digest that very many rows share. Every row becomes a response (or revisit), a request and a metadata record; the last two name
the first in WARC-Concurrent-To. Payloads are UTF-8, so a file of records is a text file whose lines end
with the CRLF CRLF that closes a WARC record, and Spark's own text sink writes it to any file system.
Reading. Files come through ``binaryFile`` and are parsed by Content-Length. Assembly groups records by
the identifier they are concurrent to; payloads need not travel for that.

Null html is an empty payload, a null url leaves WARC-Target-URI out, line ends in a url are escaped.
Of records with equal payloads of at least ``min_revisit_bytes`` the smallest id is the response and the
others revisit it; null ids count as largest, rows with the response's own id are responses too. Repeated
rows give equal records, counted and given back as often as they came.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import fresh_path, written
from .text import mapped

RECORDS = "record_type string, record_id string, concurrent_to string, target_uri string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, fields map<string,string>, payload binary"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", broadcast_rows: int = 500_000) -> DataFrame:
    """One row per record, its text in ``value``."""
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
    ).withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "size": F.octet_length("payload")})
    rows = rows.withColumn("capture", F.concat(F.lit("<urn:capture:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.concat_ws("\n", F.coalesce("url", F.lit("")), "digest").cast("binary")), F.lit(">")))
    first = (
        rows.filter(F.col("size") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "capture"))).alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and first is not null")
    )
    first = written(first.select("digest", "first"), "first")
    small = first.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = rows.join(F.broadcast(first) if small else first, "digest", "left").withColumn(
        "refers", F.when((F.col("size") >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id")), F.col("first.capture"))
    )
    nl = F.lit("\r\n")
    uri = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), "url", nl)).otherwise(F.lit(""))

    def record(kind, own, head, content_type, block):
        return F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), kind, nl, F.lit("WARC-Record-ID: "), own, nl, F.lit(f"WARC-Date: {date}\r\n"), uri, head,
            F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
        )

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest", nl)
    revisit = F.concat(digest, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), "refers", nl)
    same = F.concat(F.lit("WARC-Concurrent-To: "), "capture", nl)
    target = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://([^/?#]*)", 1)
    own = lambda kind: F.concat(F.regexp_replace("capture", ">$", ""), F.lit(f":{kind}>"))
    return rows.select(
        F.explode(
            F.array(
                F.when(F.col("refers").isNull(), record(F.lit("response"), F.col("capture"), digest, "application/http;msgtype=response", F.concat(http, F.col("payload")))).otherwise(
                    record(F.lit("revisit"), F.col("capture"), revisit, "application/http;msgtype=response", http)
                ),
                record(F.lit("request"), own("request"), same, "application/http;msgtype=request", F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))),
                record(F.lit("metadata"), own("metadata"), same, "application/warc-fields", F.concat(F.lit("id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), nl)),
            )
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, captures_per_file: int = 4000, file_bytes: int = 1 << 30, html_col: str = "html", **columns) -> None:
    """Gzipped archives below ``path``. No file holds more than ``captures_per_file`` captures, nor so many that their
    payloads could exceed ``file_bytes``, unless it is one capture."""
    largest = pages.agg(F.max(F.octet_length(F.col(html_col))).alias("n")).first()["n"] or 0
    captures_per_file = max(1, min(captures_per_file, file_bytes // (largest + 4096)))
    (
        records(pages, html_col=html_col, **columns)
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * captures_per_file)
        .text(path)
    )


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of one archive, gzipped or not."""
    raw = io.BytesIO(content)
    stream = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record. A response's digest and length are taken from its payload, a revisit's from its headers."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = pa.schema([(n, pa.string()) for n in ("record_type", "record_id", "concurrent_to", "target_uri", "refers_to", "payload_digest")] + [("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def of(batch: pa.RecordBatch):
        for content in batch.column(0):
            rows, size = [], 0
            for head, block in parsed(content.as_py()):
                kind = head.get("warc-type")
                said = head.get("warc-payload-digest", "").partition(":")[2] or None
                payload = length = ok = None
                fields = []
                if kind in ("response", "revisit"):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if kind == "response":
                        digest = hashlib.sha256(payload).hexdigest()
                        ok, said, length = said in (None, digest), digest, len(payload)
                    else:
                        declared = dict(x.split(b":", 1) for x in http.split(b"\r\n")[1:] if b":" in x)
                        length = int(declared.get(b"Content-Length", b"0"))
                        payload = None
                elif kind == "metadata":
                    fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode().splitlines()) if k]
                rows.append((kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-refers-to"), said, length, ok, fields, payload if with_payload else None))
                size += len(payload or b"") if with_payload else 200
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return mapped(files, of, RECORDS)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row per capture: its main record, request, metadata, joined by concurrent-to."""
    main = F.col("record_type").isin("response", "revisit")
    part = lambda cond, *names: F.first(F.when(cond, F.struct(*names)), ignorenulls=True)
    rows = found.withColumn("capture", F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
    joined = rows.groupBy("capture").agg(
        F.count_if(main).alias("copies"),
        part(main, "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "digest_ok", "payload").alias("response"),
        part(F.col("record_type") == "request", "record_id", "target_uri").alias("request"),
        part(F.col("record_type") == "metadata", "record_id", "fields").alias("metadata"),
    )
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int")))).drop("copies", "copy")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives to the shared folder, reads them back, and describes each capture."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, id_col=id_col, url_col=url_col, html_col=html_col)
    captures = transactions(read_records(spark, path, with_payload=False))
    kind = pages.schema[id_col].dataType.simpleString()
    return captures.select(
        F.expr("nullif(metadata.fields['id'], '')").cast(kind).alias(id_col),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.expr("nullif(regexp_extract(response.refers_to, '^<urn:capture:(.*):[0-9a-f]+>$', 1), '')").cast(kind).alias("refers_to"),
    )
