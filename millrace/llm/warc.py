"""WARC archives, content-addressed.

An archive is two tables in one folder: `payloads` holds each distinct payload once, deflated, under its
SHA-256, `headers` the exact header bytes of every record. A record is header + payload + CRLF CRLF,
rebuilt by a join on the digest. Reading parses the rebuilt records and verifies their lengths and payloads.

Defined cases: a null payload is empty; payloads under `least` bytes are always responses; of equal
larger payloads the smallest page_id is the response (null ids last, then the smallest URL, then one
of identical rows) and the others revisit it; a null URL leaves its header line out; a URL
with control characters is percent-encoded in its line and kept exactly in a line of its own; a null date is `DATE`; an empty table makes an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, ship

LEAST_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(url: Column) -> Column:
    """The URL with each control character percent-encoded, as a header line may not hold one."""
    clean = url
    for c in [*range(32), 127]:
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike("[\\x00-\\x1F\\x7F]"), clean).otherwise(url)


def _pages(pages: DataFrame, key: str, url: str, payload: str, date: str | None) -> DataFrame:
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    when = F.date_format(F.to_utc_timestamp(F.col(date).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date else F.lit(None)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.coalesce(when.cast("string"), F.lit(DATE)).alias("date"))
    return rows.withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def plan_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """A row for each record: page_id, digest, header. `pages` as from _pages; payload bytes do not travel.

    Equal rows are counted before anything is joined, and only digests that occur twice take part in
    the join, one row each; a digest of very many pages is split by adaptive skew handling.
    """
    meta = pages.select("page_id", "url", "date", "digest", F.octet_length("payload").cast("long").alias("size")).groupBy("page_id", "url", "date", "digest", "size").agg(F.count("*").alias("copies"))
    owner = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "date"))
    shared = (
        meta.where(F.col("size") >= least).groupBy(F.col("digest").alias("of"))
        .agg(owner.alias("owner"), F.sum("copies").alias("n")).where("n > 1")
    )
    rows = (
        meta.join(shared, F.col("digest") == F.col("of"), "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .withColumn("revisit", F.col("of").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("owner.page_id")) & F.col("url").eqNullSafe(F.col("owner.url")) & (F.col("date") == F.col("owner.date")) & (F.col("copy") == 1)))
    )
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    only = lambda c: F.when(F.col("revisit"), c)
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _uuid(F.col("page_id"), F.col("url"), F.col("date"), F.col("digest"), F.col("copy")), F.lit(">"))),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", _clean(F.col("url"))),
        _line("X-Target-URI-Base64", F.when(_clean(F.col("url")) != F.col("url"), F.base64(F.encode("url", "UTF-8")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", only(F.lit(PROFILE))),
        _line("WARC-Refers-To", only(F.concat(F.lit("<urn:uuid:"), _uuid(F.col("owner.page_id"), F.col("owner.url"), F.col("owner.date"), F.col("digest"), F.lit(1)), F.lit(">")))),
        _line("WARC-Refers-To-Target-URI", only(_clean(F.col("owner.url")))),
        _line("X-Page-Id", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-Id", only(F.col("owner.page_id").cast("string"))),
        _line("X-Payload-Length", F.col("size").cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )
    return rows.select("digest", header.alias("header"))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_BYTES, date: str | None = None) -> None:
    """Write both tables below `path`; `date` names a column of capture times. Payloads are folded by digest on the map side, so copies cross the network once a task."""
    rows = _pages(pages, key, url, payload, date)
    ship(pages.sparkSession)
    plan_records(rows, least).write.option("compression", "zstd").parquet(f"{path}/headers")
    bodies = rows.select("digest", F.encode("payload", "UTF-8").alias("payload")).mapInArrow(_deflate, "digest string, deflated binary")
    bodies.groupBy("digest").agg(F.first("deflated").alias("deflated")).write.parquet(f"{path}/payloads")


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of a batch once each, deflated, so that what crosses the network is small."""
    for batch in batches:
        once = dict(zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        held = [zlib.compress(x.as_buffer(), 1) for x in once.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.string()), pa.array(held, pa.binary())], names=["digest", "deflated"])


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", f"(?:^|\\r\\n){name}: ([^\\r]*)\\r\\n", 1), F.lit(""))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The stored headers, with the fields that joins need."""
    h = spark.read.schema("digest string, header string").parquet(f"{path}/headers")
    return h.select("digest", "header", _field("X-Page-Id").cast("long").alias("page_id"), _field("WARC-Type").alias("record_type"))


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [zlib.decompress(x.as_buffer()) for x in batch.column(1)]
        columns = [batch.column(0), pa.array(held, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in held], pa.string()), pa.array([len(x) for x in held], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["stored", "payload", "actual", "size"])


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads: digest, payload, and digest and length of the bytes as read."""
    ship(spark)
    return spark.read.schema("digest string, deflated binary").parquet(f"{path}/payloads").mapInArrow(_payloads, "stored string, payload binary, actual string, size long")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one digest stand together (or nearly so): each payload is inflated and hashed once for a run of them."""
    last = payload = found = None
    for batch in batches:
        out: list[tuple] = []
        for page, kind, header, digest, held in zip(*batch.columns, strict=True):
            if not held.is_valid:
                raise ValueError(f"a record has no stored payload: {digest.as_py()}")
            if digest != last:
                payload = zlib.decompress(held.as_buffer())
                last, found = digest, (hashlib.sha256(payload).hexdigest(), len(payload))
            body = payload if kind.as_py() == "response" else b""
            out.append((page.as_py(), kind.as_py(), header.as_py().encode() + body + b"\r\n\r\n", *found))
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["page_id", "record_type", "record", "actual", "size"])


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, the original record, byte for byte (a revisit has no payload of its own), and digest and length of the stored payload as read."""
    ship(spark)
    stored = spark.read.schema("digest string, deflated binary").parquet(f"{path}/payloads").withColumnRenamed("digest", "stored")
    held = read_headers(spark, path).join(stored, F.col("digest") == F.col("stored"), "left").select("page_id", "record_type", "header", "digest", "deflated")
    return held.mapInArrow(_records, "page_id long, record_type string, record binary, actual string, size long")


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The fields of the record at a place, its payload (what follows the HTTP header), and where the record ends."""
    cut = data.find(b"\r\n\r\n", at)
    fields = dict(x.split(": ", 1) for x in data[at:cut].decode().split("\r\n")[1:])
    if raw := fields.pop("X-Target-URI-Base64", None):
        fields["WARC-Target-URI"] = base64.b64decode(raw).decode()
    end = cut + 4 + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"record does not end where its length says: {fields.get('WARC-Record-ID')}")
    return fields, data[data.find(b"\r\n\r\n", cut + 4) + 4 : end], end + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for record, actual, size in zip(*batch.columns, strict=True):
            fields, payload, _ = parsed(record.as_buffer().to_pybytes())
            said, length = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
            found = (hashlib.sha256(payload).hexdigest(), len(payload)) if fields["WARC-Type"] == "response" else (actual.as_py(), size.as_py())
            if found != (said, length):
                raise ValueError(f"payload does not match its digest: {said}")
            refers = fields.get("X-Refers-To-Page-Id")
            page = fields.get("X-Page-Id")
            rows.append((page and int(page), found[1], found[0], fields["WARC-Type"], refers and int(refers), fields.get("WARC-Target-URI")))
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, from the rebuilt record: its length must be right and its payload what the digest says, else this fails.

    A response's payload is hashed as it stands in the record; a revisit's, once, where it is stored.
    """
    ship(spark)
    rows = reconstruct(spark, path).select("record", "actual", "size")
    return rows.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def export_files(spark: SparkSession, path: str, out: str, compression: str = "gzip", records_per_file: int = 20_000) -> None:
    """Standard WARC files from an archive, through Spark's own writer: the record separator is its line separator."""
    held = read_headers(spark, path).join(read_payloads(spark, path), F.col("digest") == F.col("stored"), "left")
    body = F.when(F.col("record_type") == "response", F.decode("payload", "UTF-8")).otherwise("")
    rows = held.select(F.concat("header", body).alias("value")).write.option("maxRecordsPerFile", records_per_file)
    rows.option("lineSep", "\r\n\r\n").option("compression", compression).text(out)


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import gzip

    for frame in frames:
        for raw in frame["content"]:
            data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            at, found = 0, []
            while at < len(data):
                fields, payload, at = parsed(data, at)
                found.append((fields.get("WARC-Record-ID"), fields.get("WARC-Type"), fields.get("WARC-Target-URI"), fields.get("WARC-Payload-Digest"), payload))
            yield pd.DataFrame(found, columns=["record_id", "record_type", "url", "payload_digest", "payload"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of exported WARC files."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_parse, "record_id string, record_type string, url string, payload_digest string, payload binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path)


OP5_SQL = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, url, octet_length(body) AS n, sha256(body) AS digest FROM p
), r AS (
  SELECT *, first_value(page_id) OVER (PARTITION BY digest ORDER BY page_id, url) AS owner,
         row_number() OVER (PARTITION BY digest ORDER BY page_id, url) AS k
  FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND k > 1 THEN owner END AS refers_to, url
FROM r
"""
