"""WARC archives: writing, reading, and assembly of transactions (operator 10)."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import delete_path
from .common import Workspace, scratch_path, table

CRLF = "\r\n"
CAPTURES = ("response", "revisit", "resource")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, warc_date string, "
    "payload_digest string, payload_bytes long, block string, payload binary"
)


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]).cast("binary"))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without its closing blank lines; a header with a null value is left out."""
    lines = [F.concat(F.lit(f"{name}: "), v if isinstance(v, Column) else F.lit(v), F.lit(CRLF)) for name, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], length, block)


def refer_to_first(pages: DataFrame, least_bytes: int = 100, hot_share: int = 20_000) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, refers_to, refers_url`` of every page.

    Of equal payloads of at least ``least_bytes`` the page with the smallest id
    (and url, if ids repeat) stays, the others refer to it; rows with its id
    stay as well. Null ids refer to an id but are never referred to. Payloads with very many copies, ``hot_share`` at most, come by
    a bounded broadcast so that their pages stay spread.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html, 256).alias("payload_digest"),
    )
    rows = pages.count()
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    # Small and read by every later step, so it stays.
    firsts = Workspace(pages.sparkSession, "warc").keep(
        base.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and first is not null"),
        "firsts",
    )
    limit = max(64, rows // hot_share)
    hot = firsts.filter(F.col("copies") > limit).select(F.col("payload_digest").alias("hd"), F.col("first").alias("hot_first"))
    rest = firsts.filter(F.col("copies") <= limit).select(F.col("payload_digest").alias("rd"), F.col("first").alias("rest_first"))
    marked = base.join(F.broadcast(hot), F.col("payload_digest") == F.col("hd"), "left").withColumn(
        "jd", F.when(F.col("hd").isNull(), F.col("payload_digest")).otherwise(F.sha2(F.monotonically_increasing_id().cast("string"), 256))
    )
    # ``rest`` is a written table, so the optimizer knows its size and broadcasts it only if it is small.
    joined = marked.join(rest, F.col("jd") == F.col("rd"), "left")
    first = F.coalesce("hot_first", F.when(F.col("hd").isNull(), F.col("rest_first")))
    other = ~first["page_id"].eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(other, first["page_id"]).alias("refers_to"), F.when(other, first["url"]).alias("refers_url"),
    )


def write_warc(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", records_per_file: int = 4000) -> None:
    """Write a response or revisit record for every page, with its request and a metadata record.

    The archives are gzipped text files written by Spark's own writer, on any
    file system that Spark reaches. They are cut by bytes: pages of up to 64 KB
    lie ``records_per_file`` to a file, larger ones of up to 4 MB at most 64,
    still larger ones alone. So a file, which a reader takes as one value, is
    at most 256 MB of text or one page. ``pages`` comes from :func:`refer_to_first`.
    """
    blank = r"[\s\x00-\x1f]"
    uri = F.regexp_replace("url", blank, "%20")
    digest, n = F.col("payload_digest"), F.col("payload_bytes")
    target = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    capture_id = _urn("capture", F.col("page_id"), F.col("url"), digest)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n.cast("string"), F.lit(CRLF + CRLF)
    )
    revisit = F.col("refers_to").isNotNull()
    capture = _record(
        [
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", capture_id),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
            ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
            ("WARC-Refers-To", F.when(revisit, _urn("capture", F.col("refers_to"), F.col("refers_url"), digest))),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    request = _record(
        [
            ("WARC-Type", "request"),
            ("WARC-Record-ID", _urn("request", F.col("page_id"), F.col("url"), digest)),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", capture_id),
            ("Content-Type", "application/http; msgtype=request"),
        ],
        F.concat(
            F.lit("GET "), F.when(F.coalesce(target, F.lit("")) == "", F.lit("/")).otherwise(target),
            F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF),
        ),
    )
    metadata = _record(
        [
            ("WARC-Type", "metadata"),
            ("WARC-Record-ID", _urn("metadata", F.col("page_id"), F.col("url"), digest)),
            ("WARC-Date", date),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", capture_id),
            ("Content-Type", "application/warc-fields"),
        ],
        F.concat(
            F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
            F.coalesce(F.concat(F.lit("refers-to-page: "), F.col("refers_to").cast("string"), F.lit(CRLF)), F.lit("")),
        ),
    )
    end = CRLF + CRLF
    rows = pages.select(n.alias("n"), F.concat_ws(end, capture, request, metadata).alias("value"))
    longest, least = rows.agg(F.max("n")).first()[0] or 0, -1
    for most, per_file in ((64 << 10, records_per_file), (4 << 20, min(64, records_per_file)), (1 << 62, 1)):
        if least < longest or least < 0:
            out = rows.filter((F.col("n") > least) & (F.col("n") <= most)).select("value").write.mode("append")
            out.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
        least = most


def iter_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of an uncompressed stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        length = int(headers.get("content-length", 0))
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("the archive ends within a record")
        yield headers, block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload of a block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    return (head, payload) if gap else (block, b"")


def _fields(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    digest, n, text, payload = headers.get("warc-payload-digest"), None, None, None
    if digest:
        digest = digest.rpartition(":")[2].lower()
    if kind in CAPTURES:
        http = headers.get("content-type", "").startswith("application/http")
        head, body = split_http(block) if http else (b"", block)
        if kind == "revisit":
            for line in head.split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    n = int(value)
        else:
            digest, n = hashlib.sha256(body).hexdigest(), len(body)
            payload = body if with_payload else None
        text = head.decode("utf-8", "replace")
    else:
        text = block.decode("utf-8", "replace")
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
        headers.get("warc-target-uri"), headers.get("warc-date"), digest, n, text, payload,
    )


def read_warc(spark, path: str, with_payload: bool = True, batch: int = 2000) -> DataFrame:
    """Records of the archives below ``path``, gzipped as a whole or by record, or plain.

    A response's digest and size are those of the payload that was read; a
    revisit's are the ones that it states. ``block`` is the text of a request
    or metadata record and the HTTP head of a capture. A file that ends within
    a record raises an error.
    """
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for content in files.column(0):
                raw, rows, size = io.BytesIO(content.as_buffer()), [], 0
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.read(2) == b"\x1f\x8b" else raw
                raw.seek(0)
                for headers, block in iter_records(stream):
                    rows.append(_fields(headers, block, with_payload))
                    size += len(block)
                    if len(rows) >= batch or size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, capture, request, metadata`` (structs, null if absent).

    Records belong together through concurrent-to identifiers, whichever of
    them states it, directly or over a request. Of several requests or
    metadata records of one capture the one with the smallest id stays.
    Records with no capture are left out. A capture that occurs n times gives n
    rows. An empty table gives no rows.
    """
    is_capture = F.col("record_type").isin(*CAPTURES)
    parents = (
        records.filter(~is_capture & F.col("concurrent_to").isNotNull())
        .select(F.col("record_id").alias("child"), F.col("concurrent_to").alias("parent"))
        .union(records.filter(is_capture & F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to"), F.col("record_id")))
        .groupBy("child")
        .agg(F.min("parent").alias("parent"))
    )
    grand = parents.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
    lifted = parents.join(grand, "parent", "left").select("child", F.coalesce("grand", "parent").alias("owner"))
    keyed = records.join(lifted, (F.col("record_id") == F.col("child")) & ~is_capture, "left").withColumn(
        "owner", F.when(is_capture, F.col("record_id")).otherwise(F.coalesce("owner", "record_id"))
    )
    fields = [c for c in records.columns]

    def one(cond: Column) -> Column:
        return F.min_by(F.when(cond, F.struct(*fields)), F.when(cond, F.col("record_id")))

    grouped = keyed.groupBy("owner").agg(
        F.count_if(is_capture).alias("n"),
        one(is_capture).alias("capture"),
        one(F.col("record_type") == "request").alias("request"),
        one(F.col("record_type") == "metadata").alias("metadata"),
    )
    return grouped.filter("n > 0").select(
        F.col("owner").alias("record_id"), "capture", "request", "metadata", F.explode(F.expr("sequence(1L, n)")).alias("nth")
    ).drop("nth")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages as WARC, read the archives back and assemble the captures.

    Output: ``page_id, payload_bytes, payload_digest, record_type, refers_to,
    url``, a row for each page. Null html is an empty payload; a null url gives
    a record without target; a null page id stays null; repeated rows give a
    capture each; other columns are ignored. Payloads below 100 bytes are never
    revisits. Without ``path`` the archives lie in the shared folder until the
    result is written there and are deleted then.
    """
    spark = pages.sparkSession
    target = path or scratch_path(spark, "warc")
    write_warc(refer_to_first(pages), target)
    assembled = assemble(read_warc(spark, target, with_payload=False).drop("payload"))
    field = lambda name: F.nullif(F.regexp_extract("metadata.block", rf"(?m)^{name}: (-?\d+)", 1), F.lit("")).cast("long")
    out = assembled.select(
        field("page-id").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        field("refers-to-page").alias("refers_to"),
        F.col("capture.target_uri").alias("url"),
    )
    if path is None:
        out = Workspace(spark, "warc").keep(out, "captures")
        delete_path(spark, target)
    return out


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Archive round trip of all pages."""
    return archive_round_trip(table(spark, sf_dir, "pages"))


#: The digests, sizes and revisits that the archives must give back.
OP10_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, CAST(octet_length(CAST(encode(html) AS BLOB)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f IS NOT NULL AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to, url
FROM m
"""
