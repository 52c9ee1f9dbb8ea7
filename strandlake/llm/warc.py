"""WARC archives as a Spark sink and source, with transactions put together again.

A capture is written as request, response (or revisit) and metadata records; the request and
the metadata name the response in WARC-Concurrent-To. Reading the archives back gives one row
a record, and `assemble` joins the records of a transaction through these identifiers.

Files: Spark's text writer makes them, one record a row and the record's two closing line ends
as the line separator. A reader holds one gzipped file and one record of it at a time.
"""

from __future__ import annotations

import gzip
import io
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import columns_apart, is_empty, new_path, stage

#: The most records in a file; partitions end files earlier, by Spark's advisory partition size.
FILE_RECORDS = 30_000
CRLF = "\r\n"
#: Digits in base 32 as Spark's conv writes them, and those of RFC 4648.
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, warc_date string,"
    " payload_digest string, payload_bytes long, headers map<string,string>, http_status string, http_headers string, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight times five hex digits are four base-32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _CONV_DIGITS, _BASE32_DIGITS)


def _uuid(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_from: int = 0) -> DataFrame:
    """Per page: its payload, digest, copy number and the capture that its record refers to.

    Of payloads that are equal and have at least ``dedup_from`` bytes, the one with the smallest
    id is the response and the others revisit it. Rows that repeat that id with the same payload
    are numbered by ``copy``; copy 0 is the response and the others revisit it as well. A null id
    comes after all others, a null payload is empty, a null URL is the empty one.
    """
    rows = columns_apart(pages, id_col, url_col, html_col).toDF("page_id", "url", "html")
    rows = rows.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    return rows


def write_archives(pages: DataFrame, path: str, warc_date: str = "2024-01-01T00:00:00Z", dedup_from: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write request, response or revisit, and metadata of each page to gzipped WARC files under ``path``."""
    rows = captures(pages, id_col, url_col, html_col, dedup_from)
    # the captures without their payloads: numbered, and told which one each refers to
    small = rows.select("page_id", "url", "digest", "bytes").groupBy("page_id", "url", "digest", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    first = small.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("first"))
    known = stage(first.select(F.col("digest").alias("first_digest"), F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url")), "first")
    again = rows.join(known, rows.digest == known.first_digest, "left").drop("first_digest")
    if is_empty(small.where("copies > 1")):
        numbered = again.withColumn("copy", F.lit(0))
    else:  # which of several equal rows is copy 0 makes no difference to any reader
        numbered = again.withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "url", "digest").orderBy(F.lit(0))) - 1)
    is_first = F.col("page_id").eqNullSafe(F.col("first_page")) & (F.col("url") == F.col("first_url")) & (F.col("copy") == 0)
    revisit = ~is_first & (F.col("bytes") >= dedup_from)
    marked = numbered.withColumn("revisit", revisit)
    own = [F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy")]
    marked = marked.withColumn("id", _uuid("response", *own)).withColumn("refers", _uuid("response", F.col("first_page"), F.col("first_url"), F.col("digest"), F.lit(0)))
    lines = marked.select(F.explode(F.array(_request(own, warc_date), _response(warc_date), _metadata(own, warc_date))).alias("value"))
    lines.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _record(kind: Column | str, fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """Version line, named fields (null ones left out), and the block with its length in bytes."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    named = [("WARC-Type", kind), *fields, ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v) for k, v in named]
    return F.concat(F.lit("WARC/1.1" + CRLF), F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def _uri() -> Column:
    """The URL on one line, as a header needs it."""
    return F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")


def _response(date: str) -> Column:
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    again = F.col("revisit")
    fields = [
        ("WARC-Record-ID", F.col("id")), ("WARC-Date", date), ("WARC-Target-URI", _uri()), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Refers-To", F.when(again, F.col("refers"))), ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), fields, F.when(again, head).otherwise(F.concat(head, "html")))


def _request(own: list[Column], date: str) -> Column:
    path = F.regexp_replace(_uri(), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    host = F.regexp_extract(_uri(), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    block = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    fields = [("WARC-Record-ID", _uuid("request", *own)), ("WARC-Date", date), ("WARC-Target-URI", _uri()), ("WARC-Concurrent-To", F.col("id")), ("Content-Type", "application/http; msgtype=request")]
    return _record("request", fields, block)


def _metadata(own: list[Column], date: str) -> Column:
    block = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f"{CRLF}payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF))
    fields = [("WARC-Record-ID", _uuid("metadata", *own)), ("WARC-Date", date), ("WARC-Target-URI", _uri()), ("WARC-Concurrent-To", F.col("id")), ("Content-Type", "application/warc-fields")]
    return _record("metadata", fields, block)


# ------------------------------------------------------------------ reading


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, gzipped or not, found by their Content-Length."""
    source = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source), 1 << 20) if data[:2] == b"\x1f\x8b" else source
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {version[:20]!r}")
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield {"headers": headers, "block": block}


def _row(record: dict) -> tuple:
    h, block = record["headers"], record["block"]
    status = http = payload = None
    n = None
    if h.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        status, _, http = head.decode("utf-8", "replace").partition(CRLF)
        n = len(payload)
    else:
        payload = block
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if digest and h.get("warc-type") == "response" and b32encode(sha1(payload).digest()).decode() != digest:
        raise ValueError(f"record {h.get('warc-record-id')} does not have its payload's digest")
    return (h.get("warc-type"), h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, n, list(h.items()), status, http, payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives under ``path``, columns as in ``RECORDS``."""
    kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.binary()]
    names = [x.strip().split()[0] for x in RECORDS.replace("<string,string>", "").split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, held = [], 0
                for record in parse_archive(data.as_py()):
                    rows.append(_row(record))
                    held += len(record["block"])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the records of each batch by their first column; ``whole`` says that nothing is missing."""
    for b in batches:
        ids, parts = b.column(0).to_pylist(), b.columns[1:]
        at: dict[str | None, list[int | None]] = {}
        for k, part in enumerate(parts):
            for i in np.flatnonzero(part.is_valid().to_numpy(zero_copy_only=False)).tolist():
                places = at.setdefault(ids[i], [None] * len(parts))
                if places[k] is None:
                    places[k] = i
        whole = [x is not None and None not in places for x, places in at.items()]
        taken = [part.take(pa.array([places[k] for places in at.values()], pa.int64())) for k, part in enumerate(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(list(at), b.schema.types[0]), *taken, pa.array(whole, pa.bool_())], [*b.schema.names, "whole"])


def assemble(records: DataFrame, unique_ids: bool = False) -> DataFrame:
    """One nested row a capture: ``capture_id, response, request, metadata`` (structs; null if absent).

    The records are joined on the identifier of the response or revisit: its own, or that in
    WARC-Concurrent-To. As one key has a few records only, the join is a grouping, which reads
    the archives once. A transaction without a response is left out; of several requests of one
    transaction the row has one, and so of responses that share an identifier.

    Archives have a transaction's records side by side. With ``unique_ids`` (no identifier names two
    responses, as the standard demands and `write_archives` makes them) records are joined where
    they are read. Only transactions that are not whole there are shuffled, so payloads hardly
    move, and the archives are read a second time for these.
    """
    fields = F.str_to_map(F.regexp_replace(F.decode("payload", "UTF-8"), r"(\r\n)+$", ""), F.lit("\r\n"), F.lit(": "))
    answer = F.struct("record_type", "target_uri", "warc_date", "refers_to", "payload_digest", "payload_bytes", "http_status", "http_headers", "payload")
    keyed = records.select(
        F.coalesce("concurrent_to", "record_id").alias("capture_id"),
        F.when(F.col("record_type").isin("response", "revisit"), answer).alias("response"),
        F.when(F.col("record_type") == "request", F.struct("record_id", "http_status", "http_headers")).alias("request"),
        F.when(F.col("record_type") == "metadata", F.struct("record_id", fields.alias("fields"))).alias("metadata"),
    )
    names = keyed.columns
    if unique_ids:
        joined = keyed.mapInArrow(_together, StructType([*keyed.schema.fields, StructField("whole", BooleanType())]))
        keyed = joined.where("not whole").select(*names)
    parts = [F.first(c, ignorenulls=True).alias(c) for c in names[1:]]
    grouped = keyed.groupBy("capture_id").agg(*parts).where("response is not null")
    return joined.where("whole").select(*names).unionByName(grouped) if unique_ids else grouped


def page_records(found: DataFrame) -> DataFrame:
    """Assembled captures -> ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    What a revisit leaves out, and whose page it refers to, comes from the capture it names.
    """
    flat = found.select("capture_id", F.col("metadata.fields")["page-id"].alias("page"), "response.record_type", "response.payload_digest", "response.payload_bytes", F.col("response.refers_to").alias("refers"))
    flat = stage(flat.withColumn("page_id", F.when(F.col("page") != "", F.col("page")).cast("long")).drop("page"), "captures")
    named = flat.where("record_type = 'response'").select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full"))
    again = flat.where("record_type = 'revisit'").join(named, "refers", "left")
    out = ["page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"]
    first = flat.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again.select(*out))


def round_trip(pages: DataFrame, dedup_from: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, dedup_from=dedup_from)
    return assemble(read_archives(spark, path), unique_ids=True)
