r"""WARC: archives written from pages, and transaction assembly when they are read back.

Writing: each page gives a capture of three records, one after the other: `response` (or
`revisit`, if a page with a smaller id has an equal payload), and the `request` and `metadata`
records that name it by WARC-Concurrent-To. Spark's text writer lays records end to end, its line
separator being the two empty lines that close a record, as gzip files
on any file system that Spark writes to.

Reading: files come as binary rows and are parsed as streams by Content-Length, one record in
memory at a time. Records of a capture are brought together by grouping on the id they are
concurrent to (a record without that header stands for itself); where the records named have such
headers themselves, or several, on connected components of the links. Each capture is one nested row.

Equal payloads are found by grouping digests, so a payload that a third of the pages share is
one group row; joining it back is a skewed equi-join that adaptive execution splits. Rows are known
by what they hold (id, url and digest), never by a position, so that a page read again after a lost
executor has the same record ids whatever the order of the input. Rows equal in all of it are counted
and given out again with ordinal numbers.

Files are bounded in bytes: pages are written in classes of size, each with so many records in a file.
Spark's writer compresses a file as one gzip member, not one a record.

Null html is the empty payload, null url an empty target. Null page ids come after all others.
Repeated rows are separate captures, of which the first is the response. Concurrent-to identifiers
count in both directions, along chains and several a record; if captures name each other, each has
its row with all requests and metadata of them. A record without Content-Length has an empty block,
bytes between records are skipped, and what can't be read of a broken file is one row with `error`.
An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import bound_batches, components, fresh_path, materialise, table

# WARC 1.1 names.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SIZES = ((1 << 18, 512), (1 << 24, 8), (1 << 62, 1))  # payload bytes up to which so many captures go into one file
RECORD_SCHEMA = "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary, error string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five bytes at a time are eight digits of radix 32."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    parts = [F.lit(VERSION)]
    for name, value in headers:
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise(F.lit("")))
    return F.concat(*parts, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def _uuid(*parts: Column) -> Column:
    """A name-based id of the MD5 kind."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-3"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def plan_captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per page: payload, its size and digest, ids, and for a revisit what it refers to."""
    row = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    row = row.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.encode("payload", "UTF-8")).alias("digest"))
    row = row.withColumn("key", F.sha1(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "digest", "url").cast("binary")))
    kinds = row.drop("payload").groupBy("key", "page_id", "url", "digest", "payload_bytes").agg(F.count("*").alias("copies"))
    kinds = materialise(kinds, "warc-kinds")
    first = kinds.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "key", "url")).alias("f"), F.sum("copies").alias("alike"))
    first = first.filter("alike > 1").select("digest", "payload_bytes", F.col("f.key").alias("first_key"), F.col("f.page_id").alias("first_page"), F.col("f.url").alias("first_url"))
    repeated = kinds.join(first, ["digest", "payload_bytes"], "left").filter("copies > 1 or first_key is not null")
    repeated = materialise(repeated.select("key", "copies", "first_key", "first_page", "first_url"), "warc-repeated")
    both = row.join(repeated, "key", "left")
    one = F.lit(1).cast("long")
    got = both.filter("copies is null or copies = 1").withColumn("ordinal", one)
    if not repeated.filter("copies > 1").isEmpty():
        rest = [c for c in both.columns if c != "key"]
        alike = both.filter("copies > 1").groupBy("key").agg(*[F.any_value(c).alias(c) for c in rest])
        got = got.unionByName(alike.withColumn("ordinal", F.explode(F.sequence(one, F.col("copies")))))
    revisit = F.coalesce(~((F.col("first_key") == F.col("key")) & (F.col("ordinal") == 1)), F.lit(False))
    name = lambda kind: _uuid(F.col("key"), F.col("ordinal").cast("string"), F.lit(kind))
    refers = lambda c: F.when(F.col("revisit"), c)
    got = got.withColumn("revisit", revisit)
    got = got.select("page_id", "url", "payload", "payload_bytes", "digest", name("response").alias("rid"), name("request").alias("request_rid"), name("metadata").alias("metadata_rid"), "revisit", refers(_uuid(F.col("first_key"), F.lit("1"), F.lit("response"))).alias("refers"), refers(F.col("first_page")).alias("refers_page"), refers(F.col("first_url")).alias("refers_url"))
    got.millrace_largest = int(kinds.agg(F.max("payload_bytes")).first()[0] or 0)
    return got


def write_warc(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", sizes=SIZES) -> str:
    """Writes a folder of archives for each class of size that the captures have."""
    c = F.col
    line = lambda x: F.regexp_replace(x, r"[\r\n]", " ")
    safe = line("url")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), c("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", safe)]
    again = lambda x: F.when(c("revisit"), x)
    main = _record(
        [("WARC-Type", F.when(c("revisit"), F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", c("rid")), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("digest"))), ("WARC-Profile", again(F.lit(PROFILE))), ("WARC-Refers-To", c("refers")), ("WARC-Refers-To-Target-URI", again(line("refers_url"))), ("WARC-Refers-To-Date", again(F.lit(date))), ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(c("revisit"), F.lit("")).otherwise(c("payload"))),
    )
    host = F.regexp_extract(safe, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", c("request_rid")), *common, ("WARC-Concurrent-To", c("rid")), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), safe, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    fields = F.concat(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise(F.lit("")) for k, v in (("page-id", c("page_id").cast("string")), ("refers-to-page", c("refers_page").cast("string")))])
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", c("metadata_rid")), *common, ("WARC-Concurrent-To", c("rid")), ("Content-Type", F.lit("application/warc-fields"))], fields)
    end = "\r\n\r\n"
    largest = getattr(captures, "millrace_largest", None)
    if largest is None:
        largest = int(captures.agg(F.max("payload_bytes")).first()[0] or 0)
    below = -1
    for most, records in sizes:
        if below < largest or below < 0:
            rows = captures if below < 0 and largest <= most else captures.filter((c("payload_bytes") > below) & (c("payload_bytes") <= most))
            rows.select(F.concat(main, F.lit(end), request, F.lit(end), metadata).alias("value")).write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", records).text(f"{path}/upto-{most}")
        below = most
    return path


def parse_records(stream) -> Iterator[dict]:
    """Records of one WARC file; a payload is what follows the HTTP head of a response."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head, concurrent = {}, []
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            head[name] = value
            if name == "warc-concurrent-to":
                concurrent.append(value)
        length = head.get("content-length", "")
        block = stream.read(int(length)) if length.isdigit() else b""
        kind, fields, payload, size = head.get("warc-type"), {}, None, None
        if kind in ("response", "revisit"):
            top, _, body = block.partition(b"\r\n\r\n")
            for x in top.split(b"\r\n")[1:]:
                name, _, value = x.decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
            if kind == "response":
                payload, size = body, len(body)
            else:
                size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
        elif kind == "metadata":
            for x in block.decode("utf-8", "replace").split("\r\n"):
                name, _, value = x.partition(":")
                if name:
                    fields[name.strip()] = value.strip()
        elif kind == "request":
            fields["request-line"] = block.partition(b"\r\n")[0].decode("utf-8", "replace")
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        yield {"type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": concurrent, "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "payload_digest": digest, "payload_bytes": size, "fields": fields, "payload": payload, "error": None}


def _parse_files(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    text = pa.string()
    kinds = {"concurrent_to": pa.list_(text), "payload_bytes": pa.int64(), "fields": pa.map_(text, text), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, text)) for n in ("type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "fields", "payload", "error")])

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([list((r.get(f.name) or {}).items()) if f.name == "fields" else r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            stream = io.BytesIO(memoryview(content.as_buffer()))
            if stream.getbuffer()[:2] == b"\x1f\x8b":
                stream = gzip.GzipFile(fileobj=stream)
            try:
                for r in parse_records(io.BufferedReader(stream, 1 << 20)):
                    held += len(r["payload"] or b"")
                    rows.append(r if payloads else r | {"payload": None})
                    if len(rows) >= 1000 or held > 8_000_000:
                        yield out(rows)
                        rows, held = [], 0
            except (EOFError, OSError, zlib.error) as broken:
                rows.append({"error": f"{type(broken).__name__}: {broken}"})
            if rows:
                yield out(rows)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; without payloads, only their sizes and digests, computed from the stored bytes."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(lambda it: _parse_files(it, payloads), StructType.fromDDL(RECORD_SCHEMA))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture. Requests and metadata whose capture is absent give a row without one.

    records are read several times: pass a written table where reading them is dear.
    """
    kind = F.col("type")
    main = F.struct("type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload", "fields")
    other = F.struct("record_id", "date", "fields")
    records = records.filter(kind.isin("response", "revisit", "request", "metadata"))
    links = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    # Where each record names one that names no other, what it names is the capture.
    direct = records.filter(F.size("concurrent_to") > 1).isEmpty() and links.join(links.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
    if direct:
        keyed = records.withColumn("capture_id", F.coalesce(F.get("concurrent_to", F.lit(0)), "record_id"))
    else:
        comp = components(links)
        keyed = records.join(comp, F.col("record_id") == F.col("node"), "left").withColumn("capture_id", F.coalesce("comp", "record_id"))
    grouped = keyed.groupBy("capture_id").agg(
        F.collect_list(F.when(kind.isin("response", "revisit"), main)).alias("captures"),
        F.collect_list(F.when(kind == "request", other)).alias("requests"),
        F.collect_list(F.when(kind == "metadata", other)).alias("metadata"),
    )
    rows = grouped.select("capture_id", F.explode_outer("captures").alias("capture"), "requests", "metadata")
    return rows.withColumn("capture_id", F.coalesce("capture.record_id", "capture_id"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_warc(plan_captures(table(spark, sf_dir, "pages")), fresh_path(spark, "warc"))
    captures = assemble(materialise(read_warc(spark, path, payloads=False), "warc-records"))
    field = lambda name: F.element_at(F.element_at("metadata", 1)["fields"], name).cast("long")
    return captures.filter("capture is not null").select(field("page-id").alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.type").alias("record_type"), field("refers-to-page").alias("refers_to"))


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS s FROM p),
d AS (SELECT page_id, payload_bytes, translate(concat(to_base(('0x' || s[1:10])::BIGINT, 32, 8), to_base(('0x' || s[11:20])::BIGINT, 32, 8), to_base(('0x' || s[21:30])::BIGINT, 32, 8), to_base(('0x' || s[31:40])::BIGINT, 32, 8)),
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS f FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM f
"""
