"""Operator 9: WARC archives and transaction assembly.

``write`` makes one archive per task (gzip, a member per record): for each page
a response or revisit record, and a request and a metadata record that name it
in WARC-Concurrent-To.  ``read`` parses archives into record rows as a stream.
``assemble`` joins request and metadata records to their response or revisit
through these identifiers and gives one nested row per capture.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the
largest page_id is the response and the others revisit it; a revisit has no
payload, its digest and length are in its records.

Archives carry their task attempt's name and only those in the committed
manifest are read, so lost executors and retries do no harm.  Rows that are
joined carry no payload unless asked for.

Defined cases: null html is an empty payload; a null page_id never is the
response if another page has the payload; rows that repeat the response's
page_id and payload are responses too, and their records pair up by order of
occurrence; a null url gives no target; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, stored, table, with_row_id
from .files import opened, own_file

#: Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
RECORD = (
    "file string, ord long, type string, record_id string, concurrent_to string, refers_to string, uri string, date string, content_type string, "
    "payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
)


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, rid: str, headers: dict[str, str | None], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": DATE} | headers | {"Content-Length": str(len(block))}
    lines = [f"{k}: {' '.join(v.split())}" for k, v in head.items() if v is not None]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n") + z.flush()


def roles(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(_row, original) for the pages that revisit page ``original``."""
    html = F.coalesce("html", F.lit(""))
    rows = with_row_id(pages.select("page_id", "html")).select("_row", "page_id", F.unhex(F.sha1(html.cast("binary"))).alias("d"), F.octet_length(html).alias("n"))
    rows = stored(spark, rows, "payloads").where(F.col("n") >= min_bytes)
    best = rows.groupBy("d").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("k")).where("k > 1 and original is not null").drop("k")
    return stored(spark, rows.join(best, "d").where("not (page_id <=> original)").select("_row", "original"), "revisits")


def write(spark: SparkSession, pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes archives of ``pages`` (a file scan); returns the committed manifest (file, pages)."""
    rows = with_row_id(pages.select("page_id", "url", "html")).join(roles(spark, pages, min_bytes), "_row", "left")
    rows = rows.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"), "original", F.col("original").isNotNull().alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n = own_file(folder, ".warc.gz"), None, 0
        for b in batches:
            out = out or opened(name, "w")
            for page, url, html, original, again in zip(*b.columns, strict=True):
                page, url, html, original = page.as_py(), url.as_py(), html.as_py(), original.as_py()
                digest, n = _digest(html), n + 1
                main = _id(page, digest) if not again.as_py() else _id(page, digest, name, n)
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
                shared = {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
                if again.as_py():
                    out.write(_record("revisit", main, shared | {"WARC-Profile": PROFILE, "WARC-Refers-To": _id(original, digest)}, http))
                else:
                    out.write(_record("response", main, shared, http + html))
                path = "/" if url is None else "/" + "".join(url.split()).partition("://")[2].partition("/")[2]
                ask = f"GET {path} HTTP/1.1\r\nAccept: text/html\r\n\r\n".encode()
                out.write(_record("request", _id(name, n, "request"), {"WARC-Target-URI": url, "WARC-Concurrent-To": main, "Content-Type": "application/http; msgtype=request"}, ask))
                about = (f"page-id: {page}\r\n" if page is not None else "") + f"payload-bytes: {len(html)}\r\n"
                out.write(_record("metadata", _id(name, n, "metadata"), {"WARC-Target-URI": url, "WARC-Concurrent-To": main, "Content-Type": "application/warc-fields"}, about.encode()))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "pages"])

    return stored(spark, rows.mapInArrow(run, "file string, pages long"), "archives")


def _bytes(f) -> Iterator[bytes]:  # noqa: ANN001
    """The unpacked content of a gzip file with many members, or of a plain file."""
    data = f.read(CHUNK)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = f.read(CHUNK)
        return
    z = zlib.decompressobj(31)
    while data:
        yield z.decompress(data, CHUNK)
        data = z.unconsumed_tail
        if z.eof:
            data, z = z.unused_data, zlib.decompressobj(31)
        data = data or f.read(CHUNK)


def records(f) -> Iterator[tuple[dict[str, str], bytes]]:  # noqa: ANN001
    """(headers with lower-case names, block) of each record."""
    source, have = _bytes(f), bytearray()

    def more() -> bool:
        piece = next(source, None)
        if piece is not None:
            have.extend(piece)
        return piece is not None

    while True:
        while (end := have.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in have[:end].decode("utf-8", "replace").strip().split("\r\n")[1:]))
        need = end + 4 + int(head.get("content-length", 0))
        while len(have) < need + 4 and more():
            pass
        yield head, bytes(have[end + 4 : need])
        del have[: need + 4]


def read(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Record rows of the archives named in column ``file``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 8, pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows, held = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                with opened(name, "r") as f:
                    for n, (h, block) in enumerate(records(f)):
                        kind, fields = h.get("warc-type"), None
                        payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
                        if h.get("content-type") == "application/warc-fields":
                            fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()]
                        digest = _digest(payload) if kind == "response" else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        rows.append((name, n, kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"),
                                     h.get("warc-date"), h.get("content-type"), digest, len(payload), fields, payload if with_payload else None))
                        held += len(payload) if with_payload else 1000
                        if held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    return files.select("file").mapInArrow(run, RECORD)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, type, uri, capture, request, metadata, original (metadata of the revisited response)."""
    turn = F.row_number().over(Window.partitionBy("type", "key").orderBy("file", "ord"))
    keyed = rows.withColumn("key", F.when(F.col("type").isin("request", "metadata"), F.col("concurrent_to")).otherwise(F.col("record_id")))
    keyed = keyed.withColumn("turn", turn)
    body = F.struct(*[c for c in rows.columns])
    main = keyed.where(F.col("type").isin("response", "revisit")).select("key", "turn", body.alias("capture"))
    asked = keyed.where("type = 'request'").select("key", "turn", body.alias("request"))
    about = keyed.where("type = 'metadata'").select("key", "turn", body.alias("metadata"))
    whole = main.join(asked, ["key", "turn"], "left").join(about, ["key", "turn"], "left")
    first = whole.where("turn = 1 and capture.type = 'response'").select(F.col("key").alias("_of"), F.col("metadata").alias("original"))
    whole = whole.join(first, F.col("capture.refers_to") == F.col("_of"), "left")
    return whole.select(F.col("key").alias("record_id"), "capture.type", "capture.uri", "capture", "request", "metadata", "original")


def op9_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(spark, table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    # A range for each archive: a number that is asked for isn't coalesced, so every archive is read by a task of its own.
    files = archives.select("file").repartitionByRange(max(archives.count(), 1), "file")
    rows = stored(spark, read(files).drop("payload"), "records")
    page = lambda c: F.col(c)["fields"]["page-id"].cast("long")
    return assemble(rows).select(
        page("metadata").alias("page_id"),
        F.col("metadata")["fields"]["payload-bytes"].cast("long").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("original").alias("refers_to"),
        F.col("uri").alias("url"),
        F.col("request").isNotNull().alias("has_request"),
    )


QUERIES = {"op9_warc_roundtrip": op9_warc_roundtrip}
ORACLE = {
    "op9_warc_roundtrip": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS original, count(*) OVER (PARTITION BY html) AS k,
  array_to_string(list_transform(string_split(d, ''), lambda c: right(bin(16 + instr('0123456789abcdef', c) - 1), 4)), '') AS bits FROM p),
r AS (SELECT *, k > 1 AND original IS NOT NULL AND page_id IS DISTINCT FROM original AS again FROM g)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda j: (substring(bits, (i * 5 + j + 1)::INT, 1) = '1')::INT << (4 - j)))::INT, 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN original END AS refers_to,
  trim(regexp_replace(url, '\s+', ' ', 'g')) AS url, true AS has_request FROM r"""
}
