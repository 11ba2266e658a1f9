"""WARC archives: writing, reading, and revisit records for repeated payloads.

Archives are written by Spark's text writer with the record separator as line separator, so any shared file system will
do. Each file begins with a warcinfo record and is cut by bytes: records of like size share files of about FILE_BYTES.
They are read back as binary files, each decompressed and parsed as a stream.
"""

from __future__ import annotations

import datetime
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FILE_BYTES = 256 << 20  # of records in a file, before compression, unless one record is larger
#: Records above each of these sizes have files of their own, with fewer records in each.
SIZES = (0, 1 << 16, 1 << 20, 1 << 24)
MIN_REVISIT = 1000  # payloads below this size are always stored
REVISIT_BOUND = 1_000_000  # revisits that are broadcast at most; beyond it they are joined file by file
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SEPARATOR = "\r\n\r\n"


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _lines(*fields: tuple[str, Column | str]) -> Column:
    """WARC fields; one whose value is null is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v, F.lit("\r\n")), F.lit("")) for k, v in fields])


def _ident(*of: Column) -> Column:
    """A record id made of the given values: the same if a task is repeated."""
    h = F.md5(F.concat_ws("\x1f", *of))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _record(date: str) -> Column:
    """The record of a row (record_id, record_type, page_id, url, payload_digest, payload_bytes, html, o_*) as text,
    without the separator that ends it. The o_ columns describe the original of a revisit and are null for others."""
    size = F.col("payload_bytes").cast("string")
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("html"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    head = _lines(
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", angle(F.col("record_id"))), ("WARC-Date", date), ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), ("WARC-Refers-To", angle(F.col("o_record_id"))), ("WARC-Refers-To-Target-URI", F.col("o_url")),
        ("WARC-Refers-To-Date", F.col("o_date")), ("WARC-Profile", F.when(F.col("record_type") == "revisit", PROFILE)), ("X-Page-ID", F.col("page_id").cast("string")), ("X-Refers-To-Page-ID", F.col("o_page_id").cast("string")),
        ("X-Payload-Bytes", size), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
    )
    return F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), http, body)


def _classes(rows: DataFrame, size: Column) -> set[int]:
    """Numbers of the size classes that occur: at most len(SIZES) of them."""
    return {r[0] for r in rows.select(sum([(size > x).cast("int") for x in SIZES if x], F.lit(0)).alias("k")).distinct().collect()}


def _write(rows: DataFrame, path: str, size: Column, found: set[int], date: str, level: str = "DEFAULT_COMPRESSION") -> None:
    """Writes the records of rows; ``size`` is about a record's bytes, ``found`` its classes. Every file starts with a
    warcinfo record."""
    about = b"software: dispatchlake\r\nformat: WARC File Format 1.1\r\n"
    info = F.concat(F.lit("WARC/1.1\r\n"), _lines(("WARC-Type", "warcinfo"), ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(about)))), F.lit("\r\n" + about.decode() + _SEPARATOR))
    for k in sorted(found) or [0]:
        lo, hi = SIZES[k], SIZES[k + 1] if k + 1 < len(SIZES) else None
        own = rows.filter((size > lo) | F.lit(k == 0)) if hi is None else rows.filter(((size > lo) | F.lit(k == 0)) & (size <= hi))
        count = max(1, FILE_BYTES // hi) if hi else 1  # records in a file
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in the task's output
        value = F.concat(F.when(place % count == 0, info).otherwise(F.lit("")), F.col("record"))
        own.select(_record(date).alias("record")).select(value.alias("value")).write.mode("append").option("lineSep", _SEPARATOR).option("compression", "gzip").option("zlib.compress.level", level).option("maxRecordsPerFile", count).text(path)


_ORIGINAL = ("o_record_id", "o_url", "o_date")


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None, level: str = "DEFAULT_COMPRESSION") -> None:
    """A response record for each row (null html: an empty payload, null url: an urn made of the id)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    page = F.col(id_col).cast("long")
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")))), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(page.alias("page_id"), url.alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("payload_digest"), F.octet_length(html).alias("payload_bytes"))
    rows = rows.withColumn("record_type", F.lit("response")).withColumn("record_id", F.concat(F.lit("urn:uuid:"), F.uuid())).withColumn("o_page_id", F.lit(None).cast("long"))
    for c in _ORIGINAL:
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    size = F.octet_length("html")
    _write(rows, path, size, _classes(pages.select(html.alias("html")), size), date or _now(), level)


def _stream(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Records (fields, block) of a gzipped archive, without holding it decompressed."""
    box, at = zlib.decompressobj(31), 0
    held = bytearray()

    def more() -> bool:
        nonlocal box, at
        if at >= len(data):
            return False
        held.extend(box.decompress(data[at : at + 65536]))
        at += 65536
        if box.eof:  # a further member
            at -= len(box.unused_data)
            box = zlib.decompressobj(31)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        lines = bytes(held[:end]).decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        fields["version"] = lines[0]
        need = end + 4 + int(fields["Content-Length"])
        while len(held) < need + 4 and more():
            pass
        yield fields, bytes(held[end + 4 : need])
        del held[: need + 4]


_FIELDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, block_bytes long, html string, record_id string, date string, refers_to_id string, path string"


_REVISIT = "o_page_id long, o_record_id string, o_url string"


def _read(files: DataFrame) -> DataFrame:
    """Records of (path, content) rows, in the order of each file.

    If a third column lists the file's revisits (r, o_page_id, o_record_id, o_url), these go to the records named r.
    """
    import hashlib

    listed = len(files.columns) > 2
    fields = _FIELDS + f", {_REVISIT}" * listed
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for batch in batches:
            for k, (path, content) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                rows, held = [], 0
                own_revisits = {x["r"]: (x["o_page_id"], x["o_record_id"], x["o_url"]) for x in batch.column(2)[k].as_py() or ()} if listed else {}
                for f, block in _stream(content.as_py()):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    payload = block[block.find(b"\r\n\r\n") + 4 :]
                    if f["WARC-Type"] == "revisit":
                        own = (f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Bytes"]), len(block), None)
                    else:
                        own = (hashlib.sha1(payload).hexdigest(), len(payload), len(block), payload.decode())
                    ids = (f["WARC-Record-ID"].strip("<>"), f["WARC-Date"], f.get("WARC-Refers-To", "").strip("<>") or None, path)
                    rows.append((number(f.get("X-Page-ID")), f["WARC-Target-URI"], f["WARC-Type"], number(f.get("X-Refers-To-Page-ID")), *own, *ids, *(own_revisits.get(ids[0], (None,) * 3) if listed else ())))
                    held += len(block)
                    if held > 4 << 20:
                        yield C.record_batch(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), fields)
                        rows, held = [], 0
                if rows:
                    yield C.record_batch(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), fields)

    return files.mapInArrow(run, fields)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of archives: (page_id, url, record_type, refers_to, payload_digest, payload_bytes, block_bytes, html,
    record_id, date, refers_to_id, path).

    Size and digest of a response are computed from the payload that was read; those of a revisit come from its fields.
    """
    return _read(C.prepare(spark).read.format("binaryFile").load(path).select("path", "content"))


def originals(headers: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(payload_digest, payload_bytes, original, n) of payloads that several records have: the largest page_id is the original.

    Only headers are shuffled, and they are reduced before, so a digest with very many records is one row of each task.
    ``original`` holds page_id, record_id, url and date; n is the number of records.
    """
    same = headers.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    return same.agg(F.max(F.struct("page_id", "record_id", "url", "date")).alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def deduplicate(spark: SparkSession, source: str, target: str, least: int = MIN_REVISIT, date: str | None = None) -> None:
    """Writes archives with the records of ``source`` in which repeated payloads are revisit records.

    All records get headers of their own: new ids, the date of this writing, and, for revisits, id, address and date of
    the original's new record. Rows that share both page_id and payload are all responses if that id is the largest of
    its payload. A null page_id counts as the smallest. Payloads stay in their tasks: the table of revisits (ids only)
    goes to them by broadcast within REVISIT_BOUND, and beyond it is gathered by file and joined to the files.
    """
    date = date or _now()
    run = F.lit(uuid.uuid4().hex)
    files = C.prepare(spark).read.format("binaryFile").load(source).select("path", "content")
    records = _read(files)
    headers = C.store(records.select("page_id", "payload_digest", "payload_bytes", "record_id", "url", "date", "path"), "warc-headers")
    total = C.rows_of(headers)
    met = C.join_keyed(headers.filter(F.col("payload_bytes") >= least), originals(headers, least), ["payload_digest", "payload_bytes"], total)
    revisits = met.filter(F.coalesce("page_id", F.lit(-(1 << 63))) < F.col("original.page_id")).select(F.col("record_id").alias("r"), F.col("original.page_id").alias("o_page_id"), _ident(run, F.col("original.record_id")).alias("o_record_id"), F.col("original.url").alias("o_url"), "path")
    revisits = C.store(revisits, "warc-revisits")
    names = ("o_page_id", "o_record_id", "o_url")
    if C.fits(revisits, REVISIT_BOUND):
        out = records.join(F.broadcast(revisits.drop("path")), F.col("record_id") == F.col("r"), "left")
    else:
        lists = revisits.groupBy("path").agg(F.collect_list(F.struct("r", *names)).alias("own"))  # at most the records of one file
        out = _read(files.join(lists, "path", "left"))
    kind = F.when(F.col("o_record_id").isNull(), "response").otherwise("revisit")
    out = out.select("page_id", "url", "html", "payload_digest", "payload_bytes", kind.alias("record_type"), _ident(run, F.col("record_id")).alias("record_id"), *names, F.when(F.col("o_record_id").isNotNull(), date).alias("o_date"))
    size = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    _write(out, target, size, {0} | _classes(headers, F.col("payload_bytes")), date)


def revisit_archives(pages: DataFrame, least: int = MIN_REVISIT, **columns) -> tuple[str, DataFrame]:
    """(folder of the deduplicated archives, records read back from them).

    Each row gives one record, repeated rows too; null html is an empty payload; very long payloads have files of their
    own. An empty table gives no records. Only the three named columns are read, so the names of others don't matter.
    """
    spark = pages.sparkSession
    root = C.new_path(spark, "warc")
    write_pages(pages, f"{root}/raw", **columns, level="BEST_SPEED")  # read once more and left
    deduplicate(spark, f"{root}/raw", f"{root}/deduplicated", least)
    return f"{root}/deduplicated", read_archive(spark, f"{root}/deduplicated")
