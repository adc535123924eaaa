"""WARC archives: written from page tables, read back, and assembled.

A capture is written as three records: a request, a response (or a revisit,
when another capture has the same payload) and metadata.  Request and metadata
name the response in WARC-Concurrent-To; assembly joins the records on that
identifier and emits one nested row a capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import stored

#: Bytes of one archive file before it is packed, unless one capture has more.
FILE_BYTES = 1 << 25
#: Bytes that a reading task unpacks at once.
STEP = 1 << 20
#: The two line ends that close every record.
RECORD_END = "\r\n\r\n"
RECORD = "file string, place bigint, warc_type string, record_id string, concurrent_to string, refers_to string, uri string, date string, payload_digest string, payload_bytes bigint, digest_ok boolean, http_status int, headers map<string,string>, payload binary"


def with_payload_digest(df: DataFrame, name: str, payload: Column) -> DataFrame:
    """``df`` with the bare upper-case base32 SHA-1 of a binary column, by
    column functions: each group of five bits of the digest is one letter."""
    numbers = {f"__n{k}": F.conv(F.substring("__sha1", 1 + 10 * k, 10), 16, 10).cast("bigint") for k in range(4)}
    five = lambda k: F.shiftright(F.col(f"__n{k // 8}"), 35 - k % 8 * 5).bitwiseAND(31).cast("int") + 1
    letters = F.concat(*[F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), five(k), F.lit(1)) for k in range(32)])
    return df.withColumn("__sha1", F.sha1(payload)).withColumns(numbers).withColumn(name, letters).drop("__sha1", *numbers)


def _urn(kind: str, number: Column, sha1: Column) -> Column:
    """A stable record id from the kind of record, and the page's number and
    payload: repeated numbers of other payloads have ids of their own."""
    h = F.md5(F.concat(F.lit(kind + ":"), F.coalesce(number.cast("string"), F.lit("null")), F.lit(":"), sha1).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, record_id: Column, uri: Column, more: list[Column], content_type: str, block: Column) -> Column:
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), uri), *more,
        F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    return F.concat(head, F.lit("\r\n\r\n"), block)


def dedup_plan(pages: DataFrame, least_bytes: int, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """page_id, payload_digest and response_id of each row: of equal payloads
    of at least ``least_bytes`` bytes the largest page_id is the response."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = stored(pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.sha1(payload).alias("sha1"), F.length(payload).alias("n")), "payload-digests")
    last = stored(keyed.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("response_id")), "payload-groups")
    return keyed.join(last, "sha1", "left").select("page_id", "sha1", F.when(F.col("n") >= least_bytes, F.col("response_id")).otherwise(F.col("page_id")).alias("response_id"), "n")


def _in_files(most: int):
    """Puts captures together to files of ``most`` bytes, one value each."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([RECORD_END.encode().join(held)], pa.binary()).cast(pa.string())], names=["value"])
        for batch in batches:
            for capture in batch.column(0).cast(pa.binary()):
                capture = capture.as_py()
                if held and size + len(capture) > most:
                    yield out()
                    held, size = [], 0
                held.append(capture)
                size += len(capture)
        if held:
            yield out()

    return files


def write_captures(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Writes one capture (three records) a row of ``pages`` to gzip archives
    under ``path`` by Spark's own writer, so any file system Spark knows will do.

    The pages are read twice, once for the digests that say what revisits what,
    and once to be written.  A null payload counts as empty, a null URL as
    ``about:blank``; control characters in a URL become spaces.  Of repeated
    rows of one page_id all become responses or revisits alike.  A payload is
    written whole, however long.  Other columns play no part; an empty table
    writes no record.
    """
    plan = dedup_plan(pages, least_bytes, id_col, payload_col).select(F.col("page_id").alias("__id"), F.col("sha1").alias("__sha1"), "response_id").distinct()
    plan = stored(plan, "capture-plan")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("about:blank")), r"[\x00-\x1F\x7F]", " ").alias("uri"),
    ).join(plan.hint("merge"), F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha1(F.col("payload").cast("binary")) == F.col("__sha1")))
    rows = with_payload_digest(rows.withColumnRenamed("__sha1", "sha1"), "payload_digest", F.col("payload").cast("binary"))
    number, uri, sha1 = F.col("page_id"), F.col("uri"), F.col("sha1")
    revisit = ~F.col("page_id").eqNullSafe(F.col("response_id"))
    response_id = _urn("response", number, sha1)
    path_of = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    request = F.concat(F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("\r\n\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"))
    fields = F.concat(F.lit("page-id: "), F.coalesce(number.cast("string"), F.lit("null")), F.lit("\r\n"))
    to = F.concat(F.lit("WARC-Concurrent-To: "), response_id)
    refers = F.when(revisit, F.concat_ws("\r\n", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.concat(F.lit("WARC-Refers-To: "), _urn("response", F.col("response_id"), sha1))))
    main = _record(F.when(revisit, "revisit").otherwise("response"), response_id, uri, [digest, refers], "application/http; msgtype=response", F.when(revisit, http).otherwise(F.concat(http, "payload")))
    records = F.array(
        _record(F.lit("request"), _urn("request", number, sha1), uri, [to], "application/http; msgtype=request", request),
        main,
        _record(F.lit("metadata"), _urn("metadata", number, sha1), uri, [to], "application/warc-fields", fields),
    )
    files = rows.select(F.array_join(records, RECORD_END).alias("value")).mapInArrow(_in_files(file_bytes), "value string")
    files.write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _unzipped(data: bytes) -> Iterator[bytes]:
    """An archive's bytes in blocks, its gzip members joined (one a record, or
    one a file)."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), STEP):
            yield bytes(view[at : at + STEP])
        return
    while data[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(data):
            given = view[at : at + STEP]
            out = z.decompress(given, STEP)
            at += len(given) - len(z.unused_data if z.eof else z.unconsumed_tail)
            yield out
        yield z.flush()


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space
    continues the one before."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def parse(blocks: Iterator[bytes] | bytes) -> Iterator[dict]:
    """The records of one archive, given in blocks, by their Content-Length;
    bytes between records that begin none are skipped, a record cut off at the
    end too.  No more is held than a record and a block."""
    source = iter([blocks] if isinstance(blocks, bytes) else blocks)
    data, passed = bytearray(), 0

    def more() -> bool:
        block = next(source, None)
        data.extend(block or b"")
        return block is not None

    def drop(n: int) -> None:
        nonlocal passed
        passed += n
        del data[:n]

    while True:
        at = data.find(b"WARC/1.")
        if at < 0:
            drop(max(0, len(data) - 6))
            if not more():
                return
            continue
        drop(at)
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        fields = _fields(bytes(data[data.find(b"\r\n") + 2 : end]))
        if not fields.get("content-length", "").isdigit():
            drop(end)
            continue
        size = int(fields["content-length"])
        while len(data) < end + 4 + size:
            if not more():
                return
        block = bytes(data[end + 4 : end + 4 + size])
        status = length = None
        payload = block
        if "msgtype=response" in fields.get("content-type", "") or "msgtype=request" in fields.get("content-type", ""):
            head, _, payload = block.partition(b"\r\n\r\n")
            line, _, rest = head.partition(b"\r\n")
            http = _fields(rest)
            word = line.split(b" ")
            status = int(word[1]) if len(word) > 1 and word[0].startswith(b"HTTP/") and word[1].isdigit() else None
            length = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "").rpartition(":")[2] or None
        digest = _sha1(payload) if kind == "response" else said
        yield {
            "place": passed, "warc_type": kind, "record_id": fields.get("warc-record-id"), "concurrent_to": fields.get("warc-concurrent-to"),
            "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "payload_digest": digest, "payload_bytes": len(payload) if kind == "response" or length is None else length,
            "digest_ok": digest == said if said else None, "http_status": status, "headers": list(fields.items()), "payload": payload,
        }
        drop(end + 4 + size)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives (plain, or gzip by file or by record) under
    ``path``: one row a record, payload whole."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                some, held = [], 0
                for record in parse(_unzipped(content.as_py())):
                    some.append(record | {"file": name})
                    held += len(record["payload"])
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)
                        some, held = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInArrow(rows, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: record_id, response (a response or revisit record),
    request (null if none) and metadata (array of records).

    Records are joined through WARC-Concurrent-To.  A capture is a response
    or revisit; requests and metadata that point at none are left out.  Of
    two requests the one first by record id is taken, of repeated metadata
    records (one record_id) one; each of repeated responses and revisits is a
    capture, with what points at it.
    """
    whole = F.struct(*[F.col(c) for c in records.columns])
    main = records.where(F.col("warc_type").isin("response", "revisit"))
    main = main.select("record_id", whole.alias("response"))
    beside = records.where(F.col("warc_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    order = F.struct(F.coalesce("payload", F.lit(b"")), *[c for c in ("file", "place") if c in records.columns])
    # Repeated records meet before anything is collected, so an array does not grow with them.
    once = beside.groupBy(F.col("concurrent_to").alias("to"), "warc_type", F.col("record_id").alias("id")).agg(F.min_by(whole, order).alias("record"))
    beside = once.groupBy(F.col("to").alias("record_id")).agg(
        F.min_by(F.when(F.col("warc_type") == "request", F.col("record")), F.when(F.col("warc_type") == "request", F.struct(F.col("id").isNull(), F.col("id")))).alias("request"),
        F.collect_list(F.when(F.col("warc_type") == "metadata", F.col("record"))).alias("metadata"),
    )
    return main.join(beside, "record_id", "left").select("record_id", "response", "request", F.coalesce("metadata", F.array()).alias("metadata"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The assembled captures of the archives under ``path``."""
    return assemble(read_records(spark, path))
