"""WARC archives of pages: writing with revisit records and segments, and reading with segment reassembly.

Archives are gzip files of WARC/1.1 records, written by Spark to any file system it reaches. A payload is sent in
chunked transfer framing; a block above `segment_bytes` becomes an origin record and continuation records. A file holds
at most `RECORDS_PER_FILE` records, each of at most `segment_bytes` and its header, so a reading task's memory is bounded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import lookup
from ..session import materialize
from .tables import column, small_batches

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 4_096
END = "\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PARSED = ("record_id string, record_type string, target_uri string, refers_to string, header_digest string, "
           "origin string, segment int, total_length bigint, block binary")
_READ = ("record_id string, record_type string, target_uri string, refers_to string, payload binary, "
         "payload_bytes bigint, payload_digest string, valid boolean")


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunk_frames(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i:i + size]), payload[i:i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; raises ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            if at > len(body):
                raise ValueError("truncated framing")
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk length does not fit")
        parts.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP response block."""
    head, separator, body = block.partition(b"\r\n\r\n")
    if not separator:
        raise ValueError("no end of the HTTP header")
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers if v is not None]
    return ("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]) + END).encode("utf-8", "surrogatepass") + block


def page_records(page: str, url: str | None, payload: bytes, response: str | None, repeated: bool, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit of the page `response`, or a response, in segments where it is long."""
    digest = digest_of(payload)
    uri = None if url is None else "".join(url.split("\r")).replace("\n", "")
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    record = f"urn:page:{page}:{digest}" + (f"#{uuid.uuid4().hex}" if repeated or response else "")
    if response:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record}>"), *common, ("WARC-Profile", _PROFILE),
                       ("WARC-Refers-To", f"<urn:page:{response}:{digest}>"), ("Content-Type", "application/http; msgtype=response")], _HTTP)
        return
    block = _HTTP + chunk_frames(payload)
    kind = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record}>"), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment_bytes:
        yield _record(kind, block)
        return
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([*kind, ("WARC-Segment-Number", 1)], parts[0])
    for number, part in enumerate(parts[1:], 2):
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common,
                       ("WARC-Segment-Origin-ID", f"<{record}>"), ("WARC-Segment-Number", number),
                       ("WARC-Segment-Total-Length", len(block) if number == len(parts) else None)], part)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a gzip archive, read as a stream."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as stream:
        while True:
            line = stream.readline()
            while line and not line.strip():
                line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError("a record does not begin where the one before it ends")
            headers = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
                headers[name.strip().lower()] = value.strip()
            yield headers, stream.read(int(headers["content-length"]))


def _bare(value: str | None) -> str | None:
    return None if value is None else value.strip("<>")


def _build_rows(segment_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[bytes] = []
            for page, url, payload, response, repeated in batch.itertuples(index=False):
                out.extend(page_records(page, url, bytes(payload), response, bool(repeated), segment_bytes))
                if len(out) >= 500:
                    yield pd.DataFrame({"value": out})
                    out = []
            yield pd.DataFrame({"value": out})
    return run


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record for every row of (page_id, url, html) to new archives in `folder`.

    The payload is the html in UTF-8, empty for null. Of equal payloads, that with the largest page_id is the response and the
    others revisit it; ids that are null come last. Rows that repeat the response's id and payload are responses too.
    An empty table writes an archive without records.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(column(pages, "page_id").cast("bigint").alias("page_id"), column(pages, "url").alias("url"),
                        F.coalesce(column(pages, "html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    each = rows.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.sum("n").alias("total"),
                                        F.coalesce(F.max_by("n", "page_id"), F.sum("n")).alias("repeats")).filter("total > 1").drop("total")
    roles = lookup(rows, groups, ["digest"], "left")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    revisits = ~F.col("page_id").eqNullSafe(F.col("response_id")) & F.col("response_id").isNotNull()
    records = roles.select(page.alias("page"), "url", "payload", F.when(revisits, F.col("response_id").cast("string")).alias("response"),
                           (F.coalesce("repeats", F.lit(1)) > 1).alias("repeated"))
    (records.mapInPandas(_build_rows(segment_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


def _parse_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [field.split()[0] for field in _PARSED.split(", ")]
    for batch in batches:
        for data in batch["content"]:
            out, held = [], 0
            for h, block in parse_records(bytes(data)):
                number = h.get("warc-segment-number")
                out.append((_bare(h.get("warc-record-id")), h.get("warc-type"), h.get("warc-target-uri"), _bare(h.get("warc-refers-to")),
                            (h.get("warc-payload-digest") or "").removeprefix("sha1:"), _bare(h.get("warc-segment-origin-id")),
                            None if number is None else int(number),
                            int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block))
                held += len(block)
                if held > 4 << 20:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)


def _decoded(rows: list[tuple]) -> pd.DataFrame:
    """Rows (record_id, type, uri, refers_to, header digest, block or None) with the payload decoded and checked."""
    out = []
    for record, kind, uri, refers, header, block in rows:
        payload = None
        if kind != "revisit" and block is not None:
            try:
                payload = payload_of(bytes(block))
            except ValueError:
                payload = None
        digest = header if payload is None else digest_of(payload)
        valid = kind == "revisit" or payload is not None and (not header or digest == header)
        out.append((record, kind, uri, refers, payload, None if payload is None else len(payload), digest, valid))
    frame = pd.DataFrame(out, columns=[field.split()[0] for field in _READ.split(", ")])
    return frame.astype({"payload_bytes": "Int64"})


def _decode_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield _decoded([(r.record_id, r.record_type, r.target_uri, r.refers_to, r.header_digest, r.block) for r in batch.itertuples()])


def _assemble(parts: pd.DataFrame) -> pd.DataFrame:
    """One record from its segments: in order, none missing or double, as long as the last one says."""
    parts = parts.sort_values("segment")
    numbers, total = parts["segment"].tolist(), parts["total_length"].iloc[-1]
    block = b"".join(map(bytes, parts["block"]))
    whole = numbers == list(range(1, len(numbers) + 1)) and pd.notna(total) and len(block) == int(total)
    first = parts.iloc[0]
    record = first["record_id"] if first["segment"] == 1 else first["origin"]
    kind = first["record_type"] if first["segment"] == 1 else "response"
    return _decoded([(record, kind, first["target_uri"], first["refers_to"], first["header_digest"], block if whole else None)])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives in `folder`, continuation records joined to their origin.

    Columns: record_id, record_type, target_uri, refers_to, payload, payload_bytes, payload_digest (of the decoded payload; of
    the header for revisits), valid. A record with missing or doubled segments, another length than its last segment
    says, broken framing or another digest than its header is kept with valid = false.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    parsed = files.mapInPandas(_parse_rows, _PARSED)
    whole = parsed.filter("segment is null").mapInPandas(_decode_rows, _READ)
    parts = parsed.filter("segment is not null").withColumn("of", F.coalesce("origin", "record_id"))
    return whole.unionByName(parts.groupBy("of").applyInPandas(_assemble, _READ))


def page_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page record in the archives; a revisit has
    the length of the payload that it refers to."""
    page = F.regexp_extract("record_id", r"^urn:page:(-?\d+):", 1)
    named = read_archives(spark, folder).select(
        F.when(page != "", page.cast("bigint")).alias("page_id"), F.substring_index("record_id", "#", 1).alias("record"),
        "record_type", F.col("refers_to").alias("refers"), "payload_bytes", "payload_digest")
    index = materialize(named)
    own = index.filter("record_type != 'revisit'").drop("record", "refers").withColumn("refers_to", F.lit(None).cast("bigint"))
    targets = index.filter("record_type != 'revisit'").select(F.col("record").alias("refers"), F.col("payload_bytes").alias("bytes"),
                                                              F.col("page_id").alias("refers_to")).dropDuplicates(["refers"])
    revisits = index.filter("record_type = 'revisit'").join(materialize(targets), "refers", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(*columns).unionByName(
        revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
