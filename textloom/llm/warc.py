"""WARC archives: writing with revisits and segments, and reassembly.

Writing: payload digests pick one response per group of equal long payloads;
records longer than a segment are cut into a first segment and continuation
records.  Archives are written and read through Spark's own file formats, so
they may lie in any store.  Reading: records are parsed file by file,
continuations are grouped by origin identifier, ordered by segment number,
checked against the total length, and the chunked transfer framing is decoded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, fresh_path, stage

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_BYTES = 4096
#: Tasks over which the pages of one digest are spread.
SALTS = 32


# ---- framing of one record


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        out += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decode chunked framing; chunk extensions and trailers are skipped.

    Raises ValueError on a broken or cut-off frame.
    """
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is cut off")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size < 0:
            raise ValueError("negative chunk size")
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """Body of an HTTP response block, with its transfer framing taken off."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP header is cut off")
    framed = any(line.lower().replace(b" ", b"").startswith(b"transfer-encoding:") and b"chunked" in line.lower() for line in head.split(b"\r\n")[1:])
    return unchunked(body) if framed else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the last line end, which the text writer adds."""
    head = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n"


def records_of(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive."""
    at = 0
    while True:
        while raw[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(raw):
            return
        end = raw.find(b"\r\n\r\n", at)
        lines = raw[at:end].split(b"\r\n")
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(fields["content-length"])
        if len(raw) < end + 4 + size:
            raise ValueError("block is cut off")
        yield fields, raw[end + 4 : end + 4 + size]
        at = end + 4 + size


def unzipped(raw: bytes) -> bytes:
    """All gzip members of an archive, or the bytes of a plain one."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        raw = member.unused_data
    return b"".join(out)


def page_records(key: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, segment_bytes: int) -> list[bytes]:
    """The records of one page: one, or a first segment and its continuations."""
    origin = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, key)}>"
    uri = None if url is None else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-ID", refers_to), *common], head)]
    block = head + chunked(payload)
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common], block)]
    out, count = [], -(-len(block) // segment_bytes)
    for n in range(1, count + 1):
        part = block[(n - 1) * segment_bytes : n * segment_bytes]
        if n == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", origin), ("WARC-Segment-Number", 1), *common]
        else:
            own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}/{n}')}>"
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == count else None)]
        out.append(record(fields, part))
    return out


def whole(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """Reassemble (number, total length, block) segments in any order.

    Raises ValueError if a number is missing or the total length is wrong; a
    segment that was stored twice counts once.
    """
    by: dict[int, tuple[int | None, bytes]] = {}
    for number, total, block in segments:
        by.setdefault(number, (total, block))
    if sorted(by) != list(range(1, len(by) + 1)):
        raise ValueError("a segment is missing")
    out = b"".join(by[n][1] for n in sorted(by))
    if len(by) > 1 and by[len(by)][0] != len(out):
        raise ValueError(f"total length is {by[len(by)][0]}, found {len(out)}")
    return out


# ---- writing


def decide(pages: DataFrame, least_bytes: int, page_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, digest, revisit, refers_to of each page.

    Groups of equal payloads are found on narrow keys with a partial maximum.
    The digests that several pages share (a row each) are broadcast while they
    are few, so no payload is shuffled; beyond, they are joined with salt, so a
    payload that a third of the pages share is spread over ``SALTS`` tasks.
    """
    base = pages.select(F.col(page_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    long = F.length("payload") >= least_bytes
    lead = base.filter(long).groupBy("digest").agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1 and lead is not null")
    lead = stage(lead.select(F.col("digest").alias("d"), "lead"), "warc-leads")
    if lead.count() <= MOST_BROADCAST:
        joined = base.join(F.broadcast(lead), (F.col("digest") == F.col("d")) & long, "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
        spread = lead.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.join(spread, (F.col("digest") == F.col("d")) & (salt == F.col("s")) & long, "left")
    again = F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead"))
    return joined.select("page_id", "url", "payload", "digest", again.alias("revisit"), F.when(again, F.col("lead")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, segment_bytes: int = 8192, records_per_file: int = 2048, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write gzipped archives under ``path``; a file holds at most
    ``records_per_file`` records of little more than ``segment_bytes`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(k, 256).to_pylist():
                    out += page_records(f"{part}/{n}", row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"], segment_bytes)
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = decide(pages, least_bytes, page_col, url_col, html_col).mapInArrow(run, "record binary")
    lines.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


# ---- reading

_PARSED = "origin string, number int, total long, page_id long, kind string, refers_to long, digest string, size long, error string, block binary"
_READ = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, error string"


def decoded(block: bytes, stored: str) -> tuple[int | None, str, str | None]:
    """(payload bytes, its digest, error) of a whole block; the stored digest
    where it cannot be decoded."""
    try:
        payload = http_payload(block)
    except ValueError as e:
        return None, stored, str(e)
    found = hashlib.sha1(payload).hexdigest()
    return len(payload), found, "digest differs" if stored and stored != found else None


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record of all archives under ``path``, gzipped (a
    member a record or a file) or plain: page_id, record_type, payload_bytes,
    payload_digest, refers_to, error.

    Records of one piece are decoded where they are read; only the blocks of
    segments are shuffled.  A record that cannot be reassembled or decoded keeps its row, with the
    reason in ``error`` and no bytes; a digest that differs from the stored
    one is an error too.  Revisits have no payload of their own here.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARSED.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for fields, block in records_of(unzipped(batch.column(0)[i].as_py())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    number = _number(fields, "warc-segment-number")
                    size, digest, error = None, fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
                    if number is None and kind == "response":
                        size, digest, error = decoded(block, digest)
                    rows.append((fields.get("warc-segment-origin-id") or fields["warc-record-id"], number, _number(fields, "warc-segment-total-length"), _number(fields, "x-page-id"), kind, _number(fields, "x-refers-to-page-id"), digest, size, error, None if number is None else block))
                for k in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 512]), kinds)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column(0).to_pylist():
                first = next((p for p in parts if p["kind"] != "continuation"), parts[0])
                kind, size, digest, error = first["kind"], first["size"], first["digest"], first["error"]
                if first["number"] is not None:
                    try:
                        size, digest, error = decoded(whole([(p["number"], p["total"], p["block"]) for p in parts]), digest)
                    except ValueError as e:
                        error = str(e)
                rows.append((first["page_id"], kind, size, digest, first["refers_to"], error))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _READ.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("content")
    parts = files.mapInArrow(parse, _PARSED)
    fields = F.struct("number", "total", "page_id", "kind", "refers_to", "digest", "size", "error", "block")
    return parts.groupBy("origin").agg(F.collect_list(fields).alias("parts")).select("parts").mapInArrow(join, _READ)


def round_trip(pages: DataFrame, least_bytes: int = 1000, segment_bytes: int = 8192, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages as archives, read those back and resolve the revisits.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest,
    record_type, refers_to, error.  A null html has an empty payload; a null
    page_id or url is left out of the record and read as null; rows that
    repeat a page and its payload are records each, of one type; an empty
    table gives no rows; extra columns are not read.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least_bytes, segment_bytes, page_col=page_col, url_col=url_col, html_col=html_col)
    read = stage(read_archives(spark, path), "warc-read")
    first = read.filter("record_type = 'response' and error is null").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("like")).agg(F.max("payload_bytes").alias("full"))
    whole_ = read.filter("record_type <> 'revisit'")
    again = read.filter("record_type = 'revisit'").join(first, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("like")), "left").withColumn("payload_bytes", F.col("full")).withColumn("error", F.when(F.col("full").isNull(), "no response to refer to")).select(read.columns)
    return whole_.unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
