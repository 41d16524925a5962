"""WARC archives: writing with revisits, segmentation and chunked framing, and reassembly.

Writing: equal payloads (by SHA-1) are stored once. The record of the largest id holds the
payload, the others are revisit records. A block longer than ``segment_bytes`` is cut into a
first record and continuation records that name it by WARC-Segment-Origin-ID.

Reading: records are parsed by Content-Length. Continuations are grouped by origin, ordered
by segment number, held against WARC-Segment-Total-Length, and the chunked framing of the
whole block is decoded; the payload's digest is verified.

Defined cases: a null payload counts as empty; a null url has no target header; a null id
stays null and never becomes the kept one unless all ids of that payload are null, when all
are responses; repeated rows each give a record, and all rows with the kept id are responses;
an empty table gives an empty archive. Columns other than id, url and payload are ignored.
A record that fails verification is returned with its ``problem`` and null payload figures: broken
framing, another digest or none, no end of the HTTP head, a revisit without a length, segments that
don't fit. Bytes that aren't a record are one row with a problem, and reading goes on at the next
"WARC/" after an empty line; so does what remains of an archive whose compressed data is broken.
Header lines without a colon are passed over; records other than response and revisit aren't returned.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, problem string"
#: Stands among a record's header fields for what is wrong with it.
DAMAGE = ""
SEGMENT_SCHEMA = "origin string, number int, total long, head map<string,string>, block binary"


def chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for k in range(0, len(payload), size):
        piece = payload[k : k + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size < 0:
            raise ValueError("negative chunk size")
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1"] + [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _records(page_id, url, payload: bytes, keeper, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    own = f"<urn:uuid:{uuid.uuid4()}>"
    url = None if url is None else " ".join(url.split())
    fields = [
        ("WARC-Type", "response" if keeper is None else "revisit"),
        ("WARC-Record-ID", own),
        ("WARC-Target-URI", url),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("X-Page-ID", page_id),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if keeper is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", keeper)]
        yield _record(fields, HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record(fields, block)
        return
    cuts = range(0, len(block), segment_bytes)
    for number, k in enumerate(cuts, 1):
        if number == 1:
            head = [*fields, ("WARC-Segment-Number", 1)]
        else:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number)]
            if number == len(cuts):
                head.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(head, block[k : k + segment_bytes])


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, segment_bytes: int = 65_536, chunk_bytes: int = 16_384, records_per_file: int = 2_000) -> None:
    """Write one WARC record for each row as gzip archives under path.

    A file holds at most records_per_file blocks of segment_bytes each, so a reader's memory is bounded.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    # dealt anew, so that the join below has an exchange on both sides and a hot payload can be split
    shared = shared.repartition("keeper")
    marked = rows.join(shared, "digest", "left").select("page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("keeper")), None).otherwise(F.col("keeper")).alias("keeper"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for page_id, url, payload, keeper in batch.itertuples(index=False):
                for r in _records(None if pd.isna(page_id) else int(page_id), url, payload, None if pd.isna(keeper) else int(keeper), segment_bytes, chunk_bytes):
                    out.append(r)
                    held += len(r)
                if held > 1 << 24:
                    yield pd.DataFrame({"record": out})
                    out, held = [], 0
            if out:
                yield pd.DataFrame({"record": out})

    records = marked.mapInPandas(build, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _inflated(archive: bytes) -> tuple[bytes, str | None]:
    """The archive's content, or what can be had of it and what is wrong."""
    try:
        return gzip.decompress(archive), None
    except (OSError, EOFError, zlib.error):
        out, reader = [], zlib.decompressobj(31)
        try:
            for k in range(0, len(archive), 4096):
                out.append(reader.decompress(archive[k : k + 4096]))
        except zlib.error:
            pass
        return b"".join(out), "compressed data is broken"


def _number(x: str | None, bits: int = 63) -> int | None:
    """None for what isn't a whole number of so many bits and a sign."""
    try:
        n = None if x is None else int(x)
    except ValueError:
        return None
    return n if n is not None and -(1 << bits) <= n < 1 << bits else None


def _segment_number(head: dict[str, str]) -> int | None:
    return _number(head.get("WARC-Segment-Number"), 31)


def _head(raw: bytes) -> dict[str, str] | None:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    fields = dict(x.split(":", 1) for x in lines[1:] if ":" in x)
    head = {k.strip(): v.strip() for k, v in fields.items()}
    return head if (_number(head.get("Content-Length")) or 0) >= 0 and "Content-Length" in head else None


def _parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and block of each record; DAMAGE is among the fields where there is any."""
    (data, broken), at = _inflated(archive), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = None if end < 0 else _head(data[at:end])
        size = None if head is None else _number(head["Content-Length"])
        if size is None:
            yield {DAMAGE: "no WARC record"}, b""
            after = data.find(b"\r\n\r\nWARC/", at)
            at = len(data) if after < 0 else after + 4
            continue
        block = data[end + 4 : end + 4 + size]
        yield (head if len(block) == size else head | {DAMAGE: "record is cut short"}), block
        at = end + 4 + size + 4
    if broken:
        yield {DAMAGE: broken}, b""


def _origin(head: dict[str, str]) -> str | None:
    return head.get("WARC-Segment-Origin-ID", head.get("WARC-Record-ID"))


def _is_segment(head: dict[str, str]) -> bool:
    return DAMAGE not in head and _segment_number(head) is not None and _origin(head) is not None


def _is_whole(head: dict[str, str]) -> bool:
    return not _is_segment(head) and (DAMAGE in head or "WARC-Segment-Number" in head or head.get("WARC-Type") in ("response", "revisit"))


def _whole(head: dict[str, str], block: bytes, keep: bool, segmented: bool = False) -> tuple:
    """A row of RECORD_SCHEMA from a whole record."""
    page, kind = _number(head.get("X-Page-ID")), head.get("WARC-Type")

    def bad(problem: str) -> tuple:
        return page, None, None, kind, None, None, problem

    if DAMAGE in head:
        return bad(head[DAMAGE])
    if "WARC-Segment-Number" in head and not segmented:
        return bad("segment has no number or origin")
    if "WARC-Payload-Digest" not in head:
        return bad("no payload digest")
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    http, end, body = block.partition(b"\r\n\r\n")
    if not end:
        return bad("HTTP head has no end")
    if kind == "revisit":
        lengths = [_number(x.split(b":", 1)[1].decode("latin-1")) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if not lengths or lengths[-1] is None:
            return bad("revisit has no length")
        return page, lengths[-1], digest, kind, _number(head.get("X-Refers-To-Page-ID")), None, None
    try:
        payload = dechunked(body) if b"\r\nTransfer-Encoding: chunked" in http else body
    except ValueError:
        return bad("broken chunked framing")
    if base32_sha1(payload) != digest:
        return bad("payload digest differs")
    return page, len(payload), digest, kind, None, payload if keep else None, None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "problem"])
    return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str, *, keep_payload: bool = True) -> DataFrame:
    """One row for each response or revisit record under path, segmented records reassembled."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = [_whole(h, b, keep_payload) for h, b in _parse(content) if _is_whole(h)]
                yield _frame(rows)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for h, b in _parse(content):
                    if _is_segment(h):
                        number = _segment_number(h)
                        rows.append((_origin(h), number, _number(h.get("WARC-Segment-Total-Length")), h if number == 1 else None, b))
                yield pd.DataFrame(rows, columns=["origin", "number", "total", "head", "block"]).astype({"number": "int32", "total": "Int64"})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for origin, parts in batch.itertuples(index=False):
                yield _frame([_reassemble(parts, keep_payload)])

    grouped = files.mapInPandas(segments, SEGMENT_SCHEMA).groupBy("origin").agg(F.collect_list(F.struct("number", "total", "head", "block")).alias("parts"))
    return files.mapInPandas(whole, RECORD_SCHEMA).unionByName(grouped.mapInPandas(joined, RECORD_SCHEMA))


def _reassemble(parts: list, keep: bool) -> tuple:
    """A row of RECORD_SCHEMA from the segments of one record, in any order."""
    parts = sorted(parts, key=lambda p: p["number"])
    head = parts[0]["head"]
    if head is None:
        return None, None, None, "response", None, None, "first segment is missing"
    head = dict(head)
    page = _number(head.get("X-Page-ID"))
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
        return page, None, None, "response", None, None, "segment numbers have gaps"
    total, block = parts[-1]["total"], b"".join(bytes(p["block"]) for p in parts)
    if total is None or pd.isna(total) or int(total) != len(block):
        return page, None, None, "response", None, None, "total length differs"
    return _whole(head, block, keep, segmented=True)
