"""WARC archives: writing with deduplication and segmentation, and reading back.

Each page becomes one logical record. Of records with equal payloads the page of the
smallest id is a response, the others revisit it (they carry no payload). A
response's block is an HTTP message with chunked transfer framing; a block longer than
``segment_bytes`` is cut into segments: a first one, and continuation records that
name it as their origin. The archives are written by Spark's text sink (the blank lines
behind a record are its line separator), gzipped, so any shared store serves.

Reading parses each file as a stream of records. Whole responses are decoded where they
are read; only segments are shuffled: grouped by origin, ordered by number, checked
for gaps and for the total length, and joined before the framing is decoded.
Lengths and digests are checked against the headers; damaged archives raise an error.

Defined results: a null text is an empty payload; repeated rows (same id, same
payload) each have a record of the same kind; a row without an id revisits an equal
payload's page, and is a response if there is none with an id; payloads shorter than
``least`` bytes are never deduplicated; control characters in a URL are escaped, a
null URL has no header. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.session import scratch_path

SEGMENT_BYTES = 8192
FRAME_BYTES = 2048       # of a chunk of the transfer framing
FILE_RECORDS = 10_000    # in an archive file, at most
DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"
IDS = uuid.UUID("6f0d7a52-6d0e-4f0e-9a59-6f6f35a7c1de")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def framed(payload: bytes, size: int = FRAME_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i:i + size]), payload[i:i + size])
             for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(body: bytes) -> bytes:
    """The payload of chunked transfer framing (extensions and trailers are skipped)."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("broken transfer framing")
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unframed(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record_id(page: int | None, sha1: str, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, f'{page}:{sha1}:{segment}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None),
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _page_records(page: int | None, url: str | None, text: str | None, sha1: str, first: int | None,
                  size: int, revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    own = _record_id(page, sha1)
    shared = [("WARC-Date", DATE), ("X-Page-ID", page),
              ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"))]
    payload_digest = ("WARC-Payload-Digest", "sha1:" + digest32(bytes.fromhex(sha1)))
    if revisit:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shared, payload_digest,
                       ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(first, sha1)),
                       ("X-Refers-To-Page-ID", first), ("Content-Type", "application/http;msgtype=response")],
                      f"{HTTP}Content-Length: {size}\r\n\r\n".encode())
        return
    block = f"{HTTP}Transfer-Encoding: chunked\r\n\r\n".encode() + framed((text or "").encode())
    cut = len(block) > segment_bytes
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *shared, payload_digest,
                   ("WARC-Segment-Number", 1 if cut else None),
                   ("Content-Type", "application/http;msgtype=response")], block[:segment_bytes])
    for i, at in enumerate(range(segment_bytes, len(block), segment_bytes), start=2):
        last = at + segment_bytes >= len(block)
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _record_id(page, sha1, i)), *shared,
                       ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i),
                       ("WARC-Segment-Total-Length", len(block) if last else None)], block[at:at + segment_bytes])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   text_col: str = "html", least: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write gzipped archive files of at most ``FILE_RECORDS`` records below ``path``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), text.alias("text"),
                        F.sha1(text.cast("binary")).alias("sha1"), F.octet_length(text).alias("size"))
    keys = ["sha1", "size"]
    # payloads alone are compared, by digest and length; their texts are not moved
    firsts = rows.filter(F.col("size") >= least).groupBy(*keys).agg(F.min("page").alias("first"))
    is_first = F.col("page").eqNullSafe(F.col("first"))
    f = firsts.select(F.col("sha1").alias("f_sha1"), F.col("size").alias("f_size"), "first")
    responses = (rows.join(f, is_first & (F.col("sha1") == F.col("f_sha1")) & (F.col("size") == F.col("f_size")))
                 .withColumn("revisit", F.lit(False)))
    revisits = (rows.drop("text").join(firsts, keys).filter(~is_first)
                .withColumn("text", F.lit(None).cast("string")).withColumn("revisit", F.lit(True)))
    small = (rows.filter(F.col("size") < least).withColumn("first", F.lit(None).cast("long"))
             .withColumn("revisit", F.lit(False)))
    names = ["page", "url", "text", "sha1", "first", "size", "revisit"]
    out = responses.select(*names).unionByName(revisits.select(*names))
    if least > 0:
        out = out.unionByName(small.select(*names))

    def run(batches):
        for batch in batches:
            records = []
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                records.extend(_page_records(*row, segment_bytes))
                if len(records) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])
                    records = []
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    (out.mapInArrow(run, "record binary").select(F.col("record").cast("string")).write
     .option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive's bytes."""
    while line := stream.readline():
        if line not in (b"WARC/1.1\r\n", b"WARC/1.0\r\n"):
            raise ValueError(f"a record was expected: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != END.encode():
            raise ValueError("a record is cut short")
        yield headers, block


_FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
           ("record_type", pa.string()), ("refers_to", pa.int64()),
           ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
_RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _whole(headers: dict[str, str], block: bytes) -> dict:
    payload = payload_of(block)
    digest = digest32(hashlib.sha1(payload).digest())
    if headers.get("warc-payload-digest", "sha1:" + digest) != "sha1:" + digest:
        raise ValueError("a payload differs from its digest")
    return {"payload_bytes": len(payload), "payload_digest": digest, "record_type": "response"}


def _row(headers: dict[str, str], block: bytes) -> dict:
    page, kind = headers.get("x-page-id"), headers["warc-type"]
    row = {"page_id": None if page is None else int(page)}
    if kind == "revisit":
        fields = dict(x.split(b": ", 1) for x in block.split(b"\r\n")[1:] if b": " in x)
        refers = headers.get("x-refers-to-page-id")
        return row | {"payload_bytes": int(fields[b"Content-Length"]), "record_type": "revisit",
                      "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"),
                      "refers_to": None if refers is None else int(refers)}
    if "warc-segment-number" not in headers:
        return row | _whole(headers, block)
    total = headers.get("warc-segment-total-length")
    return row | {"origin": headers.get("warc-segment-origin-id", headers["warc-record-id"]),
                  "segment": int(headers["warc-segment-number"]), "block": block,
                  "payload_digest": headers.get("warc-payload-digest"),
                  "total": None if total is None else int(total)}


def _read_files(batches):
    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS],
                                          names=[n for n, _ in _FIELDS])
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            with gzip.open(io.BytesIO(content.as_py())) as stream:
                for headers, block in parsed(stream):
                    rows.append(_row(headers, block))
                    if len(rows) >= 500:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)


def reassembled(segments: list[dict]) -> tuple[int, bytes]:
    """(copies, block) of one record's segments; a record that was written more than
    once has all of its segments as often."""
    blocks: dict[int, list[dict]] = {}
    for s in segments:
        blocks.setdefault(s["segment"], []).append(s)
    numbers = sorted(blocks)
    copies = len(blocks[numbers[0]])
    block = b"".join(blocks[k][0]["block"] for k in numbers)
    total = blocks[numbers[-1]][0]["total"]
    if (numbers != list(range(1, len(numbers) + 1)) or any(len(x) != copies for x in blocks.values())
            or total != len(block)):
        raise ValueError("segments are missing")
    return copies, block


def _reassemble(batches):
    for batch in batches:
        rows = []
        for segments in batch.column("segments").to_pylist():
            copies, block = reassembled(segments)
            first = next(s for s in segments if s["segment"] == 1)
            headers = {} if first["payload_digest"] is None else {"warc-payload-digest": first["payload_digest"]}
            rows += [{"page_id": first["page_id"], "refers_to": None} | _whole(headers, block)] * copies
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS[:5]],
                                         names=[n for n, _ in _FIELDS[:5]])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each logical
    record of the archives below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parts = files.mapInArrow(_read_files, _RESULT + ", origin string, segment int, total long, block binary")
    whole = parts.filter("origin is null").select(*[n for n, _ in _FIELDS[:5]])
    # one record's segments: as many as its length asks for
    joined = (parts.filter("origin is not null").groupBy("origin")
              .agg(F.collect_list(F.struct("segment", "page_id", "payload_digest", "total", "block")).alias("segments"))
              .select("segments").mapInArrow(_reassemble, _RESULT))
    return whole.unionByName(joined)


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the archives (to the shared folder, if no path is given), read them back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    return read_archives(spark, path)
