"""WARC: writing archives, reading them back, putting segmented records together.

Writing: a page whose payload another page of a larger id has too becomes a revisit record, every other one a response
with its payload in chunked transfer framing. Blocks beyond `segment_bytes` are cut into a first record and continuation
records, each in a gzip member of its own. Archives are rows (name, content) of a table, since executors can only write
through Spark; archives_in() reads files of any origin into such rows.

Reading: whole records are decoded where they are found; only the pieces of segmented ones travel. They meet by origin
identifier, sorted by segment number, one record at a time: numbers must run from 1 without a gap, the total length that
the last one states must be right, then the framing is decoded.

Defined results. A null html is an empty payload; a null url an empty one. A null page_id is smaller than any other, and
null again when read back. Of rows that repeat the largest page_id of a payload, each is a response. Records that can't
be put together come back with `error` set and no payload. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.common import ship, table, written

ARCHIVE_BYTES, SEGMENT_BYTES, CHUNK_BYTES = 4 << 20, 16 << 10, 4 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- bytes ---------------------------------------------------------------------------------------------------------


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(piece := data[k : k + size]), piece) for k in range(0, len(data), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The payload within chunked transfer framing. Chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size is missing")
        n = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(data[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, str]], block: bytes, level: int = 3) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def page_records(page_id: int | None, url: str, payload: bytes, refers_to: int | None, unique: str, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response with its continuations."""
    name = lambda n: f"<urn:page:{'' if page_id is None else page_id}:{unique}{f':{n}' if n else ''}>"
    url = "".join(url.split()) or "urn:none"
    about = [("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    http = [("Content-Type", "application/http; msgtype=response")]
    ok = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = ok + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name(0)), *about, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), *http], block)
        return
    block = ok + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", name(0)), *about, *http], block)
        return
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    for n, part in enumerate(parts, 1):
        total = [("WARC-Segment-Total-Length", str(len(block)))] * (n == len(parts))
        if n == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", name(0)), *about, *http, ("WARC-Segment-Number", "1")], part)
        else:
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(n)), ("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name(0)), ("WARC-Segment-Number", str(n)), *total], part)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, compressed or not, streaming."""
    raw = io.BytesIO(content)
    f = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        last = ""
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in (" ", "\t") and last:
                headers[last] += " " + text.strip()
            else:
                key, _, value = text.partition(":")
                last = key.strip().lower()
                headers[last] = value.strip()
        n = int(headers.get("content-length", 0))
        block = f.read(n)
        if len(block) != n:
            raise ValueError("a record is cut off")
        yield headers, block


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and payload, the transfer framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return http, dechunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body


# --- tables --------------------------------------------------------------------------------------------------------


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, sha1 and refers_to of the rows whose payload a row of a larger page_id has too. Only ids and digests move."""
    html = F.coalesce("html", F.lit(""))
    seen = pages.select("page_id", F.unhex(F.sha1(html)).alias("sha1"), F.octet_length(html).alias("n")).filter(F.col("n") >= min_bytes)
    facts = seen.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    return seen.join(facts, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()


def archives(pages: DataFrame, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """name and content of gzipped archives of about archive_bytes that hold a record (and its continuations) for each page."""
    ship()
    again = revisits(pages, min_bytes).select(F.col("page_id").alias("again_id"), F.col("sha1").alias("again_sha1"), "refers_to")
    rows = pages.select("page_id", "url", "html").withColumn("sha1", F.unhex(F.sha1(F.coalesce("html", F.lit("")))))
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["again_id"]) & (rows["sha1"] == again["again_sha1"]), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, seq = TaskContext.get().partitionId(), 0, 0
        start = lambda: io.BytesIO()
        out = start()

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:06d}.warc.gz"]), pa.array([out.getvalue()], pa.binary())], ["name", "content"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                for data in page_records(page_id.as_py(), url.as_py() or "", payload, refers_to.as_py(), f"{part}-{seq}", segment_bytes):
                    if out.tell() and out.tell() + len(data) > archive_bytes:
                        yield full()
                        out, n = start(), n + 1
                    if not out.tell():
                        out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{part}-{n}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(data)
                seq += 1
        if out.tell():
            yield full()

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, "name string, content binary")


def archives_in(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from .warc and .warc.gz files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")


FOUND = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("stated_digest", pa.string()),
    ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
])


def _decoded(row: dict, block: bytes, with_payload: bool) -> dict:
    try:
        http, payload = payload_of(block)
    except ValueError as e:
        return row | {"block": None, "error": str(e)}
    if row["record_type"] == "revisit":  # the payload is the other record's; its length and digest are stated
        stated = http.get("content-length", "")
        return row | {"block": None, "payload_bytes": int(stated) if stated.isdigit() else None, "payload_digest": row["stated_digest"]}
    return row | {"block": None, "payload_bytes": len(payload), "payload_digest": base32_sha1(payload), "payload": payload if with_payload else None}


def read(found: DataFrame, with_payload: bool = False) -> DataFrame:
    """record_id, record_type, target_uri, refers_to, stated_digest, payload_bytes, payload_digest, payload (where asked
    for) and error, a row for each response, resource or revisit record of the archives (name, content)."""
    ship()
    sql = "record_id string, record_type string, target_uri string, refers_to string, stated_digest string, segment int, total_length bigint, block binary, payload_bytes bigint, payload_digest string, payload binary, error string"
    empty = dict.fromkeys(FOUND.names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content")):
                rows, held = [], 0
                try:
                    for h, block in records(content.as_py()):
                        kind = h.get("warc-type", "").lower()
                        if kind not in ("response", "resource", "revisit", "continuation"):
                            continue
                        digest = h.get("warc-payload-digest", "")
                        segment = h.get("warc-segment-number")
                        row = empty | {
                            "record_id": h.get("warc-segment-origin-id") if kind == "continuation" else h.get("warc-record-id"), "record_type": kind, "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"),
                            "stated_digest": digest.split(":", 1)[-1].upper() or None, "segment": int(segment) if segment else None, "total_length": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                        }
                        rows.append(row | {"block": block} if segment else _decoded(row, block, with_payload))
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, FOUND)
                            rows, held = [], 0
                except (ValueError, OSError, EOFError, zlib.error) as e:
                    rows.append(empty | {"record_id": name.as_py(), "record_type": "archive", "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, FOUND)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict] = []

        def whole() -> dict:
            first, numbers = parts[0], [p["segment"] for p in parts]
            row = first | {"segment": None, "total_length": None, "block": None}
            total = parts[-1]["total_length"]
            if first["record_type"] == "continuation" or numbers != list(range(1, len(parts) + 1)):
                return row | {"error": f"segments {numbers[:20]}"}
            block = b"".join(p["block"] for p in parts)
            if total != len(block):
                return row | {"error": f"{len(block)} bytes of {total}"}
            return _decoded(row, block, with_payload)

        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if parts and row["record_id"] != parts[0]["record_id"]:
                    rows.append(whole())
                    held += len(rows[-1]["payload"] or b"")
                    parts.clear()
                parts.append(row)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, FOUND)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, FOUND)
        if parts:
            yield pa.RecordBatch.from_pylist([whole()], FOUND)

    parsed = written(found.select("name", "content").mapInArrow(parse, sql), "parsed")
    pieces = parsed.filter("segment IS NOT NULL").repartition("record_id").sortWithinPartitions("record_id", "segment")  # only pieces travel
    return parsed.filter("segment IS NULL").unionByName(pieces.mapInArrow(assemble, sql)).drop("segment", "total_length", "block")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    back = read(written(archives(pages), "warc"))
    id_of = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*)", 1).try_cast("bigint")
    return back.select(
        id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", id_of("refers_to")).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
b AS (SELECT p.*, r.last, unhex(p.h)::BIT::VARCHAR AS bits FROM p JOIN r USING (h))
SELECT page_id, strlen(html) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
         + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT
         + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM b
"""
