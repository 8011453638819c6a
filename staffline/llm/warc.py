"""WARC archives: writing with segments and revisits, reading with segment reassembly.

Records longer than a segment are written as a first record and continuation records. The reader decodes whole records
where it finds them; only segments are shuffled: grouped by the origin's identifier, ordered by segment
number, checked against the total length and joined. Payloads are taken out of their chunked transfer framing.

Files are written by attempts under names of their own and listed in a manifest that Spark commits, so a retried task leaves at
most a file that nobody reads.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffline.llm.common import durable, open_folder, shared_folder

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
FILE_BYTES = 64 << 20
#: Payloads below this are never revisits.
LEAST_SHARED = 100
EMIT_BYTES = 8 << 20

OUT = (
    "page_id string, record_type string, refers_to string, target_uri string, segment int, origin string, total long, "
    "block binary, payload binary, payload_bytes long, payload_digest string, error string"
)
OUT_ARROW = pa.schema(
    [(n, pa.string()) for n in ("page_id", "record_type", "refers_to", "target_uri")]
    + [("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary()), ("payload", pa.binary())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())]
)


# -- one record ------------------------------------------------------------------------------------

def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body; ValueError where the framing is broken. Chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where its length says")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> tuple[bytes, dict[str, str]]:
    """(payload, headers) of an HTTP response."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP headers")
    fields = dict(
        (k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    )
    if fields.get("transfer-encoding", "").lower() == "chunked":
        body = unchunked(body)
    return body, fields


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("record is cut off")
        yield fields, block


def _record(fields: list[tuple[str, object]], block: bytes, level: int = 4) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", level, mtime=0)


def page_records(
    page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str, segment_bytes: int = SEGMENT_BYTES,
) -> list[bytes]:
    """The compressed records of a page: a revisit, a response, or a response in segments."""
    name = lambda: f"<urn:uuid:{uuid.uuid4()}>"
    own = name()
    page = [("WARC-Target-URI", " ".join((url or "").split()))] + ([] if page_id is None else [("X-Page-ID", page_id)])
    digest = ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest())
    http = ("Content-Type", "application/http; msgtype=response")
    first = [("WARC-Record-ID", own), ("WARC-Date", date), *page, digest, http]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", refers_to)]
        return [_record([("WARC-Type", "revisit"), *first, *profile], head + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), *first], block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([("WARC-Type", "response"), *first, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", name()), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k)]
        if k == len(parts):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_record(fields, part))
    return out


# -- writing ---------------------------------------------------------------------------------------

def with_roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` with ``refers_to``: the smallest id with the same payload, where that is another and the payload is large.

    Only digests and ids are grouped; pages meet the groups of at least two in one join, which a hot payload does not
    stop Spark from splitting.
    """
    body = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    keyed = pages.withColumn("_digest", F.when(F.octet_length(body) >= LEAST_SHARED, F.sha2(body, 256)))
    shared = (
        keyed.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").drop("_n")
    )
    other = F.col("_least").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_least"))
    return keyed.join(shared, "_digest", "left").withColumn("refers_to", F.when(other, F.col("_least"))).drop("_digest", "_least")


def write_archives(
    pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES,
    file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Write a record per row of ``pages`` into compressed archives; returns the manifest (path, n_records, n_bytes).

    A null html is an empty payload, a null url an empty target, a null id no identifier. Repeated rows are written each; where
    several rows have the smallest id of a payload, all of them are responses. Extra columns are ignored.
    A file ends after ``file_bytes``, between any two records, so segments can lie in different files.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = with_roles(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "page_id", "html")
    rows = rows.select(F.col("page_id").cast("string"), "url", F.col("html").cast("binary"), F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        part, attempt, done, sink, size, count = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], [], None, 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                columns = [batch.column(k).slice(i, 64).to_pylist() for k in range(4)]
                for page_id, url, html, refers_to in zip(*columns):
                    for data in page_records(page_id, url, html or b"", refers_to, date, segment_bytes):
                        if sink is None:
                            name = f"part-{part:06d}-{len(done):04d}-{attempt}.warc.gz"
                            fs.create_dir(base, recursive=True)
                            sink, size, count = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                        size, count = size + sink.write(data), count + 1
                        if size >= file_bytes:
                            sink.close()
                            done.append({"path": f"{folder}/{name}", "n_records": count, "n_bytes": size})
                            sink = None
        if sink is not None:
            sink.close()
            done.append({"path": f"{folder}/{name}", "n_records": count, "n_bytes": size})
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return durable(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


# -- reading ---------------------------------------------------------------------------------------

def _finished(block: bytes, fields: dict, payload: bool) -> dict:
    """Results of a whole block: payload, length, digest, or what is wrong with it."""
    try:
        body, http = http_payload(block)
        claimed = fields.get("payload_digest")
        if fields["record_type"] == "revisit":
            return {"payload_bytes": int(http["content-length"]), "payload_digest": claimed}
        digest = hashlib.sha256(body).hexdigest()
        if claimed and claimed != digest:
            return {"error": "payload digest differs"}
        return {"payload_bytes": len(body), "payload_digest": digest} | ({"payload": body} if payload else {})
    except (ValueError, KeyError) as error:
        return {"error": f"broken HTTP block: {error}"}


def read_archives(paths: DataFrame, payload: bool = True, path_col: str = "path") -> DataFrame:
    """A row per page record of the archives: page_id, record_type, refers_to, target_uri, payload, payload_bytes, payload_digest, error.

    One file per task, records one by one. Segmented records are reassembled: missing or repeated segment numbers, a total
    length that is absent or wrong, broken chunk framing, a digest that differs, and segments without their first record
    give a row with ``error`` and no payload. ``payload=False`` leaves payloads out and keeps their length and digest.
    Ids are strings; an empty list of paths gives an empty table.
    """
    files = max(1, paths.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_folder(path)
                with fs.open_input_file(name) as source, io.BufferedReader(gzip.GzipFile(fileobj=source)) as stream:
                    for fields, block in records(stream):
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        digest = fields.get("warc-payload-digest", "")
                        row = {
                            "page_id": fields.get("x-page-id"), "record_type": kind, "refers_to": fields.get("x-refers-to-page-id"),
                            "target_uri": fields.get("warc-target-uri"), "payload_digest": digest.partition(":")[2] or None,
                        }
                        if "warc-segment-number" in fields:
                            row |= {
                                "segment": int(fields["warc-segment-number"]), "block": block,
                                "origin": fields.get("warc-segment-origin-id", fields.get("warc-record-id")),
                                "total": int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None,
                            }
                        else:
                            row |= _finished(block, row, payload)
                        held.append(row)
                        size += len(row.get("block") or b"") + len(row.get("payload") or b"") + 500
                        if size >= EMIT_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=OUT_ARROW)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=OUT_ARROW)

    # Both branches below use what was read once.
    found = durable(paths.select(path_col).repartition(files).mapInArrow(run, OUT), "warc-records")
    columns = ["page_id", "record_type", "refers_to", "target_uri", "payload", "payload_bytes", "payload_digest", "error"]
    return found.where("segment IS NULL").select(*columns).unionByName(reassemble(found.where("segment IS NOT NULL"), payload).select(*columns))


def reassemble(segments: DataFrame, payload: bool = True) -> DataFrame:
    """One row per origin from its segments; a group is one record, so it is no larger than that."""
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = segments.groupBy("origin").agg(
        *[first(c) for c in ("page_id", "record_type", "refers_to", "target_uri", "payload_digest")],
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                parts, total = row.pop("parts"), row["total"]
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                    done = {"error": "segments are missing or repeated"}
                elif total != len(block):
                    done = {"error": "segments do not have the total length"}
                else:
                    done = _finished(block, row, payload)
                yield pa.RecordBatch.from_pylist([row | done], schema=OUT_ARROW)

    return grouped.mapInArrow(run, OUT)
