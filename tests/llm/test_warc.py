import gzip
import hashlib
import io
from collections import defaultdict

import pytest
from corpus_helpers import empty, rows
from pyspark.sql import functions as F

from staffline.llm import warc

PAGES = "page_id BIGINT, url STRING, html STRING, segment INT, origin STRING"
COLUMNS = ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "error")


def pages(spark):
    data = [(5, "u", "b" * 100), (4, "u", "b" * 100), (9, "u", "b" * 100), (2, "u", "a" * 99), (3, "u", "a" * 99), (1, None, None), (6, "u", ""), (6, "u", "")]
    data += [(7, "http://x/ y\r\nz", "é" * 300_000), (8, "u", "é" * 300_000), (10, "u", "\r\n0\r\n\r\nWARC/1.1\r\n" * 30), (None, "u", "n" * 200), (11, "u", "n" * 200)]
    return spark.createDataFrame([(*d, 1, "o") for d in data], PAGES)


def plain(data):
    by = defaultdict(list)
    for i, html in data:
        by[html].append(i)
    out = []
    for i, html in data:
        body = (html or "").encode()
        least = min((k for k in by[html] if k is not None), default=i) if len(body) >= 100 else i
        kind = ("response", None) if least == i else ("revisit", str(least))
        out.append((None if i is None else str(i), *kind, len(body), hashlib.sha256(body).hexdigest(), None))
    return sorted(out, key=repr)


def test_archives_give_back_every_page(spark):
    frame = pages(spark)
    manifest = warc.write_archives(frame, segment_bytes=1000, file_bytes=3000)
    assert manifest.count() > 20
    found = warc.read_archives(manifest)
    data = [(r.page_id, r.html) for r in frame.collect()]
    assert rows(found, *COLUMNS) == plain(data)
    bodies = {r.page_id: r.payload for r in found.where("record_type = 'response'").collect()}
    assert bodies["7"].decode() == "é" * 300_000 and bodies["1"] == b""
    assert rows(warc.read_archives(manifest, payload=False), *COLUMNS) == plain(data)


def test_no_pages_no_archives(spark):
    manifest = warc.write_archives(empty(pages(spark)))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_broken_segments_are_reported(spark):
    records = warc.page_records("1", "u", b"x" * 5000, None, "2024-01-01T00:00:00Z", segment_bytes=1000)
    read = [list(warc.records(io.BytesIO(gzip.decompress(r))))[0] for r in records]
    parts = [
        {"page_id": f.get("x-page-id"), "record_type": f["warc-type"], "segment": int(f["warc-segment-number"]), "block": b,
         "origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "payload_digest": f.get("warc-payload-digest", ":").split(":")[1] or None,
         "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None}
        for f, b in read
    ]
    full = spark.createDataFrame(parts, warc.OUT)
    assert warc.reassemble(full.orderBy(F.rand(1))).select("payload_bytes", "error").collect() == [(5000, None)]
    for damage in (full.where("segment <> 3"), full.where("segment <> 1"), full.where("total IS NULL"), full.union(full.where("segment = 2"))):
        assert warc.reassemble(damage).select("payload_bytes").collect()[0][0] is None
        assert warc.reassemble(damage).select("error").collect()[0][0]


@pytest.mark.parametrize("size", [1, 7, 8192])
def test_chunked_framing(size):
    for payload in (b"", b"a", b"\r\n" * 50, bytes(range(256)) * 100):
        assert warc.unchunked(warc.chunked(payload, size)) == payload
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"3\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)
