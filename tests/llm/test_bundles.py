"""WARC bundles: round trips, revisits, seek tables and random access."""

import hashlib
import io
from collections import Counter, defaultdict

import zstandard

from tablewitness.llm import bundles

CLASH = "page_id bigint, url string, html string, digest string, copies string, deal int, role string, path string"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "c", 1, "x", "p") for r in rows], CLASH)


def _wanted(rows, least=0):
    """Plain definition: of equal payloads the greatest (page_id, url) is the response."""
    groups = defaultdict(list)
    for page, url, html in rows:
        groups[(html or "").encode()].append((page is not None, page or 0, url is not None, url or ""))
    out = Counter()
    for payload, members in groups.items():
        digest = bundles.base32(hashlib.sha1(payload).digest())
        members.sort()
        ids = [m[1] if m[0] else None for m in members]
        small = len(payload) < least
        out[ids[-1], len(payload), digest, "response", None] += 1
        for i in ids[:-1]:
            out[i, len(payload), digest, "response" if small else "revisit", None if small else ids[-1]] += 1
    return out


ROWS = (
    [(k, f"http://a/{k}", "very common") for k in range(300)] + [(7, "http://a/7", "very common")] * 1200 + [(299, "http://a/299", "very common")] * 3
    + [(None, None, None), (None, "x", ""), (3, "", ""), (5, "a b\nc ", "é😀"), (5, "a b\nc", "é😀"), (None, "n", "é😀"), (9, "u", "x" * 3_000_000), (10, "v", "\r\n\r\nWARC/1.1\r\n\r\n")]
    + [(100 + k, f"h{k}", f"page {k % 40}") for k in range(200)]
)


def _plain(r):
    return r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to


def test_round_trip(spark):
    assert Counter(map(_plain, bundles.archived(_pages(spark, ROWS)).collect())) == _wanted(ROWS)
    assert Counter(map(_plain, bundles.archived(_pages(spark, ROWS), least=7).collect())) == _wanted(ROWS, 7)
    assert bundles.archived(_pages(spark, [])).count() == 0


def test_files_and_access(spark, tmp_path):
    index = bundles.write(_pages(spark, ROWS), str(tmp_path / "warc"))
    rows = index.collect()
    assert len({r.record_id for r in rows}) == len(ROWS)
    files = sorted({r.path for r in rows})
    assert files and all(f.endswith(".warc.zst") for f in files)
    plain = {}
    for f in files:
        store, inside = bundles.open_store(f)
        with open(inside, "rb") as raw:
            packed = raw.read()
        table = bundles.seek_table(store, inside)
        frames = [bundles.read_frame(store, inside, *t) for t in table]
        # Any reader of Zstandard gets the same bytes from the file as a whole.
        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(packed), read_across_frames=True).read() == b"".join(frames)
        plain[f] = frames
    for r in rows:
        found = next(bundles.records(plain[r.path][r.frame][r.start : r.start + r.length]))
        assert found[2]["warc-record-id"] == f"<urn:uuid:{r.record_id}>" and found[2]["warc-type"] == r.record_type
    everything = bundles.read(index, payloads=True).collect()
    responses = {r.record_id: bytes(r.payload) for r in everything if r.record_type == "response"}
    assert all(r.refers_to_id in responses for r in everything if r.record_type == "revisit")
    wanted = index.where("page_id IN (5, 7, 9, 299) OR page_id IS NULL").select("record_id").union(spark.createDataFrame([("unknown",)], "record_id string"))
    got = Counter((r.page_id, bytes(r.payload).decode()) for r in bundles.fetch(index, wanted).collect())
    assert got == Counter((p, h or "") for p, _, h in ROWS if p in (5, 7, 9, 299, None))


def test_frames_hold_many_records(spark, monkeypatch):
    monkeypatch.setattr(bundles, "FRAME_BYTES", 5_000)
    pages = _pages(spark, [(k, "u", f"{k} " * 200) for k in range(100)]).coalesce(1)
    index = bundles.write(pages)
    assert bundles.read(index).count() == 100
    assert index.groupBy("path", "frame").count().agg({"count": "max"}).first()[0] > 1
