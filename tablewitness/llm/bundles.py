"""WARC archives as seekable Zstandard bundles.

A bundle is one ``.warc.zst`` file: records are grouped into frames of about ``FRAME_BYTES`` that decompress on
their own, and a skippable frame at the end holds the seek table (compressed and plain size of each frame), in the public
seekable format. Any Zstandard tool reads the file as a whole. The index maps a record identifier to
(file, frame, place inside the decompressed frame), so one record costs one range read of one frame.

Equal payloads are stored once: the row with the largest page_id (then the greatest url) is a response, the others are
revisit records that name it and keep only its HTTP header. Null page_ids rank below all numbers, null urls below all others.
Rows that are equal in all columns are records of their own, one of them the response; null html is an empty payload.

Rows meet by payload digest in one shuffle, sorted, so that the writer sees the response first. A digest with more than a thousandth of
all rows (fewer than a thousand digests can have that) does not meet: its rows are counted by
(page_id, url) without their html, its payload is sent once, and blocks of equal rows are dealt by hash.

A task that is run again writes files of other names; the index, written by Spark's commit, names only the files of
tasks that succeeded, and readers go by the index. Files are written and read through ``pyarrow.fs``, so the folder may be
any shared store that knows its scheme.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewitness.session import scratch_path, stage

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: Decompressed bytes that one task reads.
TASK_BYTES = 16 << 20
#: Equal rows in one record block, and the fewest rows of a digest that counts as hot.
COPIES, HOT_ROWS = 1000, 64

#: Fixed values of the seekable format: magic of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, record_type string, page_id bigint, path string, frame int, start bigint, length bigint"
FRAMES = "path string, frame int, start bigint, size bigint, plain bigint"
RECORDS = "path string, frame int, record_id string, record_type string, page_id bigint, payload_bytes bigint, payload_digest string, refers_to bigint, refers_to_id string, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Bundle:
    """One file being written: frames, then the seek table."""

    store: fs.FileSystem
    path: str
    sizes: list[tuple[int, int]] = field(default_factory=list)
    held: bytearray = field(default_factory=bytearray)
    written: int = 0

    def __post_init__(self) -> None:
        self.out = self.store.open_output_stream(self.path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, start inside it and length of a record; a frame ends behind the record that fills it."""
        place = len(self.sizes), len(self.held), len(record)
        self.held += record
        if len(self.held) >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.packer.compress(bytes(self.held))
            self.out.write(frame)
            self.sizes.append((len(frame), len(self.held)))
            self.written += len(frame)
            self.held = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(store: fs.FileSystem, path: str) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the end of the file alone."""
    with store.open_input_file(path) as f:
        size = f.size()
        count, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = f.read_at(count * width, size - 9 - count * width)
    out, start = [], 0
    for k in range(count):
        packed, plain = struct.unpack_from("<II", table, k * width)
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(store: fs.FileSystem, path: str, start: int, size: int, plain: int) -> bytes:
    with store.open_input_file(path) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(size, start), max_output_size=plain)


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], int, int]]:
    """(start, end, named fields, start and end of the block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        begin, length = end + 4, int(fields["content-length"])
        yield at, begin + length + 4, fields, begin, begin + length
        at = begin + length + 4


def _each(batch: pa.RecordBatch, rows: int = 256) -> Iterator[dict]:
    for k in range(0, batch.num_rows, rows):
        yield from batch.slice(k, rows).to_pylist()


def _uuid(kind: str, *parts: object) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "\x00".join([kind, *map(str, parts)])))


def _rows(pages: DataFrame, least: int) -> DataFrame:
    """Rows for the writer: (digest, page_id, url, html, n_bytes, copies, role, best_id, best_url, deal).

    ``role`` is null where the writer elects the response, ``best_*`` name the response of a hot digest, and ``deal`` says
    which rows have to meet.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("html")), "n_bytes": F.octet_length("html").cast("long")})
    shared = rows.where(F.col("n_bytes") >= least)
    counts = stage(shared.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS), "digests")
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))
    hot = [bytes(r.digest) for r in counts.join(total, F.col("n") > F.col("total") / 1000).collect()]  # fewer than 1,000
    nothing = F.lit(None).cast("string")
    is_hot = F.col("digest").isin(hot) & (F.col("n_bytes") >= least) if hot else F.lit(False)
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("url").isNotNull().alias("has_url"), "url")
    usual = rows.where(~is_hot).select(
        "digest", "page_id", "url", "html", "n_bytes", F.lit(1).cast("long").alias("copies"),
        F.when(F.col("n_bytes") < least, F.lit("response")).alias("role"), F.lit(None).cast("long").alias("best_id"), nothing.alias("best_url"),
        F.when(F.col("n_bytes") < least, F.xxhash64("digest", "page_id", "url")).otherwise(F.xxhash64("digest")).alias("deal"),
    )
    if not hot:
        return usual
    often = rows.where(is_hot)
    best = often.groupBy("digest").agg(F.max(order).alias("best"), F.first("html").alias("html"))
    best = stage(best, "hot")  # a row for each of fewer than 1,000 digests
    first = best.select(
        "digest", F.col("best.page_id").alias("page_id"), F.col("best.url").alias("url"), "html", F.octet_length("html").cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("copies"),
        F.lit("response").alias("role"), F.lit(None).cast("long").alias("best_id"), nothing.alias("best_url"), F.xxhash64("digest").alias("deal"),
    )
    groups = often.groupBy("digest", "page_id", "url", "n_bytes").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.join(F.broadcast(best.select("digest", F.col("best.page_id").alias("best_id"), F.col("best.url").alias("best_url"))), "digest")
    is_best = F.col("page_id").eqNullSafe(F.col("best_id")) & F.col("url").eqNullSafe(F.col("best_url"))
    groups = groups.withColumn("n", F.col("n") - is_best.cast("long")).where("n > 0")
    blocks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    revisits = blocks.select(
        "digest", "page_id", "url", F.lit(b"").alias("html"), "n_bytes", F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("block")).alias("copies"),
        F.lit("revisit").alias("role"), "best_id", "best_url", F.xxhash64("digest", "page_id", "url", "block").alias("deal"),
    )
    return usual.unionByName(first).unionByName(revisits)


def write(pages: DataFrame, folder: str | None = None, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the index, a written table.

    Payloads of fewer than ``least`` bytes are responses always. The index has ``INDEX``'s columns, ``start`` and ``length``
    inside the decompressed frame; other columns of ``pages`` are not archived. An empty table has no file.
    """
    folder = (folder or scratch_path(pages.sparkSession, "warc")).rstrip("/")
    rows = _rows(pages, least)
    rows = rows.repartition(F.col("deal")).sortWithinPartitions(
        "digest", F.col("page_id").desc_nulls_last(), F.col("url").desc_nulls_last()
    ).drop("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, seen, elected = None, None, (None, None, "")
        for batch in batches:
            index: list[tuple] = []
            for r in _each(batch):
                digest, page, url, payload, size, role = r["digest"], r["page_id"], r["url"], r["html"], r["n_bytes"], r["role"]
                if role is None:
                    role = "revisit" if digest == seen else "response"
                    if role == "response":
                        seen, elected = digest, (page, url, _uuid("payload", digest.hex()))
                    to = elected
                else:
                    to = r["best_id"], r["best_url"], _uuid("payload", digest.hex())
                for _ in range(r["copies"]):
                    if bundle is None or bundle.written >= BUNDLE_BYTES:
                        if bundle:
                            bundle.close()
                        name = uuid.uuid4().hex
                        store, inside = open_store(f"{folder}/{name}.warc.zst")
                        store.create_dir(inside.rpartition("/")[0], recursive=True)
                        bundle = Bundle(store, inside)
                        info = b"software: tablewitness\r\nformat: WARC File Format 1.1\r\n"
                        bundle.add(record("warcinfo", _uuid("info", name), [("WARC-Date", date), ("Content-Type", "application/warc-fields")], info))
                    whole = role == "response" and size >= least
                    record_id = _uuid("payload", digest.hex()) if whole else str(uuid.uuid4())
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                    fields = [("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{base32(digest)}"), ("Content-Type", "application/http; msgtype=response")]
                    if url is not None:
                        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
                    if page is not None:
                        fields.append(("X-Page-ID", str(page)))
                    if role == "revisit":
                        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:uuid:{to[2]}>")]
                        if to[1] is not None:
                            fields.append(("WARC-Refers-To-Target-URI", quote(to[1], safe="!#$%&'()*+,/:;=?@[]~")))
                        if to[0] is not None:
                            fields.append(("X-Refers-To-Page-ID", str(to[0])))
                    place = bundle.add(record(role, record_id, fields, http + payload if role == "response" else http))
                    index.append((record_id, role, page, f"{folder}/{name}.warc.zst", *place))
            if index:
                yield _batch(index, INDEX)
        if bundle:
            bundle.close()

    return stage(rows.mapInArrow(run, INDEX), "warc-index")


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(part.split() for part in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(column, _ARROW[kind]) for column, kind in zip(zip(*rows), kinds)], names=list(names))


def frames(index: DataFrame) -> DataFrame:
    """The frames of the files that an index names, from their seek tables: (path, frame, start, size, plain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = [(path, k, *f) for k, f in enumerate(seek_table(*open_store(path)))]
                if found:
                    yield _batch(found, FRAMES)

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("path").distinct().repartition(tasks, "path").mapInArrow(run, FRAMES)  # a fixed number is not coalesced


def _parsed(data: bytes, path: str, frame: int, payloads: bool) -> Iterator[tuple]:
    for _, _, named, begin, end in records(data):
        kind = named["warc-type"]
        if kind == "warcinfo":
            continue
        head, _, payload = data[begin:end].partition(b"\r\n\r\n")
        digest, size = named["warc-payload-digest"].removeprefix("sha1:"), None
        if kind == "response":
            size = len(payload)
            if base32(hashlib.sha1(payload).digest()) != digest:
                raise ValueError(f"payload of {named['warc-record-id']} does not have its digest")
        else:
            size = next(int(line.partition(":")[2]) for line in head.decode().split("\r\n") if line.lower().startswith("content-length:"))
        number = lambda name: int(named[name]) if name in named else None
        plain = lambda name: named[name][len("<urn:uuid:") : -1] if name in named else None
        yield (
            path, frame, plain("warc-record-id"), kind, number("x-page-id"), size, digest,
            number("x-refers-to-page-id"), plain("warc-refers-to"), payload if payloads and kind == "response" else None,
        )


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the archives that an index names, with ``RECORDS``'s columns.

    Each frame is read and decompressed by itself, so a large file is as parallel as many small ones. A response is checked
    against its digest; a revisit's size is the one in its HTTP header. ``payload`` is null unless asked for, and for revisits.
    """
    found = stage(frames(index), "frames")
    tasks = -(-(found.agg(F.sum("plain")).first()[0] or 1) // TASK_BYTES)
    return _read_frames(found.repartition(tasks, "path", "frame"), payloads)


def _read_frames(wanted: DataFrame, payloads: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                found = list(_parsed(read_frame(*open_store(f["path"]), f["start"], f["size"], f["plain"]), f["path"], f["frame"], payloads))
                if found:
                    yield _batch(found, RECORDS)

    return wanted.mapInArrow(run, RECORDS)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The payloads of the records in ``wanted`` (record_id): (record_id, page_id, record_type, payload).

    Only the frames that hold them, or the responses they refer to, are read. Unknown identifiers have no row.
    """
    wanted = wanted.select("record_id").distinct()
    mine = stage(index.join(wanted, "record_id", "left_semi"), "wanted")
    places = frames(mine)
    own = _read_frames(places.join(mine.select("path", "frame").distinct(), ["path", "frame"]), True)
    own = stage(own.join(wanted, "record_id", "left_semi"), "fetched")
    ids = own.where("refers_to_id IS NOT NULL").select(F.col("refers_to_id").alias("record_id")).distinct()
    theirs = stage(index.join(ids, "record_id", "left_semi"), "referred")
    spots = frames(theirs).join(theirs.select("path", "frame").distinct(), ["path", "frame"])
    origin = _read_frames(spots, True).join(ids, "record_id", "left_semi").select(F.col("record_id").alias("refers_to_id"), F.col("payload").alias("original"))
    joined = own.join(origin, "refers_to_id", "left")
    return joined.select("record_id", "page_id", "record_type", F.coalesce("payload", "original").alias("payload"))


def archived(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write all pages and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    return read(write(pages, folder, least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def base32_sql(hex_column: str) -> str:
    """DuckDB's expression for the base32 form of 40 hexadecimal digits: five of them are four symbols."""
    part = f"('0x' || substr({hex_column}, 5 * i + 1, 5))::BIGINT"
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({0} >> {1}) & 31)::BIGINT + 1, 1)"
    return "array_to_string(list_transform(range(8), lambda i: " + " || ".join(letter.format(part, s) for s in (15, 10, 5, 0)) + "), '')"
