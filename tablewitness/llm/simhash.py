"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius by block tables.

Terms are pairs of neighbouring words (the word itself in a text of one word), A-Z in lower case, weighted
by how often they occur. Each term's hash votes for or against every bit; the majority is the fingerprint.
Equal texts get equal fingerprints; a text without words gets zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tablewitness.llm.textbytes import Rolling, lower, mix, slices, spaces, utf8, words

BITS = 128
_SPACE = spaces()
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def prints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of the rows as an array of (rows, BITS / 8) bytes."""
    n = len(offsets) - 1
    out = np.zeros((n, BITS // 8), np.uint8)
    low = lower(data)
    starts, ends, row = words(low, offsets, _SPACE)
    if not len(starts):
        return out
    each = Rolling(low).of(starts, ends)
    paired = row[:-1] == row[1:]
    count = np.bincount(row, minlength=n)
    alone = np.flatnonzero(count[row] == 1)
    terms = np.concatenate([mix(each[:-1] * _SECOND + each[1:])[paired], each[alone]])
    of = np.concatenate([row[:-1][paired], row[alone]])
    order = np.argsort(of, kind="stable")
    terms, of = terms[order], of[order]
    firsts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    votes = np.diff(np.r_[firsts, len(of)])[:, None]
    for k, half in enumerate((terms, mix(terms ^ _SECOND))):
        bits = np.unpackbits(half.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
        out[of[firsts], 8 * k : 8 * k + 8] = np.packbits(2 * ones > votes, axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1.0 - np.bitwise_count(a ^ b).sum(1) / BITS


def _hex(found: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in found]


def fingerprints(documents: DataFrame) -> DataFrame:
    """Add ``fingerprint``, BITS bits in hexadecimal, to documents with a text (null: empty)."""
    kept = [c for c in documents.columns if c != "fingerprint"]
    rows = documents.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_hex(prints(data, offsets)))], names=[*kept, "fingerprint"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("fingerprint", StringType())]))


def within(marked: DataFrame, radius: int = 3, extra: int = 2) -> DataFrame:
    """All pairs of different fingerprints at most ``radius`` bits apart: (a, b, distance), a < b.

    The bits are cut into ``radius + extra`` blocks. Two fingerprints that near agree on ``extra`` of
    them, so a table for each choice of ``extra`` blocks, keyed by their bits, holds both under one key.
    Copies are one fingerprint here; a join on ``fingerprint`` gives the documents behind it.
    """
    blocks = radius + extra
    at = [round(k * BITS / blocks) for k in range(blocks + 1)]
    halves = [F.conv(F.substring("fingerprint", 1 + 16 * k, 16), 16, -10).cast("long") for k in range(BITS // 64)]
    distinct = marked.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct().withColumn("bits", F.array(*halves))
    binary = F.concat(*(F.lpad(F.bin(F.col("bits")[k]), 64, "0") for k in range(BITS // 64)))
    keys = [F.concat_ws(":", F.lit(str(t)), *(F.substring(F.col("binary"), at[k] + 1, at[k + 1] - at[k]) for k in chosen)) for t, chosen in enumerate(combinations(range(blocks), extra))]
    tables = distinct.withColumn("binary", binary).select("fingerprint", "bits", F.explode(F.array(*keys)).alias("key"))
    left = tables.select("key", F.col("fingerprint").alias("a"), F.col("bits").alias("x"))
    right = tables.select("key", F.col("fingerprint").alias("b"), F.col("bits").alias("y"))
    distance = sum((F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(BITS // 64)), F.lit(0))
    return left.join(right, "key").where(F.col("a") < F.col("b")).select("a", "b", distance.alias("distance")).where(F.col("distance") <= radius).distinct()


def _bucket(bounds: list[float]) -> Column:
    """How many bounds the id has reached; a null id comes first."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))), F.lit(0))


def edited_likeness(documents: DataFrame) -> DataFrame:
    """Each document next to an edited text and to the document after it, in the order of doc_id.

    The edited text has the last half of its code points replaced by as many first ones of the next
    document (or all); after the last document comes the first. Equal ids are ordered by a hash of the
    text, null ids come first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Documents are shuffled once, into ranges of doc_id; the first of each range is sent to the range
    before it as well. Only these first ids, one for each range, pass the driver.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = documents.select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    docs = docs.withColumn("bucket", _bucket(sorted(set(found))))
    firsts = docs.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("f")).select("bucket", "f.doc_id", "f.tie").collect()
    firsts.sort(key=lambda r: r["bucket"])
    before = [(firsts[k - 1]["bucket"], r["doc_id"], r["tie"]) for k, r in enumerate(firsts)]  # the last range is before the first
    guests = spark.createDataFrame(before, "to int, id long, first long")
    heads = docs.join(F.broadcast(guests), docs["doc_id"].eqNullSafe(guests["id"]) & (docs["tie"] == guests["first"])).select("doc_id", "text", "tie", F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    rows = docs.withColumn("guest", F.lit(0)).select("doc_id", "text", "tie", "bucket", "guest").unionByName(heads)
    rows = rows.repartition(ranges, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "tie").select("doc_id", "text", "bucket", "guest")
    return rows.mapInArrow(_compare, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.RecordBatch | None = None
    for batch, _, _ in slices(batches):
        rows = batch if held is None else pa.concat_batches([held, batch])
        held = rows.slice(rows.num_rows - 1)
        texts = rows.column("text").to_pylist()
        bucket, guest = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "guest"))
        # A guest only serves the row before it; there may be equal ones.
        mine = np.flatnonzero((bucket[:-1] == bucket[1:]) & (guest[:-1] == 0))
        if not len(mine):
            continue
        edited = []
        for i in mine.tolist():
            half = len(texts[i]) // 2
            edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
        own = prints(*utf8(rows.column("text")))
        other = prints(*utf8(pa.array(edited, pa.large_string())))
        yield pa.RecordBatch.from_pydict({
            "doc_id": rows.column("doc_id").take(pa.array(mine)),
            "n_chars": pa.array([len(texts[i]) for i in mine.tolist()], pa.int64()),
            "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            "fingerprint": _hex(own[mine]),
            "edited_fingerprint": _hex(other),
            "near_edited": likeness(own[mine], other),
            "near_next": likeness(own[mine], own[mine + 1]),
        })
