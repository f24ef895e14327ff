"""Removal of repeated substrings by content-defined chunking with a gear rolling hash.

A cut stands behind every byte at which the gear hash of the last 32 bytes is small, unless there was
another such byte shortly before; stretches without one are cut every ``longest`` bytes. Cuts depend on
the bytes just before them alone, so an insertion moves no other cut and copies of a passage
fall into the same chunks wherever they stand. Chunks are compared by a digest of 128 bits; the first
place, by doc_id and position, stays, and runs of repeated chunks of ``least`` bytes or more go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewitness.llm.textbytes import Rolling, mix, slices
from tablewitness.session import stage

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)
_WINDOW = 32


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2 h + gear[byte] modulo 2**32 at each byte: only the last 32 bytes count."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):  # from k to 2 k bytes
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h = longer
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, one_in: int = 14, shortest: int = 16, longest: int = 256) -> np.ndarray:
    """Ends of the chunks of all rows, in order; every row's end is one."""
    marks = np.flatnonzero(gear(data) < np.uint32((1 << 32) // one_in)) + 1 if len(data) else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, marks - 1, "right") - 1
    alone = np.ones(len(marks), bool)
    alone[1:] = (np.diff(marks) >= shortest) | (row[1:] != row[:-1])
    marks = marks[alone & (marks - offsets[row] >= _WINDOW)]
    ends = np.union1d(marks, offsets[1:][np.diff(offsets) > 0])
    starts = np.r_[offsets[:1], ends[:-1]]
    more = (ends - starts - 1) // longest
    if more.any():
        which = np.repeat(np.arange(len(ends)), more)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.union1d(ends, starts[which] + nth * longest)
    return ends


def chunks(documents: DataFrame, **sizes: int) -> DataFrame:
    """All chunks: (doc_id, text_key, start, length, high, low), in bytes; null and empty texts have none.

    ``text_key`` is a hash of the text: rows with equal id and text are one place, different texts under one id, or
    under no id, are not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            ends = cuts(data, offsets, **sizes)
            if not len(ends):
                continue
            starts = np.r_[0, ends[:-1]]
            row = np.searchsorted(offsets, starts, "right") - 1
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(row)), "text_key": batch.column("text_key").take(pa.array(row)),
                "start": pa.array((starts - offsets[row]).astype(np.int32)),
                "length": pa.array((ends - starts).astype(np.int32)),
                "high": pa.array(Rolling(data, 1).of(starts, ends).view(np.int64)),
                "low": pa.array(Rolling(data, 2).of(starts, ends).view(np.int64)),
            })

    return _keyed(documents).mapInArrow(run, "doc_id bigint, text_key bigint, start int, length int, high bigint, low bigint")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def repeated(documents: DataFrame, least: int = 80, **sizes: int) -> DataFrame:
    """Spans to remove: (doc_id, text_key, start, length, chunks, first_doc_id, first_start), in bytes.

    A span is a maximal run of chunks that stand at an earlier place too; ``first_*`` is the first
    place of its first chunk. Rows with equal id and text are one place; null ids come first, texts of one id by ``text_key``.
    A chunk that fills a third of the table is one partial result for each task in the aggregation, and
    one side of an inner join that adaptive execution may split afterwards.
    """
    parts = stage(chunks(documents, **sizes), "chunks")  # cut once, read twice
    where = ["doc_id", "text_key", "start"]
    place = F.struct(*where)  # a null id sorts first
    # Copies of one place count too; the comparison with the first place drops them.
    firsts = parts.groupBy("high", "low").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = parts.join(firsts, ["high", "low"]).where(~place.eqNullSafe(F.col("first")))
    later = later.select(*where, "length", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")).dropDuplicates(where)
    order = Window.partitionBy("doc_id", "text_key").orderBy("start")
    later = later.withColumn("new", (F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("length")).over(order), F.lit(-1))).cast("int"))
    later = later.withColumn("run", F.sum("new").over(order))
    runs = later.groupBy("doc_id", "text_key", "run").agg(
        F.min(F.struct("start", "first_doc_id", "first_start")).alias("f"), F.sum("length").alias("length"), F.count("*").alias("chunks")
    )
    return runs.where(F.col("length") >= least).select(
        "doc_id", "text_key", F.col("f.start").cast("long").alias("start"), "length", "chunks", F.col("f.first_doc_id").alias("first_doc_id"), F.col("f.first_start").cast("long").alias("first_start")
    )


def without_repeats(documents: DataFrame, least: int = 80, **sizes: int) -> DataFrame:
    """Documents without the repeated spans; code points that a span cuts in two go as a whole."""
    spans = repeated(documents, least, **sizes).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("_spans"))
    columns = documents.columns
    at, id_at = columns.index("text"), columns.index("doc_id")
    names = [str(k) for k in range(len(columns))]  # so that no name clashes
    plain = documents.toDF(*names)
    same = F.col(f"`{id_at}`").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"`{at}`")) == F.col("_key"))
    joined = plain.join(spans, same, "left").drop("_id", "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(at).to_pylist(), batch.column("_spans").to_pylist()):
                if found and text:
                    raw, kept, last = text.encode(), [], 0
                    for span in found:
                        kept.append(raw[last : span["start"]])
                        last = span["start"] + span["length"]
                    text = b"".join([*kept, raw[last:]]).decode(errors="ignore")
                texts.append(text)
            arrays = [batch.column(k) for k in range(len(columns))]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, plain.schema).toDF(*columns)
