"""Row order without a single-task window: global index and overlapping blocks.

Spark tables have no row order, so every ordered operator takes ``order_cols``, which must be a
total order within a dataset. Rows are range partitioned and sorted, numbered inside their
partition, and shifted by the size of the partitions before. Neighbour access then works on
blocks of the index that also hold the first rows of the following block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewitness.operators.columns import BROADCAST_GROUPS, attach, long_numbers
from tablewitness.session import stage

BLOCK_ROWS = 65536
SHARED_HALO = 24


def range_sorted(df: DataFrame, keys: Sequence[str], label: str, drop: Sequence[str] = ()) -> DataFrame:
    """``df`` written in global order of ``keys``, with its partition ``_pid`` and place ``_lid``.

    Columns in ``drop`` only give the order and are not written.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stage(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_lid", place).drop(*drop), label)


def ordered_index(
    df: DataFrame, order_cols: Sequence[str], by: Sequence[str] = (), name: str = "row_idx", extra: Sequence[str] = (),
    drop: Sequence[str] = (),
) -> DataFrame:
    """Add the 0-based position of each row within its group, in ``order_cols`` order."""
    if not by:
        df = df.withColumn("_all", F.lit(0))
        return ordered_index(df, order_cols, ["_all"], name, extra, drop).drop("_all")
    placed = range_sorted(df, [*by, *order_cols], "index", drop)
    # One row per group and partition it touches: a group of any size adds at most one row per partition.
    spans = placed.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_lid").alias("_first"))
    w = Window.partitionBy(*by).orderBy("_pid")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.sum("_n").over(Window.partitionBy(*by))
    spans = stage(spans.select(*by, "_pid", (before - F.col("_first")).alias("_shift"), size.alias("n")), "spans")
    # Few spans are broadcast; many meet the rows in tasks, and neither side passes the driver, however small its files are.
    few = spans.count() <= BROADCAST_GROUPS
    out = placed.join(F.broadcast(spans) if few else spans.hint("merge"), [*by, "_pid"]).withColumn(name, F.col("_lid") + F.col("_shift"))
    return out.drop("_pid", "_lid", "_shift", *([] if "n" in extra else ["n"]))


def hash_rank(df: DataFrame, by: Sequence[str], hashed: str, ties: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Add the 0-based position within ``by`` in the order of ``hashed``, a hexadecimal hash.

    A hash spreads evenly, so its leading bits cut every group into known, equal buckets: rows are
    numbered per bucket and shifted by the counts of the buckets before, without a range sort.
    """
    bits = min(24, max(0, math.ceil(math.log2(max(df.count(), 1) / BLOCK_ROWS))))
    lead = F.conv(F.substring(hashed, 1, 6), 16, 10).cast("long")
    # As bytes, in the order of the text, a hash takes half the room in the shuffle.
    cut = df.withColumn("_b", F.shiftright(lead, 24 - bits)).withColumn(hashed, F.unhex(hashed))
    counts = cut.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(hashed, *ties))
    numbered = cut.withColumn("_r", place).drop(hashed)
    return numbered.join(counts, [*by, "_b"]).withColumn(name, F.col("_r") - 1 + F.col("_before")).drop("_b", "_r", "_before")


def series(df: DataFrame, columns: Sequence[str], order_cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Every numeric column as a compact ordered series ``(by, column, row_idx, n, value)``.

    Missing cells are dropped first, so positions close up.
    """
    keys = [f"_k{i}" for i in range(len(order_cols))]
    long = long_numbers(df, by, columns, keep=order_cols)
    return ordered_index(long, keys, [*by, "column"], extra=("n",), drop=keys)


def overlapping(df: DataFrame, halo: int | Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repeat the first ``halo`` rows of each index block at the end of the block before.

    Adds ``_block`` (where the row sits) and ``_own`` (false for the repeated rows).
    """
    if isinstance(halo, int) and halo > block_rows:
        raise ValueError("a block must be at least as long as the overlap")
    home = F.floor(F.col("row_idx") / F.lit(block_rows))
    repeated = (F.col("row_idx") % F.lit(block_rows) < halo) & (home > 0)
    places = F.when(repeated, F.array(home, home - 1)).otherwise(F.array(home))
    return df.withColumn("_block", F.explode(places)).withColumn("_own", F.col("_block") == home)


def ahead(
    df: DataFrame, keys: Sequence[str], length: int, block_rows: int = BLOCK_ROWS, leads: Sequence[int] = ()
) -> DataFrame:
    """Give each row its next values: ``lead_k`` for each of ``leads``, or all ``length`` of them as ``ahead``.

    ``df`` is a series, or blocks from ``shared_blocks`` with an overlap of at least ``length``.
    """
    blocks = df if "_block" in df.columns else overlapping(df, length, block_rows)
    w = Window.partitionBy(*keys, "_block").orderBy("row_idx")
    if leads:
        cols = [F.lead("value", k).over(w).alias(f"lead_{k}") for k in leads]
    else:
        cols = [F.collect_list("value").over(w.rowsBetween(1, length)).alias("ahead")]
    return blocks.select("*", *cols).where("_own").drop("_block", "_own")


def with_spread(s: DataFrame, keys: Sequence[str], single: bool) -> DataFrame:
    """Next to each value the ``mean``, ``std`` and ``std_pop`` of its series."""
    if "std_pop" in s.columns:
        return s
    stats = s.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.stddev_pop("value").alias("std_pop")
    )
    return attach(s, stats, keys, single)


def shared_blocks(s: DataFrame, keys: Sequence[str], single: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks for all ordered measures: shuffled, sorted and kept once, read by each of them.

    The cached rows keep their partitioning and order, so the measures need no shuffle of their
    own. A lost part is rebuilt from the written series. The caller unpersists it.
    """
    blocks = overlapping(with_spread(s, keys, single), SHARED_HALO, max(block_rows, SHARED_HALO))
    placed = blocks.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "row_idx")
    return placed.persist(StorageLevel.MEMORY_AND_DISK)


def own_rows(s: DataFrame) -> DataFrame:
    """The rows of a series without the repeated ones."""
    return s.where("_own").drop("_block", "_own") if "_block" in s.columns else s
