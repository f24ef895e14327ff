"""Ordered series with one row a block: an array of its values and of the first values of the next block.

Rows are sorted once for all columns and travel as arrays, so that a cell takes eight bytes. What looks a few rows ahead is numpy on
one block, and each block adds a short row of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablewitness.operators.columns import beside
from tablewitness.operators.histogram import COUNT_ROWS, _joined
from tablewitness.operators.ordering import BLOCK_ROWS, overlapping, own_rows, with_spread
from tablewitness.session import stage

#: Values of the next block that a block holds too.
PACK_HALO = 64
_FACTS = ("n", "mean", "std", "std_pop")


def block_length(block_rows: int) -> int:
    return max(block_rows, PACK_HALO)


def _chunks(columns: Sequence[str], by: Sequence[str]):
    """Present values of each column and dataset of sorted batches, in order, with their moments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(_joined(batches, COUNT_ROWS)):
            keys = [batch.column(b) for b in by]
            codes = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                coded = k.dictionary_encode()
                codes = codes * (len(coded.dictionary) + 1) + pc.fill_null(coded.indices, -1).to_numpy() + 1
            begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
            cells = [batch.column(f"_v{i}").to_numpy(zero_copy_only=False) for i in range(len(columns))]  # null is NaN
            found = []
            for a, b in zip(begins, [*begins[1:], len(codes)]):
                for i, x in enumerate(cells):
                    v = x[a:b]
                    v = v[~np.isnan(v)]
                    if len(v):
                        lo, hi = v.min(), v.max()
                        mean = lo if lo == hi else v.mean()
                        found.append((a, i, v, lo, hi, mean, 0.0 if lo == hi else float(((v - mean) ** 2).sum())))
            if not found:
                continue
            row, which, values, lo, hi, mean, m2 = zip(*found)
            sizes = np.array([len(v) for v in values])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(values)))
            first = pa.array(np.array(row))
            names = pa.array([columns[i] for i in which])
            numbers = [pa.array(np.array(x, float)) for x in (lo, hi, mean, m2)]
            place = [batch.column("_pid").take(first), pa.array(np.full(len(row), number, np.int64))]
            out = [*(k.take(first) for k in keys), names, *place, lists, pa.array(sizes, pa.int64()), *numbers]
            yield pa.RecordBatch.from_arrays(out, names=[*by, "column", "_pid", "_chunk", "_values", "_size", "_lo", "_hi", "_mu", "_m2"])

    return run


def packed_series(df: DataFrame, columns: Sequence[str], order_cols: Sequence[str], by: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The series of the numeric ``columns`` in blocks: ``(by, column, _block, _start, _own, n, mean, std, std_pop, _values)``.

    Missing cells are left out, so positions close up. Rows are sorted once, with all their columns.
    """
    keys, block = [*by, "column"], block_length(block_rows)
    order = [f"_k{i}" for i in range(len(order_cols))]
    cells = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]
    wide = df.select(*by, *[F.col(c).alias(k) for c, k in zip(order_cols, order)], *cells)
    ranged = wide.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_pid", F.spark_partition_id()).drop(*order)
    fields = "column string, _pid int, _chunk long, _values array<double>, _size long, _lo double, _hi double, _mu double, _m2 double"
    schema = T.StructType([*(df.schema[b] for b in by), *T._parse_datatype_string(fields).fields])
    chunks = stage(ranged.mapInArrow(_chunks(list(columns), by), schema), "chunks")

    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_pid", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    lo, hi, n = F.min("_lo").over(whole), F.max("_hi").over(whole), F.sum("_size").over(whole)
    mean = F.when(lo == hi, lo).otherwise(F.sum(F.col("_size") * F.col("_mu")).over(whole) / n)
    spans = chunks.drop("_values").select(
        *keys, "_pid", "_chunk", "_size", "_mu", "_m2", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_at"),
        n.alias("n"), mean.alias("mean"), (lo == hi).alias("_flat"),
    )
    far = F.col("_mu") - F.col("mean")
    square = F.when(F.col("_flat"), F.lit(0.0)).otherwise(F.sum(F.col("_m2") + F.col("_size") * far * far).over(whole))
    spread = [F.when(F.col("n") > 1, F.sqrt(square / (F.col("n") - 1))).alias("std"), F.sqrt(square / F.col("n")).alias("std_pop")]
    spans = stage(spans.select(*keys, "_pid", "_chunk", "_at", "n", "mean", *spread), "spans")

    placed = chunks.select(*keys, "_pid", "_chunk", "_values", "_size").join(spans, [*keys, "_pid", "_chunk"])
    home, end = F.floor(F.col("_at") / block), F.col("_at") + F.col("_size")
    before = ((F.col("_at") % block < PACK_HALO) & (home > 0)).cast("long")
    cut = placed.withColumn("_block", F.explode(F.sequence(home - before, F.floor((end - 1) / block))))
    low = F.greatest(F.col("_at"), F.col("_block") * block)
    high = F.least(end, (F.col("_block") + 1) * block + PACK_HALO)
    part = F.slice("_values", (low - F.col("_at") + 1).cast("int"), (high - low).cast("int"))
    return _gathered(cut.select(*keys, "_block", *_FACTS, low.alias("_at"), part.alias("_part")), keys, block)


def _gathered(parts: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """Blocks put together from their parts ``_part``, which begin at ``_at``."""
    every = F.array_sort(F.collect_list(F.struct("_at", "_part")))
    rows = parts.groupBy(*keys, "_block").agg(*[F.max(c).alias(c) for c in _FACTS], F.flatten(F.transform(every, lambda p: p["_part"])).alias("_values"))
    return _bounded(rows, keys, block)


def _bounded(rows: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    start = F.col("_block") * block
    return rows.select(*keys, "_block", start.alias("_start"), F.least(F.lit(block), F.col("n") - start).cast("int").alias("_own"), *_FACTS, "_values")


def packed(s: DataFrame, keys: Sequence[str], single: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A series of rows in blocks, as ``packed_series`` gives them; blocks stay as they are."""
    if "_values" in s.columns:
        return s
    block = block_length(block_rows)
    rows = overlapping(with_spread(own_rows(s), keys, single), PACK_HALO, block)
    heads = [*keys, "_block", *_FACTS]
    rows = rows.select(*keys, "_block", *[F.col(c).cast("long" if c == "n" else "double").alias(c) for c in _FACTS], "row_idx", "value")

    def gather(group: pa.Table) -> pa.Table:
        values = group["value"].to_numpy()[np.argsort(group["row_idx"].to_numpy(), kind="stable")]
        lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
        return pa.table([*(group[c].slice(0, 1) for c in heads), lists], names=[*heads, "_values"])

    schema = T.StructType([*(rows.schema[c] for c in heads), *T._parse_datatype_string("_values array<double>").fields])
    return _bounded(rows.groupBy(*keys, "_block").applyInArrow(gather, schema), keys, block)


def unpacked(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a value again: ``(keys, n, mean, std, std_pop, row_idx, value)``."""
    own = F.slice("_values", F.lit(1), F.col("_own"))
    rows = blocks.select(*keys, *_FACTS, "_start", F.posexplode(own).alias("_i", "value"))
    return rows.select(*keys, *_FACTS, (F.col("_start") + F.col("_i")).alias("row_idx"), "value")


def widened(blocks: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Blocks with as many values of the next block as their column ``lag`` says, at most a block."""
    mine = F.struct(F.col("_block"), F.col("_start").alias("_at"), F.slice("_values", F.lit(1), F.col("_own")).alias("_part"))
    begin = F.slice("_values", F.lit(1), F.least(F.col("lag"), F.col("_own")).cast("int"))
    halo = F.struct((F.col("_block") - 1).alias("_block"), F.col("_start").alias("_at"), begin.alias("_part"))
    parts = blocks.select(*keys, *_FACTS, "lag", F.explode(F.when(F.col("_block") > 0, F.array(mine, halo)).otherwise(F.array(mine))).alias("_p"))
    lags = blocks.select(*keys, "lag").distinct()
    wide = _gathered(parts.select(*keys, *_FACTS, "_p.*"), keys, block_length(block_rows))
    return beside(wide, lags, None, list(keys))


def per_block(blocks: DataFrame, keys: Sequence[str], func: Callable[[np.ndarray, dict], tuple], fields: str) -> DataFrame:
    """``(keys, _block, fields)``: ``func(values, facts)`` of each block, where ``facts`` are its other columns."""
    kinds = T._parse_datatype_string(fields)
    schema = T.StructType([*(blocks.schema[k] for k in [*keys, "_block"]), *kinds.fields])
    heads = [*keys, "_block"]
    facts = [c for c in blocks.columns if c not in (*heads, "_values")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("_values")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            known = batch.select(facts).to_pylist()
            with np.errstate(all="ignore"):
                rows = [func(flat[a:b], f) for a, b, f in zip(np.r_[0, ends], ends, known)]
            cells = [pa.array(list(x), to_arrow_type(f.dataType)) for x, f in zip(zip(*rows), kinds.fields)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in heads), *cells], names=[*heads, *kinds.names])

    return blocks.mapInArrow(run, schema)


#: Leading bits of a value by which the selection of a median counts, in turn, and rows of a group that end it early.
_BITS = (20, 36, 52, 64)
LAST_ROWS = 1 << 16


def _leads(bits: int):
    """Counts of the leading bits of values that begin as one of ``_near`` does; values are zero or more."""

    def run(values: np.ndarray, facts: dict) -> tuple:
        code = (values + 0.0).view(np.int64)
        wanted = facts.get("_near")
        if wanted is not None:
            code = code[np.isin(code >> (64 - facts["_bits"]), wanted)]
        lead, count = np.unique(code >> (64 - bits), return_counts=True)
        return lead, count

    return run


@F.pandas_udf(T.DoubleType())
def _double(bits: pd.Series) -> pd.Series:
    """The doubles whose 64 bits longs hold."""
    return pd.Series(bits.to_numpy(dtype=np.int64).view(np.float64))


def medians(arrays: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``(keys, name)``: exact medians of the values, zero or more, that ``(keys, _block, _values)`` hold.

    The two middle values are found by counting leading bits, then the next ones of those that begin alike. Cells stay where they are.
    """
    sizes = arrays.groupBy(*keys).agg(F.sum(F.size("_values")).cast("long").alias("_all")).where("_all > 0")
    low = F.floor((F.col("_all") - 1) * F.lit(0.5))
    middle = [F.struct(F.lit(i).alias("_side"), r.alias("_rank")) for i, r in enumerate((low, F.least(low + 1, F.col("_all") - 1)))]
    ranks = sizes.select(*keys, F.explode(F.array(*middle)).alias("_r"))
    state, read, bits, known = stage(ranks.select(*keys, "_r.*"), "ranks"), arrays, _BITS[0], None
    while True:
        counts = per_block(read, keys, _leads(bits), "_lead array<long>, _cnt array<long>")
        cells = counts.select(*keys, F.inline(F.arrays_zip("_lead", "_cnt"))).groupBy(*keys, "_lead").agg(F.sum("_cnt").alias("_cnt"))
        # Ranks count within the values that begin as the searched one does.
        group = F.lit(0).cast("long") if known is None else F.shiftright("_lead", bits - known)
        cells = cells.withColumn("_group", group)
        upto = F.sum("_cnt").over(Window.partitionBy(*keys, "_group").orderBy("_lead"))
        cells = cells.withColumn("_upto", upto)
        if known is None:
            state = state.withColumn("_group", F.lit(0).cast("long"))
        hit = cells.join(state, [*keys, "_group"]).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_cnt") <= F.col("_rank")))
        found = hit.select(*keys, "_side", F.col("_lead").alias("_group"), (F.col("_rank") - F.col("_upto") + F.col("_cnt")).alias("_rank"), "_cnt")
        state = stage(found, "leads")
        if bits == 64:
            break
        most = state.agg(F.max("_cnt")).first()[0] or 0
        known, bits = bits, 64 if most <= LAST_ROWS else _BITS[_BITS.index(bits) + 1]
        near = state.groupBy(*keys).agg(F.collect_set("_group").alias("_near"), F.lit(known).alias("_bits"))
        read = beside(arrays, near, None, list(keys))
        state = state.drop("_cnt")
    both = state.select(*keys, "_side", _double("_group").alias("_x")).groupBy(*keys).agg(
        F.max(F.when(F.col("_side") == 0, F.col("_x"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_x"))).alias("_b")
    )
    place = (F.col("_all") - 1) * F.lit(0.5)
    a, b = F.col("_a"), F.col("_b")
    return both.join(sizes, list(keys)).select(*keys, (a + (b - a) * (place - F.floor(place))).alias(name))
