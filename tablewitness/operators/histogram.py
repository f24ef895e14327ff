"""Value histograms and what a sorted histogram tells: quantiles, uniformity, grids, entropy.

A table is read once into ``(by, column, value, cnt)``. Counting combines before the shuffle, so
a value that fills a third of all rows is one small record per task. The sorted form adds the
cumulative count ``cum`` with the two-level sums of ``ordering``: no window sees a whole column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewitness.functions.scalars import EPS, entropy_term
from tablewitness.operators.columns import long_numbers, long_texts
from tablewitness.operators.ordering import range_sorted


def value_histogram(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``(by, column, value, cnt)`` of the present numeric cells."""
    return long_numbers(df, by, columns).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("cnt"))


def text_histogram(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``(by, column, text, cnt)`` of the present cells of any type."""
    return long_texts(df, by, columns).groupBy(*by, "column", "text").agg(F.count(F.lit(1)).alias("cnt"))


#: Rows of a column that one bucket of a sorted histogram stands for, and most buckets of one column. Buckets are far smaller
#: than ``TASK_CELLS``, because a hash deals them to tasks, and few large ones would fall unevenly.
BUCKET_ROWS = 1 << 15
MOST_BUCKETS = 4096
SKETCH_ROWS = 256


#: Cells of a sorted histogram that one task counts and sorts, about 350 bytes each.
TASK_CELLS = 1 << 18


def bucket_bounds(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], rows: int, bucket_rows: int = BUCKET_ROWS
) -> dict[tuple, list[list[float]]]:
    """Approximate quantiles of the columns of each group with more than ``bucket_rows`` rows, from mergeable sketches
    of about ``SKETCH_ROWS`` rows a bucket.

    They only cut the work, results do not depend on them. Groups in this list hold eight bytes for each ``bucket_rows`` cells,
    all others need none; without a large group there is no pass over the table.
    """
    if rows <= bucket_rows:
        return {}
    most = min(MOST_BUCKETS, -(-rows // bucket_rows))
    cuts = F.array(*(F.lit(k / most) for k in range(1, most)))
    sketch = [F.percentile_approx(F.col(c).cast("double"), cuts, F.lit(max(100, 4 * most))).alias(f"_q{i}") for i, c in enumerate(columns)]
    share = min(1.0, SKETCH_ROWS / bucket_rows)
    large = df.where(F.rand(7) < share).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *sketch).where(F.col("_n") > share * bucket_rows)
    out = {}
    for r in large.collect():
        keep = min(most, int(r["_n"] / share / bucket_rows) + 1)
        marks = [k for k in range(1, most) if k * keep // most != (k - 1) * keep // most]
        out[tuple(r[b] for b in by)] = [sorted({r[f"_q{i}"][k - 1] for k in marks} if r[f"_q{i}"] else set()) for i in range(len(columns))]
    return out


#: Rows whose equal cells are counted together before the shuffle.
COUNT_ROWS = 1 << 16


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _count_cells(columns: Sequence[str], by: Sequence[str], bounds: dict[tuple, list[list[float]]]):
    """Counts of equal cells of a batch, the combination before the shuffle: a row for each bucket, with its values ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, COUNT_ROWS):
            keys = [batch.column(b) for b in by]
            codes = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                coded = k.dictionary_encode()
                codes = codes * (len(coded.dictionary) + 1) + pc.fill_null(coded.indices, -1).to_numpy() + 1
            _, first, code = np.unique(codes, return_index=True, return_inverse=True)
            parts = []
            for i, c in enumerate(columns):
                values = batch.column(c).to_numpy(zero_copy_only=False)  # null is NaN
                there = np.flatnonzero(~np.isnan(values))
                order = there[np.lexsort((values[there], code[there]))]
                v, g = values[order], code[order]
                new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (g[1:] != g[:-1])]) if len(v) else order
                cnt = np.diff(np.r_[new, len(v)])
                v, g = v[new], g[new]
                bucket = np.zeros(len(v), np.int32)
                begins = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if bounds and len(g) else ()
                for a, b in zip(begins, [*begins[1:], len(g)]):
                    cuts = bounds.get(tuple(x[int(first[g[a]])].as_py() for x in keys))
                    if cuts and cuts[i]:
                        bucket[a:b] = np.searchsorted(cuts[i], v[a:b])
                parts.append((first[g], np.full(len(v), i), bucket, v, cnt))
            row, which, bucket, v, cnt = (np.concatenate(x) for x in zip(*parts))
            fresh = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (which[1:] != which[:-1]) | (bucket[1:] != bucket[:-1])][: len(row)])
            names = pa.DictionaryArray.from_arrays(pa.array(which[fresh].astype(np.int32)), pa.array(list(columns))).cast(pa.string())
            ends = pa.array(np.r_[fresh, len(row)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(v + 0.0), pa.array(cnt, pa.int64()))]
            cells = [*(k.take(pa.array(row[fresh])) for k in keys), names, pa.array(bucket[fresh], pa.int32()), *lists]
            yield pa.RecordBatch.from_arrays(cells, names=[*by, "column", "_bucket", "_values", "_cnts"])

    return run


def column_histogram(df: DataFrame, columns: Sequence[str], by: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The sorted histogram of ``columns``, as ``sorted_histogram`` gives it, with one shuffle of cells.

    Cells are counted in batches and dealt by (group, column, bucket), where a bucket is a range of values. A bucket of a batch travels
    as one row of two lists, so that a task holds little more than 16 bytes a cell until its shuffle is written. Counting, sorting and
    the running sums inside a bucket need no other shuffle; the totals of the buckets, a row each, give the rest.
    """
    wide = df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns))
    # Nothing is null but the group, and both uses of the rows below read both lists: they have one plan and share its shuffle.
    own = T.StructType(
        [
            T.StructField("column", T.StringType(), False), T.StructField("_bucket", T.IntegerType(), False),
            T.StructField("_values", T.ArrayType(T.DoubleType(), False), False), T.StructField("_cnts", T.ArrayType(T.LongType(), False), False),
        ]
    )
    schema = T.StructType([*(df.schema[b] for b in by), *own.fields])
    rows = df.count()
    counted = wide.mapInArrow(_count_cells(columns, by, bucket_bounds(wide, columns, by, rows, bucket_rows)), schema)
    group = [*by, "column"]
    # Cells take few bytes in a shuffle and many in a sort: tasks are as many as the cells ask for, not as their bytes do.
    tasks = -(-rows * len(columns) // TASK_CELLS)
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartition(max(tasks, few), *group, "_bucket") if tasks > 1 else counted.repartition(*group, "_bucket")
    cells = dealt.select(*group, "_bucket", F.inline(F.arrays_zip(F.col("_values").alias("value"), F.col("_cnts").alias("cnt"))))
    spans = dealt.groupBy(*group, "_bucket").agg(
        F.sum(F.aggregate("_cnts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("_total"),
        F.min(F.element_at("_values", 1)).alias("_lo"), F.max(F.element_at("_values", -1)).alias("_hi"),
    )
    return _with_totals(cells.groupBy(*group, "_bucket", "value").agg(F.sum("cnt").alias("cnt")), spans, by, "_bucket")


def sorted_histogram(hist: DataFrame, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Add ``cum`` (count up to and with the value), ``prev`` (next smaller value) and the totals
    ``n``, ``lo``, ``hi`` of the column."""
    placed = range_sorted(hist, [*by, "column", "value"], "histogram").drop("_lid")
    spans = placed.groupBy(*by, "column", "_pid").agg(
        F.sum("cnt").alias("_total"), F.min("value").alias("_lo"), F.max("value").alias("_hi")
    )
    return _with_totals(placed, spans, by, "_pid", keep)


def _with_totals(placed: DataFrame, spans: DataFrame, by: Sequence[str], part: str, keep: Sequence[str] = ()) -> DataFrame:
    """Running sums of counts in parts of ascending values, then over the parts, whose totals and ends are ``spans``."""
    group = [*by, "column"]
    inside = Window.partitionBy(*group, part).orderBy("value")
    local = placed.withColumn("_cum", F.sum("cnt").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn("_prev", F.lag("value").over(inside))

    whole = Window.partitionBy(*group)
    parts = whole.orderBy(part)
    spans = spans.select(
        *group,
        part,
        F.coalesce(F.sum("_total").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_hi").over(parts).alias("_last"),
        F.sum("_total").over(whole).alias("n"),
        F.min("_lo").over(whole).alias("lo"),
        F.max("_hi").over(whole).alias("hi"),
    )
    joined = local.join(spans, [*group, part])
    return joined.select(
        *group,
        "value",
        "cnt",
        (F.col("_cum") + F.col("_before")).alias("cum"),
        F.coalesce("_prev", "_last").alias("prev"),
        "n",
        "lo",
        "hi",
        *keep,
    )


def quantile_of(q: float, name: str) -> list[Column]:
    """Aggregates that pick the two ranks around quantile ``q`` of a sorted histogram."""
    low = F.floor((F.col("n") - 1) * F.lit(q))
    high = F.least(low + 1, F.col("n") - 1)
    start = F.col("cum") - F.col("cnt")
    return [
        F.max(F.when((start <= low) & (F.col("cum") > low), F.col("value"))).alias(f"_{name}_a"),
        F.max(F.when((start <= high) & (F.col("cum") > high), F.col("value"))).alias(f"_{name}_b"),
    ]


def quantile_value(q: float, name: str, n: str = "n") -> Column:
    """Linear interpolation between the two ranks."""
    place = (F.col(n) - 1) * F.lit(q)
    part = place - F.floor(place)
    a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
    return (a + (b - a) * part).alias(name)


def exact_quantiles(sorted_hist: DataFrame, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per ``(by, column)``, named by the keys of ``probs``."""
    picks = [c for name, q in probs.items() for c in quantile_of(q, name)]
    agg = sorted_hist.groupBy(*by, "column").agg(F.max("n").alias("n"), *picks)
    return agg.select(*by, "column", "n", *[quantile_value(q, name) for name, q in probs.items()])


def uniform_distance() -> Column:
    """Kolmogorov-Smirnov distance to the uniform distribution on [lo, hi], as an aggregate."""
    u = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    above = F.col("cum") / F.col("n") - u
    below = u - (F.col("cum") - F.col("cnt")) / F.col("n")
    usable = (F.col("n") > 3) & (F.col("hi") > F.col("lo"))
    return F.max(F.when(usable, F.greatest(above, below)))


def column_shapes(sorted_hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """All per-column measures of a sorted histogram in one pass.

    ``uniform_ks`` is null for constant or tiny columns; ``grid_density`` is the variation of the
    gaps between neighbouring values, 0 below ten values; ``entropy`` is in bits.
    """
    gap = F.col("value") - F.col("prev")
    agg = sorted_hist.groupBy(*by, "column").agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.max("lo").alias("lo"),
        F.max("hi").alias("hi"),
        uniform_distance().alias("uniform_ks"),
        (F.stddev_pop(gap) / (F.avg(gap) + F.lit(1e-9))).alias("_grid"),
        F.sum(entropy_term(F.col("cnt") / F.col("n"), 1e-9)).alias("entropy"),
        F.sum(F.when(F.col("value") == F.floor("value"), F.col("cnt")).otherwise(0)).alias("n_whole"),
        *quantile_of(0.25, "q25"),
        *quantile_of(0.5, "median"),
        *quantile_of(0.75, "q75"),
    )
    iqr = F.col("q75") - F.col("q25")
    return (
        agg.select(
            "*",
            F.when(F.col("n_distinct") < 10, F.lit(0.0)).otherwise(F.col("_grid")).alias("grid_density"),
            quantile_value(0.25, "q25"),
            quantile_value(0.5, "median"),
            quantile_value(0.75, "q75"),
        )
        .withColumn("iqr_range_ratio", F.when(F.col("n") > 1, iqr / (F.col("hi") - F.col("lo") + F.lit(EPS))))
        .drop(*[f"_{q}_{s}" for q in ("q25", "median", "q75") for s in "ab"], "_grid")
    )


def text_shapes(hist: DataFrame, by: Sequence[str], single: bool) -> DataFrame:
    """Distinct count and entropy per column from an unsorted histogram."""
    group = [*by, "column"]
    # How many texts occur how often says all, and is far shorter than the histogram.
    times = hist.groupBy(*group, "cnt").agg(F.count(F.lit(1)).alias("_texts"))
    totals = times.groupBy(*group).agg(F.sum(F.col("cnt") * F.col("_texts")).alias("n"))
    return (
        times.join(F.broadcast(totals) if single else totals, group)
        .groupBy(*group)
        .agg(
            F.max("n").alias("n"),
            F.sum("_texts").alias("n_distinct"),
            F.sum(F.col("_texts") * entropy_term(F.col("cnt") / F.col("n"), 1e-9)).alias("entropy"),
        )
    )
