"""Wide one-pass aggregates: counts, missing cells, moments and the correlation structure."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewitness.functions.scalars import corrected_kurtosis, corrected_skewness, finite_or, not_nan, total
from tablewitness.operators.columns import BROADCAST_GROUPS, attach, long_numbers
from tablewitness.session import stage

def missing_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean missing rate over columns, and the sample variance of the missing share per row."""
    share = total([F.col(c).isNull().cast("double") for c in columns]) / F.lit(float(len(columns)))
    rates = [F.avg(F.col(c).isNull().cast("double")) for c in columns]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        (total(rates) / F.lit(float(len(columns)))).alias("missing_pct"),
        finite_or(F.var_samp(share), 0.0).alias("missing_variance"),
    )


def numeric_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``(by, column, n, lo, hi, mean, std, std_pop, variance, skewness, kurtosis)`` in one scan.

    Skewness and kurtosis carry the small-sample correction and need more than three values. A
    column without any value has no row. The long form keeps the aggregate small enough to
    compile well, however many columns there are.
    """
    flat = long_numbers(df, by, columns).groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.skewness("value").alias("g1"),
        F.kurtosis("value").alias("g2"),
    )
    n, enough = F.col("n"), F.col("n") > 3
    # Like the data-frame statistics this mirrors, a constant column has zero skewness and kurtosis.
    shape = lambda value: F.when(enough & (F.col("lo") == F.col("hi")), F.lit(0.0)).when(enough, not_nan(value))
    return flat.select(
        *by, "column", "n", "lo", "hi", "mean", "std",
        F.when(n > 1, F.col("std") * F.sqrt((n - 1) / n)).otherwise(F.lit(0.0)).alias("std_pop"),
        (F.col("std") * F.col("std")).alias("variance"),
        shape(corrected_skewness(F.col("g1"), n)).alias("skewness"),
        shape(corrected_kurtosis(F.col("g2"), n)).alias("kurtosis"),
    )


#: A task adds up the products of so many pairs of columns before it hands them on.
HELD_PAIRS = 1 << 20
#: Sums over the rows of a pair of columns.
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def held_groups(width: int) -> int:
    """Datasets of ``width`` columns whose products a task holds."""
    return max(1, HELD_PAIRS // max(1, width * (width - 1) // 2))


def pair_products(x: np.ndarray) -> np.ndarray:
    """The ``SUMS`` of all pairs of columns over the rows where both are present."""
    left, right = np.triu_indices(x.shape[1], 1)
    there = (~np.isnan(x)).astype(float)
    x = np.where(there > 0, x, 0.0)
    square = x * x
    full = (there.T @ there, x.T @ there, there.T @ x, square.T @ there, there.T @ square, x.T @ x)
    return np.stack([m[left, right] for m in full])


def pair_rows(held: dict, keys: Sequence[str], width: int):
    """Held sums of datasets, a row for each pair of columns."""
    left, right = np.triu_indices(width, 1)
    for key, sums in held.items():
        for at in range(0, len(left), 1 << 16):
            part = slice(at, at + (1 << 16))
            lead = {k: [v] * len(left[part]) for k, v in zip(keys, key)}
            yield pd.DataFrame({**lead, "_i": left[part], "_j": right[part], **dict(zip(SUMS, sums[:, part]))})


def _pair_sums(depth: int, width: int):
    """Sums over present pairs, by dataset and pair of columns, of all the rows that a task reads.

    Each dataset of a batch is four matrix products. They are held until ``HELD_PAIRS`` pairs of columns are
    reached, so a task's memory is bounded for any number of datasets.
    """
    names = [f"_x{i}" for i in range(width)]
    keys = [f"_g{i}" for i in range(depth)]
    limit = held_groups(width)

    def run(batches):
        held: dict = {}
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            groups = pdf.groupby(keys, dropna=False, sort=False).indices if keys else {(): np.arange(len(x))}
            for key, places in groups.items():
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                sums = pair_products(x[places])
                held[key] = held[key] + sums if key in held else sums
                if len(held) > limit:
                    yield from pair_rows(held, keys, width)
                    held = {}
        yield from pair_rows(held, keys, width)

    return run


def centers(columns: Sequence[str]) -> list[Column]:
    """Aggregates to shift by: the mean, or the value itself of a constant column, which leaves exact zeros."""
    cells = [F.col(c).cast("double") for c in columns]
    return [F.when(F.min(x) == F.max(x), F.min(x)).otherwise(F.avg(x)) for x in cells]


def _keyed(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Group keys ``_g<i>`` and numbers ``_x<i>``. Integer keys travel as text: with a null among them, pandas would make them doubles."""
    keys = [F.col(k).cast("string") if isinstance(df.schema[k].dataType, T.IntegralType) else F.col(k) for k in by]
    numbers = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    return df.select(*[k.alias(f"_g{i}") for i, k in enumerate(keys)], *numbers)


def group_centers(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The ``centers`` of each group, written: ``_o_g<i>`` are its keys and ``_m<i>`` the centers in the order of ``columns``."""
    groups = [f"_g{i}" for i in range(len(by))]
    own = _keyed(df, columns, by).groupBy(*groups).agg(*[mu.alias(f"_m{i}") for i, mu in enumerate(centers([f"_x{i}" for i in range(len(columns))]))])
    return stage(own.select(*[F.col(g).alias(f"_o{g}") for g in groups], *[f"_m{i}" for i in range(len(columns))]), "centers")


def correlations(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], single: bool = False, shifts: Sequence[float] | DataFrame | None = None
) -> DataFrame:
    """``(by, a, b, r)`` for each pair of columns, over the rows where both are present.

    Gram sums: a task multiplies its rows as matrices, a dataset at a time, and Spark adds up one small row for each
    task, dataset and pair, so no row of the table is repeated for its pairs and the driver holds no matrix. Values are
    shifted by the means of their dataset first (``shifts``, when the caller has the ``centers`` of a single table or the
    ``group_centers`` of many), so the sums do not cancel. A pair with a constant or empty side has r = 0.
    """
    width = range(len(columns))
    keys = [] if single else list(by)
    groups = [f"_g{i}" for i in range(len(keys))]
    if single:
        shifts = df.agg(*centers(columns)).first() if shifts is None else shifts
        shifted = _keyed(df, columns, []).select(*[(F.col(f"_x{i}") - F.lit(float(mu or 0.0))).alias(f"_x{i}") for i, mu in enumerate(shifts)])
    else:
        wide = _keyed(df, columns, by)
        own = group_centers(df, columns, by) if shifts is None else shifts
        # Few centers are broadcast, so the rows of a large dataset stay in their tasks.
        own = F.broadcast(own) if own.count() <= BROADCAST_GROUPS else own
        joined = wide.join(own, [F.col(g).eqNullSafe(F.col(f"_o{g}")) for g in groups])
        shifted = joined.select(*groups, *[(F.col(f"_x{i}") - F.col(f"_m{i}")).alias(f"_x{i}") for i in width])
    parts = shifted.mapInPandas(_pair_sums(len(keys), len(columns)), pair_schema(shifted, groups))
    added = parts.groupBy(*groups, "_i", "_j").agg(*[F.sum(c).alias(c) for c in SUMS])
    return pair_correlations(added, df, columns, by, single)


def pair_schema(keyed: DataFrame, groups: Sequence[str]) -> T.StructType:
    heads = [T.StructField(g, keyed.schema[g].dataType) for g in groups]
    return T.StructType([*heads, *[T.StructField(c, T.IntegerType()) for c in ("_i", "_j")], *[T.StructField(c, T.DoubleType()) for c in SUMS]])


def pair_correlations(added: DataFrame, df: DataFrame, columns: Sequence[str], by: Sequence[str], single: bool) -> DataFrame:
    """``(by, a, b, r)`` from the ``SUMS`` of each dataset and pair of ``columns`` of ``df``."""
    keys = [] if single else list(by)
    groups = [f"_g{i}" for i in range(len(keys))]
    kinds = [df.schema[k].dataType for k in keys]
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in SUMS)
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    # What remains of equal values away from the mean is rounding.
    varied = (n > 0) & (vx > sxx * 1e-12) & (vy > syy * 1e-12)
    r = F.when(varied, (sxy - sx * sy / n) / (F.sqrt(vx) * F.sqrt(vy)))
    names = F.array(*[F.lit(c) for c in columns])
    ids = [F.lit("table").alias(k) for k in by] if single else [F.col(g).cast(kind).alias(k) for g, k, kind in zip(groups, keys, kinds)]
    return added.select(*ids, names[F.col("_i")].alias("a"), names[F.col("_j")].alias("b"), finite_or(r, 0.0).alias("r"))


def fill_means(df: DataFrame, columns: Sequence[str], by: Sequence[str], single: bool) -> DataFrame:
    """Replace missing numbers by the mean of their column (within the dataset)."""
    means = df.groupBy(*by).agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in columns])
    joined = attach(df, means, by, single)
    rest = [c for c in df.columns if c not in columns]
    return joined.select(*rest, *[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) for c in columns])


@F.pandas_udf(T.DoubleType())
def _tail_share(pairs: pd.Series, live: pd.Series, width: pd.Series) -> pd.Series:
    """Sum of the eigenvalues behind the five largest, over the number of columns."""
    out = []
    for cells, columns, d in zip(pairs, live, width):
        at = {name: i for i, name in enumerate(columns)}
        m = np.eye(len(columns))
        for cell in cells:
            if cell["a"] in at and cell["b"] in at:
                i, j = at[cell["a"]], at[cell["b"]]
                m[i, j] = m[j, i] = cell["r"]
        rest = np.sort(np.linalg.eigvalsh(m))[::-1][min(int(d), 5):] if len(columns) else np.zeros(0)
        out.append(float(max(rest.sum(), 0.0) / d))
    return pd.Series(out)


def reconstruction_error(df: DataFrame, columns: Sequence[str], by: Sequence[str], single: bool) -> DataFrame:
    """Mean squared residual after projecting z-scored rows on their five main components.

    That equals the sum of the remaining eigenvalues of the correlation matrix over the number of
    columns, so rows are read only for the d x d correlations. Constant columns add nothing. Datasets of ten
    rows or fewer say too little: null.
    """
    filled = fill_means(df, columns, by, single)
    live = filled.groupBy(*by).agg(
        F.array_compact(
            F.array(*[F.when(F.stddev_pop(c) > 0, F.lit(c)) for c in columns])
        ).alias("_live"),
        F.lit(len(columns)).alias("_d"),
        (F.count(F.lit(1)) > 10).alias("_enough"),
    )
    if len(columns) == 1:
        return live.select(*by, F.when(F.col("_enough"), F.lit(0.0)).alias("reconstruction_error"))
    cells = (
        correlations(filled, columns, by, single)
        .groupBy(*by)
        .agg(F.collect_list(F.struct("a", "b", "r")).alias("_cells"))
    )
    return live.join(cells, list(by)).select(
        *by, F.when(F.col("_enough"), _tail_share("_cells", "_live", "_d")).alias("reconstruction_error")
    )
