"""Sketch states of columns: kept for each dataset, merged when data is appended.

One pass gives a row for each dataset and column: counts, extremes, a HyperLogLog state of the values and, for
numbers, a KLL state of their ranks. States of parts merge to the state of the whole, so an increment is measured without reading
the rest again. Estimates have known errors: distinct counts within ``DISTINCT_ERROR`` and ranks within ``RANK_ERROR`` of the rows,
three standard errors each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewitness.functions.scalars import EPS
from tablewitness.operators.columns import as_text, numeric_columns

#: Logarithm of the registers of a HyperLogLog state, and the size of a KLL state.
HLL_BITS, KLL_SIZE = 14, 800
DISTINCT_ERROR = 3 * 1.04 / 2 ** (HLL_BITS / 2)
RANK_ERROR = 3 * 2.446 / KLL_SIZE**0.9433
STATE = ("rows", "n", "lo", "hi", "distinct_state", "rank_state")


def column_states(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``(by, column, rows, n, lo, hi, distinct_state, rank_state)`` in one pass; missing cells are in ``rows`` only.

    All states of a dataset are aggregated side by side from the wide rows. Text columns, and columns without a value, have no ranks.
    """
    numbers = set(numeric_columns(df, by))
    cells = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        value = F.when(~F.isnan(value), value) + F.lit(0.0)  # no negative zero
        text = value.cast("string") if c in numbers else as_text(df, c)
        cells += [F.count(text).alias(f"_n{i}"), F.hll_sketch_agg(text, F.lit(HLL_BITS)).alias(f"_d{i}")]
        if c in numbers:
            cells += [F.min(value).alias(f"_lo{i}"), F.max(value).alias(f"_hi{i}"), F.kll_sketch_agg_double(value, F.lit(KLL_SIZE)).alias(f"_r{i}")]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *cells)
    none = lambda kind: F.lit(None).cast(kind)
    each = [
        F.struct(
            F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("n"),
            (F.col(f"_lo{i}") if c in numbers else none("double")).alias("lo"), (F.col(f"_hi{i}") if c in numbers else none("double")).alias("hi"),
            F.col(f"_d{i}").alias("distinct_state"), (F.when(F.col(f"_n{i}") > 0, F.col(f"_r{i}")) if c in numbers else none("binary")).alias("rank_state"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(*by, F.explode(F.array(*each)).alias("_s")).select(*by, "_s.*")


def merged_states(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The states of the whole from the states of its parts."""
    return states.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.hll_union_agg("distinct_state").alias("distinct_state"), F.when(F.min("lo").isNotNull(), F.kll_merge_agg_double("rank_state")).alias("rank_state"),
    )


def append_states(df: DataFrame, columns: Sequence[str], by: Sequence[str], path: str) -> None:
    """Add the states of an increment to the table of states at ``path``."""
    column_states(df, columns, by).write.mode("append").parquet(path)


def stored_states(spark: SparkSession, by: Sequence[str], path: str) -> DataFrame:
    """The states of everything appended so far."""
    return merged_states(spark.read.parquet(path), by)


def estimates(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, column, rows, n, n_distinct, cardinality, lo, hi, q25, median, q75, iqr_range_ratio)`` from states."""
    ranks = F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75)))
    out = states.withColumn("_q", F.when(F.col("lo").isNotNull(), F.kll_sketch_get_quantile_double("rank_state", ranks)))
    out = out.withColumn("n_distinct", F.hll_sketch_estimate("distinct_state"))
    q = {name: F.get("_q", F.lit(k)) for k, name in enumerate(("q25", "median", "q75"))}
    ratio = F.when(F.col("n") > 1, (q["q75"] - q["q25"]) / (F.col("hi") - F.col("lo") + F.lit(EPS)))
    return out.select(
        *by, "column", "rows", "n", "n_distinct", (F.col("n_distinct") / F.col("rows")).alias("cardinality"), "lo", "hi",
        *(c.alias(name) for name, c in q.items()), ratio.alias("iqr_range_ratio"),
    )
