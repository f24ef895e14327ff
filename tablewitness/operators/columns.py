"""Column selection by type, missing values and the long form of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewitness.session import stage

DATASET = "dataset_id"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)
_TIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Numbers, without booleans and times."""
    return [f.name for f in df.schema if isinstance(f.dataType, _NUMERIC) and f.name not in skip]


def categorical_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Everything that is not numeric."""
    return [f.name for f in df.schema if not isinstance(f.dataType, _NUMERIC) and f.name not in skip]


def integer_typed(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def long_decimals(df: DataFrame) -> list[str]:
    """Decimal columns with more digits than a double can tell apart."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType) and f.dataType.precision > 15]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _TIME)]


def with_dataset(df: DataFrame, dataset_id: str | None) -> DataFrame:
    """Give every row a ``dataset_id``: the named column, or one constant for a single table."""
    if dataset_id is None:
        return df.withColumn(DATASET, F.lit("table"))
    if dataset_id == DATASET:
        return df
    return df.withColumnRenamed(dataset_id, DATASET)


def nan_to_null(df: DataFrame, keep_decimals: bool = False) -> DataFrame:
    """NaN counts as missing everywhere; decimals become doubles unless kept; dots leave the column names."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _FLOATING):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.DecimalType) and not keep_decimals:
            c = c.cast("double")
        out.append(c.alias(f.name.replace(".", "_")))
    return df.select(*out)


def as_text(df: DataFrame, name: str) -> Column:
    """A printable, comparable form of any column (arrays, maps and structs as JSON)."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.col(name))
    return F.col(name).cast("string")


def long_numbers(df: DataFrame, by: Sequence[str], columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per numeric cell that is present: ``(by, keep, column, value)``."""
    wide = df.select(
        *by,
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)],
        *[F.col(c).cast("double").alias(c) for c in columns],
    )
    ids = [*by, *[f"_k{i}" for i in range(len(keep))]]
    long = wide.unpivot(ids, list(columns), "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def long_texts(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per present cell of any type, as text: ``(by, column, text)``."""
    wide = df.select(*by, *[as_text(df, c).alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "column", "text").where(F.col("text").isNotNull())


def column_position(columns: Sequence[str]) -> Column:
    """Position of ``column`` in the schema, for rules on the first k columns."""
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")).cast("int") - 1


#: Statistics of so many groups at most, a row each, are broadcast; more meet salted rows.
BROADCAST_GROUPS = 10_000
SALTS = 64


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], single: bool) -> DataFrame:
    """Per-group statistics next to the rows of their group, a row for each group on the right side.

    For one table the right side holds at most one row per column, which bounds the broadcast. For many
    datasets it is written and counted: few groups are broadcast, so the rows stay where they are; else rows
    are salted by their place, so that a group with a third of all rows is ``SALTS`` join keys.
    """
    if single:
        return left.join(F.broadcast(right), list(on))
    return beside(left, right, None, on)


def beside(t: DataFrame, stats: DataFrame, spread: str | None = None, on: Sequence[str] = (DATASET,)) -> DataFrame:
    """Rows next to the written statistics of their group, without bringing a group's rows together.

    ``spread`` names the column that salts the rows when there are many groups; none means their place. Many
    groups are never broadcast: a small file may hold millions of them, and the driver would hold them ``SALTS`` times.
    """
    stats = stage(stats, "stats")
    if stats.count() <= BROADCAST_GROUPS:
        return t.join(F.broadcast(stats), list(on))
    salt = F.pmod(F.xxhash64(spread) if spread else F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    copies = stats.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return t.withColumn("_s", salt).join(copies.hint("merge"), [*on, "_s"]).drop("_s")
