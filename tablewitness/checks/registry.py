"""Registration of queries and small helpers they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewitness.operators.columns import nan_to_null, with_dataset

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LINEITEM = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)
ORDERS = ("o_orderkey", "o_custkey", "o_totalprice")
EVENTS = ("event_id", "user_id", "value")
PART = ("p_partkey", "p_size", "p_retailprice")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows can be checked."""

    def add(func: Query) -> Query:
        QUERIES[name] = func
        if sql is not None:
            SQL[name] = sql
        return func

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dataset(spark: SparkSession, folder: str, name: str, dataset_id: str | None = None) -> DataFrame:
    """A table in the form operators take."""
    return nan_to_null(with_dataset(table(spark, folder, name), dataset_id))


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Round doubles, so that the last bits of float sums do not matter, and drop negative zero."""
    return df.withColumns({c: r6(F.col(c), digits) for c in columns})


def r6(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def sql_long(source: str, columns: Sequence[str], extra: Sequence[str] = ()) -> str:
    """SQL for the long form of numeric columns."""
    lead = "".join(f"{e}, " for e in extra)
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS \"column\", {c}::DOUBLE AS value FROM {source} WHERE {c} IS NOT NULL" for c in columns
    )


def sql_unit(seed: int, tag: str, keys: str) -> str:
    """SQL for the hash-based random number of ``scalars.unit_hash``."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{tag}', {keys})), 1, 13))::BIGINT / 4503599627370496e0)"
