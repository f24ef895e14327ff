"""Parquet scan, sinks and row samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewitness.functions.scalars import shuffle_key


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Training metrics as JSON lines."""
    metrics.write.json(path)


def sample_rows(df: DataFrame, cap: int, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """A uniform sample of ``cap`` rows: those whose hash comes first.

    A threshold thins the table to little more than ``cap`` rows before they are sorted, so no
    task sorts more than the sample. Smaller tables pass unchanged.
    """
    n = df.count()
    if n <= cap:
        return df
    hashed = df.withColumn("_h", shuffle_key(seed, "sample", key_cols))
    share = min(1.0, (cap + 10 * math.sqrt(cap)) / n)
    limit = format(min(int(share * 16**12), 16**12 - 1), "012x")
    thin = hashed if share >= 1.0 else hashed.where(F.substring("_h", 1, 12) <= limit)
    return thin.orderBy("_h", *key_cols).limit(cap).drop("_h")
