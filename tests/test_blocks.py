"""Series in blocks, and what is measured on them without moving a cell."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewitness.operators import blocks as b
from tablewitness.operators import isolation
from tablewitness.operators.ordering import series, with_spread

BY, KEYS = ["dataset_id"], ["dataset_id", "column"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"dataset_id": rng.choice(["a", "b", "c"], 1500, p=[0.85, 0.149, 0.001]), "i": rng.permutation(1500),
                        "x": rng.normal(1e6, 1, 1500), "y": np.where(rng.random(1500) < 0.3, np.nan, 0.1), "z": np.nan})
    return spark.createDataFrame(pdf).repartition(7)


def test_rows_are_sorted_once_and_packed_as_the_series_says(rows):
    want = with_spread(series(rows, ["x", "y", "z"], ["i"], BY), KEYS, False).select(*KEYS, "row_idx", "n", "value", "mean", "std", "std_pop").toPandas()
    blocks = b.packed_series(rows, ["x", "y", "z"], ["i"], BY, 100)
    found = b.unpacked(blocks, KEYS).select(want.columns.tolist()).toPandas()
    want, found = (x.sort_values([*KEYS, "row_idx"]).reset_index(drop=True) for x in (want, found))
    pd.testing.assert_frame_equal(found, want, check_dtype=False, rtol=1e-9)
    assert (found.loc[found.column == "y", "std_pop"] == 0).all()  # exactly, though 0.1 has no exact sum
    held = {(r["dataset_id"], r["column"], r["_block"]): r for r in blocks.collect()}
    for r in held.values():
        after = held.get((r["dataset_id"], r["column"], r["_block"] + 1))
        assert r["_values"][r["_own"]:] == (after["_values"][: min(b.PACK_HALO, after["_own"])] if after else [])
    packed = {(r["dataset_id"], r["column"], r["_block"]): r["_values"] for r in b.packed(series(rows, ["x"], ["i"], BY), KEYS, False, 100).collect()}
    assert packed == {k: r["_values"] for k, r in held.items() if k[1] == "x"}


def test_wider_blocks(rows):
    blocks = b.packed_series(rows, ["x"], ["i"], BY, 100).where("dataset_id = 'a'")
    whole = b.unpacked(blocks, KEYS).orderBy("row_idx").toPandas()["value"].tolist()
    for r in b.widened(blocks.withColumn("lag", F.lit(90).cast("long")), KEYS, 100).collect():
        assert r["lag"] == 90 and r["_values"] == whole[r["_start"] : r["_start"] + r["_own"] + 90]


@pytest.mark.parametrize("last", [1 << 16, 3])
def test_medians_by_counting(spark, monkeypatch, last):
    monkeypatch.setattr(b, "LAST_ROWS", last)
    rng = np.random.default_rng(12)
    sets = {"even": np.abs(rng.normal(size=400)), "odd": 1e9 + rng.random(301), "ties": rng.integers(0, 3, 50) * 1.0, "one": np.array([2.5])}
    parts = [(k, "v", i, v.tolist()) for k, x in sets.items() for i, v in enumerate(np.array_split(x, 3))]
    arrays = spark.createDataFrame(parts, "dataset_id string, column string, _block long, _values array<double>")
    found = {r["dataset_id"]: r["mid"] for r in b.medians(arrays, KEYS, "mid").collect()}
    assert found == {k: float(np.median(x)) for k, x in sets.items()}


def test_few_forests_meet_the_rows_where_they_lie(spark, monkeypatch):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"dataset_id": np.repeat(["p", "q", "tiny"], [700, 300, 5]), "k": range(1005), "a": rng.normal(size=1005).round(1), "b": rng.integers(0, 4, 1005)})
    df = spark.createDataFrame(pdf).repartition(5)
    sizes = df.groupBy("dataset_id").agg(F.count("*").alias("n")).where("n > 10")
    forests = isolation.grow_forest(df, ["a", "b"], BY, sizes, ["k"], 12)
    count = lambda: {
        (r["dataset_id"], round(r["score"], 9)): r["c"]
        for r in isolation.score_rows(df, ["a", "b"], BY, forests, sizes).groupBy("dataset_id", "score").agg(F.sum("cnt").alias("c")).collect()
    }
    plan = isolation.score_rows(df, ["a", "b"], BY, forests, sizes)._jdf.queryExecution().optimizedPlan().toString()
    here = count()
    assert "MapInArrow" in plan and "CoGroup" not in plan and sum(here.values()) == 1000
    monkeypatch.setattr(isolation, "BROADCAST_TREES", 0)
    assert count() == here
