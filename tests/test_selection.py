"""Exact samples by selection, row digests, sketch states and Gram sums."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewitness.operators import corruption, sketches
from tablewitness.operators.duplicates import repeat_share, row_digest
from tablewitness.operators.moments import correlations

BY = ["dataset_id"]


def _rank(seed, tag, name, i):
    return hashlib.md5(f"{seed}|{tag}|{name}|{i}".encode()).hexdigest(), i


@pytest.mark.parametrize("few", [1 << 16, 3])
def test_exactly_so_many_rows(spark, monkeypatch, few):
    """As by a sort of the hashes; with few rows to sort, several rounds of digits; the table is not shuffled."""
    monkeypatch.setattr(corruption, "LAST_ROWS", few)
    sizes = {"a": 900, "b": 40, "c": 1, "d": 5}
    rows = [(name, i) for name, n in sizes.items() for i in range(n)]
    t = spark.createDataFrame(rows, "dataset_id string, row_idx bigint").repartition(5)
    want = {"a": 333, "b": 0, "c": 1, "d": 9}
    found = corruption.chosen_exactly(t, spark.createDataFrame(list(want.items()), "dataset_id string, _want bigint"), 7, "keep")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dataset_id" not in plan.split("BroadcastExchange")[0]
    got = {(r.dataset_id, r.row_idx) for r in found.where("_chosen").collect()}
    expected = {(name, i) for name, n in sizes.items() for _, i in sorted(_rank(7, "keep", name, i) for i in range(n))[: want[name]]}
    assert got == expected and found.count() == len(rows)


def test_augment_takes_three_quarters(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(202)], "k int, x double")
    assert {t.count() for t in corruption.augment(df, ["k"])} == {152}  # 151.5, half to even


def test_row_digests(spark):
    rows = [("a", "bc", 1.0), ("ab", "c", 1.0), ("a", "bc", 1.0), (None, "n", 0.0), (None, "n", -0.0), ("n", None, float("nan")), ("n", None, float("nan")), ("1:a", "", None), ("", "1:a", None)]
    df = spark.createDataFrame([("d", *r) for r in rows], "dataset_id string, s string, t string, x double")
    # Of nine rows six are different: equal ones are the first and third, both zeros and both NaN.
    assert repeat_share(df, ["s", "t", "x"], BY, "share").first()["share"] == pytest.approx(3 / 9)
    assert df.select(row_digest([F.col("s"), F.col("t")]).alias("d")).where("octet_length(d) = 32").count() == 9
    big = spark.createDataFrame([("d", 2**53), ("d", 2**53 + 1)], "dataset_id string, n bigint")
    assert repeat_share(big, ["n"], BY, "share").first()["share"] == 0


def test_states_merge_to_the_whole(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.gauss(0, 1), rng.randrange(500), rng.choice(["x", "y", None]), None) for _ in range(30_000)]
    rows += [("a", float("nan"), None, "z", None), ("b", -0.0, 1, "z", None), ("b", 0.0, 1, "z", None)]
    df = spark.createDataFrame(rows, "dataset_id string, x double, k int, s string, nothing double")
    columns = ["x", "k", "s", "nothing"]
    for part in range(4):
        sketches.append_states(df.where(F.pmod(F.xxhash64("x", "k"), F.lit(4)) == part), columns, BY, str(tmp_path / "states"))
    parts = sketches.estimates(sketches.stored_states(spark, BY, str(tmp_path / "states")), BY)
    whole = sketches.estimates(sketches.column_states(df, columns, BY), BY)
    exact = {}
    for r in rows:
        for c, v in zip(columns, r[1:]):
            if v is not None and v == v:
                exact.setdefault((r[0], c), []).append(v)
    for found in (parts, whole):
        found = {(r.dataset_id, r.column): r for r in found.collect()}
        assert len(found) == 8
        for (name, c), r in found.items():
            values = sorted(exact.get((name, c), []))
            assert r.rows == sum(x[0] == name for x in rows) and r.n == len(values)
            assert abs(r.n_distinct - len(set(values))) <= sketches.DISTINCT_ERROR * len(set(values)) + 1
            if c in ("x", "k"):
                assert (r.lo, r.hi) == (values[0], values[-1])
                for q, at in ((0.25, r.q25), (0.5, r.median), (0.75, r.q75)):
                    low, high = sum(v < at for v in values) / len(values), sum(v <= at for v in values) / len(values)
                    assert low - sketches.RANK_ERROR <= q <= high + sketches.RANK_ERROR
            else:
                assert r.median is None and r.lo is None


def test_pair_sums_per_dataset(spark, monkeypatch):
    """Gaps, a null integer key, a constant column, a large offset and tasks that hand on early."""
    monkeypatch.setattr("tablewitness.operators.moments.HELD_PAIRS", 6)
    rng = np.random.default_rng(8)
    n, big = 3000, 2**60 + 1
    pdf = pd.DataFrame({"a": rng.normal(1e9, 1, n), "b": rng.normal(size=n), "c": np.full(n, 0.1), "d": rng.exponential(size=n)})
    pdf["b"] += pdf["a"] - 1e9
    pdf.loc[rng.random(n) < 0.2, "d"] = np.nan
    key = rng.choice(3, n)
    rows = [(None if k == 0 else big + int(k), *(None if np.isnan(v) else float(v) for v in r)) for k, r in zip(key, pdf.to_numpy())]
    df = spark.createDataFrame(rows, "g bigint, a double, b double, c double, d double").repartition(7)
    got = {(r["g"], r["a"], r["b"]): r["r"] for r in correlations(df, list("abcd"), ["g"]).collect()}
    assert len(got) == 18
    near = pdf.assign(a=pdf["a"] - 1e9)  # exact, and easier for the reference's running means
    for k in range(3):
        want = near[key == k].corr().fillna(0.0)
        for a, b in ("ab", "ac", "ad", "bc", "bd", "cd"):
            assert got[None if k == 0 else big + k, a, b] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_pair_sums_of_a_wide_table(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 120))
    names = [f"c{i}" for i in range(120)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    r = correlations(df, names, ["dataset_id"], True).toPandas()
    want = np.corrcoef(x.T)
    assert len(r) == 120 * 119 // 2
    assert np.allclose(r["r"], [want[int(a[1:]), int(b[1:])] for a, b in zip(r["a"], r["b"])])
