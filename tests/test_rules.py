"""Hand-worked calibration rows."""

import pytest
from pyspark.sql import functions as F

from tablewitness.plans.calibrate import calibrate, verdict

SHORT = {"ks": "uniform_ks_stat", "entropy": "mean_entropy", "pe": "mean_permutation_entropy", "lag1": "mean_autocorr_lag1",
         "recon": "reconstruction_error", "corr": "mean_abs_correlation", "consist": "joint_correlation_consistency", "grid": "grid_density_score"}
BASE = {"ks": 0.3, "entropy": 4.0, "pe": 0.75}
CASES = [
    ("autocorr", 0.50, "sensor_iot", {**BASE, "lag1": 0.8}, 0.65, 0.15, 0.0, ["CAL4"]),
    ("sensor", 0.20, "sensor_iot", {**BASE, "lag1": 0.85}, 0.35, 0.15, 0.0, ["CAL4"]),
    ("base", 0.60, "tabular", BASE, 0.30, 0.15, 0.45, ["CAL4", "CAL6"]),
    ("low pe", 0.70, "tabular", {**BASE, "pe": 0.2}, 0.01, 0.15, 0.85, ["CAL4", "CAL6", "CAL8"]),
    ("near uniform", 0.65, "tabular", {**BASE, "ks": 0.02}, 0.01, 0.0, 1.10, ["CAL6", "CAL7"]),
    ("natural", 0.30, "tabular", {**BASE, "recon": 0.3, "corr": 0.2, "consist": 0.15}, 0.99, 0.70, 0.0, ["CAL1", "CAL4"]),
    ("narrow", 0.10, "tabular", {**BASE, "recon": 0.0, "corr": 0.2, "consist": 0.15}, 0.99, 0.90, 0.0, ["CAL1", "CAL3", "CAL4"]),
    ("grid", 0.80, "timeseries", {"ks": 0.002, "entropy": 9.0, "recon": 0.0, "grid": 0.0, "corr": 1.0, "consist": 0.9, "pe": 0.0, "lag1": 1.0},
     0.01, 0.65, 1.65, ["CAL2", "CAL3", "CAL5", "CAL7", "CAL8"]),
    ("pe only", 0.60, "tabular", {"ks": 0.1, "entropy": 2.0, "pe": 0.2, "corr": 0.2, "consist": 0.1}, 0.20, 0.0, 0.40, ["CAL8"]),
    ("independent", 0.90, "tabular", {"ks": 0.10, "entropy": 2.0, "pe": 0.75}, 0.05, 0.0, 0.45, ["CAL6", "CAL11"]),
    ("strong sensor", 0.40, "sensor_iot", {**BASE, "recon": 0.1, "lag1": 0.9, "corr": 0.9, "consist": 0.8}, 0.99, 1.35, 0.0, ["CAL1", "CAL2", "CAL3", "CAL4"]),
    ("both", 0.50, "tabular", {**BASE, "recon": 0.1, "grid": 0.1, "corr": 0.3, "consist": 0.2}, 0.05, 0.90, 0.60, ["CAL1", "CAL3", "CAL4", "CAL5", "CAL11"]),
    ("floor", 0.20, "tabular", {"ks": 0.1, "entropy": 4.0, "pe": 0.75, "recon": 0.3, "corr": 0.2, "consist": 0.15}, 0.92, 0.55, 0.0, ["CAL1", "CAL10"]),
]


def test_golden_rows(spark):
    names = list(SHORT.values())
    rows = [
        (name, p, kind, kind != "tabular", *[f.get(k) for k in SHORT]) for name, p, kind, f, *_ in CASES
    ]
    schema = "name string, probability double, dataset_type string, is_timeseries boolean, " + ", ".join(f"{n} double" for n in names)
    got = {r["name"]: r for r in calibrate(spark.createDataFrame(rows, schema)).collect()}
    for name, _, _, _, score, boost, penalty, rules in CASES:
        r = got[name]
        assert r["score"] == pytest.approx(score), name
        assert (r["boost"], r["penalty"]) == (pytest.approx(boost), pytest.approx(penalty)), name
        assert r["rules"] == rules, name
        assert len(r["reasons"]) == len(rules), name


def test_verdict_edges(spark):
    df = spark.createDataFrame([(s,) for s in (0.76, 0.75, 0.6, 0.4)], "s double").select(verdict(F.col("s")).alias("v"))
    assert [r["v"] for r in df.collect()] == [
        "VERIFIED AUTHENTIC", "PROBABLE AUTHENTICITY", "SIGNALS UNCERTAIN", "SYNTHETIC ARTIFACT DETECTED"]
