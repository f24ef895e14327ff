"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import logging
import os
import time
import warnings

warnings.filterwarnings("ignore")
logging.disable(logging.WARNING)

HEADLINE = (
    "agg01_duplicate_rows", "agg03_near_duplicates", "agg11_uniform_ks", "agg12_mean_correlation",
    "agg13_correlation_consistency", "agg14_benford_error", "agg16_entropy", "agg17_iqr_range", "agg19_grid_density",
    "agg20_numeric_summary", "agg22_roc_auc", "dom4_domain_type", "win1_autocorrelation", "win3_permutation_entropy",
    "win5_spike_fraction", "win8_higuchi", "win9_adf_test", "win10_kpss_automatic_lag", "win11_decomposition",
    "mul1_shapiro", "mul2_isolation_forest", "mul3_reconstruction_error", "cor01_uniform", "cor02_shuffled",
    "cor03_marginal", "cor06_duplicated", "cal12_calibrated_score", "src1_csv_scan", "profile_lineitem_natural",
    "profile_orders_datasets",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    from tablewitness.checks import QUERIES
    from tablewitness.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # The whole result is computed and thrown away, as a sink would read it.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
