"""The tables a reader sees next to a verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewitness.operators.histogram import value_histogram
from tablewitness.operators.moments import numeric_summary

# Diagnostic names and the features behind them.
TEMPORAL_METRICS = (
    ("ADF Stationarity p-value", "adf_p_value"),
    ("KPSS Stationarity p-value", "kpss_p_value"),
    ("Autocorr Lag-1", "mean_autocorr_lag1"),
    ("Autocorr Lag-5", "mean_autocorr_lag5"),
    ("Seasonality Strength", "seasonality_strength"),
    ("Residual Variance", "residual_variance"),
    ("Permutation Entropy", "mean_permutation_entropy"),
    ("Higuchi Fractal Dimension", "higuchi_fd"),
    ("Spike Fraction", "spike_fraction"),
    ("Noise Level Estimate", "noise_level_estimate"),
)
HEADLINE = (
    ("Duplicate Rows", "duplicate_pct"),
    ("Missing Volatility", "missing_variance"),
    ("Entropy Score", "mean_entropy"),
    ("Outlier Fraction", "outlier_fraction"),
    ("Permutation Entropy", "mean_permutation_entropy"),
    ("Autocorr Lag-1", "mean_autocorr_lag1"),
    ("Near-Duplicate %", "near_duplicate_ratio"),
    ("Higuchi Fractal Dim.", "higuchi_fd"),
)
TYPE_LABELS = {
    "sensor_iot": "Verified Sensor Stream",
    "timeseries": "Sequential Analysis Active",
    "tabular": "Standard Tabular Matrix",
}


def gauge_colour(score: Column) -> Column:
    return F.when(score > 0.6, F.lit("green")).when(score > 0.3, F.lit("orange")).otherwise(F.lit("red"))


def evidence(ks: Column, recon: Column, grid: Column, pe: Column) -> dict[str, Column]:
    """Four flags with the sentence shown for each side."""
    text = F.format_string
    # Thresholds and wording.
    return {
        "natural_distribution": ks > 0.2,
        "distribution_text": F.when(ks > 0.2, text("Natural value distribution (KS=%.2f)", ks)).otherwise(
            text("Unusually uniform distribution (KS=%.2f)", ks)
        ),
        "strong_manifold": recon < 0.15,
        "manifold_text": F.when(recon < 0.15, text("Strong manifold fit (recon=%.3f)", recon)).otherwise(
            text("High reconstruction error (recon=%.3f)", recon)
        ),
        "natural_spacing": grid > 0.3,
        "spacing_text": F.when(grid > 0.3, text("Natural value spacing (grid=%.2f)", grid)).otherwise(
            text("Perfect grid spacing detected (grid=%.2f)", grid)
        ),
        "complex_pattern": pe > 0.6,
        "pattern_text": F.when(pe > 0.6, text("Complex pattern (entropy=%.2f)", pe)).otherwise(
            text("High sequence regularity (entropy=%.2f)", pe)
        ),
    }


def type_label(dataset_type: Column) -> Column:
    known = F.when(F.lit(False), F.lit(""))
    for kind, label in TYPE_LABELS.items():
        known = known.when(dataset_type == kind, F.lit(label))
    return known.otherwise(F.lit(TYPE_LABELS["tabular"]))


def insights(clustered: Column, narrow: Column, missing: Column, entropy: Column, kind: Column, lag1: Column) -> Column:
    """Short remarks that apply, in order."""
    # Wording.
    return F.array_compact(
        F.array(
            F.when(clustered, F.lit("High duplicates + high entropy = natural clustered measurements (not synthetic inflation).")),
            F.when(narrow, F.lit("Narrow bounded columns detected (ratings/scores range). Integer penalties softened.")),
            F.when(
                (missing == 0.0) & (entropy > 4.5),
                F.lit("Zero missing values + very high randomness: expert preprocessing, not synthetic generation."),
            ),
            F.when(
                kind == "sensor_iot",
                F.format_string("Strong temporal structure detected (autocorrelation lag-1 = %.2f). Sensor/IoT scoring rules applied.", lag1),
            ),
        )
    )


def metric_rows(features: DataFrame, metrics: Sequence[tuple[str, str]], keys: Sequence[str], digits: int = 4) -> DataFrame:
    """``(keys, metric, value)`` with the value printed to ``digits`` decimals."""
    cells = [
        F.struct(F.lit(name).alias("metric"), F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias("value"))
        for name, c in metrics
    ]
    return features.select(*keys, F.explode(F.array(*cells)).alias("_m")).select(*keys, "_m.*")


def top_features(features: DataFrame, names: Sequence[str], keys: Sequence[str], count: int = 12) -> DataFrame:
    """The first ``count`` features as ``(keys, indicator, value)``, apart from the time flags."""
    shown = [n for n in names if n not in ("is_timeseries", "is_sensor_iot")][:count]
    cells = [
        F.struct(
            F.lit(n.replace("_", " ").capitalize()).alias("indicator"), F.round(F.col(n).cast("double"), 4).alias("value")
        )
        for n in shown
    ]
    return features.select(*keys, F.explode(F.array(*cells)).alias("_m")).select(*keys, "_m.*")


def telemetry(scored: DataFrame) -> DataFrame:
    """What a log line per scored dataset holds."""
    flags = "context_flags." if "context_flags" in scored.columns else ""
    return scored.select(
        F.col(flags + "is_timeseries").alias("is_ts"),
        F.col(flags + "dataset_type").alias("dtype"),
        F.col("uniform_ks_stat").alias("ks_stat"),
        F.col("mean_entropy").alias("entropy"),
        F.col("reconstruction_error").alias("recon_err"),
        F.col("grid_density_score").alias("grid"),
        F.col("raw_score").alias("raw_prob"),
    )


def benford_column(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The column worth a first-digit chart: highest variance among those with over ten values, else the first."""
    distinct = value_histogram(df, columns, by).groupBy(*by, "column").agg(F.count(F.lit(1)).alias("_d"))
    spread = numeric_summary(df, columns, by).join(distinct, [*by, "column"])
    best = F.max_by(
        F.when((F.col("_d") > 10) & (F.col("variance") > 0), F.col("column")),
        F.when((F.col("_d") > 10) & (F.col("variance") > 0), F.col("variance")),
    )
    return spread.groupBy(*by).agg(F.coalesce(best, F.lit(columns[0])).alias("column"))
