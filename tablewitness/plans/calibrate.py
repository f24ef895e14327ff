"""Rules that move a model probability, with the evidence for each move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewitness.functions.scalars import clip, total

# Feature values a rule assumes when the feature is absent.
DEFAULTS = {
    "uniform_ks_stat": 0.5,
    "mean_entropy": 0.0,
    "reconstruction_error": 0.5,
    "mean_autocorr_lag1": 0.0,
    "grid_density_score": 0.5,
    "joint_correlation_consistency": 0.0,
    "mean_abs_correlation": 0.0,
    "mean_permutation_entropy": 0.5,
    "total_rows": 1000.0,
}


def _inputs(df: DataFrame) -> dict[str, Column]:
    have = set(df.columns)
    return {k: F.coalesce(F.col(k).cast("double"), F.lit(v)) if k in have else F.lit(v) for k, v in DEFAULTS.items()}


def rules(df: DataFrame, dataset_type: Column, is_timeseries: Column) -> list[tuple[str, Column, float, Column]]:
    """``(rule, fires, weight, reason)`` in order; a positive weight speaks for a natural table."""
    f = _inputs(df)
    ks, entropy, recon = f["uniform_ks_stat"], f["mean_entropy"], f["reconstruction_error"]
    lag1, grid, rows = f["mean_autocorr_lag1"], f["grid_density_score"], f["total_rows"]
    consist, corr, pe = f["joint_correlation_consistency"], f["mean_abs_correlation"], f["mean_permutation_entropy"]
    text = F.format_string
    # Thresholds, weights and wording of the rules.
    return [
        ("CAL1", (ks > 0.08) & (entropy > 2.5) & (recon < 0.45), 0.55,
         text("Authentic Distribution Trace: KS=%.2f, Entropy=%.2f (+0.55)", ks, entropy)),
        ("CAL2", is_timeseries & (lag1 > 0.3) & (recon < 0.25), 0.45,
         text("Authentic temporal memory (lag-1=%.2f) (+0.45)", lag1)),
        ("CAL3", recon < 0.18, 0.20,
         text("Strong Manifold Consistency (recon_err=%.3f) (+0.20)", recon)),
        ("CAL4", (rows < 2000) & (ks > 0.15), 0.15,
         F.lit("Small-dataset distribution grace (+0.15)")),
        ("CAL5", grid < 0.15, -0.60,
         text("Synthetic Grid Artifact (density=%.3f) (-0.60)", grid)),
        ("CAL6", (consist < 0.04) & (corr < 0.05) & (dataset_type != "sensor_iot"), -0.45,
         text("Suspiciously Independent Columns (consist=%.3f) (-0.45)", consist)),
        ("CAL7", ks < 0.04, -0.65,
         text("Ultra-Uniform Marginals (KS=%.3f) -> synthetic (-0.65)", ks)),
        ("CAL8", pe < 0.35, -0.40,
         text("Unnatural Sequence Regularity (PE=%.2f) (-0.40)", pe)),
        ("CAL9", entropy < 1.2, -0.50,
         text("Low Information Entropy (%.2f) -> synthetic (-0.50)", entropy)),
    ]


FLOOR_REASON = "Verified Realism: Ensemble confirms natural data topology -> 92%"
CAP_REASON = "Verified Synthetic: Detected generation artifacts -> 5%"


def calibrate(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Add ``score``, ``boost``, ``penalty``, ``rules`` and ``reasons`` to feature rows.

    Context comes from ``context_flags`` or from columns ``dataset_type`` and ``is_timeseries``.
    """
    flags = "context_flags." if "context_flags" in df.columns else ""
    have = set(df.columns)
    kind = F.col(flags + "dataset_type") if flags or "dataset_type" in have else F.lit("tabular")
    kind = F.coalesce(kind, F.lit("tabular"))
    timed = F.col(flags + "is_timeseries") if flags or "is_timeseries" in have else F.lit(False)
    timed = F.coalesce(timed.cast("boolean"), F.lit(False))
    found = rules(df, kind, timed)
    recon = _inputs(df)["reconstruction_error"]
    plus = [F.when(fires, F.lit(w)).otherwise(F.lit(0.0)) for _, fires, w, _ in found if w > 0]
    minus = [F.when(fires, F.lit(-w)).otherwise(F.lit(0.0)) for _, fires, w, _ in found if w < 0]
    out = df.withColumn("boost", total(plus)).withColumn("penalty", total(minus))

    boost, penalty = F.col("boost"), F.col("penalty")
    raw = F.col(probability) + boost - penalty
    natural = ((boost >= 0.50) | (recon < 0.12)) & (penalty < 0.25)
    floored = F.when(natural, F.greatest(raw, F.lit(0.92))).otherwise(raw)
    artificial = (penalty >= 0.55) | ((penalty > 0.40) & (boost < 0.10))
    capped = F.when(artificial, F.least(floored, F.lit(0.05))).otherwise(floored)

    names = [F.when(fires, F.lit(name)) for name, fires, _, _ in found]
    texts = [F.when(fires, reason) for _, fires, _, reason in found]
    names += [F.when(natural & (raw < 0.92), F.lit("CAL10")), F.when(artificial & (floored > 0.05), F.lit("CAL11"))]
    texts += [F.when(natural & (raw < 0.92), F.lit(FLOOR_REASON)), F.when(artificial & (floored > 0.05), F.lit(CAP_REASON))]
    return (
        out.withColumn("score", clip(capped, 0.01, 0.99))
        .withColumn("rules", F.array_compact(F.array(*names)))
        .withColumn("reasons", F.array_compact(F.array(*texts)))
    )


def verdict(score: Column) -> Column:
    """The headline for a calibrated score."""
    # Thresholds and wording of the verdict.
    return (
        F.when(score > 0.75, F.lit("VERIFIED AUTHENTIC"))
        .when(score > 0.60, F.lit("PROBABLE AUTHENTICITY"))
        .when(score > 0.40, F.lit("SIGNALS UNCERTAIN"))
        .otherwise(F.lit("SYNTHETIC ARTIFACT DETECTED"))
    )
