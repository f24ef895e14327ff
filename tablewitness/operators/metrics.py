"""Quality of a binary score: ranking, confusion and the usual report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewitness.operators.histogram import sorted_histogram


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """``(by, auc)`` as the share of ordered pairs, ties counting half, from one sorted histogram of scores."""
    hits = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    hist = df.groupBy(*by, F.lit("score").alias("column"), F.col(score).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("cnt"), hits.alias("pos")
    )
    ranked = sorted_histogram(hist, by, keep=("pos",))
    middle = F.col("cum") - F.col("cnt") + (F.col("cnt") + 1) / 2.0
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("pos") * middle).alias("_ranks"), F.sum("pos").cast("double").alias("_p"), F.sum("cnt").alias("_n")
    )
    p = F.col("_p")
    auc = (F.col("_ranks") - p * (p + 1) / 2.0) / (p * (F.col("_n") - p))
    return sums.select(*by, F.when((p > 0) & (p < F.col("_n")), auc).alias("auc"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``(class, precision, recall, f1, support)`` for both classes, their averages, and accuracy."""
    actual, guess = F.col(label), F.col(predicted)
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("double")
    cells = df.agg(
        *[count((actual == k) & (guess == k)).alias(f"_hit{k}") for k in (0, 1)],
        *[count(guess == k).alias(f"_said{k}") for k in (0, 1)],
        *[count(actual == k).alias(f"_is{k}") for k in (0, 1)],
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = []
    for k in (0, 1):
        precision, recall = ratio(F.col(f"_hit{k}"), F.col(f"_said{k}")), ratio(F.col(f"_hit{k}"), F.col(f"_is{k}"))
        rows.append((str(k), precision, recall, ratio(2 * precision * recall, precision + recall), F.col(f"_is{k}")))
    total = F.col("_is0") + F.col("_is1")
    accuracy = ratio(F.col("_hit0") + F.col("_hit1"), total)
    rows.append(("accuracy", accuracy, accuracy, accuracy, total))
    for name, w0, w1 in (("macro avg", F.lit(0.5), F.lit(0.5)), ("weighted avg", F.col("_is0") / total, F.col("_is1") / total)):
        rows.append((name, *[rows[0][i] * w0 + rows[1][i] * w1 for i in (1, 2, 3)], total))
    structs = [
        F.struct(F.lit(n).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))
        for n, p, r, f, s in rows
    ]
    return cells.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, balanced, boosting)``: n/(2 n_class), and negatives per positive for the positive class."""
    both = df.agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"), F.count(F.lit(1)).alias("_all")
    )
    pos, neg = F.col("_pos"), F.col("_all") - F.col("_pos")
    row = lambda k, n, boosting: F.struct(
        F.lit(k).alias("label"), n.alias("n"), (F.col("_all") / F.nullif(2.0 * n, F.lit(0.0))).alias("balanced"), boosting.alias("boosting")
    )
    rows = F.array(row(0, neg, F.lit(1.0)), row(1, pos, neg / F.nullif(pos, F.lit(0)) + F.lit(1e-5)))
    return both.select(F.explode(rows).alias("_r")).select("_r.*")
