"""Stacked classifier over feature rows: boosting, forest and isolation score under a logistic layer.

A row is one dataset, so these tables are small next to the data they describe; training and
scoring still run as Spark ML jobs over however many rows there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewitness.functions.scalars import clip, finite_or, total
from tablewitness.operators.isolation import grow_forest, score_one
from tablewitness.operators.metrics import class_weights, classification_report, roc_auc
from tablewitness.operators.ordering import hash_rank, ordered_index
from tablewitness.session import checkpoints, stage

FOLDS = 5
MODELS = ("p_boost", "p_forest", "p_isolation")
NOT_FEATURES = ("context_flags", "dataset_type", "dataset_id", "base", "total_rows", "label", "row_idx")


@dataclass
class Settings:
    """Model sizes. Smaller ones are for trials and tests."""

    boost_trees: int = 300
    boost_step: float = 0.06
    boost_depth: int = 6
    forest_trees: int = 300
    forest_depth: int = 12
    isolation_trees: int = 200
    seed: int = 42
    threads: int = 4


def model_columns(df: DataFrame) -> list[str]:
    """Numeric feature columns, without keys, labels and context."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES]


def align_features(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` and the named features in order; absent ones and missing values become 0."""
    have = set(df.columns)
    return df.select(*keys, *[(finite_or(F.col(n), 0.0) if n in have else F.lit(0.0)).alias(n) for n in names])


def assign_folds(df: DataFrame, label: str, key_cols: Sequence[str], folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """Stratified ``fold`` per row: position in a hash order within the class, modulo ``folds``."""
    from tablewitness.functions.scalars import shuffle_key

    hashed = df.withColumn("_h", shuffle_key(seed, "fold", key_cols))
    placed = hash_rank(hashed, [label], "_h", key_cols, "_place")
    return placed.withColumn("fold", (F.col("_place") % folds).cast("int")).drop("_place")


def assign_group_folds(df: DataFrame, label: str, group: str, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """``fold`` per row, the same for all rows of a ``group``, so that siblings never stand on both sides.

    Groups are dealt in turn, ordered by their rows of class 1, their rows and a hash: folds differ by one group in
    groups, by one group's rows of class 1 in these and, among groups with equally many of them, by one
    group's rows. A null group is one group; a null label counts as class 0.
    """
    from tablewitness.functions.scalars import shuffle_key

    of = F.col(group)
    sizes = df.groupBy(of.alias("_group")).agg(F.sum(F.coalesce((F.col(label) == 1).cast("long"), F.lit(0))).alias("_one"), F.count(F.lit(1)).alias("_all_rows"))
    sizes = sizes.withColumn("_hash", shuffle_key(seed, "fold", ["_group"]))
    dealt = ordered_index(sizes, ["_one", "_all_rows", "_hash", "_group"], name="_place")
    dealt = dealt.select("_group", (F.col("_place") % folds).cast("int").alias("fold"))
    return df.join(dealt, of.eqNullSafe(F.col("_group"))).drop("_group")


def probability_of(model, df: DataFrame, name: str) -> DataFrame:
    """Add the model's probability of class 1 as ``name``."""
    scored = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return scored.drop("probability", "rawPrediction", "prediction")


def weigh(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``w_boost`` and ``w_balanced`` from the class counts (two rows, collected)."""
    rows = class_weights(df, label).collect()
    boost = total([F.when(F.col(label) == r["label"], F.lit(float(r["boosting"] or 0))).otherwise(0.0) for r in rows])
    balanced = total([F.when(F.col(label) == r["label"], F.lit(float(r["balanced"] or 0))).otherwise(0.0) for r in rows])
    return df.withColumn("w_boost", boost).withColumn("w_balanced", balanced)


def boosted(s: Settings) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="w_boost", maxIter=s.boost_trees, stepSize=s.boost_step,
        maxDepth=s.boost_depth, minInstancesPerNode=3, subsamplingRate=0.8, featureSubsetStrategy="0.75", seed=s.seed,
    )


def fit_boosted(rows: DataFrame, s: Settings) -> GBTClassificationModel:
    """The boosted model of ``rows``. Each tree needs the scores of all trees before; checkpoints of these keep a tree's cost the same."""
    checkpoints(rows.sparkSession)
    return boosted(s).fit(rows)


def forest(s: Settings) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="w_balanced", numTrees=s.forest_trees,
        maxDepth=s.forest_depth, featureSubsetStrategy="sqrt", minInstancesPerNode=3, seed=s.seed,
    )


def isolation(df: DataFrame, names: Sequence[str], s: Settings) -> pd.DataFrame:
    """A forest of fixed size grown on the natural tables only."""
    real = df.where("label = 1").withColumn("_g", F.lit(0))
    sizes = real.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    return grow_forest(real, names, ["_g"], sizes, ["dataset_id"], s.isolation_trees, s.seed, True).toPandas()


def _range(df: DataFrame, column: str) -> tuple[float, float]:
    row = df.agg(F.min(column), F.max(column)).first()
    return (row[0], row[1]) if row[0] is not None else (-1.0, 0.0)


def _scaled(column: str, lo: float, hi: float) -> Column:
    return clip((F.col(column) - F.lit(lo)) / F.lit(hi - lo + 1e-10), 0.0, 1.0)


@dataclass
class StackedModel:
    """Everything needed to score feature rows."""

    names: list[str]
    boost: GBTClassificationModel
    trees: RandomForestClassificationModel
    isolation: pd.DataFrame
    isolation_range: tuple[float, float]
    meta: list[dict] = field(default_factory=list)

    def base_scores(self, features: DataFrame) -> DataFrame:
        """``features`` plus the three base probabilities."""
        keys = [c for c in features.columns if c not in self.names]
        rows = _vectors(align_features(features, self.names, keys), self.names)
        rows = probability_of(self.boost, rows, "p_boost")
        rows = probability_of(self.trees, rows, "p_forest")
        rows = score_one(rows, self.names, self.isolation, "_iso")
        return rows.withColumn("p_isolation", _scaled("_iso", *self.isolation_range)).drop("_iso", "features")

    def predict(self, features: DataFrame) -> DataFrame:
        """Add ``probability`` with its interval ``ci_lower`` .. ``ci_upper``."""
        rows = self.base_scores(features).withColumn("probability", clip(meta_probability(self.meta), 0.0, 1.0))
        return confidence_interval(rows)

    def save(self, path: str) -> None:
        """Write base models with their own writers, the rest as one-row tables."""
        self.boost.write().overwrite().save(f"{path}/boost")
        self.trees.write().overwrite().save(f"{path}/forest")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(self.isolation.drop(columns="_g", errors="ignore"), _FOREST).write.mode("overwrite").parquet(
            f"{path}/isolation"
        )
        about = spark.createDataFrame([(self.names, *map(float, self.isolation_range))], "names array<string>, iso_lo double, iso_hi double")
        about.write.mode("overwrite").parquet(f"{path}/about")
        spark.createDataFrame([tuple(m[k] for k in _META) for m in self.meta], _META_SCHEMA).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> StackedModel:
        about = spark.read.parquet(f"{path}/about").first()
        return StackedModel(
            list(about["names"]),
            GBTClassificationModel.load(f"{path}/boost"),
            RandomForestClassificationModel.load(f"{path}/forest"),
            spark.read.parquet(f"{path}/isolation").orderBy("tree").toPandas(),
            (about["iso_lo"], about["iso_hi"]),
            [r.asDict() for r in spark.read.parquet(f"{path}/meta").orderBy("fold").collect()],
        )


_FOREST = "tree int, size int, feature array<int>, threshold array<double>, path array<double>"
_META = ("fold", "w0", "w1", "w2", "bias", "slope", "shift")
_META_SCHEMA = "fold int, w0 double, w1 double, w2 double, bias double, slope double, shift double"


def meta_probability(meta: Sequence[dict]) -> Column:
    """Mean of the calibrated logistic scores of the folds."""

    def one(m: dict) -> Column:
        value = total([F.col(c) * F.lit(float(m[f"w{i}"])) for i, c in enumerate(MODELS)]) + F.lit(float(m["bias"]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(value * F.lit(float(m["slope"])) + F.lit(float(m["shift"])))))

    return total([one(m) for m in meta]) / F.lit(float(len(meta)))


def confidence_interval(df: DataFrame, columns: Sequence[str] = MODELS) -> DataFrame:
    """Mean of the models' probabilities, plus and minus 1.96 population deviations, within 0 and 1."""
    n = F.lit(float(len(columns)))
    mean = total([F.col(c) for c in columns]) / n
    spread = F.sqrt(total([F.pow(F.col(c) - mean, F.lit(2.0)) for c in columns]) / n)
    return df.withColumns(
        {
            "ci_lower": F.round(clip(mean - 1.96 * spread, 0.0, 1.0), 3),
            "ci_upper": F.round(clip(mean + 1.96 * spread, 0.0, 1.0), 3),
        }
    )


def _vectors(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df)


def out_of_fold(rows: DataFrame, names: Sequence[str], s: Settings) -> DataFrame:
    """Base scores of every row from models that did not see its fold."""

    def run(fold: int) -> DataFrame:
        train = weigh(rows.where(F.col("fold") != fold))
        held = rows.where(F.col("fold") == fold)
        scored = probability_of(fit_boosted(train, s), held, "p_boost")
        scored = probability_of(forest(s).fit(train), scored, "p_forest")
        scored = score_one(scored, names, isolation(train, names, s), "_iso")
        lo, hi = _range(scored, "_iso")
        return scored.withColumn("p_isolation", _scaled("_iso", lo, hi)).select("dataset_id", "label", "fold", *MODELS)

    with ThreadPoolExecutor(s.threads) as pool:
        parts = list(pool.map(run, range(FOLDS)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stage(out, "oof")


def fit_meta(oof: DataFrame, s: Settings) -> list[dict]:
    """Per fold: balanced logistic regression on the other folds, sigmoid calibration on this one."""
    rows = _vectors(oof, MODELS)

    def run(fold: int) -> dict:
        train, held = weigh(rows.where(F.col("fold") != fold)), rows.where(F.col("fold") == fold)
        n = train.count()
        base = LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="w_balanced", regParam=1.0 / (0.5 * n),
            elasticNetParam=0.0, standardization=False, maxIter=1000,
        ).fit(train)
        w, b = [float(x) for x in base.coefficients], float(base.intercept)
        value = total([F.col(c) * F.lit(x) for c, x in zip(MODELS, w)]) + F.lit(b)
        counts = held.agg(F.sum("label"), F.count(F.lit(1))).first()
        pos, neg = float(counts[0] or 0), float(counts[1] - (counts[0] or 0))
        # Platt's soft targets, written as two weighted rows per dataset.
        target = F.when(F.col("label") == 1, F.lit((pos + 1) / (pos + 2))).otherwise(F.lit(1 / (neg + 2)))
        twice = F.array(
            F.struct(F.lit(1).alias("label"), target.alias("w")), F.struct(F.lit(0).alias("label"), (1.0 - target).alias("w"))
        )
        soft = held.select(value.alias("value"), F.explode(twice).alias("_t")).select("value", "_t.*")
        platt = LogisticRegression(featuresCol="v", labelCol="label", weightCol="w", regParam=0.0, standardization=False)
        fitted = platt.fit(VectorAssembler(inputCols=["value"], outputCol="v").transform(soft))
        return dict(zip(_META, (fold, *w, b, float(fitted.coefficients[0]), float(fitted.intercept))))

    return [run(fold) for fold in range(FOLDS)]


def train(features: DataFrame, settings: Settings | None = None) -> tuple[StackedModel, DataFrame]:
    """Fit on rows ``(dataset_id, features, label)``; returns the model and its out-of-fold report.

    With a column ``base``, as ``labelled_features`` gives it, the variants of one dataset share a fold: their
    out-of-fold scores come from models that saw none of them.
    """
    s = settings or Settings()
    names = model_columns(features)
    if "base" in features.columns:
        rows = assign_group_folds(align_features(features, names, ["dataset_id", "label", "base"]), "label", "base", FOLDS, s.seed).drop("base")
    else:
        rows = assign_folds(align_features(features, names, ["dataset_id", "label"]), "label", ["dataset_id"], FOLDS, s.seed)
    rows = stage(rows, "train")
    rows = _vectors(rows, names)
    oof = out_of_fold(rows, names, s)
    full = weigh(rows)
    trees = isolation(full, names, s)
    lo, hi = _range(score_one(full.where("label = 1"), names, trees, "_iso"), "_iso")
    model = StackedModel(names, fit_boosted(full, s), forest(s).fit(full), trees, (lo, hi), fit_meta(oof, s))
    return model, report(oof.withColumn("probability", meta_probability(model.meta)), len(names))


def report(scored: DataFrame, n_features: int) -> DataFrame:
    """Training report as ``(metric, value)`` rows."""
    guess = scored.withColumn("guess", (F.col("probability") >= 0.5).cast("int"))
    cells = classification_report(guess, "label", "guess")
    per_class = cells.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.concat_ws(".", "class", F.lit(c)).alias("metric"), F.col(c).alias("value"))
                    for c in ("precision", "recall", "f1", "support")
                ]
            )
        ).alias("_r")
    ).select("_r.*")
    auc = roc_auc(guess.select(F.lit("all").alias("dataset_id"), "label", "probability"), "label", "probability")
    counts = guess.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"), F.avg((F.col("guess") == F.col("label")).cast("double")).alias("a"))
    facts = counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"))
                    for k, v in (
                        ("oof_acc", F.round("a", 4)), ("n_train", F.col("n")), ("n_features", F.lit(n_features)),
                        ("real_count", F.col("p")), ("fake_count", F.col("n") - F.col("p")),
                    )
                ]
            )
        ).alias("_r")
    ).select("_r.*")
    return (
        auc.select(F.lit("oof_auc").alias("metric"), F.round("auc", 4).alias("value")).unionByName(facts).unionByName(per_class)
    )


def train_single(features: DataFrame, settings: Settings | None = None) -> tuple[GBTClassificationModel, DataFrame]:
    """The simple variant: one boosted model, 80/20 split, report on the held-out rows."""
    s = settings or Settings(boost_step=0.08)
    names = model_columns(features)
    rows = _vectors(align_features(features, names, ["dataset_id", "label"]), names).withColumn("w_boost", F.lit(1.0))
    part, held = rows.randomSplit([0.8, 0.2], 42)
    model = fit_boosted(part, s)
    scored = probability_of(model, held, "p_real")
    return model, classification_report(scored.withColumn("guess", (F.col("p_real") >= 0.5).cast("int")), "label", "guess")


def load_or_train(spark: SparkSession, path: str, corpus, settings: Settings | None = None) -> StackedModel:
    """The saved model if there is one, else train on ``corpus()`` and save.

    Only a path that is not there leads to training; a model that cannot be read raises. A new model is
    written beside its place and moved there whole.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place):
        return StackedModel.load(spark, path)
    model, _ = train(corpus(), settings)
    written = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    model.save(written)
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(written), place):
        raise OSError(f"cannot move {written} to {path}")
    return model
