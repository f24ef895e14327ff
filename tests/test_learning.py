import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewitness.operators.corruption import METHODS, indexed, perturb
from tablewitness.operators.isolation import expected_path, forest_score, grow_tree, outlier_fraction
from tablewitness.operators.normality import shapiro_wilk
from tablewitness.operators.ordering import hash_rank, ordered_index
from tablewitness.plans import model as m
from tablewitness.plans.corpus import chosen_methods
from tablewitness.session import scratch_path, stage


def test_shapiro_known_example():
    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.7888, abs=5e-4) and p == pytest.approx(0.0067, abs=3e-4)


def test_shapiro_tells_normal_from_exponential():
    rng = np.random.default_rng(0)
    assert shapiro_wilk(rng.normal(size=200))[1] > shapiro_wilk(rng.exponential(size=200))[1]
    assert shapiro_wilk(np.ones(20)) == (1.0, 1.0)


def test_forest_ranks_planted_outliers_first():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(2000, 3)), [[9, 9, 9], [-8, 8, 9], [9, -9, 8]]])
    rows = []
    for t in range(100):
        r = np.random.default_rng([1, t])
        take = r.choice(len(x), 256, replace=False)
        f, c, p = grow_tree(x[take], r)
        rows.append((t, 256, f, c, p))
    s = forest_score(x, pd.DataFrame(rows, columns=["tree", "size", "feature", "threshold", "path"]))
    assert set(np.argsort(s)[:3]) == {2000, 2001, 2002}
    assert expected_path(np.array([1, 2]))[1] == 1.0


def test_outlier_share_same_with_one_and_many_datasets(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"dataset_id": "d", "k": range(1500), "a": rng.normal(size=1500), "b": rng.normal(size=1500)})
    df = spark.createDataFrame(pdf)
    one = outlier_fraction(df, ["a", "b"], ["dataset_id"], ["k"], True, 30).first()[1]
    many = outlier_fraction(df, ["a", "b"], ["dataset_id"], ["k"], False, 30).first()[1]
    assert one == pytest.approx(0.05, abs=0.002) and many == pytest.approx(one)


def test_hash_rank_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr("tablewitness.operators.ordering.BLOCK_ROWS", 16)
    pdf = pd.DataFrame({"g": ["a"] * 900 + ["b"] * 100, "k": range(1000)})
    df = spark.createDataFrame(pdf).withColumn("h", F.md5(F.col("k").cast("string")))
    want = {(r["g"], r["k"]): r["h"] for r in df.collect()}
    rows = hash_rank(df, ["g"], "h", ["k"]).collect()
    for g in "ab":
        keys = [r["k"] for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["row_idx"])]
        assert [want[g, k] for k in keys] == sorted(want[g, k] for k in keys)
        assert sorted(r["row_idx"] for r in rows if r["g"] == g) == list(range(len(keys)))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(50, 10, 600)
    pdf = pd.DataFrame({"ds": np.repeat(["p", "q"], 300), "k": list(range(300)) * 2, "a": a, "b": 2 * a + rng.normal(size=600),
                        "c": rng.exponential(5, 600), "s": rng.choice(["x", "y", "z"], 600, p=[0.8, 0.15, 0.05])})
    return spark.createDataFrame(pdf), pdf


def test_corruptions_change_what_they_should(table):
    df, pdf = table
    t = indexed(df, ["k"], "ds")
    out = {name: f(t).where("dataset_id = 'p'").toPandas() for name, f in METHODS.items()}
    real = pdf[pdf.ds == "p"]
    assert abs(out["shuffled"][["a", "b"]].corr().iloc[0, 1]) < 0.3 < real[["a", "b"]].corr().iloc[0, 1]
    assert sorted(out["shuffled"]["a"]) == sorted(real["a"])
    assert out["uniform"]["a"].between(real["a"].min(), real["a"].max()).all()
    grid = out["perfect_grid"].sort_values("row_idx")["a"].diff().dropna()
    assert grid.std() < 1e-9
    assert out["duplicated"]["a"].isna().mean() == pytest.approx(0.15, abs=0.07)
    assert set(out["marginal"]["a"]) <= set(real["a"])
    assert out["marginal"]["s"].value_counts(normalize=True).max() < 0.5
    assert (out["outliers"]["a"] - real["a"].mean()).abs().max() > 9 * real["a"].std()
    gaps = out["block_missing"].isna().sum().sum()
    assert 30 <= gaps < 75
    assert (out["rounded"]["a"] % 10).abs().max() == 0


def test_perturb_levels(table):
    df, pdf = table
    same = perturb(df, 0.0, ["k"], "ds").toPandas()
    assert sorted(same["a"]) == sorted(pdf["a"]) and same["s"].notna().all()
    worse = perturb(df, 1.0, ["k"], "ds")
    assert worse.count() >= 600
    assert sum(worse.select([F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in ("k", "a", "b", "c", "s")]).first()) > 0


def test_few_categories_are_drawn_where_the_rows_lie(spark, monkeypatch):
    """Few distinct cells are broadcast; the cells drawn are those of the ranked pool, empty columns of a dataset stay empty."""
    from tablewitness.operators import corruption

    df = spark.range(900).select(
        F.when(F.col("id") < 600, "p").otherwise("q").alias("ds"), "id", (F.col("id") * 1.5).alias("x"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("s"),
        F.when(F.col("id") < 600, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 11).cast("int"))).alias("d"),
    )
    t = indexed(df, ["id"], "ds")
    with monkeypatch.context() as no_pool:
        no_pool.setattr(corruption, "_draw_many", None)
        few = corruption.draw_cells(t, 7, ["s", "d"], ["s", "d"]).select("dataset_id", "row_idx", "_d_s", "_d_d")
    rows = sorted(few.collect())
    assert len(rows) == 900 and all((r["_d_d"] is None) == (r["dataset_id"] == "q") for r in rows) and len({r["_d_s"] for r in rows}) == 5
    whole = sorted(map(str, corruption.marginal(t, 7).collect()))
    monkeypatch.setattr(corruption, "BROADCAST_GROUPS", 6)  # s has ten distinct cells in all, d eleven
    assert sorted(corruption.draw_cells(t, 7, ["s", "d"], ["s", "d"]).select(few.columns).collect()) == rows
    assert sorted(map(str, corruption.marginal(t, 7).collect())) == whole


def test_steps_of_a_perturbation_are_not_shuffled_anew(spark, monkeypatch):
    """What is read several times is written once, and rows that have all their places are not sorted for them."""
    from tablewitness.operators import corruption

    df = spark.range(500).select("id", (F.col("id") % 9).cast("double").alias("a"), (F.col("id") % 5).cast("string").alias("s"))
    t = indexed(df, ["id"])
    sorts = []
    monkeypatch.setattr(corruption, "ordered_index", lambda *a, **k: sorts.append(a) or ordered_index(*a, **k))
    assert [r[0] for r in corruption.places(t).where("_pos = row_idx AND _rows = 500").agg(F.count("*")).collect()] == [500] and not sorts
    gaps = t.where("row_idx % 3 = 1")
    assert sorted((r["row_idx"], r["_pos"], r["_rows"]) for r in corruption.places(gaps).collect()) == [(3 * i + 1, i, 167) for i in range(167)]
    assert len(sorts) == 1
    labels = []
    monkeypatch.setattr(corruption, "stage", lambda t, label="stage": labels.append(label) or stage(t, label))
    perturb(df, 0.9, ["id"])
    assert labels.count("step") == 2


def test_five_methods_per_dataset(spark):
    df = spark.createDataFrame([(f"d{i}",) for i in range(50)], "dataset_id string")
    picked = chosen_methods(df).toPandas()
    assert (picked.groupby("dataset_id")["method"].nunique() == 5).all() and picked["method"].nunique() == 10


def test_stack_learns_saves_and_loads(spark):
    rng = np.random.default_rng(4)
    y = np.repeat([0, 1], 60)
    pdf = pd.DataFrame({"dataset_id": [f"d{i}" for i in range(120)], "f1": rng.normal(size=120) + 2.5 * y, "f2": rng.normal(size=120), "label": y})
    features = spark.createDataFrame(pdf)
    settings = m.Settings(boost_trees=4, boost_depth=3, forest_trees=10, forest_depth=4, isolation_trees=20)
    model, report = m.train(features, settings)
    facts = {r["metric"]: r["value"] for r in report.collect()}
    assert facts["oof_auc"] > 0.85 and facts["n_train"] == 120 and facts["n_features"] == 2
    path = scratch_path(spark, "model")
    model.save(path)
    a = model.predict(features).orderBy("dataset_id").toPandas()
    b = m.StackedModel.load(spark, path).predict(features).orderBy("dataset_id").toPandas()
    assert np.allclose(a["probability"], b["probability"])
    assert a["probability"].between(0, 1).all() and (a["ci_lower"] <= a["ci_upper"]).all()
    assert a[a.label == 1]["probability"].mean() > a[a.label == 0]["probability"].mean()


def boosted_settings(spark, monkeypatch, name):
    """Sizes of the boosted model that a query fits, and its rows, on 80 feature rows and with two trees."""
    from dataclasses import replace

    from tablewitness.checks import QUERIES, learning

    rng = np.random.default_rng(7)
    y = np.tile([0, 1], 40)
    pdf = pd.DataFrame({"dataset_id": [f"b{i // 2}#{i % 2}" for i in range(80)], "base": [f"b{i // 2}" for i in range(80)],
                        "f1": rng.normal(size=80) + 2.0 * y, "f2": rng.normal(size=80), "label": y})
    seen = []
    monkeypatch.setattr(learning, "_monthly_corpus", lambda *_: stage(spark.createDataFrame(pdf), "features"))
    monkeypatch.setattr(m, "boosted", lambda s, real=m.boosted: seen.append(s) or real(replace(s, boost_trees=2, boost_depth=2)))
    rows = QUERIES[name](spark, "").collect()
    assert spark.sparkContext.getCheckpointDir()  # else each tree would be computed from all trees before
    return [(s.boost_trees, s.boost_depth, s.boost_step) for s in seen], rows


def test_boosted_trees_have_their_full_sizes(spark, monkeypatch):
    sizes, rows = boosted_settings(spark, monkeypatch, "ml2_boosted_trees")
    assert sizes == [(300, 6, 0.06)] and len(rows) == 16


def test_the_single_model_has_its_own_sizes(spark, monkeypatch):
    sizes, rows = boosted_settings(spark, monkeypatch, "ml9_single_model_report")
    assert sizes == [(300, 6, 0.08)] and len(rows) >= 4


def test_missing_features_count_as_zero(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert m.align_features(df, ["b", "c", "a"]).first().asDict() == {"b": 0.0, "c": 0.0, "a": 1.0}


def test_group_folds_keep_siblings_together(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 10, 203)
    pdf = pd.DataFrame({"g": np.repeat([f"g{i}" if i else None for i in range(203)], sizes), "label": rng.integers(0, 2, sizes.sum())})
    out = m.assign_group_folds(spark.createDataFrame(pdf, "g string, label int"), "label", "g").toPandas()
    assert len(out) == len(pdf) and (out.groupby("g", dropna=False)["fold"].nunique() == 1).all()
    groups = out.drop_duplicates(["g"]).groupby("fold").size()
    assert groups.max() - groups.min() <= 1
    ones = out.groupby("fold")["label"].sum()
    assert ones.max() - ones.min() <= out.groupby("g", dropna=False)["label"].sum().max()


def test_report_is_made_without_siblings(spark):
    """Labels drawn per base say nothing about unseen bases, though each base's rows are alike."""
    rng = np.random.default_rng(6)
    y = np.repeat(np.arange(40) % 2, 6)
    pdf = pd.DataFrame({"dataset_id": [f"b{i // 6}#{i}" for i in range(240)], "base": [f"b{i // 6}" for i in range(240)],
                        "f1": np.repeat(rng.normal(size=40), 6), "f2": np.repeat(rng.normal(size=40), 6), "label": y})
    s = m.Settings(boost_trees=4, boost_depth=4, forest_trees=10, forest_depth=6, isolation_trees=10)
    auc = lambda df: {r["metric"]: r["value"] for r in m.train(spark.createDataFrame(df), s)[1].collect()}["oof_auc"]
    assert auc(pdf.drop(columns="base")) > 0.95 > 0.85 > auc(pdf)
