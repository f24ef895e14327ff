"""What the optimizer makes of the operators."""

import re

from pyspark.sql import functions as F

from tablewitness.checks.registry import LINEITEM, dataset, table
from tablewitness.operators import temporal as t
from tablewitness.operators.columns import nan_to_null, with_dataset
from tablewitness.operators.histogram import column_shapes, sorted_histogram, value_histogram
from tablewitness.operators.moments import numeric_summary
from tablewitness.operators.ordering import series, shared_blocks
from tests.conftest import SMALL

BY, KEYS = ["dataset_id"], ["dataset_id", "column"]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    plan = physical(numeric_summary(dataset(spark, SMALL, "lineitem"), ["l_tax"], BY))
    assert re.search(r"ReadSchema: struct<l_tax:double>", plan)


def test_filters_reach_the_scan(spark):
    lines = table(spark, SMALL, "lineitem").where("l_quantity > 40")
    plan = physical(value_histogram(nan_to_null(with_dataset(lines, None)), ["l_quantity"], BY))
    assert "GreaterThan(l_quantity,40.0)" in plan and "ReadSchema: struct<l_quantity:double>" in plan


def test_no_window_runs_in_a_single_task_and_no_cartesian(spark):
    e = dataset(spark, SMALL, "events")
    s = series(e, ["value", "user_id"], ["event_id"], BY)
    hist = sorted_histogram(value_histogram(dataset(spark, SMALL, "lineitem"), LINEITEM, BY), BY)
    for df in (t.sequence_steps(s, KEYS, True), t.higuchi(s, KEYS), t.decomposition(s, KEYS), column_shapes(hist, BY)):
        plan = physical(df)
        assert "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_shared_blocks_need_no_further_shuffle(spark):
    s = series(dataset(spark, SMALL, "events"), ["value"], ["event_id"], BY)
    blocks = shared_blocks(s, KEYS, True)
    near = t.ahead(blocks, KEYS, 2, leads=[1, 2]).select("value", F.col("lead_1"))
    near.collect()
    plan = physical(near)
    blocks.unpersist()
    # The one shuffle and sort is inside the cached relation, below this plan.
    above = plan.split("Initial Plan")[0].split("InMemoryRelation")[0]
    assert "Window" in above and "Exchange" not in above and "Sort [" not in above


def test_column_histogram_has_one_shuffle_of_cells(spark):
    """Same rows as by range sorting, for one bucket and for many; cells travel once and nothing is written."""
    import random

    from tablewitness.operators.histogram import column_histogram, sorted_histogram, value_histogram

    rng = random.Random(1)
    cell = lambda: rng.choice([rng.gauss(0, 1), 7.0, -0.0, 0.0, None, float("nan"), float(rng.randrange(50))])
    rows = [(rng.choice("aaab"), cell(), rng.choice([1, 2, 3, None])) for _ in range(20_000)] + [("only", None, 1)]
    df = spark.createDataFrame(rows, "dataset_id string, x double, y int")
    columns = ["dataset_id", "column", "value", "cnt", "cum", "prev", "n", "lo", "hi"]
    want = sorted(map(str, sorted_histogram(value_histogram(df, ["x", "y"], ["dataset_id"]), ["dataset_id"]).select(columns).collect()))
    for bucket_rows in (1 << 17, 700):
        found = column_histogram(df, ["x", "y"], ["dataset_id"], bucket_rows)
        assert sorted(map(str, found.select(columns).collect())) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == plan.count("RepartitionByExpression") == 2  # one shuffle, read twice
        found.collect()
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    assert column_histogram(df.limit(0), ["x", "y"], ["dataset_id"]).count() == 0


def test_cells_of_a_bucket_travel_as_one_row():
    """What a task holds until its shuffle is written: few rows with lists, not a row with the names of its group for each cell."""
    import pyarrow as pa

    from tablewitness.operators.histogram import _count_cells

    batches = [pa.record_batch({"g": ["a", "b"] * 500, "x": [float((i * 7 + k) % 900) for i in range(1000)]}) for k in range(4)]
    (found,) = _count_cells(["x"], ["g"], {("a",): [[300.0, 600.0]]})(iter(batches))
    rows = found.to_pylist()
    assert [(r["g"], r["_bucket"]) for r in rows] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert sum(sum(r["_cnts"]) for r in rows) == 4000 and all(r["_values"] == sorted(set(r["_values"])) for r in rows)


def test_few_datasets_stay_in_their_tasks(spark):
    """Statistics of few datasets come to the rows; no row is shuffled by its dataset."""
    from tablewitness.operators.isolation import outlier_fraction
    from tablewitness.operators.moments import correlations, fill_means

    df = dataset(spark, SMALL, "lineitem", "l_returnflag")
    for out in (correlations(df, LINEITEM, BY), fill_means(df, LINEITEM, BY, False)):
        plan = physical(out)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    orders = dataset(spark, SMALL, "orders", "o_orderstatus")
    assert outlier_fraction(orders, ["o_totalprice"], BY, ["o_orderkey"], False, 10).count() == 3


def test_shuffled_cells_are_read_once(spark, monkeypatch):
    """Their means are those of the table, also for many datasets: nothing but the sums asks for the shuffled cells."""
    from tablewitness.operators import moments, permutation

    df = dataset(spark, SMALL, "orders", "o_orderstatus").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice")))
    names, tables = ["o_custkey", "o_totalprice"], []
    monkeypatch.setattr(moments, "centers", lambda columns, real=moments.centers: tables.append(columns) or real(columns))
    found = permutation.correlation_consistency(df, names, ["o_orderkey"], BY, 42)
    assert len(tables) == 1
    own = permutation.permuted_columns(df.select(*BY, "o_orderkey", *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)]), ["_v0", "_v1"], ["o_orderkey"], BY, 42)
    want = {r["dataset_id"]: abs(r["r"]) for r in moments.correlations(own, ["_v0", "_v1"], BY).collect()}
    real = {r["dataset_id"]: abs(r["r"]) for r in moments.correlations(df, names, BY).collect()}
    for r in found.collect():
        assert abs(r["joint_correlation_consistency"] - abs(real[r["dataset_id"]] - want[r["dataset_id"]])) < 1e-12


def test_shuffled_cells_meet_in_one_shuffle(spark, monkeypatch):
    """Parts and turns of any size give what the permuted columns give, equal keys and missing cells included."""
    from tablewitness.operators import moments, permutation

    monkeypatch.setattr(permutation, "FINE", 8)
    cell = lambda k: F.when(F.hash("id", F.lit(k)) % 9 > 0, (F.hash("id", F.lit(k)) % 1000) * 0.5)
    group = F.when(F.col("id") % 5 > 0, F.lit("a")).when(F.col("id") % 10 > 0, F.lit("b")).otherwise(F.lit("c"))
    df = spark.range(6000).select(group.alias("dataset_id"), (F.col("id") % 4000).alias("k"), *[cell(i).alias(f"c{i}") for i in range(3)])
    names = ["c0", "c1", "c2"]
    centers = moments.group_centers(df, names, BY)
    want = moments.correlations(permutation.permuted_columns(df, names, ["k"], BY, 42), names, BY, False, centers).collect()
    want = {(r["dataset_id"], r["a"], r["b"]): r["r"] for r in want}
    assert len(want) == 9
    for cells, turn_cells in ((1 << 21, 1 << 29), (1500, 1 << 29), (1500, 5000)):
        monkeypatch.setattr(permutation, "PART_CELLS", cells)
        monkeypatch.setattr(permutation, "TURN_CELLS", turn_cells)
        labels = []
        with monkeypatch.context() as counted:
            counted.setattr(permutation, "stage", lambda t, label, real=permutation.stage: labels.append((label, physical(t))) or real(t, label))
            found = permutation._mixed_correlations(df, names, ["k"], BY, 42, False, centers).collect()
        assert {(r["dataset_id"], r["a"], r["b"]) for r in found} == set(want)
        assert all(abs(r["r"] - want[r["dataset_id"], r["a"], r["b"]]) < 1e-12 for r in found)
        mixed = [plan for label, plan in labels if label == "mixed"]
        assert len(mixed) == -(-18_000 // turn_cells) and all(plan.count("Exchange") == 2 and "Window" not in plan for plan in mixed)


def test_a_profile_leaves_no_shuffle_files(spark):
    """Files of shuffles go as their jobs end, written steps with the last measure, and the session keeps its setting."""
    import os
    import time

    from tablewitness import profile
    from tablewitness.session import scratch_root

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before, folders = shuffles(), set(os.listdir(scratch_root(spark)))
    setting = spark.conf.get(key, "false")
    assert profile(table(spark, SMALL, "orders").drop("o_orderdate"), ["o_orderkey"]).count() == 1
    for _ in range(20):  # files are removed in the background
        left = {name.split("_")[1] for name in shuffles() - before}
        if len(left) <= 3:
            break
        time.sleep(0.5)
    assert len(left) <= 3  # of the count itself
    assert spark.conf.get(key, "false") == setting
    made = {name.split("-")[0] for name in set(os.listdir(scratch_root(spark))) - folders}
    assert made == {"part", "domain"}


def test_labelled_features_leave_only_their_results(spark):
    """Versions, corpora and steps go as soon as what is made of them is written; two rows of one run stay readable."""
    import os

    from tablewitness.plans.corpus import labelled_features
    from tablewitness.session import scratch_root

    folders = set(os.listdir(scratch_root(spark)))
    orders = table(spark, SMALL, "orders").where("o_orderpriority IN ('1-URGENT', '5-LOW')").drop("o_orderdate")
    rows = labelled_features(orders, ["o_orderkey"], "o_orderpriority", trees=3, methods=["uniform", "shuffled"])
    made = {name.split("-")[0] for name in set(os.listdir(scratch_root(spark))) - folders}
    assert made == {"part", "domain"}
    found = [(r["base"], r["label"]) for r in rows.select("base", "label").collect()]
    assert found.count(("1-URGENT", 1)) == found.count(("5-LOW", 1)) == 4


def test_many_groups_meet_salted_rows(spark, monkeypatch):
    from tablewitness.operators import columns

    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("dataset_id"), "id")
    stats = df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(columns.attach(df, stats, BY, False).collect())
    monkeypatch.setattr(columns, "BROADCAST_GROUPS", 10)
    salted = columns.attach(df, stats, BY, False)
    assert "_s" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(salted.collect()) == want and len(want) == 3000


def test_many_groups_do_not_pass_the_driver(spark, monkeypatch):
    """Copies of the statistics of many groups, and their spans, are never broadcast, however small their files are."""
    from tablewitness.checks import QUERIES
    from tablewitness.operators import columns, ordering

    df = spark.range(3000).select((F.col("id") % 1500).alias("dataset_id"), "id")
    stats = df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    want = sorted(ordering.ordered_index(df, ["id"], BY).collect())
    before = sorted(QUERIES["flt2_size_guards"](spark, SMALL).collect())
    for module in (columns, ordering):
        monkeypatch.setattr(module, "BROADCAST_GROUPS", 10, raising=False)
    placed = ordering.ordered_index(df, ["id"], BY)
    flags = QUERIES["flt2_size_guards"](spark, SMALL)
    for out in (columns.attach(df, stats, BY, False), placed, flags):
        assert "BroadcastExchange" not in physical(out)
    assert sorted(placed.collect()) == want and sorted(flags.collect()) == before


def test_tasks_of_a_histogram_follow_its_cells(spark, monkeypatch):
    """A task gets so many cells however few bytes they have and however few partitions the session asks for."""
    from tablewitness.operators import histogram

    df = spark.range(40_000).select(F.concat(F.lit("d"), F.col("id") % 40).alias("dataset_id"), F.col("id").cast("double").alias("a"), (F.col("id") % 7).alias("b"))
    want = sorted(map(str, histogram.column_shapes(histogram.column_histogram(df, ["a", "b"], BY), BY).collect()))
    monkeypatch.setattr(histogram, "TASK_CELLS", 1000)
    found = histogram.column_histogram(df, ["a", "b"], BY)
    assert re.search(r"RepartitionByExpression .*, 80", found._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(map(str, histogram.column_shapes(found, BY).collect())) == want


def test_tasks_of_a_histogram_hold_several_buckets():
    """A hash deals buckets to tasks: with few large ones to a task, the fullest task holds several times the mean."""
    from tablewitness.operators import histogram

    assert 8 * histogram.BUCKET_ROWS <= histogram.TASK_CELLS


def test_hash_rank_shuffles_bytes_in_the_order_of_the_text(spark):
    """Hashes travel as 16 bytes, half of their text, and give the same places."""
    from tablewitness.operators.ordering import hash_rank

    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("h"))
    want = {}
    for r in sorted(df.collect(), key=lambda r: (r.g, r.h)):
        want[r.id] = sum(1 for k in want if k % 3 == r.g)
    ranked = hash_rank(df, ["g"], "h", ["id"])
    assert {r.id: r.row_idx for r in ranked.collect()} == want
    assert "unhex" in ranked._jdf.queryExecution().optimizedPlan().toString()
