"""Column and table profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewitness.checks.registry import (
    EVENTS, LINEITEM, ORDERS, PART, dataset, query, r6, rounded, sql_long, table,
)
from tablewitness.functions.scalars import finite_or
from tablewitness.operators import sketches
from tablewitness.operators.benford import benford_error, digit_counts, first_digit_table
from tablewitness.operators.columns import categorical_columns, long_numbers, numeric_columns
from tablewitness.operators.duplicates import duplicate_share, near_duplicate_share
from tablewitness.operators.histogram import column_histogram, column_shapes, text_histogram, text_shapes, value_histogram
from tablewitness.operators.isolation import grow_forest, outlier_fraction, score_one
from tablewitness.operators.metrics import class_weights, classification_report, roc_auc
from tablewitness.operators.moments import (
    correlations, fill_means, missing_profile, numeric_summary, reconstruction_error,
)
from tablewitness.operators.normality import shapiro_columns
from tablewitness.operators.permutation import correlation_consistency
from tablewitness.plans.profile import _entropy, _shape_features, _summary_features, clustered_duplicates, rounded_share, string_variance
from tablewitness.plans.report import benford_column
from tablewitness.session import scratch_path

BY = ["dataset_id"]
DUP = ["l_quantity", "l_discount", "l_tax", "l_linestatus"]


def shapes(spark, folder, name, columns, dataset_id=None):
    df = dataset(spark, folder, name, dataset_id)
    return column_shapes(column_histogram(df, columns, BY), BY)


@query(
    "agg01_duplicate_rows",
    """SELECT l_returnflag AS dataset_id, round(sum(c - 1)::DOUBLE / sum(c), 6) AS duplicate_raw FROM (
         SELECT l_returnflag, l_quantity, l_discount, l_tax, l_linestatus, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY 1""",
)
def agg01(spark, folder):
    df = dataset(spark, folder, "lineitem", "l_returnflag").select(*BY, *DUP)
    return rounded(duplicate_share(df, BY), ["duplicate_raw"])


_ENTROPY = "-sum(c::DOUBLE / n * log2(c::DOUBLE / n + 1e-9))"


# Datasets of single suppliers, and one of all suppliers with an even number: only this one repeats itself.
_SUPPLIER = "l_suppkey % 2 * l_suppkey"
_MANY_VALUED = ("l_quantity", "l_discount", "l_tax")


@query(
    "agg02_clustered_duplicates",
    f"""WITH cells AS ({" UNION ALL ".join(f"SELECT {_SUPPLIER} AS d, '{c}' AS k, {c}::VARCHAR AS v FROM lineitem" for c in _MANY_VALUED)}),
        hist AS (SELECT d, k, v, count(*) AS c, sum(count(*)) OVER (PARTITION BY d, k) AS n FROM cells GROUP BY d, k, v),
        ent AS (SELECT d, avg(e) AS mean_entropy FROM (SELECT d, k, {_ENTROPY} AS e FROM hist GROUP BY d, k) GROUP BY d),
        dup AS (SELECT d, sum(c - 1)::DOUBLE / sum(c) AS raw FROM (SELECT {_SUPPLIER} AS d, l_quantity, l_discount, l_tax, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY 1)
        SELECT d AS dataset_id, round(mean_entropy, 6) AS mean_entropy, raw > 0.1e0 AND mean_entropy > 3.5e0 AS clustered_observations,
               round(CASE WHEN raw > 0.1e0 AND mean_entropy > 3.5e0 THEN raw * 0.3e0 ELSE raw END, 6) AS duplicate_pct
        FROM ent JOIN dup USING (d)""",
)
def agg02(spark, folder):
    df = dataset(spark, folder, "lineitem").withColumn("dataset_id", F.expr(_SUPPLIER)).select(*BY, *_MANY_VALUED)
    values = column_shapes(column_histogram(df, _MANY_VALUED, BY), BY)
    both = _entropy(df, _MANY_VALUED, [], values, BY, False).join(duplicate_share(df, BY), BY)
    clustered, value = clustered_duplicates(F.col("duplicate_raw"), F.col("mean_entropy"))
    return both.select(*BY, r6(F.col("mean_entropy")).alias("mean_entropy"), clustered.alias("clustered_observations"), r6(value).alias("duplicate_pct"))


_SNAP = "round_even(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-10) * 50, 0) AS {c}"


@query(
    "agg03_near_duplicates",
    f"""SELECT 'table' AS dataset_id, round(sum(n - 1)::DOUBLE / sum(n), 6) AS near_duplicate_ratio FROM (
        SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, count(*) AS n FROM (
          SELECT {", ".join(_SNAP.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))}, l_returnflag FROM lineitem)
        GROUP BY ALL)""",
)
def agg03(spark, folder):
    df = dataset(spark, folder, "lineitem").select(*BY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return rounded(near_duplicate_share(df, BY, True), ["near_duplicate_ratio"])


_GAPPY = "(SELECT d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _gappy(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return docs.join(labels, "doc_id", "left").select(F.col("lang").alias("dataset_id"), "n_chars", "quality", "toxic")


@query(
    "agg04_missing_share",
    f"""SELECT lang AS dataset_id, count(*) AS total_rows,
        round((avg((n_chars IS NULL)::INT) + avg((quality IS NULL)::INT) + avg((toxic IS NULL)::INT)) / 3, 6) AS missing_pct FROM {_GAPPY} GROUP BY 1""",
)
def agg04(spark, folder):
    out = missing_profile(_gappy(spark, folder), ["n_chars", "quality", "toxic"], BY)
    return rounded(out, ["missing_pct"]).drop("missing_variance")


@query(
    "agg05_missing_variance",
    f"""SELECT lang AS dataset_id, round(var_samp(((n_chars IS NULL)::INT + (quality IS NULL)::INT + (toxic IS NULL)::INT) / 3e0), 6) AS missing_variance
        FROM {_GAPPY} GROUP BY 1""",
)
def agg05(spark, folder):
    out = missing_profile(_gappy(spark, folder), ["n_chars", "quality", "toxic"], BY)
    return rounded(out, ["missing_variance"]).select(*BY, "missing_variance")


@query(
    "agg06_cardinality",
    """SELECT 'table' AS dataset_id, round((count(DISTINCT o_orderkey) + count(DISTINCT o_custkey) + count(DISTINCT o_orderstatus) + count(DISTINCT o_totalprice)
       + count(DISTINCT o_orderdate) + count(DISTINCT o_orderpriority)) / 6e0 / count(*), 6) AS mean_cardinality FROM orders""",
)
def agg06(spark, folder):
    df = dataset(spark, folder, "orders")
    cols = [c for c in df.columns if c not in BY]
    values = column_shapes(column_histogram(df, numeric_columns(df, BY), BY), BY)
    out = _entropy(df, cols, categorical_columns(df, BY), values, BY, True)
    return rounded(out, ["mean_cardinality"]).select(*BY, "mean_cardinality")


_STATE_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query(
    "agg06_stored_states",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS n, count(DISTINCT {c}) AS n_distinct, {f"min({c})::DOUBLE" if c in ORDERS else "NULL"} AS lo, {f"max({c})::DOUBLE" if c in ORDERS else "NULL"} AS hi, true AS near_distinct, true AS near_ranks FROM orders"""
        for c in _STATE_COLS
    ),
)
def agg06_states(spark, folder):
    """Orders appended in three parts; the merged states against the exact counts and ranks, within the stated errors."""
    df, path = dataset(spark, folder, "orders"), scratch_path(spark, "states")
    for part in range(3):
        sketches.append_states(df.where(F.pmod("o_custkey", F.lit(3)) == part), _STATE_COLS, BY, path)
    found = sketches.estimates(sketches.stored_states(spark, BY, path), BY)
    exact = text_histogram(df, _STATE_COLS, BY).groupBy("column").agg(F.count(F.lit(1)).alias("exact"))
    hist = column_histogram(df, ORDERS, BY).select("column", "value", "cnt", "cum", F.col("n").alias("_n"))
    marks = found.select("column", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(c).alias("at")) for q, c in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))))).alias("m"))
    met = hist.join(F.broadcast(marks.where("m.at IS NOT NULL")), "column").where(F.col("value") <= F.col("m.at"))
    far = met.groupBy("column", "m.q").agg((F.max("cum") / F.max("_n")).alias("rank"), F.max_by("cnt", "value").alias("last"), F.max("_n").alias("_n"))
    far = far.groupBy("column").agg(F.max(F.abs(F.col("rank") - F.col("q")) - F.col("last") / F.col("_n")).alias("far"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact") + 1
    return found.join(exact, "column").join(far, "column", "left").select(
        "column", "rows", "n", F.col("exact").alias("n_distinct"), "lo", "hi", near.alias("near_distinct"), F.coalesce(F.col("far") <= sketches.RANK_ERROR, F.lit(True)).alias("near_ranks"),
    )


def _rounded_sql(columns) -> str:
    return f"""SELECT l_returnflag AS dataset_id, round(sum(w)::DOUBLE / sum(n) * CASE WHEN avg(narrow::INT) > 0.5e0 THEN 0.5e0 ELSE 1e0 END, 6) AS rounded_num_ratio,
        avg(narrow::INT) > 0.5e0 AS narrow_numeric_range FROM (
          SELECT l_returnflag, "column", count(*) AS n, sum((value = floor(value))::INT) AS w, max(value) - min(value) < 50 AS narrow
          FROM ({sql_long("lineitem", columns, ["l_returnflag"])}) GROUP BY 1, 2) GROUP BY 1"""


def _rounded(spark, folder, columns):
    df = dataset(spark, folder, "lineitem", "l_returnflag").select(*BY, *columns)
    whole = _shape_features(column_shapes(column_histogram(df, columns, BY), BY), columns, BY)
    widths = _summary_features(df, numeric_summary(df, columns, BY), columns, BY)
    narrow, share = rounded_share(F.col("_whole"), F.col("_narrow"))
    return whole.join(widths, BY).select(*BY, r6(share).alias("rounded_num_ratio"), narrow.alias("narrow_numeric_range"))


@query("agg07_rounded_numbers", _rounded_sql(LINEITEM))
def agg07(spark, folder):
    return _rounded(spark, folder, LINEITEM)


@query("agg07_narrow_columns", _rounded_sql(LINEITEM[3:]))
def agg07_narrow(spark, folder):
    """Mostly narrow columns, whose share of whole numbers counts half."""
    return _rounded(spark, folder, LINEITEM[3:])


@query(
    "agg08_integer_columns",
    """SELECT lang AS dataset_id, round(((count(n_chars) = count(*))::INT + (count(quality) = count(*))::INT + (count(toxic) = count(*))::INT) / 3e0, 6) AS integer_col_ratio
       FROM (SELECT d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""",
)
def agg08(spark, folder):
    df = _gappy(spark, folder)
    cols = ["n_chars", "quality", "toxic"]
    out = _summary_features(df, numeric_summary(df, cols, BY), cols, BY)
    return out.select(*BY, r6(F.col("integer_col_ratio")).alias("integer_col_ratio"))


@query("agg09_skewness", "SELECT event_type AS dataset_id, round(skewness(value), 6) AS skewness FROM events GROUP BY 1")
def agg09(spark, folder):
    out = numeric_summary(dataset(spark, folder, "events", "event_type"), ["value"], BY)
    return out.select(*BY, r6(F.col("skewness")).alias("skewness"))


@query("agg10_kurtosis", "SELECT event_type AS dataset_id, round(kurtosis(value), 6) AS kurtosis FROM events GROUP BY 1")
def agg10(spark, folder):
    out = numeric_summary(dataset(spark, folder, "events", "event_type"), ["value"], BY)
    return out.select(*BY, r6(F.col("kurtosis")).alias("kurtosis"))


def _ks_sql(long: str, group: str) -> str:
    return f"""SELECT {group}, round(max(greatest(i / n - u, u - (i - 1) / n)), 6) AS uniform_ks FROM (
      SELECT {group}, row_number() OVER (PARTITION BY {group} ORDER BY value)::DOUBLE AS i, count(*) OVER (PARTITION BY {group})::DOUBLE AS n,
        (value - min(value) OVER (PARTITION BY {group})) / (max(value) OVER (PARTITION BY {group}) - min(value) OVER (PARTITION BY {group})) AS u
      FROM ({long})) GROUP BY {group}"""


@query("agg11_uniform_ks", _ks_sql(sql_long("lineitem", LINEITEM), '"column"'))
def agg11(spark, folder):
    return shapes(spark, folder, "lineitem", LINEITEM).select("column", r6(F.col("uniform_ks")).alias("uniform_ks"))


@query("agg11_uniform_ks_datasets", _ks_sql("SELECT event_type AS dataset_id, value FROM events", "dataset_id"))
def agg11_by(spark, folder):
    return shapes(spark, folder, "events", ["value"], "event_type").select(*BY, r6(F.col("uniform_ks")).alias("uniform_ks"))


_PAIRS = [(a, b) for i, a in enumerate(LINEITEM) for b in LINEITEM[i + 1:]]
_CORR = ", ".join(f"abs(coalesce(corr({a}, {b}), 0))" for a, b in _PAIRS)


@query(
    "agg12_mean_correlation",
    f"SELECT l_returnflag AS dataset_id, round(list_avg([{_CORR}]), 6) AS mean_abs_correlation FROM lineitem GROUP BY 1",
)
def agg12(spark, folder):
    df = dataset(spark, folder, "lineitem", "l_returnflag")
    out = correlations(df, LINEITEM, BY).groupBy(*BY).agg(F.avg(F.abs("r")).alias("mean_abs_correlation"))
    return rounded(out, ["mean_abs_correlation"])


@query(
    "agg13_correlation_consistency",
    f"""WITH {", ".join(f"p{i} AS (SELECT o_orderstatus AS d, {c}::DOUBLE AS v{i}, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', '42', '_v{i}', o_orderkey))) AS r FROM orders)" for i, c in enumerate(ORDERS))},
        mixed AS (SELECT d, r, v0, v1, v2 FROM p0 JOIN p1 USING (d, r) JOIN p2 USING (d, r)),
        after AS (SELECT d, corr(v0, v1) AS c01, corr(v0, v2) AS c02, corr(v1, v2) AS c12 FROM mixed GROUP BY d),
        before AS (SELECT o_orderstatus AS d, corr(o_orderkey, o_custkey) AS b01, corr(o_orderkey, o_totalprice) AS b02, corr(o_custkey, o_totalprice) AS b12 FROM orders GROUP BY 1)
        SELECT d AS dataset_id, round((abs(b01) + abs(b02) + abs(b12)) / 3, 6) AS mean_abs_correlation,
          round((abs(abs(b01) - abs(c01)) + abs(abs(b02) - abs(c02)) + abs(abs(b12) - abs(c12))) / 3, 6) AS joint_correlation_consistency
        FROM before JOIN after USING (d)""",
)
def agg13(spark, folder):
    df = dataset(spark, folder, "orders", "o_orderstatus")
    out = correlation_consistency(df, ORDERS, ["o_orderkey"], BY, 42)
    return rounded(out, ["mean_abs_correlation", "joint_correlation_consistency"])


def _benford_sql(long: str, group: str) -> str:
    counts = ", ".join(f"sum((d = '{k}')::INT)::DOUBLE AS d{k}" for k in range(1, 10))
    error = " + ".join(f"abs(d{k} / digits - log10(1 + 1e0 / {k}))" for k in range(1, 10))
    return f"""SELECT {group}, ({error}) / 9 AS mae FROM (
      SELECT {group}, count(*) AS n, max(value) AS hi, min(value) AS lo, sum((d <> '')::INT) AS digits, {counts}
      FROM (SELECT *, regexp_extract(value::VARCHAR, '([1-9])', 1) AS d FROM ({long})) GROUP BY {group})
      WHERE n > 30 AND hi > 10 AND hi - lo > 10 AND digits >= 20"""


@query(
    "agg14_benford_error",
    f"""SELECT "column", round(mae, 6) AS benford_mae FROM ({_benford_sql(sql_long("lineitem", LINEITEM), '"column"')})""",
)
def agg14(spark, folder):
    long = long_numbers(dataset(spark, folder, "lineitem"), BY, LINEITEM)
    out = benford_error(digit_counts(long, BY), BY)
    return out.select("column", r6(F.col("benford_mae")).alias("benford_mae"))


@query(
    "agg15_benford_columns",
    f"""SELECT dataset_id, count(*) AS benford_applicable_cols, count(*) = 0 AS benford_bypassed, round(avg(mae), 6) AS benfords_law_mae
        FROM ({_benford_sql(sql_long("lineitem", LINEITEM, ["l_returnflag AS dataset_id"]), 'dataset_id, "column"')}) GROUP BY 1""",
)
def agg15(spark, folder):
    df = dataset(spark, folder, "lineitem", "l_returnflag")
    hist = value_histogram(df, LINEITEM, BY)
    per = benford_error(digit_counts(hist, BY, "cnt"), BY)
    n = F.count(F.lit(1))
    return per.groupBy(*BY).agg(
        n.alias("benford_applicable_cols"), (n == 0).alias("benford_bypassed"), r6(F.avg("benford_mae")).alias("benfords_law_mae")
    )


_PART_COLS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query(
    "agg16_entropy",
    f"""SELECT "column", count(*) AS n_distinct, round({_ENTROPY}, 6) AS entropy FROM (
        SELECT "column", v, count(*) AS c, sum(count(*)) OVER (PARTITION BY "column") AS n FROM
          ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS v FROM part" for c in _PART_COLS)}) GROUP BY 1, 2) GROUP BY 1""",
)
def agg16(spark, folder):
    df = dataset(spark, folder, "part")
    out = text_shapes(text_histogram(df, _PART_COLS, BY), BY, True)
    return out.select("column", "n_distinct", r6(F.col("entropy")).alias("entropy"))


@query(
    "agg17_iqr_range",
    f"""SELECT dataset_id, "column", round((quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / (max(value) - min(value) + 1e-10), 6) AS iqr_range_ratio
        FROM ({sql_long("lineitem", LINEITEM, ["l_returnflag AS dataset_id"])}) GROUP BY 1, 2""",
)
def agg17(spark, folder):
    out = shapes(spark, folder, "lineitem", LINEITEM, "l_returnflag")
    return out.select(*BY, "column", r6(F.col("iqr_range_ratio")).alias("iqr_range_ratio"))


@query(
    "agg18_text_length_variance",
    "SELECT lang AS dataset_id, round((var_samp(length(text)) + var_samp(length(source))) / 2, 4) AS mean_string_len_variance FROM documents GROUP BY 1",
)
def agg18(spark, folder):
    df = dataset(spark, folder, "documents", "lang")
    return rounded(string_variance(df, ["text", "source"], BY), ["mean_string_len_variance"], 4)


@query(
    "agg19_grid_density",
    f"""SELECT "column", round(CASE WHEN count(*) < 10 THEN 0e0 ELSE stddev_pop(gap) / (avg(gap) + 1e-9) END, 6) AS grid_density FROM (
        SELECT "column", value - lag(value) OVER (PARTITION BY "column" ORDER BY value) AS gap FROM (SELECT DISTINCT * FROM ({sql_long("lineitem", LINEITEM)})))
        GROUP BY 1""",
)
def agg19(spark, folder):
    return shapes(spark, folder, "lineitem", LINEITEM).select("column", r6(F.col("grid_density")).alias("grid_density"))


@query(
    "agg20_numeric_summary",
    f"""SELECT "column", count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean,
        round(stddev_samp(value), 6) AS std FROM ({sql_long("lineitem", LINEITEM)}) GROUP BY 1""",
)
def agg20(spark, folder):
    out = numeric_summary(dataset(spark, folder, "lineitem"), LINEITEM, BY)
    return rounded(out, ["lo", "hi", "mean", "std"]).select("column", "n", "lo", "hi", "mean", "std")


@query(
    "agg21_feature_means",
    f"""SELECT dataset_id, round(coalesce(avg(s), 0), 6) AS mean_skewness, round(coalesce(avg(k), 0), 6) AS mean_kurtosis, 0.5e0 AS mean_nothing FROM (
        SELECT dataset_id, "column", skewness(value) AS s, kurtosis(value) AS k FROM ({sql_long("orders", ORDERS, ["o_orderstatus AS dataset_id"])}) GROUP BY 1, 2) GROUP BY 1""",
)
def agg21(spark, folder):
    out = numeric_summary(dataset(spark, folder, "orders", "o_orderstatus"), ORDERS, BY)
    nothing = F.avg(F.when(F.col("n") < 0, F.col("mean")))
    return out.groupBy(*BY).agg(
        r6(finite_or(F.avg("skewness"), 0.0)).alias("mean_skewness"),
        r6(finite_or(F.avg("kurtosis"), 0.0)).alias("mean_kurtosis"),
        finite_or(nothing, 0.5).alias("mean_nothing"),
    )


_LABELLED = "(SELECT d.lang, l.quality AS y, d.n_chars // 100 AS s FROM documents d JOIN labels l USING (doc_id))"


def _labelled(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return docs.join(labels, "doc_id").select(
        F.lit("table").alias("dataset_id"), F.col("quality").alias("y"), F.floor(F.col("n_chars") / 100).alias("s")
    )


@query(
    "agg22_roc_auc",
    f"""SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - p * (p + 1) / 2e0) / (p * (n - p)), 6) AS auc FROM (
        SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0 AS r, sum(y) OVER () AS p, count(*) OVER () AS n FROM {_LABELLED}) GROUP BY p, n""",
)
def agg22(spark, folder):
    return rounded(roc_auc(_labelled(spark, folder), "y", "s").select("auc"), ["auc"])


_RATE = "CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0e0 END"


@query(
    "agg22_classification_report",
    f"""WITH c AS (SELECT sum((y = 0 AND g = 0)::INT)::DOUBLE AS h0, sum((y = 1 AND g = 1)::INT)::DOUBLE AS h1, sum((g = 0)::INT)::DOUBLE AS g0, sum((g = 1)::INT)::DOUBLE AS g1,
          sum((y = 0)::INT)::DOUBLE AS y0, sum((y = 1)::INT)::DOUBLE AS y1, count(*)::DOUBLE AS n FROM (SELECT y, (s >= 5)::INT AS g FROM {_LABELLED})),
        r AS (SELECT *, {_RATE.format(a="h0", b="g0")} AS p0, {_RATE.format(a="h1", b="g1")} AS p1, {_RATE.format(a="h0", b="y0")} AS r0, {_RATE.format(a="h1", b="y1")} AS r1 FROM c),
        f AS (SELECT *, {_RATE.format(a="2 * p0 * r0", b="(p0 + r0)")} AS f0, {_RATE.format(a="2 * p1 * r1", b="(p1 + r1)")} AS f1 FROM r)
        SELECT "class", round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
          SELECT '0' AS "class", p0 AS "precision", r0 AS recall, f0 AS f1, y0 AS support FROM f UNION ALL SELECT '1', p1, r1, f1, y1 FROM f
          UNION ALL SELECT 'accuracy', (h0 + h1) / n, (h0 + h1) / n, (h0 + h1) / n, n FROM f
          UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
          UNION ALL SELECT 'weighted avg', (p0 * y0 + p1 * y1) / n, (r0 * y0 + r1 * y1) / n, (f0 * y0 + f1 * y1) / n, n FROM f)""",
)
def agg22_report(spark, folder):
    guess = _labelled(spark, folder).withColumn("g", (F.col("s") >= 5).cast("int"))
    return rounded(classification_report(guess, "y", "g"), ["precision", "recall", "f1"])


@query(
    "ml11_class_weights",
    """SELECT quality AS label, count(*) AS n, round((SELECT count(*) FROM labels) / (2e0 * count(*)), 6) AS balanced,
       round(CASE WHEN quality = 1 THEN (SELECT count(*) FROM labels WHERE quality = 0) / count(*) + 1e-5 ELSE 1e0 END, 6) AS boosting FROM labels GROUP BY 1""",
)
def ml11(spark, folder):
    return rounded(class_weights(table(spark, folder, "labels"), "quality"), ["balanced", "boosting"])


@query("mul1_shapiro")
def mul1(spark, folder):
    df = dataset(spark, folder, "lineitem")
    sizes = numeric_summary(df, LINEITEM, BY)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    long = long_numbers(df, BY, LINEITEM, keep=keys)
    return shapiro_columns(long, sizes, [*BY, "column"], [f"_k{i}" for i in range(len(keys))], 42, True)


@query("mul2_isolation_forest")
def mul2(spark, folder):
    df = dataset(spark, folder, "orders")
    return outlier_fraction(fill_means(df, ORDERS, BY, True), ORDERS, BY, ["o_orderkey"], True)


@query("mul2_isolation_forest_datasets")
def mul2_by(spark, folder):
    df = dataset(spark, folder, "orders", "o_orderstatus")
    return outlier_fraction(fill_means(df, ORDERS, BY, False), ORDERS, BY, ["o_orderkey"], False)


@query(
    "mul3_correlation_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(corr({a}, {b}), 0), 6) AS r FROM lineitem" for a, b in _PAIRS),
)
def mul3(spark, folder):
    return rounded(correlations(dataset(spark, folder, "lineitem"), LINEITEM, BY, True).select("a", "b", "r"), ["r"])


@query("mul3_reconstruction_error_table")
def mul3_table(spark, folder):
    return reconstruction_error(dataset(spark, folder, "lineitem"), LINEITEM, BY, True)


@query(
    "agg13_table_consistency",
    f"""WITH {", ".join(f"p{i} AS (SELECT {c}::DOUBLE AS v{i}, row_number() OVER (ORDER BY md5(concat_ws('|', '42', '_v{i}', o_orderkey))) AS r FROM orders)" for i, c in enumerate(ORDERS))},
        after AS (SELECT corr(v0, v1) AS c01, corr(v0, v2) AS c02, corr(v1, v2) AS c12 FROM p0 JOIN p1 USING (r) JOIN p2 USING (r)),
        before AS (SELECT corr(o_orderkey, o_custkey) AS b01, corr(o_orderkey, o_totalprice) AS b02, corr(o_custkey, o_totalprice) AS b12 FROM orders)
        SELECT 'table' AS dataset_id, round((abs(b01) + abs(b02) + abs(b12)) / 3, 6) AS mean_abs_correlation,
          round((abs(abs(b01) - abs(c01)) + abs(abs(b02) - abs(c02)) + abs(abs(b12) - abs(c12))) / 3, 6) AS joint_correlation_consistency
        FROM before, after""",
)
def agg13_table(spark, folder):
    out = correlation_consistency(dataset(spark, folder, "orders"), ORDERS, ["o_orderkey"], BY, 42, True)
    return rounded(out, ["mean_abs_correlation", "joint_correlation_consistency"])


@query("mul3_reconstruction_error")
def mul3_error(spark, folder):
    return reconstruction_error(dataset(spark, folder, "lineitem", "l_returnflag"), LINEITEM, BY, False)


@query(
    "mul4_mean_imputation",
    """SELECT d.doc_id, round(coalesce(l.quality, (SELECT avg(quality) FROM labels)), 6) AS quality, round(coalesce(l.toxic, (SELECT avg(toxic) FROM labels)), 6) AS toxic
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def mul4(spark, folder):
    docs, labels = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels")
    df = docs.join(labels, "doc_id", "left").withColumn("dataset_id", F.lit("table"))
    out = fill_means(df, ["quality", "toxic"], BY, True)
    return rounded(out, ["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query(
    "ver6_benford_chart",
    f"""SELECT "column", digit, round(coalesce(c / nullif(sum(c) OVER (PARTITION BY "column"), 0), 0), 6) AS actual, round(log10(1 + 1e0 / digit), 6) AS expected FROM (
        SELECT k."column", g.digit::INT AS digit, count(v.d)::DOUBLE AS c FROM (SELECT DISTINCT "column" FROM ({sql_long("orders", ORDERS)})) k
        CROSS JOIN range(1, 10) g(digit) LEFT JOIN (SELECT "column", regexp_extract(value::VARCHAR, '([1-9])', 1) AS d FROM ({sql_long("orders", ORDERS)})) v
        ON v."column" = k."column" AND v.d = g.digit::VARCHAR GROUP BY 1, 2)""",
)
def ver6(spark, folder):
    out = first_digit_table(table(spark, folder, "orders"), ORDERS)
    return rounded(out, ["actual", "expected"]).drop("dataset_id")


@query(
    "top2_benford_column",
    f"""SELECT dataset_id, arg_max("column", v) AS "column" FROM (SELECT dataset_id, "column", var_samp(value) AS v FROM
        ({sql_long("orders", ORDERS, ["o_orderstatus AS dataset_id"])}) GROUP BY 1, 2 HAVING count(DISTINCT value) > 10) GROUP BY 1""",
)
def top2(spark, folder):
    return benford_column(dataset(spark, folder, "orders", "o_orderstatus"), ORDERS, BY)
