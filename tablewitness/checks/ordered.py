"""Domain detection and ordered features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewitness.checks.registry import EVENTS, ORDERS, dataset, query, r6, rounded, sql_long, table
from tablewitness.operators import temporal as t
from tablewitness.operators.domain import detect_domain, mean_autocorrelation, monotone_times, time_axis
from tablewitness.operators.histogram import column_histogram
from tablewitness.operators.ordering import series
from tablewitness.operators.stationarity import adf_test, kpss_test

BY = ["dataset_id"]
KEYS = ["dataset_id", "column"]
COLS = ["value", "user_id"]

_LONG = sql_long("events", COLS, ["event_type AS dataset_id", "event_id"])
_PART = 'PARTITION BY dataset_id, "column"'
_S = f"""s AS (SELECT *, row_number() OVER ({_PART} ORDER BY event_id) - 1 AS i, count(*) OVER ({_PART}) AS n FROM ({_LONG}))"""
_W = f"({_PART} ORDER BY i)"


def _series(spark, folder):
    return series(dataset(spark, folder, "events", "event_type"), COLS, ["event_id"], BY)


@query(
    "dom1_time_axis",
    """SELECT event_type AS dataset_id, CASE WHEN event_type <> 'click' THEN 'event_time' END AS ts_column FROM events GROUP BY 1, 2""",
)
def dom1(spark, folder):
    # Times as text; those of one dataset do not parse.
    text = F.when(F.col("event_type") == "click", F.lit("soon")).otherwise(F.col("ts").cast("string"))
    e = dataset(spark, folder, "events", None).withColumn("event_time", text)
    e = e.drop("dataset_id").withColumnRenamed("event_type", "dataset_id").select(*BY, "value", "event_time")
    return time_axis(e, BY)


@query(
    "dom2_monotone_times",
    """SELECT dataset_id, bool_and(ts IS NOT NULL AND coalesce(ts >= before, true)) AS monotone FROM (
       SELECT event_type AS dataset_id, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY CASE WHEN event_type = 'error' THEN value ELSE 0 END, event_id) AS before FROM events) GROUP BY 1""",
)
def dom2(spark, folder):
    e = dataset(spark, folder, "events", None).drop("dataset_id")
    order = F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0)
    e = e.withColumn("ord", order).withColumnRenamed("event_type", "dataset_id")
    return monotone_times(e, "ts", ["ord", "event_id"], BY)


@query(
    "dom3_mean_autocorrelation",
    f"WITH {_S} SELECT dataset_id, round(avg(abs(r)), 6) AS mean_ac FROM (SELECT dataset_id, \"column\", corr(value, nx) AS r FROM (SELECT *, lead(value) OVER {_W} AS nx FROM s) GROUP BY 1, 2) GROUP BY 1",
)
def dom3(spark, folder):
    return rounded(mean_autocorrelation(_series(spark, folder), BY, COLS), ["mean_ac"])


@query(
    "dom4_domain_type",
    f"""WITH s AS (SELECT *, row_number() OVER ({_PART} ORDER BY k) - 1 AS i FROM ({sql_long("orders", ORDERS, ["o_orderstatus AS dataset_id", "o_orderkey AS k"])})),
        ac AS (SELECT dataset_id, avg(abs(r)) AS mean_ac FROM (SELECT dataset_id, "column", corr(value, nx) AS r FROM (SELECT *, lead(value) OVER {_W} AS nx FROM s) GROUP BY 1, 2) GROUP BY 1),
        mono AS (SELECT dataset_id, bool_and(coalesce(o_orderdate >= before, true)) AS monotone, count(*) AS total_rows FROM (
          SELECT o_orderstatus AS dataset_id, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS before FROM orders) GROUP BY 1)
        SELECT dataset_id, total_rows, 'o_orderdate' AS ts_column, monotone, round(mean_ac, 6) AS mean_ac,
          CASE WHEN monotone AND mean_ac > 0.3e0 THEN 'sensor_iot' ELSE 'timeseries' END AS dataset_type, true AS is_timeseries FROM ac JOIN mono USING (dataset_id)""",
)
def dom4(spark, folder):
    return rounded(detect_domain(table(spark, folder, "orders"), ["o_orderkey"], "o_orderstatus"), ["mean_ac"])


@query(
    "dom4_sensor_domain",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
       ac AS (SELECT event_type, (abs(corr(event_id, ne)) + abs(corr(user_id, nu)) + abs(corr(value, nv))) / 3 AS mean_ac, bool_and(coalesce(nt >= ts, true)) AS monotone, count(*) AS total_rows FROM (
         SELECT *, lead(event_id) OVER w AS ne, lead(user_id) OVER w AS nu, lead(value) OVER w AS nv, lead(ts) OVER w AS nt FROM s WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) GROUP BY 1)
       SELECT event_type AS dataset_id, total_rows, 'ts' AS ts_column, monotone, round(mean_ac, 6) AS mean_ac,
         CASE WHEN monotone AND mean_ac > 0.3e0 THEN 'sensor_iot' ELSE 'timeseries' END AS dataset_type, true AS is_timeseries FROM ac""",
)
def dom4_sensor(spark, folder):
    return rounded(detect_domain(table(spark, folder, "events"), ["event_id"], "event_type"), ["mean_ac"])


_LEADS = f"SELECT *, lead(value, 1) OVER {_W} AS n1, lead(value, 2) OVER {_W} AS n2, lead(value, 5) OVER {_W} AS n5 FROM s"


@query(
    "win1_autocorrelation",
    f"WITH {_S} SELECT dataset_id, \"column\", round(corr(value, n1), 6) AS autocorr_lag1, round(corr(value, n5), 6) AS autocorr_lag5 FROM ({_LEADS}) GROUP BY 1, 2",
)
def win1(spark, folder):
    out = t.sequence_steps(_series(spark, folder), KEYS, False)
    return rounded(out, ["autocorr_lag1", "autocorr_lag5"]).select(*KEYS, "autocorr_lag1", "autocorr_lag5")


@query(
    "win2_autocorrelation_curve",
    f"""WITH {_S} SELECT dataset_id, "column", lag, round(corr(value, nx), 6) AS acf, round(1.96e0 / sqrt(max(n)), 6) AS bound FROM (
        SELECT s.*, g.lag, lead(value, g.lag::INT) OVER (PARTITION BY dataset_id, "column", g.lag ORDER BY i) AS nx FROM s CROSS JOIN range(1, 41) g(lag))
        WHERE n >= 10 AND lag < n // 2 GROUP BY 1, 2, 3""",
)
def win2(spark, folder):
    out = t.autocorrelation_curve(_series(spark, folder), KEYS)
    return rounded(out.withColumn("lag", F.col("lag").cast("long")), ["acf", "bound"])


@query(
    "win3_permutation_entropy",
    f"""WITH {_S} SELECT dataset_id, "column", round(-sum(c::DOUBLE / m * log2(c::DOUBLE / m + 1e-12)) / log2(6e0), 6) AS permutation_entropy FROM (
        SELECT *, sum(c) OVER ({_PART}) AS m FROM (SELECT dataset_id, "column", value <= n1 AS a, n1 <= n2 AS b, value <= n2 AS d, count(*) AS c
        FROM ({_LEADS}) WHERE n2 IS NOT NULL GROUP BY ALL)) GROUP BY 1, 2""",
)
def win3(spark, folder):
    out = t.permutation_entropy(_series(spark, folder), KEYS)
    return rounded(out, ["permutation_entropy"]).drop("n")


@query(
    "win4_smoothness",
    f"WITH {_S} SELECT dataset_id, \"column\", round(avg(abs(n1 - value)) / (stddev_pop(value) + 1e-10), 6) AS smoothness FROM ({_LEADS}) GROUP BY 1, 2",
)
def win4(spark, folder):
    return rounded(t.sequence_steps(_series(spark, folder), KEYS, False), ["smoothness"]).select(*KEYS, "smoothness")


@query(
    "win5_spike_fraction",
    f"""WITH {_S}, r AS (SELECT dataset_id, "column", abs(value - quantile_cont(value, 0.5) OVER ({_PART} ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS r FROM s),
        m AS (SELECT dataset_id, "column", quantile_cont(r, 0.5) AS mad FROM r GROUP BY 1, 2)
        SELECT dataset_id, "column", round(avg((r / (mad + 1e-10) > 3 * 1.4826e0)::INT), 6) AS spike_fraction FROM r JOIN m USING (dataset_id, "column") GROUP BY 1, 2""",
)
def win5(spark, folder):
    return rounded(t.spike_fraction(_series(spark, folder), KEYS, False), ["spike_fraction"])


@query(
    "win6_jump_frequency",
    f"""WITH {_S}, d AS (SELECT dataset_id, "column", stddev_samp(value) AS sd FROM s GROUP BY 1, 2)
        SELECT dataset_id, "column", round(avg(coalesce((abs(n1 - value) > 3 * (sd + 1e-10))::INT, 0)), 6) AS jump_freq FROM ({_LEADS}) JOIN d USING (dataset_id, "column") GROUP BY 1, 2""",
)
def win6(spark, folder):
    return rounded(t.sequence_steps(_series(spark, folder), KEYS, False), ["jump_freq"]).select(*KEYS, "jump_freq")


@query(
    "win7_noise_level",
    f"""WITH l AS ({_LONG}), q AS (SELECT dataset_id, "column", quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM l GROUP BY 1, 2)
        SELECT dataset_id, "column", round(quantile_cont(abs(value - med), 0.5) / (max(iqr) + 1e-10), 6) AS noise_level FROM l JOIN q USING (dataset_id, "column") GROUP BY 1, 2""",
)
def win7(spark, folder):
    hist = column_histogram(dataset(spark, folder, "events", "event_type"), COLS, BY)
    return rounded(t.noise_level(hist, BY, False), ["noise_level"])


@query(
    "win8_higuchi",
    f"""WITH {_S}, p AS (SELECT s.*, g.k, lead(value, g.k::INT) OVER (PARTITION BY dataset_id, "column", g.k ORDER BY i) AS nx FROM s CROSS JOIN range(1, 11) g(k)),
        l AS (SELECT dataset_id, "column", k, i % k AS m, avg(abs(nx - value)) * (max(n) - 1) / ((count(*) + 1) * k) AS len FROM p WHERE i < n - 2 * k GROUP BY 1, 2, 3, 4),
        c AS (SELECT dataset_id, "column", k, ln(avg(len) + 1e-12) AS y FROM l GROUP BY 1, 2, 3)
        SELECT dataset_id, "column", round(abs(regr_slope(y, ln(k))), 6) AS higuchi_slope, round(2 - abs(regr_slope(y, ln(k))), 6) AS higuchi_fd FROM c GROUP BY 1, 2""",
)
def win8(spark, folder):
    return rounded(t.higuchi(_series(spark, folder), KEYS), ["higuchi_slope", "higuchi_fd"])


@query("win9_adf_test")
def win9(spark, folder):
    return adf_test(_series(spark, folder), KEYS)


@query(
    "win10_kpss_fixed_lag",
    f"""WITH {_S}, e AS (SELECT *, value - avg(value) OVER ({_PART}) AS e FROM s),
        c AS (SELECT *, sum(e) OVER ({_PART} ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum, {", ".join(f"e * lag(e, {k}) OVER {_W} AS g{k}" for k in range(1, 5))} FROM e),
        k AS (SELECT dataset_id, "column", sum(cum * cum) / (count(*) * count(*)) AS eta, (sum(e * e) + 2 * ({" + ".join(f"{1 - k / 5}e0 * sum(g{k})" for k in range(1, 5))})) / count(*) AS s2 FROM c GROUP BY 1, 2),
        x AS (SELECT dataset_id, "column", eta / s2 AS st FROM k)
        SELECT dataset_id, "column", round(st, 6) AS kpss_stat, 4::BIGINT AS kpss_lag, round(CASE WHEN st <= 0.347e0 THEN 0.1e0
          WHEN st < 0.463e0 THEN 0.1e0 + (st - 0.347e0) * (0.05e0 - 0.1e0) / (0.463e0 - 0.347e0) WHEN st < 0.574e0 THEN 0.05e0 + (st - 0.463e0) * (0.025e0 - 0.05e0) / (0.574e0 - 0.463e0)
          WHEN st < 0.739e0 THEN 0.025e0 + (st - 0.574e0) * (0.01e0 - 0.025e0) / (0.739e0 - 0.574e0) ELSE 0.01e0 END, 6) AS kpss_p FROM x""",
)
def win10(spark, folder):
    return rounded(kpss_test(_series(spark, folder), KEYS, lag=4), ["kpss_stat", "kpss_p"])


@query("win10_kpss_automatic_lag")
def win10_auto(spark, folder):
    return kpss_test(_series(spark, folder), KEYS)


@query(
    "win11_decomposition",
    f"""WITH {_S}, w AS (SELECT dataset_id, "column", n, i, value, (sum(value) OVER ({_PART} ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)
            - 0.5e0 * lag(value, 12) OVER {_W} - 0.5e0 * lead(value, 12) OVER {_W}) / 24 AS trend FROM s WHERE n >= 48),
        ph AS (SELECT dataset_id, "column", i % 24 AS j, avg(value - trend) AS s FROM w WHERE trend IS NOT NULL GROUP BY 1, 2, 3),
        f AS (SELECT w.*, ph.s - avg(ph.s) OVER (PARTITION BY w.dataset_id, w."column", w.i // 24) * 0 AS season FROM w JOIN ph ON ph.dataset_id = w.dataset_id AND ph."column" = w."column" AND ph.j = w.i % 24)
        SELECT dataset_id, "column", round(least(greatest(var_pop(season) / (var_pop(value) + 1e-10), 0), 1), 6) AS seasonality_strength,
          round(least(var_pop(CASE WHEN trend IS NOT NULL THEN value - trend - season END), 1e6), 4) AS residual_variance, round(regr_slope(trend, i), 6) AS trend_slope FROM f GROUP BY 1, 2""",
)
def win11(spark, folder):
    out = t.decomposition(_series(spark, folder), KEYS)
    return rounded(rounded(out, ["seasonality_strength", "trend_slope"]), ["residual_variance"], 4)


_MEASURED = ("mean_autocorr_lag1", "higuchi_fd", "adf_p_value", "kpss_p_value", "seasonality_strength")
_EMPTY = {"mean_autocorr_lag1": (0.0, 0.0), "higuchi_fd": (1.5, 1.5), "adf_p_value": (0.5, 0.5), "kpss_p_value": (0.05, 0.5), "seasonality_strength": (0.0, 0.0)}


@query(
    "win12_temporal_defaults",
    f"""SELECT dataset_id, CASE WHEN ts THEN 1e0 ELSE 0e0 END AS is_timeseries, 0e0 AS is_sensor_iot,
        {", ".join(f"CASE WHEN NOT ts THEN {a}e0 WHEN n < 5 THEN 0.5e0 WHEN n < 8 THEN {b}e0 ELSE round(m, 6) END AS {c}" for c, (a, b) in _EMPTY.items())}
        FROM (SELECT c_nationkey || c_mktsegment AS dataset_id, c_nationkey % 2 = 0 AS ts, count(*) AS n, avg(c_acctbal) / 10000 AS m FROM customer GROUP BY ALL)""",
)
def win12(spark, folder):
    groups = table(spark, folder, "customer").groupBy(
        F.concat(F.col("c_nationkey"), "c_mktsegment").alias("dataset_id"), (F.col("c_nationkey") % 2 == 0).alias("is_timeseries")
    ).agg(F.count(F.lit(1)).alias("total_rows"), (F.avg("c_acctbal") / 10000).alias("_m"))
    flags = groups.withColumn("dataset_type", F.when(F.col("is_timeseries"), "timeseries").otherwise("tabular")).drop("_m")
    # One value stands for every measured feature; datasets below eight rows have none.
    names = [n for n in t.NEUTRAL if not n.startswith("is_")]
    means = groups.where("total_rows >= 8").select(*BY, *[F.col("_m").alias(n) for n in names])
    out = t.temporal_row(means, flags, BY, True)
    return rounded(out.select(*BY, "is_timeseries", "is_sensor_iot", *_MEASURED), _MEASURED)


@query("win12_temporal_features")
def win12_all(spark, folder):
    return t.temporal_features(table(spark, folder, "events"), ["event_id"], "event_type")
