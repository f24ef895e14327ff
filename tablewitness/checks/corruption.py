"""Corruption operators on whole tables, against the same hashes in SQL."""

from __future__ import annotations

from functools import reduce
from random import Random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewitness.checks.registry import ORDERS, query, rounded, sql_unit, table
from tablewitness.operators import corruption as c

_T = "t AS (SELECT 'table' AS dataset_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, * FROM orders)"
_N = "(SELECT count(*) FROM orders)"
ROW = "dataset_id, row_idx"


def _orders(spark, folder):
    return c.indexed(table(spark, folder, "orders"), ["o_orderkey"])


def _numbers(df, digits=4):
    return rounded(df, ORDERS, digits).select("row_idx", *ORDERS)


def _stat(f: str, column: str) -> str:
    return f"(SELECT {f}({column}) FROM orders)"


def _unit(tag: str, seed: int = 42) -> str:
    return sql_unit(seed, tag, ROW)


def _coin(tag: str) -> str:
    return sql_unit(42, tag, "'table'")


def _normal(tag: str, seed: int = 42) -> str:
    return f"(sqrt(-2e0 * ln(1e0 - {_unit(tag + '#r', seed)})) * cos(2e0 * 3.141592653589793e0 * {_unit(tag + '#a', seed)}))"


def _select(cells: dict[str, str], source: str = "t", digits: int = 4) -> str:
    return f"SELECT row_idx, {', '.join(f'round(({e})::DOUBLE, {digits}) AS {k}' for k, e in cells.items())} FROM {source}"


@query(
    "cor01_uniform",
    f"WITH {_T} " + _select({k: f"{_stat('min', k)} + {_unit('uniform.' + k)} * ({_stat('max', k)} - {_stat('min', k)})" for k in ORDERS}),
)
def cor01(spark, folder):
    return _numbers(c.uniform(_orders(spark, folder)))


_ALL = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _mixed_sql(columns) -> str:
    return ", ".join(
        f"m_{k} AS (SELECT {k}, row_number() OVER (ORDER BY md5(concat_ws('|', '42', '{k}', {ROW}))) - 1 AS row_idx FROM t)" for k in columns
    )


@query(
    "cor02_shuffled",
    f"WITH {_T}, {_mixed_sql(_ALL)} SELECT * FROM m_o_orderkey " + " ".join(f"JOIN m_{k} USING (row_idx)" for k in _ALL[1:]),
)
def cor02(spark, folder):
    return c.shuffled(_orders(spark, folder)).drop("dataset_id")


def _pool_sql(column: str, distinct: bool) -> str:
    what = f"SELECT DISTINCT {column}::VARCHAR AS v, 0 AS tie FROM t" if distinct else f"SELECT {column}::VARCHAR AS v, row_idx AS tie FROM t"
    return f"pool_{column} AS (SELECT v, row_number() OVER (ORDER BY v, tie) - 1 AS pos, count(*) OVER () AS m FROM ({what}))"


def _draw_sql(column: str) -> str:
    pos = f"floor({sql_unit(42, 'draw', ROW + chr(44) + ' ' + chr(39) + column + chr(39))} * (SELECT max(m) FROM pool_{column}))"
    return f"(SELECT row_idx, {pos}::BIGINT AS pos FROM t) d_{column} JOIN pool_{column} ON pool_{column}.pos = d_{column}.pos"


@query(
    "cor03_marginal",
    f"""WITH {_T}, {_pool_sql("o_totalprice", False)}, {_pool_sql("o_custkey", False)}, {_pool_sql("o_orderstatus", True)}, {_pool_sql("o_orderpriority", True)}
        SELECT t.row_idx, a.v::DOUBLE AS o_totalprice, b.v::BIGINT AS o_custkey, e.v AS o_orderstatus, f.v AS o_orderpriority FROM t
        {" ".join(f"JOIN (SELECT row_idx, v FROM {_draw_sql(k)}) {n} ON {n}.row_idx = t.row_idx" for n, k in zip("abef", ("o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority")))}""",
)
def cor03(spark, folder):
    return c.marginal(_orders(spark, folder)).select("row_idx", "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority")


_NOISE = {k: f"{_stat('avg', k)} + {_normal('normal.' + k)} * ({_stat('stddev_samp', k)} + 1e-6)" for k in ORDERS}


@query(
    "cor04_normal",
    f"WITH {_T}, z AS (SELECT row_idx, {', '.join(f'{e} AS {k}' for k, e in _NOISE.items())} FROM t) "
    + _select({k: f"CASE WHEN {_coin('bend.' + k)} > 0.5e0 THEN {k} * {k} / ((SELECT max(abs({k})) FROM z) + 1e-6) ELSE {k} END" for k in ORDERS}, "z", 3),
)
def cor04(spark, folder):
    return _numbers(c.normal(_orders(spark, folder)), 3)


@query(
    "cor05_linear_combo",
    f"WITH {_T} " + _select({k: f"{a} * 0.5e0 + {b} * 0.5e0 + {_normal('combo.' + k)} * 0.05e0" for k, (a, b) in {
        "o_orderkey": ("o_custkey", "o_totalprice"), "o_custkey": ("o_orderkey", "o_totalprice"), "o_totalprice": ("o_orderkey", "o_custkey")}.items()}),
)
def cor05(spark, folder):
    return _numbers(c.linear_combo(_orders(spark, folder)))


def _resample_sql(name: str, count: str, tag: str, source: str = "t") -> str:
    """Rows drawn with replacement, placed behind the table."""
    return f"""{name} AS (SELECT w.row_idx, {', '.join('x.' + k for k in ORDERS)} FROM (
        SELECT 'table' AS dataset_id, {_N} + row_idx AS row_idx, floor({_unit(tag)} * {_N})::BIGINT AS pick FROM {source} WHERE row_idx < {count}) w JOIN {source} x ON x.row_idx = w.pick)"""


@query(
    "cor06_duplicated",
    f"""WITH {_T}, {_resample_sql("more", f"round({_N} * 0.4)", "repeat")},
        u AS (SELECT 'table' AS dataset_id, * FROM (SELECT row_idx, {', '.join(ORDERS)} FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'drop', {ROW})), row_idx) AS p FROM t) WHERE p > round({_N} * 0.4) UNION ALL SELECT * FROM more)) """
    + _select({k: f"CASE WHEN {_unit('gap.' + k)} >= 0.15e0 THEN {k} END" for k in ORDERS}, "u"),
)
def cor06(spark, folder):
    return _numbers(c.duplicated(_orders(spark, folder)))


@query(
    "cor07_rounded",
    f"WITH {_T} " + _select({k: f"round_even({k} / pow(10e0, floor(log10(abs({_stat('avg', k)}) + 1e-5))), 0) * pow(10e0, floor(log10(abs({_stat('avg', k)}) + 1e-5)))" for k in ORDERS}),
)
def cor07(spark, folder):
    return _numbers(c.rounded(_orders(spark, folder)))


@query(
    "cor08_outliers",
    f"WITH {_T} " + _select({k: f"CASE WHEN {_unit('far.' + k)} < 0.05e0 THEN {_stat('avg', k)} + 10 * {_stat('stddev_samp', k)} * (CASE WHEN {_coin('side.' + k)} < 0.5e0 THEN -1 ELSE 1 END) ELSE {k} END" for k in ORDERS}),
)
def cor08(spark, folder):
    return _numbers(c.outliers(_orders(spark, folder)))


@query(
    "cor09_perfect_grid",
    f"WITH {_T} " + _select({k: f"{_stat('min', k)} + row_idx * (({_stat('max', k)} - {_stat('min', k)}) / ({_N} - 1e0))" for k in ORDERS}),
)
def cor09(spark, folder):
    return _numbers(c.perfect_grid(_orders(spark, folder)))


_START = f"floor({_coin('start')} * ({_N} - 10))"
_LENGTH = f"(greatest(1, floor({_N} / 10)) + floor({_coin('length')} * (greatest(2, floor({_N} / 4)) - greatest(1, floor({_N} / 10)))))"


@query(
    "cor10_block_missing",
    f"WITH {_T} SELECT row_idx, "
    + ", ".join(f"CASE WHEN NOT (row_idx >= {_START} AND row_idx < {_START} + {_LENGTH} AND floor({_coin('column')} * 6) = {i}) THEN {k} END AS {k}" for i, k in enumerate(_ALL))
    + " FROM t",
)
def cor10(spark, folder):
    return c.block_missing(_orders(spark, folder)).drop("dataset_id")


@query(
    "cor11_augment",
    f"""WITH {_T}, p AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '73', 'keep', {ROW})), row_idx) AS place FROM t) WHERE place <= round_even({_N} * 0.75e0, 0)) """
    + _select({k: f"{k} + {_normal('jitter.' + k, 73)} * ((SELECT stddev_samp({k}) FROM p) * 0.01e0 + 1e-8)" for k in ORDERS}, "p"),
)
def cor11(spark, folder):
    return _numbers(c.augment(table(spark, folder, "orders"), ["o_orderkey"], seeds=[73])[0])


@query("cor12_perturb")
def cor12(spark, folder):
    return c.perturb(table(spark, folder, "orders"), 0.6, ["o_orderkey"]).drop("dataset_id")


@query("cor13_all_methods")
def cor13(spark, folder):
    t = _orders(spark, folder)
    parts = [
        method(t).agg(
            F.lit(name).alias("method"), F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("prices"),
            F.avg("o_totalprice").alias("mean_price"),
        )
        for name, method in c.METHODS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


_SOME = Random(42).sample(list(ORDERS), int(len(ORDERS) * 0.7))


@query(
    "cor14_shuffle_some",
    f"WITH {_T}, {_mixed_sql(_SOME)} SELECT row_idx, {', '.join(f'm_{k}.{k}' if k in _SOME else f't.{k}' for k in ORDERS)} FROM t "
    + " ".join(f"JOIN m_{k} USING (row_idx)" for k in _SOME),
)
def cor14(spark, folder):
    return c.shuffle_some(_orders(spark, folder), 0.7, 42).select("row_idx", *ORDERS)


@query(
    "cor15_append_repeats",
    f"WITH {_T}, {_resample_sql('more', f'floor({_N} * 0.35)', 'append')} SELECT row_idx, {', '.join(ORDERS)} FROM t UNION ALL SELECT * FROM more",
)
def cor15(spark, folder):
    return c.append_repeats(_orders(spark, folder), 0.7, 42).select("row_idx", *ORDERS)


@query(
    "cor16_flatten_numbers",
    f"WITH {_T} " + _select({k: f"CASE WHEN {_coin('flatten.' + k)} < 0.5e0 THEN {_stat('min', k)} + {_unit('flat.' + k)} * ({_stat('max', k)} - {_stat('min', k)}) ELSE {k} END" for k in ORDERS}),
)
def cor16(spark, folder):
    return _numbers(c.flatten_numbers(_orders(spark, folder), 0.5, 42))


@query(
    "cor17_round_to_tens",
    f"WITH {_T} " + _select({k: f"CASE WHEN {_coin('flatten.' + k)} < 0.9e0 AND {_coin('tens.' + k)} < 0.5e0 AND {_unit('ten.' + k)} < 0.9e0 THEN round_even({k} / 10e0, 0) * 10 ELSE {k} END" for k in ORDERS}),
)
def cor17(spark, folder):
    return _numbers(c.round_to_tens(_orders(spark, folder), 0.9, 42))


_CATS = ("o_orderstatus", "o_orderpriority")


@query(
    "cor18_flatten_categories",
    f"""WITH {_T}, {", ".join(_pool_sql(k, True) for k in _CATS)} SELECT t.row_idx,
        {", ".join(f"CASE WHEN {_coin('even.' + k)} < 0.8e0 THEN {n}.v ELSE t.{k} END AS {k}" for n, k in zip("ab", _CATS))} FROM t
        {" ".join(f"JOIN (SELECT row_idx, v FROM {_draw_sql(k)}) {n} ON {n}.row_idx = t.row_idx" for n, k in zip("ab", _CATS))}""",
)
def cor18(spark, folder):
    return c.flatten_categories(_orders(spark, folder), 0.8, 42).select("row_idx", *_CATS)


@query(
    "cor19_blank_column",
    f"WITH {_T} SELECT row_idx, "
    + ", ".join(f"CASE WHEN NOT ({_unit('blank')} < 0.4e0 AND floor({_coin('blank')} * 6) = {i}) THEN {k} END AS {k}" for i, k in enumerate(_ALL))
    + " FROM t",
)
def cor19(spark, folder):
    return c.blank_column(_orders(spark, folder), 0.5, 42).drop("dataset_id")


@query(
    "cor20_back_to_size",
    f"""WITH {_T}, {_resample_sql("more", f"floor({_N} * 0.35)", "append")}, u AS (SELECT 'table' AS dataset_id, row_idx, {', '.join(ORDERS)} FROM t UNION ALL SELECT 'table', * FROM more)
        SELECT row_idx, {', '.join(ORDERS)} FROM u ORDER BY md5(concat_ws('|', '42', 'shrink', {ROW})) LIMIT {_N}""",
)
def cor20(spark, folder):
    t = _orders(spark, folder)
    sizes = t.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_target"))
    return c.back_to_size(c.append_repeats(t, 0.7, 42), sizes, 42, always=True).select("row_idx", *ORDERS)
