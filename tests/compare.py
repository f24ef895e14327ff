"""Run registered queries next to their SQL: python tests/compare.py FOLDER [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    return str(value)


def rows_of(records: list[dict], columns: list[str]) -> list[tuple]:
    return sorted(tuple(normal(r[c]) for c in columns) for r in records)


def compare(spark, con, name: str, folder: str) -> str:
    """Empty when both sides agree, else what differs."""
    from tablewitness.checks import QUERIES, SQL

    df = QUERIES[name](spark, folder)
    mine = df.collect()
    if name not in SQL:
        return "" if mine else "no rows"
    rel = con.sql(SQL[name])
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    columns = sorted(df.columns)
    theirs = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    for c in columns:
        kind = str(rel.types[rel.columns.index(c)])
        spark_kind = df.schema[c].dataType.simpleString()
        if (kind in ("BIGINT", "INTEGER", "HUGEINT")) != (spark_kind in ("bigint", "int")) or kind.startswith("DECIMAL"):
            return f"type of {c}: {spark_kind} / {kind}"
    a, b = rows_of([r.asDict() for r in mine], columns), rows_of(theirs, columns)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, such as {bad[0]} in {columns}" if bad else ""


def main() -> None:
    from tablewitness.checks import QUERIES, SQL
    from tablewitness.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            problem = "ERROR " + str(error)[:600]
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {time.time() - start:6.2f}s {'S' if name in SQL else 'R'} {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main()
