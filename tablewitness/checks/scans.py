"""Sources, sinks, samples, projections, filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewitness.checks.registry import EVENTS, LINEITEM, ORDERS, dataset, query, r6, rounded, sql_long, table
from tablewitness.functions.scalars import dataset_slug, is_dataset_page, suspicious_name
from tablewitness.operators.benford import benford_error, digit_counts
from tablewitness.operators.blocks import packed
from tablewitness.operators.columns import categorical_columns, column_position, long_numbers, numeric_columns
from tablewitness.operators.corruption import append_repeats, chosen_exactly, indexed
from tablewitness.operators.histogram import text_shapes, value_histogram
from tablewitness.operators.moments import numeric_summary, reconstruction_error
from tablewitness.operators.ordering import series
from tablewitness.operators.temporal import decomposition, sequence_steps
from tablewitness.plans.profile import _order_entropy, sampled_entropy
from tablewitness.session import scratch_path, stage
from tablewitness.sources.csv import read_csv, read_csv_folder, read_first_csv
from tablewitness.sources.tables import read_table, sample_rows, write_csv, write_report


def _orders_text(spark, folder):
    """Orders as text cells: missing prices for one priority, a comma within the priority of urgent rows."""
    o = table(spark, folder, "orders")
    price = F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("NA")).otherwise(F.col("o_totalprice").cast("string"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("1-URGENT,surplus")).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", price.alias("o_totalprice"), urgent.alias("o_orderpriority"))


def _note(key):
    """A text with a line end, a comma and quotes."""
    return F.concat(F.lit("no.\n"), F.col(key).cast("string"), F.lit(', "x"')).alias("note")


@query(
    "src1_csv_scan",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '2-HIGH' THEN o_totalprice END AS o_totalprice, o_orderpriority
       FROM orders WHERE o_orderpriority <> '1-URGENT'""",
)
def src1(spark, folder):
    path = scratch_path(spark, "csv")
    # The reader does not know this quote mark, so urgent rows come back with a field too many.
    _orders_text(spark, folder).write.option("header", True).option("quote", "'").csv(path)
    return read_csv(spark, path)


@query(
    "src2_csv_folder",
    """SELECT 'o_orderstatus=' || o_orderstatus AS dataset, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) AS n_notes, max('no.' || chr(10) || o_orderkey::VARCHAR || ', "x"') AS last_note
       FROM orders GROUP BY 1""",
)
def src2(spark, folder):
    path = scratch_path(spark, "folder")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", _note("o_orderkey"), "o_orderstatus")
    orders.write.partitionBy("o_orderstatus").option("header", True).option("escape", '"').csv(path)
    (files,) = read_csv_folder(spark, path)
    name = F.regexp_extract("dataset_id", r"(o_orderstatus=[^/]+)/", 1).alias("dataset")
    return files.groupBy(name).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("o_totalprice"), 2).alias("total"), F.count("note").alias("n_notes"), F.max("note").alias("last_note"))


@query("src3_first_csv", """SELECT p_partkey, 'no.' || chr(10) || p_partkey::VARCHAR || ', "x"' AS note, p_retailprice FROM part WHERE p_type = (SELECT min(p_type) FROM part)""")
def src3(spark, folder):
    path = scratch_path(spark, "bundle")
    part = table(spark, folder, "part").select("p_partkey", _note("p_partkey"), "p_retailprice", "p_type")
    # One file per type: the rows of a type meet in one task, which is how a bundle of single files is made.
    part.repartition("p_type").write.partitionBy("p_type").option("header", True).option("escape", '"').csv(path)
    return read_first_csv(spark, path)


@query(
    "src4_parquet_scan",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
       FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' GROUP BY 1, 2""",
)
def src4(spark, folder):
    lines = read_table(spark, f"{folder}/lineitem.parquet").where("l_shipdate >= timestamp_ntz '1997-01-01 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity"), 2).alias("quantity")
    )


_PAGE = "(CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://www.kaggle.com/datasets/' || replace(url, 'http://', '') END)"


@query(
    "src5_dataset_slug",
    f"""SELECT page_id, contains(u, 'kaggle.com/datasets/') AS is_dataset,
        CASE WHEN len(parts) > 1 THEN parts[1] || '/' || parts[2] ELSE '' END AS slug
        FROM (SELECT page_id, u, string_split(regexp_replace(regexp_replace(u, '^/+|/+$', '', 'g'), '^.*datasets/', ''), '/') AS parts
              FROM (SELECT page_id, {_PAGE} AS u FROM pages))""",
)
def src5(spark, folder):
    # Half of the given addresses are rewritten to dataset pages, so both outcomes occur.
    p = table(spark, folder, "pages").select("page_id", F.expr(_PAGE).alias("u"))
    return p.select("page_id", is_dataset_page(F.col("u")).alias("is_dataset"), dataset_slug(F.col("u")).alias("slug"))


@query("snk1_csv_sink", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def snk1(spark, folder):
    path = scratch_path(spark, "sink")
    write_csv(table(spark, folder, "supplier"), path)
    return read_csv(spark, path)


@query("snk2_json_report", "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY lang")
def snk2(spark, folder):
    path = scratch_path(spark, "report")
    docs = table(spark, folder, "documents")
    write_report(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("n_chars")).alias("mean_chars")), path)
    return spark.read.json(path)


_SAMPLED = "(SELECT * FROM {t} ORDER BY md5(concat_ws('|', '42', 'sample', {k})), {k} LIMIT {n})"


@query(
    "sam1_row_sample",
    "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total FROM "
    + _SAMPLED.format(t="orders", k="o_orderkey", n=5000),
)
def sam1(spark, folder):
    s = sample_rows(table(spark, folder, "orders"), 5000, ["o_orderkey"])
    return s.agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), r6(F.sum("o_totalprice"), 2).alias("total")
    )


@query("sam2_feature_sample")
def sam2(spark, folder):
    df = dataset(spark, folder, "orders")
    out = sampled_entropy(df, ["o_totalprice", "o_orderstatus", "o_orderpriority"], ["dataset_id"], ["o_orderkey"], 5000, 42, True)
    return out.select("column", "n", "entropy")


@query("prj1_numeric_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def prj1(spark, folder):
    df = table(spark, folder, "orders")
    return df.select(*numeric_columns(df))


@query(
    "prj1_other_columns",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY 1, 2",
)
def prj1_other(spark, folder):
    df = table(spark, folder, "orders")
    df = df.select(*categorical_columns(df))
    return df.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderdate").alias("days")
    )


@query(
    "prj2_first_columns",
    f"SELECT \"column\", count(*) AS n, round(max(value), 6) AS hi FROM ({sql_long('lineitem', LINEITEM[:5])}) GROUP BY 1",
)
def prj2(spark, folder):
    long = long_numbers(dataset(spark, folder, "lineitem"), [], LINEITEM)
    first = long.where(column_position(LINEITEM) < 5)
    return first.groupBy("column").agg(F.count(F.lit(1)).alias("n"), r6(F.max("value")).alias("hi"))


@query(
    "prj3_long_form",
    f"SELECT \"column\", count(*) AS n, round(sum(value), 2) AS total FROM ({sql_long('lineitem', LINEITEM)}) GROUP BY 1",
)
def prj3(spark, folder):
    long = long_numbers(dataset(spark, folder, "lineitem"), [], LINEITEM)
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 2).alias("total"))


@query(
    "prj4_feature_order",
    """SELECT event_type, round(avg(value), 6) AS mean_value, round(coalesce(avg(CASE WHEN value > 400 THEN value END), 0e0), 6) AS mean_large,
       0e0 AS not_measured FROM events GROUP BY event_type""",
)
def prj4(spark, folder):
    from tablewitness.plans.model import align_features

    e = table(spark, folder, "events").groupBy("event_type").agg(
        F.avg(F.when(F.col("value") > 400, F.col("value"))).alias("mean_large"), F.avg("value").alias("mean_value")
    )
    names = ["mean_value", "mean_large", "not_measured"]
    return rounded(align_features(e, names, ["event_type"]), names)


@query(
    "prj5_column_sanity",
    """SELECT source, count(*) AS n, round(avg(CASE WHEN regexp_matches(lower(name), '(unnamed|col_\\d+|var_\\d+)') THEN 1e0 ELSE 0e0 END), 6) AS sanity
       FROM (SELECT source, CASE WHEN n_chars % 3 = 0 THEN 'Var_' || n_chars WHEN n_chars % 3 = 1 THEN 'Unnamed: ' || doc_id ELSE lang || n_chars END AS name
             FROM documents) GROUP BY source""",
)
def prj5(spark, folder):
    # Column names made from the documents, a third each of two machine-made kinds and a plain one.
    name = (
        F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("Var_"), F.col("n_chars")))
        .when(F.col("n_chars") % 3 == 1, F.concat(F.lit("Unnamed: "), F.col("doc_id")))
        .otherwise(F.concat("lang", "n_chars"))
    )
    docs = table(spark, folder, "documents").select("source", name.alias("name"))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(suspicious_name(F.col("name")).cast("double"))).alias("sanity")
    )


@query(
    "flt1_drop_missing",
    """SELECT "column", count(*) AS n, max(row_idx) AS last, round(sum(row_idx * value), 2) AS weighted FROM (
         SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY event_id) - 1 AS row_idx FROM (
           SELECT event_id, 'value' AS "column", value FROM events WHERE event_type <> 'error'
           UNION ALL SELECT event_id, 'user_id', user_id::DOUBLE FROM events WHERE user_id % 7 <> 0)) GROUP BY 1""",
)
def flt1(spark, folder):
    e = dataset(spark, folder, "events")
    gappy = e.withColumns(
        {
            "value": F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")),
            "user_id": F.when(F.col("user_id") % 7 != 0, F.col("user_id")),
        }
    )
    s = series(gappy, ["value", "user_id"], ["event_id"], ["dataset_id"])
    return s.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.max("row_idx").alias("last"), r6(F.sum(F.col("row_idx") * F.col("value")), 2).alias("weighted")
    )


@query(
    "flt2_size_guards",
    """SELECT c_nationkey, count(c_acctbal) AS n, count(c_acctbal) > 3 AS shape, count(c_acctbal) >= 8 AS ordered,
       count(c_acctbal) >= 20 AS seasonal, count(c_acctbal) > 30 AND max(c_acctbal) > 10 AND max(c_acctbal) - min(c_acctbal) > 10 AS benford,
       count(*) > 10 AS forest FROM (SELECT c_acctbal, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey WHEN c_nationkey % 3 = 1 THEN 100 + c_custkey % 9 * c_nationkey
         ELSE 1000 + c_custkey // 5 END AS c_nationkey FROM customer) GROUP BY 1""",
)
def flt2(spark, folder):
    """Which measures the product gives for datasets of nations, and of parts of nations down to single customers."""
    by = ["dataset_id"]
    nation, cust = F.col("c_nationkey"), F.col("c_custkey")
    small = F.when(nation % 3 == 0, nation).when(nation % 3 == 1, 100 + cust % 9 * nation).otherwise(1000 + F.floor(cust / 5))
    t = dataset(spark, folder, "customer").withColumn("dataset_id", small.cast("bigint")).select(*by, "c_custkey", "c_acctbal")
    keys = [*by, "column"]
    s = stage(packed(series(t, ["c_acctbal"], ["c_custkey"], by), keys, False), "series")
    there = lambda df, name: df.select(*by, F.lit(True).alias(name))
    out = numeric_summary(t, ["c_acctbal"], by).select(*by, "n", F.col("skewness").isNotNull().alias("shape"))
    measured = [
        there(_order_entropy(sequence_steps(s, keys, False), ["c_acctbal"], by), "ordered"),
        there(decomposition(s, keys), "seasonal"),
        there(benford_error(digit_counts(long_numbers(t, by, ["c_acctbal"]), by), by), "benford"),
        there(reconstruction_error(t, ["c_acctbal"], by, False).where("reconstruction_error IS NOT NULL"), "forest"),
    ]
    for m in measured:
        out = out.join(m.hint("merge"), by, "left")
    flags = ("ordered", "seasonal", "benford", "forest")
    return out.select(F.col("dataset_id").alias("c_nationkey"), "n", "shape", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])


@query("flt3_feature_columns", "SELECT event_type, round(avg(value), 6) AS mean_value, count(*)::DOUBLE AS n FROM events GROUP BY 1")
def flt3(spark, folder):
    from tablewitness.plans.model import model_columns

    e = table(spark, folder, "events").groupBy("event_type").agg(
        F.avg("value").alias("mean_value"),
        F.count(F.lit(1)).cast("double").alias("n"),
        F.struct(F.min("ts").alias("first")).alias("context_flags"),
        F.first("event_type").alias("dataset_type"),
    )
    return rounded(e.select("event_type", *model_columns(e)), ["mean_value"])


@query(
    "top1_sorted_distinct",
    f"""SELECT "column", round(value, 6) AS value, cnt FROM (SELECT "column", value, count(*) AS cnt FROM ({sql_long('part', ['p_size', 'p_retailprice'])}) GROUP BY 1, 2)""",
)
def top1(spark, folder):
    hist = value_histogram(dataset(spark, folder, "part"), ["p_size", "p_retailprice"], ["dataset_id"])
    return hist.orderBy("column", "value").select("column", r6(F.col("value")).alias("value"), "cnt")


@query(
    "set1_union_all",
    "SELECT kind, count(*) AS n, round(sum(amount), 2) AS total FROM (SELECT 'c' AS kind, c_acctbal AS amount FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier) GROUP BY 1",
)
def set1(spark, folder):
    c = table(spark, folder, "customer").select(F.lit("c").alias("kind"), F.col("c_acctbal").alias("amount"))
    s = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("amount"), F.lit("s").alias("kind"))
    return c.unionByName(s).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("amount"), 2).alias("total"))


@query(
    "set1_repeats_appended",
    """WITH t AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), n AS (SELECT count(*) AS n FROM t),
        more AS (SELECT floor(('0x' || substr(md5(concat_ws('|', '42', 'append', 'table', i)), 1, 13))::BIGINT / 4503599627370496e0 * n)::BIGINT AS j FROM t, n WHERE i < floor(n * 0.4e0))
        SELECT s_suppkey, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM (SELECT i FROM t UNION ALL SELECT j FROM more) JOIN t USING (i) GROUP BY 1""",
)
def set1_repeats(spark, folder):
    """A table with repeats of its own rows appended: how often each row is there."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    out = append_repeats(indexed(supplier, ["s_suppkey"]), 0.8, 42)
    return out.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("s_acctbal"), 2).alias("total"))


@query(
    "set2_sampled_rows_dropped",
    """WITH t AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
        SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'drop', 'table', i)), i) AS p, count(*) OVER () AS n FROM t)
        WHERE p > round(n * 0.4e0)""",
)
def set2_sampled(spark, folder):
    """The rows that stay when exactly 40 of 100 are dropped by the hash of their place."""
    t = stage(indexed(table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars"), ["doc_id"]), "rows")
    drop = t.groupBy("dataset_id").agg(F.round(F.count(F.lit(1)) * 0.4).cast("long").alias("_want"))
    return chosen_exactly(t, drop, 42, "drop").where("NOT _chosen").select("doc_id", "lang", "source", "n_chars")


@query(
    "set2_drop_row_set",
    "SELECT doc_id, lang, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def set2(spark, folder):
    drop = table(spark, folder, "labels").select("doc_id")
    return table(spark, folder, "documents").join(drop, "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars")
