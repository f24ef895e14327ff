"""Registered queries of the numbered operators, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewitness.llm import bundles, chunks, contamination, jaccard, language, licenses, packing, prefixes, repair, repeats, reputation, secrets, simhash

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(func: Query) -> Query:
        QUERIES[name] = func
        if sql is not None:
            SQL[name] = sql
        return func

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identify_documents(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


RULES = (
    reputation.Rule("com/", "allow"),
    reputation.Rule("example.com/en/", "block"),
    reputation.Rule("www.example.com/en/", "allow"),
    reputation.Rule("net/es/", "block"),
    reputation.Rule("net/fr/", "block"),
)

_SECOND = "|".join(reputation.SECOND_LEVEL)
_SQL_RULE = "CASE " + " ".join(
    f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.name}'"
    for r in sorted(RULES, key=lambda r: -len(r.name))
) + " END"
_SQL_STRENGTH = """(SELECT least(1000.0, greatest(1.0, 1 / greatest(1e-9, CASE WHEN coalesce(sum(n * (n - 1) * prior * (1 - prior)), 0) > 0
 THEN sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) / sum(n * (n - 1) * prior * (1 - prior)) ELSE 0 END) - 1)) FROM {0})"""


@query("op2_url_reputation", f"""
WITH judged AS (
 SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
outcome AS (SELECT host, CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END AS bad
 FROM judged JOIN labels ON page_id = doc_id),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, regexp_extract(host, '([^.]*(?:(?:^|\\.)(?:{_SECOND})\\.[a-z][a-z]|\\.[^.]*|))$', 1) AS domain,
 regexp_extract(host, '((?:^|\\.)(?:(?:{_SECOND})\\.[a-z][a-z]|[^.]*))$', 1) AS suffix FROM outcome WHERE bad IS NOT NULL GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM h) AS prior FROM d GROUP BY suffix),
s1 AS (SELECT suffix, (w * prior + bad) / (w + n) AS prior FROM (SELECT *, {_SQL_STRENGTH.format('s')} AS w FROM s)),
d0 AS (SELECT d.*, s1.prior FROM d JOIN s1 USING (suffix)),
d1 AS (SELECT domain, (w * prior + bad) / (w + n) AS prior FROM (SELECT *, {_SQL_STRENGTH.format('d0')} AS w FROM d0)),
h0 AS (SELECT h.*, d1.prior FROM h JOIN d1 USING (domain)),
h1 AS (SELECT host, n, w, (w * prior + bad) / (w + n) AS rate FROM (SELECT *, {_SQL_STRENGTH.format('h0')} AS w FROM h0)),
h2 AS (SELECT host, rate, greatest(0, rate - 1.645 * sqrt(rate * (1 - rate) / (w + n + 1))) AS bound FROM h1),
names AS (SELECT DISTINCT host, regexp_extract(host, '([^.]*(?:(?:^|\\.)(?:{_SECOND})\\.[a-z][a-z]|\\.[^.]*|))$', 1) AS domain,
 regexp_extract(host, '((?:^|\\.)(?:(?:{_SECOND})\\.[a-z][a-z]|[^.]*))$', 1) AS suffix FROM judged),
u AS (SELECT names.host, h2.bound AS own, coalesce(h2.rate, d1.prior, s1.prior, (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM h)) AS rate,
  {_SQL_STRENGTH.format('h0')} AS w FROM names LEFT JOIN h2 USING (host) LEFT JOIN d1 USING (domain) LEFT JOIN s1 USING (suffix)),
v AS (SELECT host, rate, coalesce(own, greatest(0, rate - 1.645 * sqrt(rate * (1 - rate) / (w + 1)))) AS bound FROM u),
r AS (SELECT *, {_SQL_RULE} AS rule FROM judged)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
 WHEN coalesce(bound, 0) > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(rate, 6) AS rate, round(bound, 6) AS bound
FROM r JOIN v ON r.host = v.host""")
def op2_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """A labelled page counts as bad when its label (same id) says toxic or low quality."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    outcomes = pages.select("page_id", reputation.host_of(F.col("url")).alias("host")).join(labels, F.col("page_id") == F.col("doc_id")).select("host", bad.alias("bad"))
    judged = reputation.judge(pages, reputation.reputation(outcomes), RULES)
    return judged.withColumns({"rate": F.round("rate", 6), "bound": F.round("bound", 6)})


def _sql_spans() -> str:
    """For each rule, the spans of each document; positions are running sums as in ``secrets.find``."""
    parts = []
    for n, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT i, {n} AS kind, '{rule.name}' AS rule, e - m AS start, e AS "end" FROM (
 SELECT i, m, g, sum(m + b) OVER (PARTITION BY i ORDER BY k) AS e FROM (
  SELECT i, unnest(ms) AS m, unnest(gs) AS g, unnest(bs[:len(ms)]) AS b, unnest(range(len(ms))) AS k FROM (
   SELECT i, list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS ms,
    list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x)) AS gs,
    list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS bs FROM d)))
 WHERE g >= {rule.least}""")
    return " UNION ALL ".join(parts)


@query("op3_secret_scan", f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_sql_spans()}),
g AS (SELECT i, count(*) FILTER (rule = 'assign') AS n_assign, count(*) FILTER (rule = 'access') AS n_access, count(*) FILTER (rule = 'hex') AS n_hex,
 string_agg(rule || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
 string_agg(rule || ':' || start || ':' || "end", ',' ORDER BY start, kind) AS spans FROM s GROUP BY i)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (i)""")
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """From an empty ledger, so that every blob is scanned."""
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda rule: F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long").alias(f"n_{rule}")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query("op5_packing")
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.edited_likeness(table(spark, folder, "documents"))


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.repeated(table(spark, folder, "documents"))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find(table(spark, folder, "documents"))


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All copies of a repeated string go, the first as well."""
    return repeats.remove(table(spark, folder, "documents"), keep_first=False, with_text=False)


@query("op11_warc_bundles", f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER w AS nth, first_value(page_id) OVER w AS best FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {bundles.base32_sql("h")} AS payload_digest,
 CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN best END AS refers_to FROM r""")
def op11_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Written below the scratch folder and read back through the seek tables."""
    return bundles.archived(table(spark, folder, "pages"))


#: DuckDB has no crc32: its table of 256 remainders, and the sum over the ASCII characters of a string.
_SQL_CRC = """crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i))"""


def _sql_crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _sql_step(to: int) -> str:
    """The least (cost, audit) in one state behind a row, before inserts: the row goes, is kept or gets another role."""
    options = [f"{{'c': c{to} + {repair.DELETE}, 'a': a{to} || 'D'}}"]
    moves = {1: [(0, "s")], 2: [(i, "u") for i in (0, 1, 3)], 3: [(2, "a")]}.get(to, [])
    for i, role in moves:
        options.append(f"CASE WHEN initial = '{role}' AND fault IS NOT DISTINCT FROM kept THEN {{'c': c{i} + late, 'a': a{i} || 'K'}} END")
        if role != "s":
            options.append(f"CASE WHEN fault IS NOT DISTINCT FROM kept THEN {{'c': c{i} + late + {repair.REROLE}, 'a': a{i} || 'R'}} END")
    return f"list_min([{', '.join(options)}])"


_SQL_INSERTS = f"""list_min([m2, {{'c': m0.c + {repair.INSERT}, 'a': m0.a || 'I'}}, {{'c': m1.c + {repair.INSERT}, 'a': m1.a || 'I'}}, {{'c': m3.c + {repair.INSERT}, 'a': m3.a || 'I'}}]) AS e2,
 list_min([m3, {{'c': m2.c + {repair.INSERT}, 'a': m2.a || 'I'}}, {{'c': m0.c + {2 * repair.INSERT}, 'a': m0.a || 'II'}}, {{'c': m1.c + {2 * repair.INSERT}, 'a': m1.a || 'II'}}]) AS e3"""
_FAR = 1_000_000_000


@query("op12_conversation_repair", f"""
WITH RECURSIVE {_SQL_CRC},
d AS (SELECT *, {_sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS damage FROM conversations, crc),
x AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
 CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
 unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
y AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest, coalesce(conv_id::VARCHAR, ' ') AS k, left(role, 1) AS initial,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS nth,
 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM x),
z AS (SELECT *, CASE WHEN rest = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
 lag(initial) OVER (PARTITION BY conv_id ORDER BY nth) || initial AS pair FROM y),
rows AS MATERIALIZED (SELECT *, CASE WHEN fault = 'truncated' THEN fault END AS kept, CASE WHEN fault = 'truncated' THEN {repair.TRUNCATED} ELSE 0 END AS late FROM z),
walk AS (
 SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') AS k, 0::BIGINT AS nth, 0::BIGINT AS c0, '' AS a0, {_FAR}::BIGINT AS c1, '' AS a1, {repair.INSERT}::BIGINT AS c2, 'I' AS a2, {2 * repair.INSERT}::BIGINT AS c3, 'II' AS a3 FROM conversations
 UNION ALL SELECT k, nth, m0.c, m0.a, m1.c, m1.a, e2.c, e2.a, e3.c, e3.a FROM (SELECT k, nth, m0, m1, {_SQL_INSERTS} FROM (
  SELECT w.k, r.nth, {_sql_step(0)} AS m0, {_sql_step(1)} AS m1, {_sql_step(2)} AS m2, {_sql_step(3)} AS m3 FROM walk w JOIN rows r ON r.k = w.k AND r.nth = w.nth + 1))),
best AS (SELECT k, nth, unnest(list_min([{{'cost': c0, 'audit': a0}}, {{'cost': c3, 'audit': a3}}])) FROM walk QUALIFY row_number() OVER (PARTITION BY k ORDER BY nth DESC) = 1),
steps AS (SELECT k, cost, audit, unnest(range(1, length(audit) + 1)) AS p FROM best),
seen AS (SELECT k, p, audit[p] AS edit, length(replace(audit[1:p], 'I', '')) AS nth, length(replace(audit[1:p], 'D', '')) AS line FROM steps),
kept AS (SELECT s.*, r.role, r.text, max(CASE WHEN line = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.k) AS led FROM seen s LEFT JOIN rows r ON r.k = s.k AND r.nth = s.nth),
repaired AS (SELECT k, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (line - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS h FROM kept WHERE edit <> 'D' GROUP BY k),
sums AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY k)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 cost, audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k FROM conversations) c JOIN best USING (k) LEFT JOIN sums USING (k) LEFT JOIN repaired USING (k)""")
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, folder, "conversations")))


@query("op13_prefix_trie", f"""
WITH {_SQL_CRC},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS nth FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS opener, {_sql_crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, nth, role, text FROM c JOIN t ON t.conv_id = opener AND nth <= h UNION ALL SELECT c.conv_id, nth, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND nth > h),
m AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(role || chr(1) || md5(text)), '') OVER w AS p, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY nth ROWS UNBOUNDED PRECEDING) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM m GROUP BY p, depth),
kids AS (SELECT left(p, 32 * (depth - 1)) AS p, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids USING (p)),
sub AS (SELECT left(p, 32 * e) AS p, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS e FROM v) GROUP BY 1),
ends AS (SELECT p, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY p)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN sub USING (p) LEFT JOIN ends USING (p) LEFT JOIN n up ON v.depth > 0 AND up.depth = v.depth - 1 AND up.p = left(v.p, 32 * (v.depth - 1))""")
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(prefixes.rebuilt(table(spark, folder, "conversations")))
