"""Secret scan with an incremental ledger of text blobs, in DataFrame operations only.

Every version of a text is addressed by its SHA-256. The ledger remembers which (blob, rule, rule
version) pairs were scanned and what was found; a run scans only pairs that the ledger lacks, each
blob once however many paths carry it, and joins the findings back to all paths.

Ledger: two Parquet folders, ``findings`` and ``scanned``. A run writes its findings first and its
scanned pairs last. Findings count only when their run stands in ``scanned``, so that a run that
broke off leaves nothing behind and is repeated as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewitness.session import scratch_path, stage


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped.

    ``quick`` holds in every text with a kept match and is cheap to test. A changed rule gets a new
    ``version``, and the ledger then scans all blobs again for this rule alone.
    """

    name: str
    pattern: str
    group: int
    least: int
    quick: str
    version: int = 1


#: The patterns of the contract, in its order, and one more kind after them.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

_FINDINGS = "run string, blob string, rule string, version int, start long, end long"
_SCANNED = "run string, blob string, rule string, version int"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def find(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Spans in texts: (blob, rule, version, start, end) in code points, ``end`` exclusive.

    ``blobs`` has unique ``blob``, ``text`` and ``todo``, the rules to apply. What lies between the
    matches and the matches alternate, so the running sum of their lengths gives the positions.
    """
    parts = []
    for rule in rules:
        whole, kept = (F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
        between = F.split("text", rule.pattern, -1)
        rows = F.transform(
            F.arrays_zip(F.transform(whole, F.length).alias("m"), F.transform(kept, F.length).alias("k"), F.slice(F.transform(between, F.length), 1, F.size(whole)).alias("b")),
            lambda x: F.struct(x["m"].cast("long").alias("m"), x["k"].cast("long").alias("k"), x["b"].cast("long").alias("b")),
        )
        wanted = F.array_contains("todo", rule.name) & F.col("text").rlike(rule.quick)
        found = F.when(wanted, rows).otherwise(F.array().cast("array<struct<m:bigint,k:bigint,b:bigint>>"))
        parts.append(F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), found.alias("found")))
    rows = (
        blobs.select("blob", F.explode(F.array(*parts)).alias("r"))
        .select("blob", "r.rule", "r.version", "r.least", F.posexplode("r.found").alias("at", "x"))
        .select("blob", "rule", "version", "least", "at", "x.*")
    )
    upto = Window.partitionBy("blob", "rule").orderBy("at")
    rows = rows.withColumn("end", F.sum(F.col("b") + F.col("m")).over(upto))
    return rows.where(F.col("k") >= F.col("least")).select("blob", "rule", "version", (F.col("end") - F.col("m")).alias("start"), "end")


def suspicious(text: Column, rules: Sequence[Rule]) -> Column:
    """Whether any rule may match: all other texts have no findings, so they need not travel."""
    return reduce(Column.__or__, [F.coalesce(text.rlike(r.quick), F.lit(False)) for r in rules], F.lit(False))


class Ledger:
    """The written state of past scans; ``path`` may not exist yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        path = f"{self.path}/{name}"
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return empty

    def scanned(self) -> DataFrame:
        return self._read("scanned", _SCANNED)

    def findings(self) -> DataFrame:
        """Findings of finished runs."""
        done = self.scanned().select("run").distinct()
        return self._read("findings", _FINDINGS).join(done, "run", "left_semi")

    def update(self, versions: DataFrame, rules: Sequence[Rule] = RULES) -> None:
        """Scan what is new in ``versions`` (text; null counts as empty)."""
        run = uuid.uuid4().hex
        text = F.when(suspicious(F.col("text"), rules), F.col("text")).otherwise("")
        blobs = versions.select(blob_of(F.col("text")).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        want = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
        seen = self.scanned().groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
        new = blobs.join(seen, "blob", "left").withColumn("new", F.array_except(want, F.coalesce("seen", F.array().cast("array<struct<rule:string,version:int>>"))))
        new = new.where(F.size("new") > 0).select("blob", "text", F.col("new.rule").alias("todo"))
        found = find(new, rules).select(F.lit(run).alias("run"), "blob", "rule", "version", "start", "end")
        found.write.mode("append").parquet(f"{self.path}/findings")
        ids = versions.select(blob_of(F.col("text")).alias("blob")).distinct().withColumn("p", F.explode(want)).select("blob", "p.rule", "p.version")
        marks = ids.join(self.scanned().select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
        # Read before the append below adds to the same folder.
        stage(marks, "marks").select(F.lit(run).alias("run"), "blob", "rule", "version").write.mode("append").parquet(f"{self.path}/scanned")


def scan(versions: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of every path: the columns of ``versions`` without text, blob, and ``spans``.

    ``spans`` is an array of (start, kind, rule, end) by start and then by the order of ``rules``;
    empty when nothing was found. Repeated rows each get theirs; null and empty texts have no spans.
    ``ledger`` is a folder kept between runs; without one each run starts afresh. Two runs that scan the same new blobs at
    once, or one that broke off and is repeated, record findings twice; they count once.
    """
    spark = versions.sparkSession
    book = Ledger(spark, ledger or scratch_path(spark, "ledger"))
    book.update(versions, rules)
    order = F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))))
    current = F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(r.version))))
    spans = (
        book.findings().where(F.col("version") == current[F.col("rule")])
        .groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", order[F.col("rule")].alias("kind"), "rule", "end"))).alias("spans"))
    )
    kept = [F.col(f"`{c}`") for c in versions.columns if c not in ("text", "blob", "spans")]
    paths = versions.select(*kept, blob_of(F.col("text")).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,kind:int,rule:string,end:bigint>>")
    return paths.join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def redact(documents: DataFrame, mark: str = "[secret]", ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Documents with every found span, overlapping ones as one, replaced by ``mark``; null texts stay null.

    ``n_chars``, where there is such a column, is counted anew for changed texts.
    """
    found = scan(documents.select("text"), ledger, rules).where(F.size("spans") > 0).dropDuplicates(["blob"])
    rows = found.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end")
    before = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(Window.partitionBy("blob").orderBy("start", "end")))
    cuts = rows.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = cuts.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    columns = documents.columns
    plain = documents.toDF(*(str(k) for k in range(len(columns))))  # so that no name clashes
    old = F.col(f"`{columns.index('text')}`")
    # Only texts that a rule may match meet the cuts; the others stay in their tasks.
    joined = plain.where(suspicious(old, rules)).withColumn("blob", blob_of(old)).join(cuts, "blob", "left")
    behind = lambda i: F.when(i > 0, F.get(F.col("_cuts")["end"], (i - 1).cast("int"))).otherwise(F.lit(0))
    upto = lambda i: F.coalesce(F.get(F.col("_cuts")["start"], i.cast("int")), F.length(old).cast("long"))  # noqa: E731  cut i, or the end
    pieces = F.transform(F.sequence(F.lit(0), F.size("_cuts")), lambda i: F.substring(old, (behind(i) + 1).cast("int"), (upto(i) - behind(i)).cast("int")))
    out = joined.withColumn("new", F.when(F.col("_cuts").isNull(), old).otherwise(F.array_join(pieces, mark)))
    changed = {"text": F.col("new")}
    if "n_chars" in columns:
        count = F.col(f"`{columns.index('n_chars')}`")
        changed["n_chars"] = F.when(F.col("_cuts").isNull(), count).otherwise(F.length("new")).cast(documents.schema["n_chars"].dataType)
    out = out.select(*(changed.get(c, F.col(f"`{k}`")).alias(str(k)) for k, c in enumerate(columns)))
    return out.unionByName(plain.where(~suspicious(old, rules))).toDF(*columns)
