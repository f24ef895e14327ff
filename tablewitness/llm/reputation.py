"""URL filter: host reputation by empirical Bayes, with explicit rules above it.

Labelled page outcomes (bad or not) are counted for each host. A host's rate of bad pages is shrunk
towards its registered domain, the domain's towards its suffix, and the suffix's towards all pages,
each by a beta-binomial prior whose strength is estimated from the spread between the groups of that
level. A host is blocked when even the lower posterior bound of its rate is above a threshold.

All steps are aggregations with partial sums, so a host with a third of all pages is one small row
after the first stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewitness.session import stage

#: Second-level names under which hosts are registered in some countries.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "ne", "net", "or", "org")


@dataclass(frozen=True)
class Rule:
    """``name`` is host/path as written; it fits the host and its subdomains when the path starts so."""

    name: str
    verdict: str

    @property
    def host(self) -> str:
        return self.name.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.name.split("/", 1)[1]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The name of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later ones are longer and win
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where the country registers below a second level."""
    second = "|".join(SECOND_LEVEL)
    return F.regexp_extract(host, rf"((?:^|\.)(?:(?:{second})\.[a-z][a-z]|[^.]*))$", 1)


def domain_of(host: Column) -> Column:
    """One label and the suffix; a host that is a suffix itself is its own domain."""
    second = "|".join(SECOND_LEVEL)
    return F.regexp_extract(host, rf"([^.]*(?:(?:^|\.)(?:{second})\.[a-z][a-z]|\.[^.]*|))$", 1)


def _strength(groups: DataFrame) -> float:
    """How many pages the prior of a level is worth, by the method of moments.

    With rates p_i of groups of n_i pages around priors m_i, the spread beyond the binomial one gives
    rho, the correlation inside groups; the prior weighs 1 / rho - 1 pages (between 1 and 1,000).
    """
    m, n, bad = F.col("prior"), F.col("n"), F.col("bad")
    excess, scale = groups.agg(F.sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)), F.sum(n * (n - 1) * m * (1 - m))).first()
    return min(1000.0, max(1.0, 1 / max(1e-9, excess / scale if scale else 0.0) - 1))


def _shrunk(groups: DataFrame) -> tuple[Column, float]:
    """The posterior mean around the column ``prior``, and the weight of that prior."""
    weight = _strength(groups)
    return (weight * F.col("prior") + F.col("bad")) / (weight + F.col("n")), weight


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of each host: (host, domain, suffix, n, bad, rate, bound).

    ``outcomes`` has host and bad (0 or 1; null rows are left out). ``rate`` is the posterior mean,
    ``bound`` the mean less ``z`` posterior standard deviations.
    """
    hosts = (
        outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull())
        .groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    )
    hosts = stage(hosts, "hosts")  # one row for each labelled host, read once for each level
    domains, _, _ = _levels(hosts)
    hosts = hosts.join(domains.select("domain", "prior"), "domain")
    rate, weight = _shrunk(hosts)
    hosts = hosts.withColumn("rate", rate)
    return hosts.select("host", "domain", "suffix", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"), "rate", _bound(weight + F.col("n"), z).alias("bound"))


def _levels(hosts: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Posterior means, as ``prior`` of what is below, of (domain, suffix) and of (suffix); the rate of all pages."""
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    domains = total(hosts, "domain", "suffix")
    suffixes = total(domains, "suffix")
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    everything = (bad + 1) / (n + 2)
    suffixes = suffixes.withColumn("prior", F.lit(everything))
    suffixes = suffixes.select("suffix", _shrunk(suffixes)[0].alias("prior"))
    domains = domains.join(suffixes, "suffix")
    return domains.select("domain", "suffix", _shrunk(domains)[0].alias("prior")), suffixes, everything


def _bound(pages: Column, z: float) -> Column:
    """``rate`` less ``z`` standard deviations of a posterior worth so many pages."""
    return F.greatest(F.lit(0.0), F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (pages + 1)))


def with_unlabelled(names: DataFrame, hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, rate, bound) for all of ``names`` (host, each once), given ``reputation``'s rows of the labelled ones.

    A host without labelled pages has what is known of its domain, else of its suffix, else of all pages: that
    prior is its rate, and the prior's weight alone gives its bound.
    """
    domains, suffixes, everything = _levels(hosts)
    weight = _strength(hosts.join(domains.select("domain", "prior"), "domain"))
    rows = names.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    rows = rows.join(hosts.select("host", F.col("rate").alias("_rate"), F.col("bound").alias("_bound")), "host", "left")
    rows = rows.join(domains.select("domain", F.col("prior").alias("_domain")), "domain", "left")
    rows = rows.join(suffixes.select("suffix", F.col("prior").alias("_suffix")), "suffix", "left")
    rows = rows.withColumn("rate", F.coalesce("_rate", "_domain", "_suffix", F.lit(everything)))
    return rows.select("host", "rate", F.coalesce(F.col("_bound"), _bound(F.lit(weight), z)).alias("bound"))


#: Fewest pages of a host that counts as hot.
HOT_PAGES = 64


def _beside_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows with rate and bound of their host. A host with more than a thousandth of all rows, of which there are fewer than
    a thousand, is broadcast; the others meet in a shuffle in which none is large."""
    counts = stage(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "counts")
    total = counts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    often = counts.where((F.col("pages") > HOT_PAGES) & (F.col("pages") > total / 1000)).select("host", F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(often), "host", "left")
    known = hosts.select("host", "rate", "bound")
    hot = marked.where("hot").join(F.broadcast(known.join(F.broadcast(often), "host").drop("hot")), "host", "left")
    return hot.unionByName(marked.where("hot IS NULL").join(known, "host", "left")).drop("hot")


def judge(pages: DataFrame, hosts: DataFrame, rules: Sequence[Rule] = (), block_above: float = 0.5, z: float = 1.645) -> DataFrame:
    """Verdict for each page by its url: page_id, host, path, rule, verdict, rate, bound.

    Rules come first. Else a host whose lower bound is above ``block_above`` is blocked, and others are allowed. Hosts
    without labelled pages have the bound of ``with_unlabelled``. Pages with a null url or without ``://`` have the empty host.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = _beside_hosts(rows, stage(with_unlabelled(rows.select("host").distinct(), hosts, z), "judged"))
    verdict = F.when(F.coalesce(F.col("bound"), F.lit(0.0)) > block_above, "block").otherwise("allow")
    for rule in rules:
        verdict = F.when(F.col("rule") == rule.name, F.lit(rule.verdict)).otherwise(verdict)
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "rate", "bound")
