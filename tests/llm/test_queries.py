"""The registered queries: those with SQL next to DuckDB, and the guard of the entry module."""

import math
from collections import Counter

import pytest

from tablewitness.llm import reputation
from tablewitness.llm.queries import QUERIES, SQL
from tests.compare import oracle
from tests.conftest import SMALL


def _plain(value):
    return round(value, 5) + 0.0 if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, name):
    df = QUERIES[name](spark, SMALL)
    rel = oracle(SMALL).sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    theirs = Counter(tuple(_plain(dict(zip(rel.columns, r))[c]) for c in columns) for r in rel.fetchall())
    assert Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect()) == theirs


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_entry_adds_them():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


def test_reputation(spark):
    rules = (reputation.Rule("com/", "allow"), reputation.Rule("bad.com/x/", "block"))
    urls = [
        (1, "http://WWW.Bad.com/x/1?q"), (2, "https://bad.com/y"), (3, "nobad.com/x/"), (4, None), (5, ""), (6, "x://a.org"), (7, "http://notbad.com/x/"),
        (8, "http://farm.co.uk/p"), (9, "http://good.co.uk/p#f"), (10, "http://://x"), (11, "ÄÖ://Ä.com/é"), (1, "http://farm.co.uk/p"),
    ]
    pages = spark.createDataFrame([(*u, "clash") for u in urls], "page_id bigint, url string, host string")
    outcomes = spark.createDataFrame([("farm.co.uk", 1)] * 40 + [("good.co.uk", 0)] * 40 + [(None, 1), ("x.org", None)], "host string, bad int")
    hosts = reputation.reputation(outcomes)
    by_host = {r.host: r for r in hosts.collect()}
    assert set(by_host) == {"farm.co.uk", "good.co.uk"}
    assert by_host["farm.co.uk"].suffix == ".co.uk" and by_host["farm.co.uk"].domain == "farm.co.uk"
    assert 0 < by_host["good.co.uk"].bound < by_host["good.co.uk"].rate < 0.5 < by_host["farm.co.uk"].bound < 1
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in reputation.judge(pages, hosts, rules).collect()}
    assert got == {
        (1, "www.bad.com", "/x/1", "bad.com/x/", "block"), (2, "bad.com", "/y", "com/", "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "a.org", "", None, "allow"), (7, "notbad.com", "/x/", "com/", "allow"), (8, "farm.co.uk", "/p", None, "block"), (9, "good.co.uk", "/p", None, "allow"),
        (10, ":", "//x", None, "allow"), (11, "Ä.com", "/é", "com/", "allow"), (1, "farm.co.uk", "/p", None, "block"),
    }
    nothing = reputation.reputation(outcomes.limit(0))
    assert nothing.count() == 0 and reputation.judge(pages, nothing, rules).count() == len(urls)


def test_reputation_of_unlabelled_hosts(spark):
    labelled = [(f"h{k}.bad.org", 1) for k in range(30) for _ in range(5)] + [(f"h{k}.good.org", 0) for k in range(30) for _ in range(5)]
    labelled += [(f"h{k}.d{k}.xyz", 1) for k in range(60) for _ in range(5)] + [(f"h{k}.d{k}.de", 0) for k in range(60) for _ in range(5)]
    hosts = reputation.reputation(spark.createDataFrame(labelled, "host string, bad int"))
    names = ["h1.bad.org", "new.bad.org", "a.b.bad.org", "bad.org", "new.good.org", "new.org", "fresh.xyz", "fresh.de", "fresh.museum", "", "h1.d1.xyz"]
    pages = spark.createDataFrame([(k, f"http://{n}/p") for k, n in enumerate(names)] + [(99, None)], "page_id bigint, url string")
    found = {r.host: r for r in reputation.judge(pages, hosts).collect()}
    assert set(found) == set(names)
    assert {n for n in names if found[n].verdict == "block"} == {"h1.bad.org", "new.bad.org", "a.b.bad.org", "bad.org", "fresh.xyz", "h1.d1.xyz"}
    assert found["new.bad.org"].rate == found["a.b.bad.org"].rate > found["new.org"].rate > found["new.good.org"].rate
    assert found["new.bad.org"].bound < found["h1.bad.org"].bound < found["h1.bad.org"].rate
    assert found["fresh.museum"].rate == found[""].rate == pytest.approx((450 + 1) / (900 + 2))
    known = {r.host: (r.rate, r.bound) for r in hosts.collect()}
    assert all((found[n].rate, found[n].bound) == known[n] for n in names if n in known)
    # A host with most of the pages is judged apart from the others, with the same result.
    many = pages.unionByName(spark.createDataFrame([(1000 + k, "http://h1.bad.org/p") for k in range(500)], "page_id bigint, url string"))
    again = reputation.judge(many, hosts).collect()
    assert len(again) == len(names) + 501 and sum(r.verdict == "block" for r in again) == 506
    assert all((r.rate, r.bound) == (found[r.host].rate, found[r.host].bound) for r in again)
