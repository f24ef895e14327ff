"""Decontamination next to a plain edit distance, and the queries and pipeline on the given tables."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from tablewitness.llm import contamination
from tests.llm.data import empty, messy


ROOT = Path(__file__).resolve().parents[2]


def _distance(item, text):
    """Edit distance of item to the best stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def _matches(item, text, region=80, rate=0.05):
    item, text = (bytes(32 if 9 <= b <= 13 else b + 32 * (65 <= b <= 90) for b in x.encode()) for x in (item, text))
    w = min(len(item), region)
    k = int(w * rate)
    return any(_distance(item[a : a + w], text) <= k for a in range(len(item) - w + 1))


def _noisy(rng, text, edits):
    for _ in range(edits):
        p = rng.randrange(len(text))
        text = rng.choice([text[:p] + "q" + text[p + 1 :], text[:p] + text[p + 1 :], text[:p] + "z" + text[p:]])
    return text


def test_against_edit_distance(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeilmnorst", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate((4, 9, 18, 25))]
    docs = []
    for k, item in items:
        for edits in (0, 1, 3, 4, 5, 7, 12):
            docs.append((len(docs), f"{prose(6)} {_noisy(rng, item, edits)} {prose(5)}"))
        docs.append((len(docs), item.upper().replace(" ", "\n")))
        docs.append((len(docs), item[: len(item) // 2]))
    docs += [(900, prose(50)), (901, ""), (902, None), (None, items[2][1])]
    found = contamination.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == {(i, k) for i, t in docs for k, item in items if t and _matches(item, t)}
    assert len(got) > 15


def test_short_items(spark):
    """One edit in the middle of 20 to 23 bytes leaves no common 12-gram, in longer ones few."""
    rng = random.Random(3)
    items = [(n, "".join(rng.choices("abcdefghijklmnop", k=n))) for n in (11, 12, 13, 19, 20, 21, 22, 23, 24, 39, 40, 41)]
    docs = []
    for n, item in items:
        for p in range(0, n, 3):
            docs.append((len(docs), f"xx{item[:p]}Q{item[p + 1 :]}yy"))
            docs.append((len(docs), f"xx{item[:p]}{item[p + 1 :]}yy"))
        docs.append((len(docs), f"{item[:5]} {item}"))
    found = contamination.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, n) for i, t in docs for n, item in items if n >= 12 and _matches(item, t)}


def test_rulers_in_bounded_memory(tmp_path):
    """A million dashes, alone and in a period of two, against items that hold rulers; within 1 GB."""
    code = f"""
import resource, sys, numpy as np
sys.path.insert(0, {str(ROOT)!r})
from tablewitness.llm.contamination import Block
from tablewitness.llm import contamination
rule = "-" * 120
items = [(1, "| a | b |\\n" + rule + "\\n| c | d |\\n" + rule), (2, "-" * 50 + " something else that stands in no text at all here"), (3, "-=" * 3000)]
items += [(10 + k, "|" + "-" * (30 + k) + "| column %d of many in a table that is not there |" % k) for k in range(0, 300, 15)]
block = Block(items, 80, 0.05)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for text, want in (("-" * 1_000_000, {{1}}), ("-=" * 500_000, {{3}}), ("x" * 1000 + "-" * 5_000, {{1}})):
    data = np.frombuffer(text.encode(), np.uint8)
    found = block.matches(data, np.array([0, len(data)]))
    ids = {{block.ids[m[1]] for m in found}}
    assert ids & {{1, 2, 3}} == want, (text[:4], ids)
used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
assert used < 1_000_000, used
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr


def test_windows_give_the_same(monkeypatch):
    """Rows read in windows and in one piece have the same matches."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcd", k=rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(n)) for k, n in enumerate((30, 45, 60, 400))]
    texts = [f"{prose(800)} {_noisy(rng, item, e)} {prose(500)}" for _, item in items for e in (0, 2, 3, 4, 6)] + [prose(2000), "", "a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    whole = sorted(contamination.Block(items, 80, 0.05).matches(data, offsets))
    monkeypatch.setattr(contamination, "_PAIRS", 1)
    monkeypatch.setattr(contamination, "WINDOW", 64)
    assert sorted(contamination.Block(items, 80, 0.05).matches(data, offsets)) == whole and len(whole) > 10
    monkeypatch.setattr(contamination, "PIECE", 100)
    assert {m[:2] for m in contamination.Block(items, 80, 0.05).matches(data, offsets)} == {m[:2] for m in whole}


def test_awkward_tables(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "a text of no item at all, with a null id")], "item_id bigint, text string")
    docs = messy(spark)
    assert contamination.find(docs, bench).count() == 0
    assert contamination.clean(docs, bench.limit(0)).count() == docs.count()
    clean = contamination.clean(docs, docs.where("doc_id = 13").selectExpr("doc_id AS item_id", "text"))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {11, 12, 13}
    assert contamination.find(empty(spark), docs.selectExpr("doc_id AS item_id", "text")).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, contamination.find(docs, bench).collect()))
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, contamination.find(docs, bench).collect())) == whole and whole
    have = {(r.doc_id, r.item_id) for r in docs.crossJoin(bench.withColumnRenamed("text", "item")).where("contains(text, item)").collect()}
    assert have <= {x[:2] for x in whole}


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):
    """Documents of the messy table next to the given ones, as a folder of tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    given = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{given}/documents.parquet")
    mess = messy(spark).selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(mess).coalesce(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{given}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_stages(spark, small):
    import corpus_pipeline
    from tablewitness.llm import secrets
    from tests.llm.test_documents import _components, _gapless, _spans

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    tables = [docs]
    for _, function in corpus_pipeline.STAGES:
        tables.append(function(spark, tables[-1], small).persist())
    for t in tables[:-1]:
        assert t.columns == docs.columns
    whole, known, single, clean, hidden, packed = (t.collect() for t in tables)
    assert sorted(map(str, known)) == sorted(str(r) for r in whole if any(c.isalpha() for c in r.text or ""))
    sets, least = _components([(r.doc_id, r.text) for r in known if r.doc_id is not None])
    assert {r.doc_id for r in single} == {i for i in least if least[i] == i} | {r.doc_id for r in known if r.doc_id is None}
    gone = {r.doc_id for r in single} - {r.doc_id for r in clean}
    assert {r.doc_id for r in single if any(t in r.text for _, t in bench)} <= gone
    assert all(any(t[k : k + 40] in (r.text or "") for _, t in bench for k in range(0, len(t), 10)) for r in single if r.doc_id in gone)
    assert len(hidden) == len(clean)
    assert not any(_spans(r.text or "") for r in hidden)
    assert sum(bool(_spans(r.text or "")) for r in clean) == sum("[secret]" in (r.text or "") for r in hidden) > 0
    assert {r.doc_id for r in packed} == {r.doc_id for r in hidden}
    _gapless(packed)
    assert secrets.RULES[0].name == "assign"
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).select("doc_id", "start", "length", "ids_crc32").collect()), key=str) == sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed), key=str)
