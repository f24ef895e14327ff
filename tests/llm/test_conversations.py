"""Conversation repair and the prefix trie next to plain definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from tablewitness.llm import prefixes, repair

CLASH = "conv_id bigint, turn bigint, role string, text string, nth int, kind string, b string, copy int, digest string, turns string, block int, path string, words int"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "b", 2, "d", "t", 3, "p", 4) for r in rows], CLASH)


def _rows(seed, convs=120):
    rng = random.Random(seed)
    rows = []
    for c in range(-25, convs):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 30])):
            turn = rng.choice([t, t, t, t + 2, None, 1])
            text = rng.choice(["Hi there.", "x y z", "", None, " \n\x0b", "What?\t", "é😀!", "no end", f"unique {rng.random()}."])
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]), text))
    rows += rows[:40]  # whole rows again
    return rows + [(None, 0, "user", "Null id."), (None, None, None, None), (7, 3, "user", "word " * 20_000)]


def _inserts(paths):
    out = dict(paths)
    for _ in range(3):
        for i, (cost, audit) in list(out.items()):
            for p, q in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if p == i and (q not in out or (cost + 3, audit + "I") < out[q]):
                    out[q] = cost + 3, audit + "I"
    return out


def _cheapest(rows):
    """Forward search over (role initial, fault) pairs; a dictionary of the least (cost, audit) for each state."""
    state = _inserts({0: (0, "")})
    for initial, fault in rows:
        new = {}

        def put(j, found):
            if j not in new or found < new[j]:
                new[j] = found

        for i, (cost, audit) in state.items():
            put(i, (cost + 4, audit + "D"))
            if fault not in ("blank", "duplicate"):
                late = 3 if fault else 0
                for p, q, role in ((0, 1, "s"), (0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a")):
                    if p == i:
                        if role == initial:
                            put(q, (cost + late, audit + "K"))
                        if role != "s":
                            put(q, (cost + late + 3, audit + "R"))
        state = _inserts(new)
    return min(state[j] for j in (0, 3) if j in state)


def _repaired(rows):
    groups = defaultdict(list)
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        damage = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if damage == 4 else role, "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        groups[c] += [(t is not None, t or 0, role, hashlib.md5(text.encode()).hexdigest(), text)] * {0: 0, 3: 2}.get(damage, 1)
    out = Counter()
    for c, members in groups.items():
        members.sort()
        seen, faults = set(), []
        for _, _, role, _, text in members:
            rest = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = _cheapest([(m[2][:1], f) for m, f in zip(members, faults)])
        lines, at, expected = [], 0, "user"
        for edit in audit:
            role, text = (expected, "") if edit == "I" else (members[at][2] if edit == "K" else expected, members[at][4])
            at += edit != "I"
            if edit != "D":
                lines.append(f"{role}:{text}")
                expected = "assistant" if role.startswith("u") else "user"
        turns = {m[1] for m in members if m[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [m[2][:1] for m in members]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        count = Counter(faults)
        out[c, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


def test_repair(spark, monkeypatch):
    rows = _rows(1)
    assert Counter(map(tuple, repair.repair(repair.damaged(_table(spark, rows))).collect())) == _repaired(rows)
    # Several blocks a conversation, few rules: the same rows.
    monkeypatch.setattr(repair, "BLOCK", 3)
    assert Counter(map(tuple, repair.repair(repair.damaged(_table(spark, rows)), rules=5).collect())) == _repaired(rows)
    assert repair.repair(repair.damaged(_table(spark, []))).count() == 0


def test_grammar(spark):
    rng = random.Random(5)
    sequences = ["".join(rng.choices("xsuaoSUAOuauaua", k=rng.randrange(14))) for _ in range(800)] + ["ua" * 500, "x" * 333, "suA" * 77]
    grammar = repair.learn(spark.createDataFrame([(s, 1) for s in sequences], "symbols string, n bigint"))
    assert len(grammar.rules) > 50 and len(grammar.compressed("ua" * 500)) < 20
    made = set("xsuaoSUAO")
    for pair, symbol in grammar.rules:
        assert set(pair) <= made and symbol not in made
        made.add(symbol)
    names = {"s": "s", "u": "u", "a": "a", "o": "t"}
    for s in sequences:
        found = grammar.evaluate(s, (0,))
        cost, audit = min((found[0, j][0], repair.text_of(found[0, j][1])) for j in (0, 3) if (0, j) in found)
        assert (cost, audit) == _cheapest([(names.get(c.lower(), "t"), "blank" if c == "x" else "truncated" if c.isupper() else None) for c in s])


def test_ropes():
    a = repair.joined(repair.joined("K" * 60, "D" * 60), "R")
    b = repair.joined(repair.joined("K" * 60, "D" * 60), "K")
    assert repair.before(b, a) and not repair.before(a, b) and not repair.before(a, a)
    assert repair.text_of(a) == "K" * 60 + "D" * 60 + "R"
    assert repair.before("D", "DI") and not repair.before("DI", "D")


def _trie(rows):
    groups = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            groups[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(m[2], m[4]) for m in sorted(members)] for c, members in groups.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        opener = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = tuple(turns.get(opener, [])[:h] + own[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p))))
        out[p] = (
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), sum(out[k][5] for k in children[p]) or 1,
            (len(members[p]) - 1) * words + sum(out[k][6] for k in children[p]), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return Counter(out.values())


def test_trie(spark):
    copies = [(c, t, "user", f"turn {t}") for c in range(400, 700) for t in range(6)]
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, rows in (("1", _rows(2)), ("8", _rows(3) + copies), ("31", _rows(4) + copies)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert Counter(map(tuple, prefixes.trie(prefixes.rebuilt(_table(spark, rows))).collect())) == _trie(rows)
        assert prefixes.trie(prefixes.rebuilt(_table(spark, []))).count() == 0
        lonely = [(21, 0, "user", "gone with its opener")]
        assert Counter(map(tuple, prefixes.trie(prefixes.rebuilt(_table(spark, lonely))).collect())) == _trie(lonely)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_extents():
    import numpy as np

    rng = random.Random(9)
    lcp = np.array([-1] + [rng.randrange(5) for _ in range(200)])
    table = prefixes.minima(lcp)
    for _ in range(500):
        row, depth = rng.randrange(len(lcp)), rng.randrange(6)
        left = right = row
        while left > 0 and lcp[left] >= depth:
            left -= 1
        while right + 1 < len(lcp) and lcp[right + 1] >= depth:
            right += 1
        assert [x[0] for x in prefixes.extents(table, np.array([row]), np.array([depth]))] == [left, right]
        assert prefixes.least(table, np.array([left]), np.array([right]))[0] == lcp[left : right + 1].min()
