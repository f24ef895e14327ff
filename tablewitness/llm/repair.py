"""Repair of conversation structure by a grammar-compressed shortest-path search.

A conversation is the sequence of its rows' symbols: the role's initial (system, user, assistant, other) and whether the row
has to go (blank, duplicate), is truncated, or is clean. The cheapest edits that make the roles read ``(s?(ua)+)?`` are
a shortest path through four states (nothing yet, after s, after u, after a). Each symbol is a 4 x 4 matrix of (cost, audit);
matrices multiply by minimum and sum, audits are joined as ropes, and of equal costs the ASCII-least audit wins. That choice is
safe under joining: audits of the same rows at the same cost are never prefixes of one another, since what one has more could only be
inserts, and those cost.

Re-Pair learns the grammar from all conversations: the most frequent pairs of neighbouring symbols become new symbols, round by round,
counted over the distinct sequences by their number of copies. Each rule's matrix is the product of two earlier ones; all
conversations share them. The number of rules (``rules``) bounds what the driver and each task hold; it changes the speed alone.

Conversations are cut into blocks of ``BLOCK`` rows. Blocks are evaluated in parallel, to a matrix each, and a
conversation's blocks are then folded in order while its rows stream by, sorted, to be hashed. A conversation is hashed by one task, as
SHA-256 has no other way, but nobody holds its rows: memory is its audit, a character a row.

Nulls: a null role or text is one space, null turns come first, and null conv_ids are one conversation. Rows of one turn
come by role, then by the MD5 of the text, equal rows side by side. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewitness.session import stage

#: Costs of the edits, white space.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACES = " \t\n\x0b\x0c\r"
BLOCK = 4096
STATES = 4
#: (from, to) for an emitted user and an emitted assistant.
USER, ASSISTANT = ((0, 2), (1, 2), (3, 2)), ((2, 3),)

Rope = str | tuple
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def leaves(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            if top:
                yield top
        else:
            stack += [top[1], top[0]]


def text_of(rope: Rope) -> str:
    return "".join(leaves(rope))


def joined(left: Rope, right: Rope) -> Rope:
    if left == "" or right == "":
        return right if left == "" else left
    if isinstance(left, str) and isinstance(right, str) and len(left) + len(right) <= 64:
        return left + right
    return left, right


def before(a: Rope, b: Rope) -> bool:
    """Whether a's text is less than b's; common left branches are skipped."""
    while isinstance(a, tuple) and isinstance(b, tuple) and a[0] is b[0]:
        a, b = a[1], b[1]
    if a is b:
        return False
    x, y, p, q = leaves(a), leaves(b), "", ""
    while True:
        p, q = p or next(x, ""), q or next(y, "")
        n = min(len(p), len(q))
        if not n:
            return len(p) < len(q)
        if p[:n] != q[:n]:
            return p[:n] < q[:n]
        p, q = p[n:], q[n:]


def better(a: tuple[int, Rope], b: tuple[int, Rope] | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and before(a[1], b[1]))


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; entries that no path reaches are absent."""
    out: Matrix = {}
    for (i, m), (cost, rope) in a.items():
        for j in range(STATES):
            if (m, j) in b:
                more, tail = b[m, j]
                found = cost + more, joined(rope, tail)
                if better(found, out.get((i, j))):
                    out[i, j] = found
    return out


def _inserts() -> Matrix:
    out: Matrix = {(i, i): (0, "") for i in range(STATES)}
    out |= {step: (INSERT, "I") for step in (*USER, *ASSISTANT)}
    return out | {(i, 3): (2 * INSERT, "II") for i in (0, 1)}


INSERTS = _inserts()


def terminal(symbol: str) -> Matrix:
    """The matrix of one row with inserts on both sides: x must go, s u a o are clean by role, in upper case truncated."""
    steps: Matrix = {(i, i): (DELETE, "D") for i in range(STATES)}
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        kept = {"s": ((0, 1),), "u": USER, "a": ASSISTANT}.get(symbol.lower(), ())
        for edit, cost, moves in (("R", REROLE + extra, (*USER, *ASSISTANT)), ("K", extra, kept)):
            steps |= {move: (cost, edit) for move in moves}
    return product(product(INSERTS, steps), INSERTS)


TERMINALS = {s: terminal(s) for s in "xsuaoSUAO"}


class Grammar:
    """Rules in the order they were made, and the matrix of every symbol, bottom-up."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.rules = list(rules)
        self.matrices = dict(TERMINALS)
        for pair, symbol in self.rules:
            self.matrices[symbol] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def compressed(self, symbols: str) -> str:
        for pair, symbol in self.rules:
            if len(symbols) < 2:
                break
            symbols = symbols.replace(pair, symbol)
        return symbols

    def evaluate(self, symbols: str, starts: Iterable[int] = range(STATES)) -> Matrix:
        """The matrix of a sequence, in the rows of the given states only."""
        out: Matrix = {(i, j): e for (i, j), e in INSERTS.items() if i in starts}
        for symbol in self.compressed(symbols):
            out = product(out, self.matrices[symbol])
        return out


def _conflict_free(pairs: Iterable[str]) -> list[str]:
    """The first pairs none of which can overlap another: no symbol is first in one and second in another."""
    firsts, seconds, out = set(), set(), []
    for x, y in pairs:
        if x in seconds or y in firsts or (x == y and x in firsts | seconds):
            continue
        firsts.add(x)
        seconds.add(y)
        out.append(x + y)
    return out


def learn(sequences: DataFrame, rules: int = 1000, a_round: int = 64) -> Grammar:
    """Re-Pair over all ``sequences`` (symbols, n): rounds of at most ``a_round`` pairs that do not overlap.

    A round ends with a job that counts pairs by task, then in all; at most 4 * ``a_round`` pairs reach the driver.
    It stops when no pair is met twice or there are ``rules`` rules.
    """
    found: list[tuple[str, str]] = []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column("symbols").to_pylist(), batch.column("n").to_numpy()
            codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
            weight = np.repeat(n, [len(t) + 1 for t in texts])
            within = (codes[:-1] != 10) & (codes[1:] != 10)
            keys, where = np.unique((codes[:-1] << 32 | codes[1:])[within], return_inverse=True)
            sums = np.bincount(where, weight[:-1][within], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"pair": [chr(k >> 32) + chr(k & 0xFFFFFFFF) for k in keys.tolist()], "n": sums})

    def rewrite(new: list[tuple[str, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("symbols")
                for pair, symbol in new:
                    column = pc.replace_substring(column, pair, symbol)
                yield pa.RecordBatch.from_arrays([column, batch.column("n")], names=["symbols", "n"])

        return run

    while len(found) < rules:
        pairs = sequences.where(F.length("symbols") > 1).mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        frequent = pairs.where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * a_round).collect()
        chosen = _conflict_free(r.pair for r in frequent)[: min(a_round, rules - len(found))]
        if not chosen:
            break
        new = [(pair, chr(0xE000 + len(found) + k)) for k, pair in enumerate(chosen)]
        found += new
        sequences = stage(sequences.where(F.length("symbols") > 1).mapInArrow(rewrite(new), "symbols string, n bigint"), "sequences")
    return Grammar(found)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in, by crc32 of ``conv_id:turn`` modulo 20: (conv_id, turn, role, text, copy); dropped rows have copy null."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key) % 20).alias("damage"),
    )
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("damage") == 0, F.array(F.lit(None).cast("int"))).when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _faults(text: Column) -> tuple[Column, Column]:
    """Blank, and truncated, by the last character that is no white space."""
    rest = F.rtrim(text, F.lit(SPACES))
    return rest == "", ~F.right(rest, F.lit(1)).isin(".", "!", "?")


def blocks(rows: DataFrame) -> DataFrame:
    """Each conversation's blocks in order, with their symbols and the counts of their faults. One shuffle, without the texts."""
    blank, cut = _faults(F.col("text"))
    rows = rows.where("copy IS NOT NULL").select(
        "conv_id", "turn", "role", "copy", F.md5("text").alias("digest"), blank.alias("blank"), cut.alias("cut"), F.substring("role", 1, 1).alias("initial")
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest", "copy")
    rows = rows.withColumn("again", F.row_number().over(same) > 1)
    rows = rows.withColumns({
        "nth": F.row_number().over(order) - 1, "pair": F.concat(F.lag("initial").over(order), "initial"), "turn_before": F.lag("turn").over(order),
    })
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    rows = rows.withColumn("fault", fault)
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    count = lambda test, name: F.sum(F.coalesce(test, F.lit(False)).cast("long")).alias(name)
    listed = F.array_sort(F.collect_list(F.struct("nth", symbol.alias("symbol"))))
    return rows.groupBy("conv_id", F.floor(F.col("nth") / BLOCK).cast("long").alias("block")).agg(
        F.array_join(F.transform(listed, lambda x: x["symbol"]), "").alias("symbols"),
        F.min("turn").alias("low"), F.max("turn").alias("high"),
        count(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before")), "turns"),
        *(count(F.col("fault") == f, f) for f in ("blank", "duplicate", "truncated")),
        count(~F.col("pair").isin("su", "ua", "au"), "illegal"),
    )


_COUNTS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")
_VALUED = "conv_id bigint, block bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", costs array<bigint>, audits array<string>"


def valued(parts: DataFrame, grammar: Grammar) -> DataFrame:
    """Blocks with their matrices, row by row of states; a conversation's first block needs the row of state 0 alone."""
    kinds = [pa.int64()] * (2 + len(_COUNTS)) + [pa.list_(pa.int64()), pa.list_(pa.string())]
    names = ["conv_id", "block", *_COUNTS, "costs", "audits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, bool], tuple[list, list]] = {}
        for batch in batches:
            costs, audits = [], []
            for symbols, block in zip(batch.column("symbols").to_pylist(), batch.column("block").to_pylist()):
                key = symbols, block == 0
                if key not in known:
                    if len(known) >= 4096:
                        known.clear()
                    starts = (0,) if block == 0 else range(STATES)
                    found = grammar.evaluate(symbols, starts)
                    cells = [found.get((i, j)) for i in starts for j in range(STATES)]
                    known[key] = [None if c is None else c[0] for c in cells], [None if c is None else text_of(c[1]) for c in cells]
                costs.append(known[key][0])
                audits.append(known[key][1])
            columns = [batch.column(c) for c in names[:-2]] + [costs, audits]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(columns, kinds)], names=names)

    return parts.mapInArrow(run, _VALUED)


class _Conversation:
    """One conversation while its blocks, then its rows, pass by in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.sums, self.low, self.high = conv_id, [0] * (len(_COUNTS) - 2), None, None
        self.row: Matrix = {(0, 0): (0, "")}
        self.audit: str | None = None
        self.cost, self.at, self.expected, self.lines = 0, 0, "user", 0
        self.hash = hashlib.sha256()

    def block(self, b: dict) -> None:
        starts = (0,) if b["block"] == 0 else range(STATES)
        cells = ((i, j) for i in starts for j in range(STATES))
        matrix = {cell: (c, a) for cell, c, a in zip(cells, b["costs"], b["audits"]) if c is not None}
        self.row = product(self.row, matrix)
        self.sums = [s + b[c] for s, c in zip(self.sums, _COUNTS[2:])]
        if b["low"] is not None:
            self.low = b["low"] if self.low is None else min(self.low, b["low"])
            self.high = b["high"] if self.high is None else max(self.high, b["high"])

    def decide(self) -> None:
        if self.audit is None:
            best = None
            for j in (0, 3):
                if (0, j) in self.row and better(self.row[0, j], best):
                    best = self.row[0, j]
            self.cost, self.audit = best[0], text_of(best[1])

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        self.expected = "assistant" if role[:1] == "u" else "user"

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line(self.expected, "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.decide()
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else self.expected, text)

    def result(self) -> tuple:
        self.decide()
        self._inserted()
        turns, blank, duplicate, truncated, illegal = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - turns
        return self.conv_id, gaps, blank, duplicate, truncated, illegal, self.cost, self.audit, self.hash.hexdigest()


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    now: _Conversation | None = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        done = []
        for k in range(0, batch.num_rows, 256):
            for r in batch.slice(k, 256).to_pylist():
                if now is None or r["conv_id"] != now.conv_id:
                    if now:
                        done.append(now.result())
                    now = _Conversation(r["conv_id"])
                if r["kind"] == 1:
                    now.block(r["b"])
                elif r["kind"] == 2:
                    now.add(r["role"], r["text"])
        if done:
            yield out(done)
    if now:
        yield out([now.result()])


def repair(rows: DataFrame, rules: int = 1000) -> DataFrame:
    """Repair conversations given as in ``damaged``'s result: a row for each conv_id with ``RESULT``'s columns.

    ``gaps`` counts the missing turn numbers between the first and the last. Conversations whose rows were all dropped
    have zeros, an empty audit and the hash of the empty string; an empty table has no row.
    """
    parts = stage(blocks(rows), "blocks")
    sequences = stage(parts.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "sequences")
    found = valued(parts, learn(sequences, rules))
    none = lambda kind: F.lit(None).cast(kind)
    summary = F.struct(*(c for c in found.columns if c != "conv_id"))
    blank = [none("long").alias("turn"), none("string").alias("role"), none("string").alias("digest"), none("string").alias("text")]
    first = found.select("conv_id", F.lit(1).alias("kind"), "block", summary.alias("b"), *blank)
    kind = first.schema["b"].dataType
    gone = rows.where("copy IS NULL").select("conv_id", F.lit(0).alias("kind"), none("long").alias("block"), none(kind).alias("b"), *blank)
    texts = rows.where("copy IS NOT NULL").select("conv_id", F.lit(2).alias("kind"), none("long").alias("block"), none(kind).alias("b"), "turn", "role", F.md5("text").alias("digest"), "text")
    stream = gone.unionByName(first).unionByName(texts).repartition("conv_id")
    stream = stream.sortWithinPartitions("conv_id", "kind", "block", F.col("turn").asc_nulls_first(), "role", "digest")
    return stream.drop("digest", "turn", "block").mapInArrow(_results, RESULT)
