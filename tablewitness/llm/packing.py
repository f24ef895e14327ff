"""Packing of documents into training sequences as a cutting-stock problem.

Documents are tokenized once and cut into full sequences and a rest, which is cut once more when it is
longer than half a sequence: short pieces fill sequences with little padding. Pieces are counted by
length class (a histogram of at most ``capacity / width`` classes, however many documents there are).
A linear program over patterns (how many pieces of each class share a sequence) minimises the number
of sequences; its columns are generated: the duals price the classes, and a knapsack by dynamic
programming finds the best new pattern. The solution is rounded down, what is left over is filled
greedily, and the patterns are dealt to the documents by their rank inside their class.

Only the histogram and the patterns are on the driver. Ranks are counted inside the tasks that wrote
the pieces and shifted by the counts of the tasks before, so that no class is ever in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewitness.llm.textbytes import slices
from tablewitness.session import stage

#: Fixed value: the split pattern of the tokenizer, for lower-case Latin text without its other letters and digits.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Texts with other characters, or with the names of special tokens, go through the tokenizer as a whole.
_OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ‐-‧]|<\|")
#: Words remembered in a task.
_REMEMBERED = 400_000


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The tokenizer encodes each word by itself, so words are encoded once in a worker and remembered.
    That holds for the plain characters of ``_OTHER``; all other texts are encoded as a whole.
    """

    _known: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [chr(k) for k in range(33, 0x2028) if not _OTHER.match(chr(k))]
        self.letters = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in plain}

    @classmethod
    def of(cls, path: str | None) -> "Encoder":
        """The encoder of this worker, kept between tasks."""
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if _OTHER.search(text):
            return self.whole(text)
        found = _WORD.findall(text.lower())
        try:
            return b"".join(map(self.words.__getitem__, found))
        except KeyError:
            if len(self.words) > _REMEMBERED:
                self.words.clear()
            for word in set(found).difference(self.words):
                tokens = self.tokenizer.model.tokenize(word.translate(self.letters))
                self.words[word] = b"".join(t.id.to_bytes(4, "little") for t in tokens)
            return b"".join(map(self.words.__getitem__, found))


def pieces(documents: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, part, start, length, ids_crc32, doc_tokens (and ids).

    Every document ends with ``end_id``; null and empty texts are that id alone. ``part`` is the task.
    """
    schema = "doc_id bigint, part int, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        for batch, _, _ in slices(batches):
            rows: list[tuple[int | None, int, int, int, int, int]] = []
            ids: list[np.ndarray] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                code = encode(text or "") + end
                total = len(code) // 4
                full, half = total // capacity * capacity, capacity // 2
                cuts = [*range(0, full, capacity), *range(full, total, half), total]
                for start, stop in zip(cuts, cuts[1:]):
                    cut = code[4 * start : 4 * stop]
                    rows.append((doc, part, start, len(cut) // 4, zlib.crc32(cut), total))
                    if with_ids:
                        ids.append(np.frombuffer(cut, "<i4"))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *(pa.int64(),) * 4))]
            names = ["doc_id", "part", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def best_pattern(prices: np.ndarray, units: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack of the highest total price: its worth, and how many of each class it holds."""
    worth, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        worth[room], choice[room] = worth[room - 1], -1
        fits = int(np.searchsorted(units, room, "right"))
        if fits:
            gain = worth[room - units[:fits]] + prices[:fits]
            k = int(gain.argmax())
            if gain[k] > worth[room]:
                worth[room], choice[room] = gain[k], k
    pattern, room = np.zeros(len(units), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= units[choice[room]]
    return float(worth[capacity]), pattern


def patterns(demand: dict[int, int], capacity: int, gap: float = 5e-3) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used, so that every class is used exactly as often as demanded.

    ``demand`` maps a class, its size in units, to a count. Column generation by the revised simplex
    method from one-class patterns; rounding down; a greedy filling of the rest, largest first.
    Duals are smoothed towards those of the best lower bound so far, at first the share of a sequence
    that a class fills. Any duals, divided by the worth of their best pattern, bound the program from
    below; it ends within a share ``gap`` of the best bound.
    """
    units = np.array(sorted(c for c, n in demand.items() if n > 0), np.int64)
    if not len(units):
        return []
    want = np.array([demand[int(c)] for c in units], np.float64)
    m = len(units)
    columns = np.diag(capacity // units).astype(np.float64)
    inverse = np.diag(1.0 / (capacity // units))
    # Slightly uneven demands, so that no pivot is without gain; what is dealt out below uses the true ones.
    amount = inverse @ (want * (1 + 1e-4 * np.sin(np.arange(1, m + 1) * 12.9898)) + 1e-3)
    center = units / capacity
    bound, smooth = float(center @ want), 0.8
    while amount.sum() > bound * (1 + gap):
        duals = inverse.sum(0)
        asked = np.maximum(0, smooth * center + (1 - smooth) * duals)
        worth, pattern = best_pattern(asked, units, capacity)
        if asked @ want / worth > bound:
            bound, center = float(asked @ want / worth), asked / worth
        if duals @ pattern <= 1 + 1e-9:  # nothing gained at the smoothed duals: come closer to the true ones
            if smooth < 1e-3:
                break
            smooth /= 2
            continue
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        amount = amount - step * ratio[leave]
        amount[leave] = ratio[leave]
        inverse[leave] /= step[leave]
        others = np.arange(m) != leave
        inverse[others] -= np.outer(step[others], inverse[leave])
        columns[:, leave] = pattern
        smooth = 0.8
    left = want.astype(np.int64)
    out = []
    for k in range(m):
        column = columns[:, k].astype(np.int64)
        used = column > 0
        n = min(int(np.floor(amount[k] + 1e-6)), int((left[used] // column[used]).min()))
        if n > 0:
            out.append((column, n))
            left = left - n * column
    while left.any():
        column, room = np.zeros(m, np.int64), capacity
        for k in range(m - 1, -1, -1):
            column[k] = min(left[k], room // units[k])
            room -= column[k] * units[k]
        used = column > 0
        n = int((left[used] // column[used]).min())
        out.append((column, n))
        left = left - n * column
    return [({int(units[k]): int(column[k]) for k in np.flatnonzero(column)}, n) for column, n in out]


def pack(documents: DataFrame, capacity: int = 2048, width: int = 8, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: sequence_id and offset, gapless from 0 in each sequence.

    ``width`` is the width of a length class in tokens: a pattern reserves that much at most in vain
    for each piece. Repeated rows are packed each; an empty table gives no sequences.
    """
    if capacity % (2 * width):
        raise ValueError("capacity is a multiple of twice the width")
    spark = documents.sparkSession
    cut = stage(pieces(documents, capacity, end_id, tokenizer, with_ids), "pieces")
    sized = cut.withColumn("class", F.ceil(F.col("length") / width).cast("int"))
    counts = sized.groupBy("part", "class").agg(F.count("*").alias("n"))
    demand = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most capacity / width rows
    plan, base, sequences = [], dict.fromkeys(demand, 0), 0
    whole = {c: n for c, n in demand.items() if c * width == capacity}  # sequences of their own
    rests = {c: n for c, n in demand.items() if c not in whole}
    for pattern, n in [*patterns(rests, capacity // width), *(({c: 1}, n) for c, n in whole.items())]:
        slot = 0
        for c, each in pattern.items():
            plan.append((c, base[c], base[c] + each * n, each, sequences, slot))
            base[c] += each * n
            slot += each
        sequences += n
    plan = spark.createDataFrame(plan, "class int, first long, behind long, each long, sequence long, slot long")
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("part", "class", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part", "class").orderBy("doc_id", "start")) - 1
    ranked = sized.drop("ids").withColumn("own", own).join(shifts, ["part", "class"]).withColumn("rank", F.col("own") + F.col("before"))
    # At most a few patterns for each class: the plan is bounded by the number of classes, not by the documents.
    placed = ranked.join(F.broadcast(plan), (ranked["class"] == plan["class"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("behind")))
    inside = F.col("rank") - F.col("first")
    placed = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank",
        (F.col("sequence") + F.floor(inside / F.col("each"))).alias("sequence_id"),
        (F.col("slot") + inside % F.col("each")).alias("slot"),
    )
    upto = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0)))
    out = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")
    if not with_ids:
        return out.drop("part")
    keys = ["part", "doc_id", "start", "ids_crc32"]
    marked = out.withColumn("_copy", F.row_number().over(Window.partitionBy(*keys).orderBy("sequence_id", "offset")))
    texts = cut.withColumn("_copy", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))).select(*(F.col(c).alias(f"_of_{c}") for c in (*keys, "_copy")), "ids")
    same = F.lit(True)
    for key in (*keys, "_copy"):
        same = same & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    return marked.join(texts, same).select(*(c for c in out.columns if c != "part"), "ids")
