"""Join of documents whose word shingles overlap, by T-occurrence search with DivideSkip.

A document is the set of its five-word shingles. Equal sets are one class, so copies cost one row. Two
classes link when 100 |x ∩ y| >= 80 |x ∪ y|, which asks for T = ceil(4 (|x| + |y|) / 9) common shingles.

1. Index. All sets are ordered alike: by hash, but shingles that are frequent come last. Linked sets
   share some of the first |x| - ceil(0.8 |x|) + 1 + s shingles of both, at least s + 1 of them with s a
   fiftieth of the smaller size. Only these prefixes are shuffled; a class with fewer prefix shingles in
   common with any other is out of the search. The frequent shingles are found from repeats inside
   batches; any choice of them gives the same links, it only shortens the lists.
2. Stars. In each list one class is the center, candidates of a center are searched together: their
   shingles form inverted lists, short ones are merged by a heap, long ones probed by binary search, and
   classes that reach T are linked. Large groups of near copies are joined in this way by as
   many comparisons as there are list entries.
3. Rest. Classes that share a list and are not yet in one component are compared pair by pair, so that
   no link between components is missed. The pairs of a list are looked at where the list lies; what leaves
   it are distinct pairs whose sizes and places allow a link.

In both steps a pair first meets as two bitmaps, the parity of the shingles in each of 512 buckets: sets differ in at
least as many shingles as their bitmaps in bits. Only pairs that this does not refute bring their sets together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewitness.llm.components import components
from tablewitness.llm.textbytes import Rolling, lower, mix, slices, spaces, words
from tablewitness.session import stage

WORDS = 5
#: Shingles found in so many documents are frequent; the order knows this many of them.
FREQUENT, KNOWN = 32, 100_000
#: Members that one task compares with a center at once, and entries of a frequent list in one part.
MEMBERS, ENTRIES = 256, 4096
#: Shingles among which a task looks for repeats at once.
SEEN = 1 << 20
#: Bits of a bitmap, pairs that a task looks at or holds at once, and the longest lists that it takes many at a time.
BITS, HELD, SHORT = 512, 1 << 20, 64
_ENTRY = "shingle bigint, one bigint, n int, part int, pos int"
_SPACE = spaces()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after another, and the offsets of the rows."""
    low = lower(data)
    starts, ends, row = words(low, offsets, _SPACE)
    each = Rolling(low).of(starts, ends)
    first = np.searchsorted(row, np.arange(len(offsets)))
    parts, sizes = [], np.zeros(len(offsets), np.int64)
    spread = each
    for k in range(1, WORDS):
        spread = mix(spread[: len(each) - k] * _STEP + each[k:]) if len(each) > k else spread[:0]
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= WORDS:
            found = np.sort(spread[a : b - WORDS + 1])
            found = found[np.r_[True, found[1:] != found[:-1]]]
        elif b > a:  # the whole sequence, told apart by its length
            one = each[a : a + 1]
            for k in range(a + 1, b):
                one = mix(one * _STEP + each[k : k + 1])
            found = mix(one ^ np.uint64(b - a))
        else:
            continue
        parts.append(found)
        sizes[i + 1] = len(found)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(sizes)


def _signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: the sum and the exclusive or of its mixed shingles."""
    n = len(bounds) - 1
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        one[full] = np.add.reduceat(mix(values ^ _STEP), bounds[full])
        two[full] = np.bitwise_xor.reduceat(mix(values * _STEP), bounds[full])
    return one.view(np.int64), two.view(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows (shingle, times) for what repeats in a run of about SEEN shingles."""
    seen, size = [], 0

    def repeats() -> pa.RecordBatch:
        values = np.concatenate(seen)
        values.sort()
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
        times = np.diff(np.r_[first, len(values)])
        values, times = values[first[times > 1]], times[times > 1]
        none = pa.nulls(len(values), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], names=["doc_id", "n", "one", "two", "shingle", "times"])

    for batch, data, offsets in slices(batches):
        values, bounds = shingle_sets(data, offsets)
        one, two = _signatures(values, bounds)
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(one), pa.array(two), none, none], names=["doc_id", "n", "one", "two", "shingle", "times"])
        seen.append(values)
        size += len(values)
        if size > SEEN:
            yield repeats()
            seen, size = [], 0
    if seen:
        yield repeats()


def _slack(n: int | np.ndarray) -> int | np.ndarray:
    return n // 50


def _prefixes(frequent: np.ndarray, times: np.ndarray):
    """Rows (shingle, one, n, part, pos) of the prefix of each set, ``pos`` the place in the common order.

    ``part`` splits the lists of frequent shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in slices(batches):
            values, bounds = shingle_sets(data, offsets)
            one, _ = _signatures(values, bounds)
            n = np.diff(bounds)
            if not len(values):
                continue
            at = np.minimum(np.searchsorted(frequent, values), max(len(frequent) - 1, 0))
            known = frequent[at] == values if len(frequent) else np.zeros(len(values), bool)
            row = np.repeat(np.arange(len(n)), n)
            rank = np.where(known, times[at] if len(frequent) else 0, 0)
            order = np.lexsort((values, rank, row))
            place = np.arange(len(values)) - bounds[row]
            length = n - (4 * n + 4) // 5 + 1 + _slack(n)
            take = order[place < length[row]]
            parts = np.where(known[take], 1 + mix(one.view(np.uint64)[row[take]]).astype(np.int64) % np.maximum(1, rank[take] // ENTRIES), 0)
            yield pa.RecordBatch.from_pydict({"shingle": values[take].view(np.int64), "one": one[row[take]], "n": n[row[take]].astype(np.int32), "part": parts.astype(np.int32), "pos": place[place < length[row]].astype(np.int32)})

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by shingle, part, one and n: its distinct rows."""
    last = None
    for batch in batches:
        known = [batch.column(c).to_numpy() for c in ("shingle", "part", "one", "n")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in known], axis=0)
        if batch.num_rows:
            new[0] = last != tuple(c[0] for c in known)
            last = tuple(c[-1] for c in known)
        yield batch.filter(pa.array(new))


def _whole(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches of a partition sorted by ``keys``, cut so that no list is in two of them, and where the lists begin."""

    def begins(batch: pa.RecordBatch) -> np.ndarray:
        known = [batch.column(c).to_numpy() for c in keys]
        return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in known], axis=0)])

    held: list[pa.RecordBatch] = []  # the list that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = begins(batch)[-1]
        if cut or (held and any(held[-1].column(c)[0] != batch.column(c)[0] for c in keys)):
            done = pa.concat_batches([*held, batch.slice(0, cut)])
            yield done, begins(done)
            held = []
        held.append(batch.slice(cut))
    if held:
        done = pa.concat_batches(held)
        yield done, begins(done)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by shingle, part, one and n: distinct rows whose list has two classes or more, and its ``length``.

    Entries of frequent shingles always stay, because their lists may be split.
    """
    for batch, first in _whole(_distinct(batches), ("shingle", "part")):
        sizes = np.diff(np.r_[first, batch.num_rows])
        length = np.repeat(sizes, sizes)
        keep = pa.array((length > 1) | (batch.column("part").to_numpy() > 0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], names=[*batch.schema.names, "length"]).filter(keep)


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs (center, member) of other labels in one list whose sizes and places allow a link.

    Rows (shingle, rep, n, can, pos, label) come sorted by shingle. Of long lists all rows but those of the most
    frequent label meet the whole list, a block at a time.
    """
    found: list[np.ndarray] = []
    size = 0

    def allowed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        both = 4 * (n[p] + n[q])
        ok = (label[p] != label[q]) & (9 * np.minimum(can[p], can[q]) >= both)
        # Linked sets share one of the first |x| - T + 1 shingles of both.
        ok &= (9 * (n[p] - pos[p]) >= both) & (9 * (n[q] - pos[q]) >= both)
        a, b = rep[p[ok]], rep[q[ok]]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)

    def met() -> Iterator[np.ndarray]:
        for length in np.unique(sizes[(sizes > 1) & (sizes <= SHORT)]):
            one, two = np.triu_indices(length, 1)
            starts = first[sizes == length]
            for k in range(0, len(starts), max(1, HELD // len(one))):
                at = starts[k : k + max(1, HELD // len(one)), None]
                yield allowed((at + one).ravel(), (at + two).ravel())
        for start, length in zip(first[sizes > SHORT], sizes[sizes > SHORT]):
            every = np.arange(start, start + length)
            labels, code = np.unique(label[every], return_inverse=True)
            few = every[code != np.bincount(code).argmax()]
            for k in range(0, len(few), max(1, HELD // length)):
                block = few[k : k + max(1, HELD // length)]
                yield allowed(np.repeat(block, length), np.tile(every, len(block)))

    def distinct() -> np.ndarray:
        return np.unique(np.concatenate(found), axis=0)

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"center": np.ascontiguousarray(pairs[:, 0]), "member": np.ascontiguousarray(pairs[:, 1])})

    for batch, first in _whole(batches, ("shingle",)):
        sizes = np.diff(np.r_[first, batch.num_rows])
        rep, n, can, pos, label = (batch.column(c).to_numpy().astype(np.int64) for c in ("rep", "n", "can", "pos", "label"))
        for pairs in met():
            if not len(pairs):
                continue
            found.append(pairs)
            size += len(pairs)
            if size >= HELD:
                found = [distinct()]
                size = len(found[0])
                if size >= HELD // 2:
                    yield out(found[0])
                    found, size = [], 0
    if found:
        yield out(distinct())


def bitmap(values: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of BITS buckets, as 64-bit words."""
    odd = np.bincount((values % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def required(a, b):
    """Common shingles that sets of these sizes need to link."""
    return (4 * (a + b) + 8) // 9


def t_occurrence(query: np.ndarray, members: list[np.ndarray]) -> list[int]:
    """The members that share enough of the sorted ``query``: DivideSkip over their inverted lists.

    The longest lists, up to L = T / (0.01 log2 M + 1), are set aside. A heap merges the others; whoever
    occurs T - L times there is probed in the long ones by binary search.
    """
    sizes = np.array([len(m) for m in members])
    need = required(len(query), sizes)
    owner = np.repeat(np.arange(len(members)), sizes)
    token = np.searchsorted(query, np.concatenate(members))
    hit = query[np.minimum(token, len(query) - 1)] == np.concatenate(members)
    token, owner = token[hit], owner[hit]
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    bounds = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True]) if len(token) else np.zeros(1, np.int64)
    lists = [owner[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    lists.sort(key=len)
    if not lists:
        return []
    least = int(need.min())
    n_long = min(len(lists), int(least / (0.01 * np.log2(max(2, len(lists[-1]))) + 1)), least - 1)
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    out = []
    for member, run in groupby(heapq.merge(*map(np.ndarray.tolist, short))):
        count = sum(1 for _ in run)
        if count < need[member] - n_long:
            continue
        for k, entries in enumerate(long):
            if count >= need[member] or count + len(long) - k < need[member]:
                break
            at = np.searchsorted(entries, member)
            count += at < len(entries) and entries[at] == member
        if count >= need[member]:
            out.append(member)
    return out


def _search(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links of a center (right, one row) to its members (left)."""
    query = right.column("query")[0].values.to_numpy(zero_copy_only=False).view(np.uint64) if right.num_rows else np.zeros(0, np.uint64)
    sets = left.column("set").combine_chunks()
    members = [s.values.to_numpy(zero_copy_only=False).view(np.uint64) for s in sets] if right.num_rows else []
    found = t_occurrence(query, members) if members else []
    b = left.column("member").to_numpy()[found]
    a = np.full(len(b), left.column("center")[0].as_py() if left.num_rows else 0, np.int64)
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (center, member) that link, each center with at most about MEMBERS members at once."""
    count = pairs.groupBy("center").agg(F.count("*").alias("c"))
    parts = F.ceil(F.col("c") / MEMBERS).cast("int")
    pairs = pairs.join(count, "center").withColumn("salt", F.pmod(F.xxhash64("member"), parts).cast("int")).select("center", "member", "salt")
    left = pairs.join(sets.select(F.col("rep").alias("member"), "set"), "member")
    right = pairs.select(F.col("center").alias("of"), F.col("salt").alias("share")).distinct().join(sets.select(F.col("rep").alias("of"), F.col("set").alias("query")), "of")
    return left.groupBy("center", "salt").cogroup(right.groupBy("of", "share")).applyInArrow(_search, "a bigint, b bigint")


def _prefix(n: Column) -> Column:
    """Length of the prefix of a set of ``n``, as the tasks cut it."""
    return n - F.floor((4 * n + 4) / 5) + 1 + F.floor(n / 50)


def _possible(a: str, b: str) -> Column:
    """What a link asks of two index rows: no set has more in common with another than its ``can`` shingles."""
    return 9 * F.least(f"{a}.can", f"{b}.can") >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs (center, member) of rows (a, b), one for each list, with the lists in common that a link needs.

    All common shingles up to the end of one prefix are in both, so at most c and what follows that
    prefix is common.
    """
    rest = lambda x: F.col(f"{x}.n") - _prefix(F.col(f"{x}.n"))
    need = F.ceil(4 * (F.col("a.n") + F.col("b.n")) / 9) - F.greatest(rest("a"), rest("b"))
    pairs = met.select(F.col("a.rep").alias("center"), F.col("b.rep").alias("member"), need.alias("need"))
    pairs = pairs.groupBy("center", "member").agg(F.count("*").alias("c"), F.max("need").alias("need"))
    return pairs.where(F.col("c") >= F.col("need")).select("center", "member")


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (center, member) whose bitmaps differ in no more bits than the sets of a link may differ in shingles."""
    small = sets.select("rep", F.size("set").cast("long").alias("n"), "bits")
    left, right = (small.toDF(side, f"n_{side}", f"bits_{side}") for side in ("center", "member"))
    bits = F.zip_with("bits_center", "bits_member", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differ = F.aggregate(bits, F.lit(0), lambda a, b: a + b)
    both = F.col("n_center") + F.col("n_member")
    met = pairs.join(left, "center").join(right, "member")
    return met.where(differ <= both - 2 * F.ceil(4 * both / 9)).select("center", "member").distinct()


def join(documents: DataFrame) -> DataFrame:
    """Components of linked documents: (doc_id, n_shingles, component_id), a row for each row.

    ``component_id`` is the smallest doc_id reachable by links, itself included. Null and empty texts
    have no shingles and no links. Rows with one id are one document; a null id has no component.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = stage(docs.mapInArrow(_survey, "doc_id bigint, n bigint, one bigint, two bigint, shingle bigint, times bigint"), "survey")
    rows = survey.where(F.col("n").isNotNull())
    repeats = survey.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT)
    known = repeats.orderBy(F.desc("times"), "shingle").limit(KNOWN).toPandas()  # bounded; orders the prefixes only
    frequent = known["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    entries = docs.select("text").mapInArrow(_prefixes(frequent[order], known["times"].to_numpy(np.int64)[order]), _ENTRY)
    shared = entries.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "one", "n").mapInArrow(_shared, f"{_ENTRY}, length bigint")
    shared = stage(shared, "shared")

    classes = rows.where(F.col("n") > 0).groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep")).where(F.col("rep").isNotNull())
    enough = shared.groupBy("one", "n").agg(F.count("*").alias("c")).where(F.col("c") > F.floor(F.floor(0.8 * F.col("n")) / 50))
    active = stage(classes.join(enough.select("one", F.col("n").cast("long").alias("n")), ["one", "n"]).select("rep", "one", F.col("n").cast("int").alias("n")), "active")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            values, bounds = shingle_sets(data, offsets)
            one, _ = _signatures(values, bounds)
            found = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            bits = pa.array([bitmap(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.list_(pa.int64()))
            right = pa.array(one == batch.column("one").to_numpy())  # an id may have other texts as well
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found, bits], names=["rep", "set", "bits"]).filter(right)

    # The active classes grow with the documents, so they are never broadcast. Repeated rows fall together here.
    chosen = active.select(F.col("rep").alias("doc_id"), "one").hint("merge")
    wanted = docs.withColumn("mark", F.xxhash64("text")).join(chosen, "doc_id").dropDuplicates(["doc_id", "one", "mark"]).select("doc_id", "one", "text")
    sets = stage(wanted.mapInArrow(sets_of, "rep bigint, set array<bigint>, bits array<bigint>"), "sets")

    # Of the prefix, what has no row in the index is in no other set: that bounds all overlaps of a set.
    # Stars: the center of a list is the class that is in the most lists, as a common origin is.
    mine, listed = Window.partitionBy("one", "n", "rep"), Window.partitionBy("shingle", "part")
    can = F.col("n") - _prefix(F.col("n")) + F.count("*").over(mine)
    index = shared.join(active, ["one", "n"]).select("shingle", "part", "rep", "n", "pos", can.cast("int").alias("can"), (F.sum("length").over(mine) / F.col("n")).alias("lists"))
    index = index.withColumn("a", F.max(F.struct("lists", "rep", "n", "can")).over(listed)).drop("part", "lists")
    index = stage(index.withColumn("a", F.struct("a.rep", "a.n", "a.can")), "index")
    stars = index.select("a", F.struct("rep", "n", "can").alias("b")).where((F.col("a.rep") != F.col("b.rep")) & _possible("a", "b"))
    links = stage(_links(stage(_close(_candidates(stars), sets), "stars"), sets), "links")
    labels = components(links)

    # Rest: lists that hold more than one component.
    label = F.coalesce("component", "rep").alias("label")
    marked = index.drop("a").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("shingle", "rep", "n", "can", "pos", label)
    pairs = marked.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_unlike, "center bigint, member bigint")
    pairs = _close(pairs.distinct(), sets)
    more = stage(_links(stage(pairs, "pairs"), sets), "links")
    final = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    reps = classes.join(final, F.col("rep") == F.col("node"), "left").select("n", "one", "two", F.coalesce("component", "rep").alias("class"))
    # An id with several texts belongs to the least component of them.
    placed = rows.join(reps, ["n", "one", "two"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class", "doc_id").alias("component_id"))
    return placed.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def representatives(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id; rows that repeat an id stay once each text."""
    plain = documents.toDF(*(str(k) for k in range(len(documents.columns))))  # so that no name clashes
    kept = join(documents).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    mine = F.col(f"`{documents.columns.index('doc_id')}`").cast("long")
    return plain.join(kept, mine.eqNullSafe(F.col("kept")), "left_semi").toDF(*documents.columns)
