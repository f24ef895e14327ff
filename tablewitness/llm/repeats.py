"""Removal of byte strings that occur more than once, by suffix order and longest previous factors.

A byte goes when a string of ``length`` bytes that covers it also starts elsewhere. Sorting all suffixes of a corpus
is not needed for that: strings that are equal have the same anchor, the least hash among their grams of
``GRAM`` bytes, so a suffix order of all places with one anchor is enough.

1. Runs. Neighbouring starts with one anchor are a run; its text holds all their strings. Runs are
   shuffled by anchor as hashes. Equal runs are repeats as a whole; runs that differ under one anchor stay
   open; an anchor with one run is done.
2. Open runs get their bytes from the documents and are sorted: the suffix order of their starts, the
   common lengths of neighbours, and for each suffix the nearest ones before and after it in that order
   that lie earlier in the text. The larger common length is the longest previous factor: from ``length`` on,
   the start repeats an earlier one.
3. Anchors with many different runs (the edge of a passage in very many documents) are not sorted in one
   task: their strings are counted by a digest of 128 bits, with partial sums in every task.

Equal runs inside one batch are one row with a mark, so that copies of one text do not meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewitness.llm.textbytes import Rolling, slices
from tablewitness.session import stage

GRAM = 100
#: Different runs of an anchor in a batch, and in all, from which on it is counted by digests.
WIDE_HERE, WIDE = 8, 2048
#: Bytes that one suffix order covers.
BLOCK_BYTES = 1 << 20
_ANCHOR, _MARK, _WIDE, _FULL = range(4)
_PLACE = np.uint64((1 << 28) - 1)


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: (row, start in the row, number of starts, anchor hash, hash of the run)."""
    nothing = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return nothing
    if len(data) > int(_PLACE):
        raise ValueError("texts of 256 MB and more have to be split before")
    rolling = Rolling(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = rolling.of(at, at + GRAM)
    least = _least_of((grams & ~_PLACE) | at.astype(np.uint64), length - GRAM + 1)
    anchor = (least & _PLACE).astype(np.int64)
    starts = np.concatenate([np.arange(a, max(a, b - length + 1)) for a, b in zip(offsets[:-1], offsets[1:])])
    if not len(starts):
        return nothing
    anchor = anchor[starts]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[first[1:], len(starts)] - 1
    begin, end = starts[first], starts[last] + length
    row = np.searchsorted(offsets, begin, "right") - 1
    return row, begin - offsets[row], last - first + 1, grams[anchor[first]], Rolling(data, 2).of(begin, end)


_RUN = "anchor bigint, run bigint, doc bigint, key bigint, packed bigint"


def _find_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts, before = [], 0
            for batch, data, offsets in slices([whole]):
                row, *rest = runs(data, offsets, length)
                parts.append((row + before, *rest))
                before += batch.num_rows
            if not parts:
                continue
            row, at, starts, anchor, text = (np.concatenate(x) for x in zip(*parts))
            doc, key = (whole.column(c).to_numpy()[row] for c in ("doc", "key"))
            order = np.lexsort((at, key, doc, text, anchor))
            row, at, starts, anchor, text, doc, key = (x[order] for x in (row, at, starts, anchor, text, doc, key))
            other = np.ones(len(anchor), bool)
            other[1:] = anchor[1:] != anchor[:-1]
            new = other.copy()
            new[1:] |= text[1:] != text[:-1]
            group = np.cumsum(other) - 1
            wide = (np.bincount(group, weights=new) >= WIDE_HERE)[group] if len(group) else other
            kind = np.where(new, np.where(wide, _WIDE, _ANCHOR), _FULL)
            several = new & np.r_[~new[1:], False] if len(new) else new
            packed = (at << 12) | (starts << 3) | (several << 2) | kind
            marks = np.flatnonzero(other & wide)
            take = np.r_[np.arange(len(anchor)), marks]
            packed = np.r_[packed, (packed[marks] >> 2 << 2) | _MARK]
            yield pa.RecordBatch.from_pydict({
                "anchor": anchor[take].view(np.int64), "run": text[take].view(np.int64), "doc": doc[take], "key": key[take], "packed": packed,
            })

    return run


_MARKED = "what int, anchor bigint, doc bigint, key bigint, start bigint, starts bigint, own boolean, several boolean"


def _resolve(keep_first: bool):
    """Decide runs in a partition sorted by anchor, run, doc, key and packed: ``what`` is 0 for a repeat as
    a whole, 1 for an open run to be sorted, 2 for one to be counted. ``own`` runs are to be marked, the
    others only help to mark."""

    def decided(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchor, text, doc, key, packed = (batch.column(c).to_numpy() for c in ("anchor", "run", "doc", "key", "packed"))
        kind, several = packed & 3, (packed >> 2 & 1).astype(bool)
        by_anchor = kind < _WIDE
        other = np.ones(len(anchor), bool)
        other[1:] = anchor[1:] != anchor[:-1]
        group = np.cumsum(other) - 1
        sort = np.lexsort((packed, key, doc, text, kind != _ANCHOR, group))  # real runs of a group first
        inverse = np.empty_like(sort)
        inverse[sort] = np.arange(len(sort))
        g, t, real = group[sort], text[sort], kind[sort] == _ANCHOR
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1]) | ~real[1:] | ~real[:-1]
        label = np.cumsum(new) - 1
        times = np.bincount(label, weights=1 + several[sort])[label]
        distinct = np.bincount(g, weights=new & real)
        wide = np.bincount(g, weights=kind[sort] == _MARK) > 0
        wide |= distinct > WIDE
        new, times = new[inverse], times[inverse]
        more = (distinct > 1)[group] | wide[group]
        repeat = by_anchor & (kind == _ANCHOR) & (times > 1)
        first = (kind == _ANCHOR) & new
        full = (kind == _FULL) | (repeat & ~first if keep_first else repeat) | ((kind == _WIDE) & several & (not keep_first))
        open_ = (first & more) | (kind == _WIDE)
        what = np.where((kind == _WIDE) | wide[group], 2, 1)
        out = []
        for chosen, code in ((np.flatnonzero(full), 0), (np.flatnonzero(open_), None)):
            own = np.ones(len(chosen), bool) if code == 0 or keep_first else ~full[chosen]
            out.append((np.zeros(len(chosen), np.int64) if code == 0 else what[chosen], chosen, own))
        what, chosen, own = (np.concatenate(x) for x in zip(*out))
        marked = np.where(kind == _ANCHOR, times > 1, several)
        return pa.RecordBatch.from_pydict({
            "what": what.astype(np.int32), "anchor": anchor[chosen], "doc": doc[chosen], "key": key[chosen], "start": packed[chosen] >> 12,
            "starts": packed[chosen] >> 3 & 511, "own": own, "several": marked[chosen],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            anchor = batch.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0  # the last anchor may go on
            held = batch.slice(cut)
            if cut:
                yield decided(batch.slice(0, cut))
        if held is not None and held.num_rows:
            yield decided(held)

    return run


_OPENED = "what int, one bigint, two bigint, bytes binary, doc bigint, key bigint, start bigint, own boolean, several boolean"


def _open(length: int):
    """Bytes of open runs to be sorted; digests of all strings of those to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            found = batch.column("open").combine_chunks() if isinstance(batch.column("open"), pa.ChunkedArray) else batch.column("open")
            row = np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy())
            flat = found.flatten()
            what, anchor, start, starts, own, several = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("what", "anchor", "start", "starts", "own", "several"))
            doc, key = (batch.column(c).to_numpy()[row] for c in ("doc", "key"))
            begin = offsets[row] + start
            sort, count = np.flatnonzero(what == 1), np.flatnonzero(what == 2)
            texts = [data[b : b + n + length - 1].tobytes() for b, n in zip(begin[sort], starts[sort])]
            which = np.repeat(count, starts[count])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(starts[count]) - starts[count], starts[count])
            at = begin[which] + nth
            one, two = (Rolling(data, s).of(at, at + length).view(np.int64) for s in (3, 4))
            take = np.r_[sort, which]
            yield pa.RecordBatch.from_pydict({
                "what": what[take].astype(np.int32), "one": np.r_[anchor[sort], one], "two": np.r_[np.zeros(len(sort), np.int64), two],
                "bytes": pa.array([*texts, *[None] * len(which)], pa.binary()), "doc": doc[take], "key": key[take],
                "start": np.r_[start[sort], start[which] + nth], "own": own[take], "several": several[take],
            })

    return run


class SuffixOrder:
    """Chosen suffixes of ``data`` in the order of their first 256 bytes, and what they have in common."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = np.r_[data, np.zeros(256, np.uint8)].astype(np.uint64)
        size = len(padded)
        key = np.zeros(size - 7, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : size - 7 + k]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        self.ranks = {8: rank}
        for step in (8, 16, 32, 64):  # ranks of twice as many bytes, by doubling
            pair = rank[: len(rank) - step] * (size + 1) + rank[step:]
            rank = self.ranks[2 * step] = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        pair = rank[starts] * (size + 1) + rank[np.minimum(starts + 128, len(rank) - 1)]
        self.order = np.argsort(pair, kind="stable")
        self.at = starts[self.order]
        #: Common length with the suffix before, in steps of eight bytes, up to 248.
        self.common = np.zeros(len(starts), np.int64)
        for step in (128, 64, 32, 16, 8):
            rank = self.ranks[step]
            a, b = self.at[1:] + self.common[1:], self.at[:-1] + self.common[1:]
            inside = (a < len(rank)) & (b < len(rank))
            equal = inside & (rank[np.minimum(a, len(rank) - 1)] == rank[np.minimum(b, len(rank) - 1)])
            self.common[1:] += step * equal

    @staticmethod
    def _nearest_smaller(at: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Common length with the nearest entry before, in this order, whose place is smaller."""
        n = len(at)
        near, shared = np.arange(n) - 1, common.copy()
        todo = np.flatnonzero((near >= 0) & (at[near] > at))
        while len(todo):  # all entries up to the one that the nearest one points at have greater places as well
            via = near[todo]
            shared[todo] = np.minimum(shared[todo], shared[via])
            near[todo] = near[via]
            todo = todo[(near[todo] >= 0) & (at[near[todo]] > at[todo])]
        return np.where(near >= 0, shared, 0)

    def _factors(self, at: np.ndarray) -> np.ndarray:
        before = self._nearest_smaller(at, self.common)
        back = self._nearest_smaller(at[::-1], np.r_[0, self.common[:0:-1]])[::-1]
        out = np.zeros(len(at), np.int64)
        out[self.order] = np.maximum(before, back)
        return out

    def previous(self) -> np.ndarray:
        """The longest previous factor of each chosen suffix, in the order they were given."""
        return self._factors(self.at)

    def following(self) -> np.ndarray:
        """The longest factor that starts again later: previous factors with the places in reverse."""
        return self._factors(-self.at)


def _sorted_runs(length: int, keep_first: bool):
    def repeats(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.take(pa.array(np.lexsort([rows.column(c).to_numpy() for c in ("start", "key", "doc")])))
        doc, key, start = (rows.column(c).to_numpy() for c in ("doc", "key", "start"))
        texts = rows.column("bytes").to_pylist()
        sizes = np.array([len(t) for t in texts])
        begin = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        which = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        order = SuffixOrder(np.frombuffer(b"".join(texts), np.uint8), begin[which] + nth)
        hit = order.previous() >= length
        if not keep_first:
            hit |= order.following() >= length
        hit &= rows.column("own").to_numpy(zero_copy_only=False)[which]
        which, nth = which[hit], nth[hit]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (nth[1:] != nth[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(which)][: len(first)] - 1
        which, a, b = which[first], nth[first], nth[last]
        return pa.RecordBatch.from_pydict({"doc": doc[which], "key": key[which], "start": start[which] + a, "end": start[which] + b + length})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # about BLOCK_BYTES at once, and all runs of an anchor
                part = batch.slice(at, 4096)
                at += part.num_rows
                held.append(part)
                if sum(x.column("bytes").nbytes for x in held) < BLOCK_BYTES:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table.column("one").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))
                held = table.slice(cut).to_batches()
                if cut:
                    yield repeats(table.slice(0, cut))
        if held and sum(x.num_rows for x in held):
            yield repeats(pa.Table.from_batches(held))

    return run


def spans(documents: DataFrame, length: int = 200, keep_first: bool = True) -> DataFrame:
    """Repeated stretches, not merged: (doc, key, start, end) in bytes of the text.

    ``doc`` is doc_id with null as the least number, ``key`` a hash of the text; rows that agree in both are
    copies. With ``keep_first`` the first place of each string, by doc, key and position, is left out.
    """
    if not 2 * GRAM <= length <= 248 or length % 8:
        raise ValueError("length is a multiple of 8 between 200 and 248")
    docs = _keyed(documents)
    found = docs.mapInArrow(_find_runs(length), _RUN)
    by = F.when(F.col("packed").bitwiseAND(3) < _WIDE, F.xxhash64("anchor")).otherwise(F.xxhash64("doc", "key"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = found.repartition(parts, by).sortWithinPartitions("anchor", "run", "doc", "key", "packed").mapInArrow(_resolve(keep_first), _MARKED)
    marked = stage(marked, "marked")
    full = marked.where("what = 0").select("doc", "key", "start", (F.col("start") + F.col("starts") + length - 1).alias("end"))
    opens = marked.where("what > 0").groupBy("doc", "key").agg(F.collect_set(F.struct("what", "anchor", "start", "starts", "own", "several")).alias("open"))
    # One row for each of equal documents is enough: their runs stand for all of them.
    opened = docs.join(opens, ["doc", "key"]).dropDuplicates(["doc", "key"]).select("doc", "key", "text", "open").mapInArrow(_open(length), _OPENED)
    opened = stage(opened, "opened")
    runs_ = opened.where("what = 1").repartition(parts, "one").sortWithinPartitions("one")
    sorted_ = runs_.mapInArrow(_sorted_runs(length, keep_first), "doc bigint, key bigint, start bigint, end bigint")
    strings = opened.where("what = 2").select("one", "two", "doc", "key", "start", "own", "several")
    place = F.struct("doc", "key", "start")
    counts = strings.groupBy("one", "two").agg(F.sum(F.when(F.col("several"), 2).otherwise(1)).alias("times"), F.min(place).alias("first")).where(F.col("times") > 1)
    counted = strings.where("own").join(counts, ["one", "two"])
    if keep_first:
        counted = counted.where(place != F.col("first"))
    counted = counted.select("doc", "key", "start", (F.col("start") + length).alias("end"))
    return full.unionByName(sorted_).unionByName(counted)


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def remove(documents: DataFrame, length: int = 200, keep_first: bool = True, with_text: bool = True) -> DataFrame:
    """Each document without its repeated bytes: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept).

    ``kept`` is binary, since a stretch may end inside a character. Null counts as empty; texts shorter than
    ``length`` stay whole; a row for each row. Without ``keep_first`` every copy of a repeated string goes.
    """
    found = spans(documents, length, keep_first).groupBy("doc", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = _keyed(documents).join(stage(found, "spans"), ["doc", "key"], "left").select("doc", "text", "spans")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            out = []
            for i, doc in enumerate(batch.column("doc").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                cuts = batch.column("spans")[i].values
                stay, n_spans = raw, 0
                if cuts is not None and len(cuts):
                    change = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(change, cuts.field("start").to_numpy(), 1)
                    np.add.at(change, cuts.field("end").to_numpy(), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                    stay = raw[~gone]
                kept = stay.tobytes()
                out.append((None if doc == -(1 << 63) else doc, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept)[: 5 + with_text])
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, schema)
