"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

A document is contaminated by an item when some region of the item (``region`` bytes, or the whole of a
shorter item) aligns with a stretch of the document at ``rate`` edits a byte or fewer. A region of w bytes
with at most k edits shares at least w + 1 - q - k q q-grams with the stretch, on diagonals at most k apart.
So shared q-grams are counted in overlapping bands of diagonals, regions that reach the bound are kept,
and a banded alignment decides. q is 12, or w / (k + 1) where 12 would leave a bound below one, so filter and
alignment are exact for this definition, for all items of ``SHORTEST`` bytes or more; shorter ones say too little.

Memory is bounded whatever the texts repeat. Pairs of equal q-grams are made for about ``_PAIRS`` at once: a document with
more is read in windows that overlap by a region, a window's items are taken in groups, and items are cut into overlapping
pieces of ``PIECE`` bytes. A window whose bytes were seen before in its document is skipped, places of a document and
an item are aligned in order until one fits, and equal stretches are aligned once, so rulers of a million dashes cost little.

Texts are compared as bytes with A-Z in lower case and each white-space byte as a blank, so positions
stay those of the text. Benchmarks are the query set: they go to the tasks in blocks of bounded size,
and the documents, never shuffled, are read once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewitness.llm.textbytes import Rolling, eights, mix, slices

Q = 12
SHORTEST = 12
#: Bytes of items in one block, of one piece of an item and of a window of a document, and pairs of q-grams at once in a task.
BLOCK_BYTES = 1 << 20
PIECE = 4096
WINDOW = 512
_PAIRS = 1 << 20


def _plain(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    return table[data]


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each position on, q up to 16."""
    count = max(0, len(data) - q + 1)
    eight = eights(data)
    if q < 8:
        return mix(eight[:count] & np.uint64((1 << (8 * q)) - 1))
    return mix(eight[:count] ^ (mix(eight[q - 8 :][:count]) * np.uint64(0x9E3779B97F4A7C15)))


def _sorted(*keys: np.ndarray) -> np.ndarray:
    """The stable order by several keys, the first one leading, as one number where they fit."""
    bits = [int(k.max()).bit_length() for k in keys]
    if sum(bits) > 62:
        return np.lexsort(keys[::-1])
    one = np.zeros(len(keys[0]), np.int64)
    for k, b in zip(keys, bits):
        one = one << b | k
    return np.argsort(one, kind="stable")


Match = tuple[int, int, int, int, int]


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index ``count`` times, and the number of each copy."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


class Block:
    """Some benchmark items, as q-gram indexes that travel to the tasks: one for each q that they need."""

    def __init__(self, items: list[tuple[int, str]], region: int, rate: float):
        self.ids = [i for i, _ in items]
        groups: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for at, (_, text) in enumerate(items):
            plain = _plain(np.frombuffer(text.encode(), np.uint8))
            width = min(len(plain), region)
            q = max(1, min(Q, width // (int(width * rate) + 1)))
            for start in range(0, max(1, len(plain) - width + 1), PIECE):  # every region lies in one piece
                groups.setdefault(q, []).append((at, width, plain[start : start + PIECE + width - 1]))
        self.indexes = [_Index(q, pieces, rate) for q, pieces in sorted(groups.items())]

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[Match]:
        """(row, item, start, end, edits) for each row and item that match, positions in the row's bytes."""
        data = _plain(data)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for index in self.indexes:
            for row, piece, *found in index.matches(data, offsets):
                key = row, index.owner[piece]
                best[key] = min(best.get(key, tuple(found)), tuple(found))
        return [(*key, *found) for key, found in best.items()]


class _Index:
    """The q-gram index of pieces of items."""

    def __init__(self, q: int, pieces: list[tuple[int, int, np.ndarray]], rate: float):
        self.q = q
        self.owner = [at for at, _, _ in pieces]
        self.sizes = np.array([len(t) for _, _, t in pieces], np.int64)
        self.offsets = np.r_[0, np.cumsum(self.sizes)]
        self.data = np.concatenate([t for _, _, t in pieces])
        self.width = np.array([w for _, w, _ in pieces], np.int64)
        self.edits = (self.width * rate).astype(np.int64)
        self.bound = np.maximum(1, self.width + 1 - q - self.edits * q)
        self.reach = int((self.width + self.edits).max())
        at = np.concatenate([np.arange(o, o + n - q + 1) for o, n in zip(self.offsets, self.sizes)])
        keys = _grams(self.data, q)[at]
        order = np.argsort(keys, kind="stable")
        self.places = at[order]
        self.item = np.searchsorted(self.offsets, self.places, "right") - 1
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.r_[self.first, len(keys)]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> np.uint64(44)] = True

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Match]:
        keys = _grams(data, self.q)
        at = np.flatnonzero(self.seen[keys >> np.uint64(44)])
        slot = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        right = self.keys[slot] == keys[at]
        at, slot = at[right], slot[right]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + self.q <= offsets[row + 1]
        at, slot, row = at[inside], slot[inside], row[inside]
        if not len(at):
            return
        rolling = Rolling(data)
        pairs = np.bincount(row, self.first[slot + 1] - self.first[slot], len(offsets) - 1)
        heavy = pairs > _PAIRS
        light = ~heavy[row]
        group = np.cumsum(np.where(heavy, 0, pairs)) // _PAIRS  # whole rows, about _PAIRS pairs at once
        edges = np.flatnonzero(np.diff(group[row[light]], prepend=-1, append=-1))
        for begin, end in zip(edges[:-1], edges[1:]):
            yield from self._regions(data, offsets, rolling, at[light][begin:end], slot[light][begin:end], row[light][begin:end], set())
        for r in np.flatnonzero(heavy):
            first, last = np.searchsorted(row, [r, r + 1])
            yield from self._windows(data, offsets, rolling, at[first:last], slot[first:last], int(r))

    def _windows(self, data, offsets, rolling, at, slot, row: int) -> Iterator[Match]:
        """One row, by windows of its bytes that overlap by the longest region, the shorter the more pairs there are."""
        done: set[int] = set()
        known: set[int] = set()
        pairs, start, stop = None, int(at[0]), int(offsets[row + 1])
        while start <= at[-1]:
            if pairs is None:  # of the items without a match so far, before each hit
                alive = np.ones(len(self.sizes), bool)
                alive[list(done)] = False
                pairs = np.r_[0, np.cumsum(np.add.reduceat(alive[self.item].astype(np.int64), self.first[:-1])[slot])]
            first = int(np.searchsorted(at, start))
            for wide in (WINDOW, WINDOW // 4, WINDOW // 16):
                end = min(start + wide + self.reach, stop)
                last = int(np.searchsorted(at, end - self.q + 1))
                if pairs[last] - pairs[first] <= _PAIRS:
                    break
            if pairs[last] > pairs[first]:
                # The bytes that alignments of this window may read.
                low, high = max(int(offsets[row]), start - 2 * self.reach), min(stop, end + 2 * self.reach)
                text = int(rolling.of(np.array([low]), np.array([high]))[0]) ^ (start - low)
                if text not in known:
                    known.add(text)
                    found = list(self._regions(data, offsets, rolling, at[first:last], slot[first:last], np.full(last - first, row), done))
                    yield from found
                    if found:
                        done |= {f[1] for f in found}
                        pairs = None
            start += wide

    def _regions(self, data, offsets, rolling, at, slot, row, done: set[int]) -> Iterator[Match]:
        """Pairs of the given hits, by groups of items, without items in ``done``; fewer pairs of an item than its bound need no more."""
        order = np.argsort(slot, kind="stable")
        at, row = at[order], row[order]
        here, first, hits = np.unique(slot[order], return_index=True, return_counts=True)
        which, nth = _spread(self.first[here + 1] - self.first[here])
        place = self.first[here[which]] + nth
        item = self.item[place]
        many = np.bincount(item, hits[which], len(self.sizes))
        alive = many >= self.bound
        alive[list(done)] = False
        keep = alive[item]
        place, which, item = place[keep], which[keep], item[keep]
        group = (np.cumsum(np.where(alive, many, 0)) // _PAIRS)[item]
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            spread, nth = _spread(hits[which[mine]])
            hit = first[which[mine[spread]]] + nth
            yield from self._bands(data, offsets, rolling, at[hit], row[hit], self.places[place[mine[spread]]], item[mine[spread]])

    def _bands(self, data, offsets, rolling, at, row, place, item) -> Iterator[Match]:
        inner = place - self.offsets[item]
        # A pair of row and item with fewer hits than the bound needs no sorting.
        pair = (row - row.min()) * len(self.sizes) + item
        n = np.bincount(pair)[pair] if pair.max() < 1 << 23 else np.unique(pair, return_inverse=True, return_counts=True)
        n = n[2][n[1]] if isinstance(n, tuple) else n
        enough = n >= self.bound[item]
        at, row, inner, item, pair = at[enough], row[enough], inner[enough], item[enough], pair[enough]
        if not len(at):
            return
        k = self.edits[item]
        diagonal = at - offsets[row] - inner + self.sizes[item]
        wide = k + 1
        band = diagonal // wide
        also = (diagonal % wide < k) & (band > 0)  # bands overlap by k diagonals
        take = np.r_[np.arange(len(at)), np.flatnonzero(also)]
        band = np.r_[band, band[also] - 1]
        order = np.lexsort((at[take], band, pair[take])) if len(take) < 1 << 12 else _sorted(pair[take], band, at[take])
        take, band = take[order], band[order]
        at, row, inner, item, pair = at[take], row[take], inner[take], item[take], pair[take]
        need, reach = self.bound[item], self.width[item] + self.edits[item] - self.q
        last = np.arange(len(at)) + need - 1
        ok = last < len(at)
        last = np.minimum(last, len(at) - 1)
        ok &= (pair[last] == pair) & (band[last] == band) & (at[last] - at <= reach)
        if ok.any():  # a region has that many places of its own, which repeated grams of one place do not make up
            group = np.cumsum(np.r_[True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])]) - 1
            cells = np.unique(group * (int(self.sizes.max()) + 1) + inner)
            own = np.bincount(cells // (int(self.sizes.max()) + 1), minlength=group[-1] + 1)
            ok &= own[group] >= need
        yield from self._verify(data, offsets, rolling, at[ok], row[ok], inner[ok], item[ok], inner[last[ok]])

    def _verify(self, data, offsets, rolling, at, row, inner, item, inner_last) -> Iterator[Match]:
        """Of each row and item the first place, by position, at which a region fits; its least (start, end, edits)."""
        if not len(at):
            return
        low = np.maximum(0, np.minimum(np.minimum(inner, inner_last) + self.q, self.sizes[item]) - self.width[item] - self.edits[item])
        high = np.minimum(np.maximum(inner, inner_last) + self.edits[item], self.sizes[item] - self.width[item])
        low = np.minimum(low, high)
        places = np.stack([row, item, at - inner, low, high], 1)
        order = _sorted(row - row.min(), item, at)
        places = places[order]
        cell = np.zeros(len(places), np.uint64)
        for column in places.T:
            cell = mix(cell + column.astype(np.uint64))
        places = places[np.sort(np.unique(cell, return_index=True)[1])]
        pair = places[:, 0] * len(self.sizes) + places[:, 1]
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        nth = np.arange(len(pair)) - np.repeat(new, np.diff(np.r_[new, len(pair)]))
        found: dict[int, Match] = {}
        begin, many = 0, 1
        while True:  # the next 1, 2, 4, ... places of each pair that has not matched yet
            mine = np.flatnonzero((nth >= begin) & (nth < begin + many))
            mine = mine[~np.isin(pair[mine], list(found))] if found else mine
            for part in np.array_split(mine, max(1, int((places[mine, 4] - places[mine, 3] + 1).sum() >> 16))):
                for j, match in self._fits(data, offsets, rolling, places[part]):
                    key = int(pair[part[j]])
                    if key not in found or (int(nth[part[j]]), match) < found[key]:
                        found[key] = int(nth[part[j]]), match
            begin, many = begin + many, 2 * many
            if begin > nth.max():
                break
        for _, match in found.values():
            yield match

    def _fits(self, data, offsets, rolling, places) -> Iterator[tuple[int, Match]]:
        """Matches of the given places: every region that may hold their hits is aligned, equal ones once."""
        for w in np.unique(self.width[places[:, 1]]):
            rows = np.flatnonzero(self.width[places[:, 1]] == w)
            spread, nth = _spread(places[rows, 4] - places[rows, 3] + 1)
            which = rows[spread]
            row, item, shift = places[which, :3].T
            a = places[which, 3] + nth
            k = int(self.edits[item[0]])
            begin = offsets[row] + shift + a - k
            low, high = np.clip(begin, offsets[row], offsets[row + 1]), np.clip(begin + w + 2 * k, offsets[row], offsets[row + 1])
            cell = mix(rolling.of(low, high) ^ mix((self.offsets[item] + a).astype(np.uint64)) ^ mix((low - begin).astype(np.uint64) + np.uint64(1 << 40)))
            _, one, back = np.unique(cell, return_index=True, return_inverse=True)
            tries = np.stack([row, item, shift, a], 1)[one]
            edits, start, end = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
            for s in range(0, len(tries), 1 << 13):
                part = slice(s, s + (1 << 13))
                edits[part], start[part], end[part] = self._align(data, offsets, tries[part], int(w), k)
            start, end = start - tries[:, 2] - tries[:, 3], end - tries[:, 2] - tries[:, 3]  # from the region's place
            for j in np.flatnonzero(edits[back] <= k):
                b = back[j]
                here = int(shift[j] + a[j])
                yield int(which[j]), (int(row[j]), int(item[j]), here + int(start[b]), here + int(end[b]), int(edits[b]))

    def _align(self, data, offsets, tries, w: int, k: int):
        """Edit distance of item[a:a + w] to the best stretch of the row within k diagonals; its place."""
        row, item, shift, a = tries.T
        columns = np.arange(2 * k + 1)
        cost = np.zeros((len(tries), 2 * k + 1), np.int32)
        begins = shift[:, None] + a[:, None] + columns - k
        base = self.offsets[item] + a
        begin, behind = offsets[row][:, None], offsets[row + 1][:, None]
        far = np.int32(w + 1)
        for r in range(w):
            j = shift[:, None] + (a[:, None] + r) + columns - k
            there = (j >= begin) & (j < behind)
            letter = np.where(there, data[np.clip(j, 0, len(data) - 1)].astype(np.int32), -1)
            step = cost + (letter != self.data[base + r][:, None])
            source = begins.copy()
            skip = np.full_like(cost, far)  # an item byte without partner
            skip[:, :-1] = cost[:, 1:] + 1
            better = skip < step
            step = np.where(better, skip, step)
            source[:, :-1] = np.where(better[:, :-1], begins[:, 1:], source[:, :-1])
            for c in range(1, 2 * k + 1):  # a document byte without partner
                longer = step[:, c - 1] + 1
                better = longer < step[:, c]
                step[:, c] = np.where(better, longer, step[:, c])
                source[:, c] = np.where(better, source[:, c - 1], source[:, c])
            cost, begins = step, source
        at = cost.argmin(1)
        line = np.arange(len(tries))
        start = np.clip(begins[line, at], offsets[row], offsets[row + 1]) - offsets[row]
        end = np.clip(shift + a + w + at - k, offsets[row], offsets[row + 1]) - offsets[row]
        return cost[line, at], start, end


def blocks(benchmark: DataFrame, region: int = 80, rate: float = 0.05) -> Iterator[Block]:
    """The items in blocks of about BLOCK_BYTES; those shorter than SHORTEST bytes say too little and are left out."""
    items, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where(F.octet_length("text") >= SHORTEST).toLocalIterator():
        items.append(tuple(r))
        held += len(r[1].encode())
        if held >= BLOCK_BYTES:
            yield Block(items, region, rate)
            items, held = [], 0
    if items:
        yield Block(items, region, rate)


def find(documents: DataFrame, benchmark: DataFrame, region: int = 80, rate: float = 0.05) -> DataFrame:
    """Matches: (doc_id, item_id, start, end, edits), one row for a document row and an item.

    ``start``, ``end`` and ``edits`` are those of the first region found, by the place of its first shared q-gram in the
    document. Clean documents, null and empty texts have no row; an empty benchmark gives an empty table.
    """
    schema = "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks(benchmark, region, rate):
        part = docs.mapInArrow(_finder(block), schema)
        out = part if out is None else out.unionByName(part)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def _finder(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            found = block.matches(data, offsets)
            if found:
                row, item, start, end, edits = (np.array(x, np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(row)), "item_id": pa.array([block.ids[i] for i in item], pa.int64()), "start": start, "end": end, "edits": edits,
                })

    return run


def clean(documents: DataFrame, benchmark: DataFrame, region: int = 80, rate: float = 0.05) -> DataFrame:
    """The documents without any match, row by row and without a shuffle."""
    for block in blocks(benchmark, region, rate):
        documents = documents.mapInArrow(_keeper(block), documents.schema)
    return documents


def _keeper(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[[m[0] for m in block.matches(data, offsets)]] = False
            yield batch.filter(pa.array(keep))

    return run
