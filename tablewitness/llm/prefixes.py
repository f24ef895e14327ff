"""The trie of conversation prefixes, from sorted conversations and range minima.

Conversations become byte strings of their turns' digests (MD5 of role and text, 16 bytes a turn); sorted, every prefix is an
interval of neighbours. Inside a range partition a sparse table holds the minima of the LCPs of neighbours over all
windows of 2**k rows. A row has a candidate prefix for each depth beyond its LCP with the row before; binary searches in the table give each candidate's left
and right extent on their own, no stack and no order between candidates, all at once in numpy. Another sparse
table gives the smallest conv_id of an interval, and sums over a subtree are differences of running sums, because candidates in (row, depth) order
are the trie in preorder.

A prefix of a partition's first or last row may go on in the next partition. Such edge nodes, at most two paths a
partition, are sent on as parts with the digest of their prefix as key, and merged: counts add up, the ids of members that end there
are concatenated in order, and what an edge node adds to the sums of its ancestors (all of them edge nodes) is added by key. No window,
list or task ever holds a hot prefix; the root is one small row for each partition.

Ranges end by (path, conv_id), so a large group of equal conversations is cut as well. A single conversation is a unit: 16 bytes a
turn. The ids that end at one node are hashed as one stream, in order, by one task, as SHA-256 demands.

Rows without a conv_id belong to no conversation; turns with equal numbers come by role, then by the MD5 of the text; null role or
text is empty; other columns are ignored; an empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewitness.session import stage

#: Bytes of a turn's digest.
WIDTH = 16
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_PART = _NODE + ", block bigint, key binary, parent_key binary, above array<binary>, words bigint, ends string, end bigint"


def minima(values: np.ndarray) -> list[np.ndarray]:
    """The sparse table: level k holds the minimum of values[i : i + 2**k]."""
    table, width = [values], 1
    while 2 * width <= len(values):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


def least(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minimum of values[first : last + 1], by two windows that cover it."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), table[0].dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][first[at]], table[k][last[at] + 1 - (1 << int(k))])
    return out


def extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share ``depth`` turns with ``row``; values[i] is the LCP of rows i - 1 and i.

    Each side is a binary search by halving windows: a window is taken when its minimum reaches the depth.
    """
    n = len(table[0])
    left, right = row.copy(), row.copy()
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        fits = left - step >= 0  # rows left - step + 1 .. left are compared with the ones before them
        fits[fits] = table[k][left[fits] - step + 1] >= depth[fits]
        left[fits] -= step
        fits = right + step < n
        fits[fits] = table[k][right[fits] + 1] >= depth[fits]
        right[fits] += step
    return left, right


def common(paths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the row before; -1 for the first."""
    size = np.diff(offsets)
    out = np.zeros(len(size), np.int64)
    out[:1] = -1
    rows = np.arange(1, len(size))
    rows = rows[np.minimum(size[rows], size[rows - 1]) > 0]
    while len(rows):
        d = out[rows]
        rows = rows[(paths[offsets[rows] + d] == paths[offsets[rows - 1] + d]).all(1)]
        out[rows] += 1
        rows = rows[out[rows] < np.minimum(size[rows], size[rows - 1])]
    return out


def _nodes(conv: np.ndarray, path: np.ndarray, offsets: np.ndarray, words: np.ndarray, block: int) -> dict[str, object]:
    """All prefixes of one sorted partition, with ``_PART``'s columns."""
    n, size = len(conv), np.diff(offsets)
    lcp = common(path, offsets)
    table, ids = minima(lcp), minima(conv)
    count = size - lcp
    row = np.repeat(np.arange(n), count)
    start = np.cumsum(count) - count
    depth = np.arange(len(row)) - start[row] + lcp[row] + 1
    left, right = extents(table, row, depth)
    edge = (left == 0) | (right == n - 1)
    above, _ = extents(table, row, depth - 1)  # where the parent begins
    parent = np.where(depth > 0, start[above] + depth - 1 - (lcp[above] + 1), -1)
    members = right - left + 1
    last_word = np.where(depth > 0, words[np.minimum(offsets[row] + np.maximum(depth - 1, 0), max(len(words) - 1, 0))] if len(words) else 0, 0)
    inner = ~edge
    children = np.bincount(parent[(parent >= 0) & inner], minlength=len(row))
    own = np.where(inner, (members - 1) * last_word, 0)
    leaf = inner & (children == 0)
    last = start[right] + count[right] - 1  # the last candidate of the subtree, in preorder
    saved, leaves = np.r_[0, np.cumsum(own)], np.r_[0, np.cumsum(leaf)]
    at = np.arange(len(row))
    alike = np.r_[lcp[1:] == size[1:], False] & (np.r_[size[1:], 0] == size)  # the next row has the same path
    runs = np.flatnonzero(~alike)  # each run's last row
    ends_at = (depth == size[row])
    stop = runs[np.searchsorted(runs, row)]
    texts, hashes = [], []
    for i in range(len(row)):
        mine = ",".join(map(str, conv[row[i] : stop[i] + 1].tolist())) if ends_at[i] else ""
        texts.append(mine if edge[i] else None)
        hashes.append(None if edge[i] else hashlib.sha256(mine.encode()).hexdigest())
    prefixes: dict[int, list[bytes]] = {}

    def key(j: int) -> bytes:
        r, d = int(row[j]), int(depth[j])
        if r not in prefixes:
            running, chain = hashlib.md5(), [hashlib.md5().digest()]
            for turn in path[offsets[r] : offsets[r + 1]]:
                running.update(turn.tobytes())
                chain.append(running.digest())
            prefixes[r] = chain
        return prefixes[r][d]

    keys = [key(j) if edge[j] else None for j in at]
    parents = [key(int(row_parent)) if depth[j] > 0 and edge[row_parent] else None for j, row_parent in zip(at, parent)]
    above_of = [prefixes[int(row[j])][: int(depth[j])] if edge[j] else None for j in at]
    smallest = least(ids, left, right)
    inside = inner & (depth > 0) & ~edge[parent]
    return {
        "conv_id": smallest, "depth": depth, "parent_conv_id": pa.array(np.where(inside, smallest[parent], 0), pa.int64(), mask=~inside), "n_convs": members,
        "n_children": children, "n_leaves": leaves[last + 1] - leaves[at], "saved_tokens": saved[last + 1] - saved[at], "ends_sha256": pa.array(hashes, pa.string()),
        "block": np.full(len(row), block), "key": pa.array(keys, pa.binary()), "parent_key": pa.array(parents, pa.binary()), "above": pa.array(above_of, pa.list_(pa.binary())),
        "words": last_word.astype(np.int64), "ends": pa.array(texts, pa.string()), "end": pa.array(np.where(ends_at, conv[row], 0), pa.int64(), mask=~ends_at),
    }


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    conv = table.column("conv_id").to_numpy()
    raw = table.column("path").to_pylist()
    offsets = np.r_[0, np.cumsum([len(p) // WIDTH for p in raw])].astype(np.int64)
    path = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, WIDTH // 8)
    words = table.column("words").combine_chunks().flatten().to_numpy().astype(np.int64)
    out = _nodes(conv, path, offsets, words, TaskContext.get().partitionId())
    whole = pa.Table.from_pydict(out)
    yield from whole.select([part.split()[0] for part in _PART.split(", ")]).to_batches(max_chunksize=10_000)


def turns(conversations: DataFrame) -> DataFrame:
    """Each conversation as the ordered list of its turns: (conv_id, turns array<struct<nth, digest, words>>)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text).alias("text"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    ).repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select("conv_id", F.row_number().over(order).alias("nth"), F.md5(F.concat("role", F.lit("\x00"), "text")).alias("digest"), "words")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "digest", "words"))).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, path, words): the first h turns of the conversation that opens its group of ``group``, then its own after h.

    h is the crc32 of the decimal conv_id modulo ``heads``; an absent opener gives no turns.
    """
    lists = turns(conversations)
    opener = F.col("conv_id") - F.col("conv_id") % group
    firsts = lists.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("opener"), F.slice("turns", 1, heads - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    rows = lists.select("conv_id", "turns", opener.alias("opener"), h.alias("h")).join(firsts, "opener", "left")
    none = F.array().cast("array<struct<nth:int,digest:string,words:int>>")
    own = F.filter("turns", lambda t: t["nth"] > F.col("h"))
    rows = rows.select("conv_id", F.concat(F.filter(F.coalesce("first", none), lambda t: t["nth"] <= F.col("h")), own).alias("turns"))
    return rows.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of edge nodes, sorted by key and the first id that ends in them, to one row each, as a stream."""
    names = ["key", "parent_key", "above", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "ends_sha256"]
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.binary()), *[pa.int64()] * 7, pa.string()]
    now: dict | None = None

    def close() -> tuple:
        return tuple(now[c] for c in names[:-1]) + (now["hash"].hexdigest(),)

    for batch in batches:
        done = []
        for r in (r for k in range(0, batch.num_rows, 64) for r in batch.slice(k, 64).to_pylist()):
            if now is not None and r["key"] == now["key"]:
                now["conv_id"] = min(now["conv_id"], r["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    now[c] += r[c]
            else:
                if now is not None:
                    done.append(close())
                now = r | {"hash": hashlib.sha256(), "any": False}
            if r["ends"]:
                now["hash"].update((("," if now["any"] else "") + r["ends"]).encode())
                now["any"] = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(close()), kinds)], names=names)


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, path, words), one row each with ``_NODE``'s columns.

    conv_id is the smallest member, parent_conv_id the parent's, null at the root. ``saved_tokens`` counts, over the
    subtree, the words of each node's turn that all but one of its members need not repeat.
    """
    ranged = sequences.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = stage(ranged.mapInArrow(_partition, _PART), "nodes")
    parts = nodes.where("key IS NOT NULL")
    kept = parts.select("key", "parent_key", "above", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "ends", "end")
    schema = "key binary, parent_key binary, above array<binary>, conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string"
    edges = stage(kept.repartition("key").sortWithinPartitions("key", F.col("end").asc_nulls_last()).mapInArrow(_merged, schema), "edges")
    below = edges.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("edge_children"))
    edges = edges.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("edge_children", F.lit(0)))
    edges = edges.withColumns({"own": (F.col("n_convs") - 1) * F.col("words"), "leaf": (F.col("n_children") == 0).cast("long")})
    giving = edges.where("own > 0 OR leaf > 0").select(F.explode(F.concat("above", F.array("key"))).alias("key"), "own", "leaf")
    sums = giving.groupBy("key").agg(F.sum("own").alias("own_sum"), F.sum("leaf").alias("leaf_sum"))
    edges = edges.join(sums, "key", "left")
    ids = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_id"))
    edges = stage(edges.join(ids, "parent_key", "left").select(
        "key", "conv_id", "depth", F.col("parent_id").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.coalesce("leaf_sum", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("own_sum", F.lit(0))).alias("saved_tokens"), "ends_sha256",
    ), "edges")
    # The parents of inner nodes by block, so that no key has more rows than a partition.
    known = parts.select("block", "key").join(edges.select("key", F.col("conv_id").alias("parent_id")), "key")
    known = known.select("block", F.col("key").alias("parent_key"), "parent_id")
    columns = [part.split()[0] for part in _NODE.split(", ")]
    inner = nodes.where("key IS NULL")
    loose = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(known, ["block", "parent_key"]).withColumnRenamed("parent_id", "parent_conv_id")
    return inner.where("parent_key IS NULL").select(columns).unionByName(loose.select(columns)).unionByName(edges.select(columns))
