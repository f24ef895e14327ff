"""CSV records from splits of files: line ends inside quotes, without one task per file.

Spark's text source cuts files into splits and gives each split its lines. Whether a split begins inside a quoted
field depends on all text before it, but as a function of two cases only: a first pass finds, for each split, in which state it
ends when it begins outside and when it begins inside quotes. Composing these functions in file order is one small list
for each file; the second pass then knows its start. Records that cross splits are put together from fragments, at most two a split.

The rules are those of the whole-file reader: a quote opens a field only at its beginning, two quotes inside are one,
and what follows a closing quote up to the next comma belongs to the field.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewitness.session import stage

RECORD, TAIL, MIDDLE, HEAD = range(4)
_SURVEY = "path string, block bigint, from_outside boolean, from_inside boolean, first string"
_STARTS = "path string, block bigint, inside boolean, header boolean, first string, closed boolean"
_PARTS = "path string, split bigint, row bigint, part int, record string, header boolean"


def ends_inside(line: str, inside: bool, comma: str = ",") -> bool:
    """Whether the end of a line lies inside a quoted field, given whether its begin does."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(comma + '"', at)
                if at < 0:
                    return False
                at += 1
            at += 1  # behind the opening quote
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            if not line.startswith('"', at + 1):
                break
            at += 2
        at = line.find(comma, at + 1)
        if at < 0:
            return False
        at, inside = at + 1, False


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All lines, with the file and the begin of the split that they came from; in order inside a split."""
    text = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    return text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _splits(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one split; a task may read several, one after the other."""
    block = batch.column("block").to_numpy()
    path = batch.column("path").dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (path[1:] != path[:-1])]) if len(block) else block
    for a, b in zip(edges, np.r_[edges[1:], len(block)]):
        yield batch.slice(int(a), int(b - a))


def _quoted(values: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, int], list] = {}
    for batch in batches:
        for part in _splits(batch):
            key = part.column("path")[0].as_py(), part.column("block")[0].as_py()
            found = seen.setdefault(key, [False, True, None])
            values = part.column("value")
            if found[2] is None:
                text = np.flatnonzero(pc.not_equal(pc.utf8_trim_whitespace(values), "").to_numpy(zero_copy_only=False))
                found[2] = values[int(text[0])].as_py() if len(text) else None
            for i in _quoted(values).tolist():
                line = values[i].as_py()
                found[0], found[1] = ends_inside(line, found[0]), ends_inside(line, found[1])
    for (path, block), (a, b, first) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, block, a, b, first), (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))], names=[p.split()[0] for p in _SURVEY.split(", ")])


def _compose(splits: pd.DataFrame) -> pd.DataFrame:
    """The start state of each split of one file, and which one holds the header."""
    splits = splits.sort_values("block")
    inside, header, out = False, True, []
    for path, block, from_outside, from_inside, first in splits.itertuples(index=False):
        mine = header and first is not None
        out.append((path, block, inside, mine, first if mine else None, not ends_inside(first, False) if mine else None))
        header, inside = header and not mine, from_inside if inside else from_outside
    return pd.DataFrame(out, columns=[p.split()[0] for p in _STARTS.split(", ")])


def starts(rows: DataFrame) -> DataFrame:
    """A row for each file's header split and each split that begins inside quotes."""
    found = stage(rows.mapInArrow(_survey, _SURVEY), "splits")
    return stage(found.groupBy("path").applyInPandas(_compose, _STARTS).where("header OR inside"), "starts")


def _assemble(batches: Iterator[pa.RecordBatch], multiline: bool = True) -> Iterator[pa.RecordBatch]:
    now: tuple | None = None
    inside = header = False
    held: list[str] = []
    kind, first_row, row = RECORD, 0, 0
    out: list[tuple] = []

    def emit(part: int, at: int, text: str) -> None:
        nonlocal header
        mine = header and part in (RECORD, TAIL) and text.strip() != ""
        header = header and not mine
        out.append((*now, at, part, text, mine))

    def close() -> None:
        """The split ends: what is held goes on in the next one."""
        nonlocal held
        if now is not None and held:
            emit(MIDDLE if kind == HEAD else TAIL, first_row, "\n".join(held))
        held = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[p.split()[0] for p in _PARTS.split(", ")])

    for batch in batches:
        for part in _splits(batch):
            key = part.column("path")[0].as_py(), part.column("block")[0].as_py()
            if key != now:
                close()
                now, row = key, 0
                inside, header = bool(part.column("inside")[0].as_py()), bool(part.column("header")[0].as_py())
                kind = HEAD if inside else RECORD
            values = part.column("value").to_pylist()
            marks = [*(_quoted(part.column("value")).tolist() if multiline else ()), len(values)]
            at = 0
            for mark in marks:
                if inside:
                    held += values[at:mark]
                else:
                    for i in range(at, mark):
                        emit(RECORD, row + i, values[i])
                if mark < len(values):
                    if not inside:
                        first_row = row + mark
                    held.append(values[mark])
                    inside = ends_inside(values[mark], inside)
                    if not inside:
                        emit(kind, first_row, "\n".join(held))
                        held, kind = [], RECORD
                at = mark + 1
            row += len(values)
            if out:
                yield batch_of(out)
                out.clear()
    close()
    if out:
        yield batch_of(out)


def records(rows: DataFrame, start: DataFrame, multiline: bool = True) -> DataFrame:
    """(path, split, row, record, header) of all records with text; split and row give the order inside a file.

    ``start`` is ``starts(rows)``, a row for each file and for each split that begins inside quotes: about a hundred bytes
    for a file and for 128 MB of text at most, broadcast to keep the lines of a split together and in order.
    """
    known = F.broadcast(start.select("path", "block", "inside", "header"))
    parts = rows.join(known, ["path", "block"], "left").select("path", "block", "value", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("header", F.lit(False)).alias("header")).mapInArrow(lambda b: _assemble(b, multiline), _PARTS)
    if not start.where("inside").limit(1).count():  # only the last record of a file can be open
        whole = parts.drop("part")
    else:
        late = F.when(F.col("part") == TAIL, 1).otherwise(0)  # a split's head comes before its tail
        order = Window.partitionBy("path").orderBy("split", late).rowsBetween(Window.unboundedPreceding, 0)
        pieces = parts.where(F.col("part") != RECORD).withColumn("nth", F.sum(late).over(order))
        pieces = pieces.groupBy("path", "nth").agg(F.array_sort(F.collect_list(F.struct("split", late.alias("late"), "row", "record", "header"))).alias("p"))
        first = F.col("p")[0]
        joined = pieces.select("path", first["split"].alias("split"), first["row"].alias("row"), F.array_join("p.record", "\n").alias("record"), first["header"].alias("header"))
        whole = parts.where(F.col("part") == RECORD).drop("part").unionByName(joined)
    ended = F.when(F.endswith("record", F.lit("\r")), F.expr("substr(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    return whole.withColumn("record", F.replace(ended, F.lit("\r\n"), F.lit("\n"))).where(F.trim("record") != "")


def headers(rows: DataFrame, start: DataFrame) -> dict[str, str]:
    """The header record of each file, by path: known from the first pass unless it holds a line end."""
    found = {r["path"]: (r["first"], r["closed"]) for r in start.where("header").collect()}  # one short row for each file
    if all(closed for _, closed in found.values()):
        return {path: first.removesuffix("\r") for path, (first, _) in found.items()}
    return {r["path"]: r["record"] for r in records(rows, start).where("header").collect()}
