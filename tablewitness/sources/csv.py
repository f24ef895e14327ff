"""CSV scan with inferred types, skipped malformed rows and the usual marks for missing values."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewitness.sources.records import headers, lines, records, starts

# Texts that mean "missing".
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Columns that give the order of rows in files: file, start of the split, position in it.
FILE_ORDER = ("__file", "__split", "__row")


def _names(spark: SparkSession, header: str) -> list[str]:
    """Column names of a header record: unnamed ones by position, repeated ones marked."""
    fields = spark.createDataFrame([(header,)], "line string")
    width = header.count(",") + 1  # at least the number of fields
    schema = ", ".join(f"_{i} string" for i in range(width))
    quoted = fields.select(F.from_csv("line", schema, {"escape": '"', "mode": "PERMISSIVE"}).alias("f")).first()["f"]
    # As many fields as have commas outside quotes before them.
    cells = [quoted[i] for i in range(width)]
    while len(cells) > 1 and cells[-1] is None and not header.rstrip().endswith(","):
        cells.pop()
    names, seen = [], set()
    for i, c in enumerate(cells):
        name = c if c else f"Unnamed: {i}"
        while name in seen:
            name += ".1"
        seen.add(name)
        names.append(name)
    return names


def read_raw_csv(spark: SparkSession, paths: str | Sequence[str], multiline: bool = True) -> DataFrame:
    """All columns as text. Rows with too many fields are skipped, short rows filled with nulls.

    Large files are split. With ``multiline`` a quoted field may hold line ends, and a pass over the text finds where records
    begin (see ``records``); without it every line is a record. Files with another header than the
    first are an error, since columns go by position.
    """
    return _parsed(spark, *_scanned(spark, paths), multiline)


def _scanned(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Lines, where splits begin, and the header of each file: one reading of the text."""
    rows = lines(spark, paths)
    start = starts(rows)
    return rows, start, headers(rows, start)


def _parsed(spark: SparkSession, rows: DataFrame, start: DataFrame, found: dict[str, str], multiline: bool) -> DataFrame:
    if len(set(found.values())) != 1:
        raise ValueError("the files have different headers; read_csv_folder reads each kind by itself" if found else "no file has a line")
    names = _names(spark, next(iter(found.values())))
    spare = f"_extra_{uuid.uuid4().hex[:8]}"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, spare]])
    if not multiline:
        start = start.withColumn("inside", F.lit(False))
    cells = F.from_csv("record", schema.toDDL(), {"escape": '"', "mode": "PERMISSIVE"})
    raw = records(rows, start, multiline).where("NOT header").select(F.col("path").alias("file_path"), F.col("split").alias(FILE_ORDER[1]), F.col("row").alias(FILE_ORDER[2]), cells.alias("_cells"))
    kept = raw.where(F.col("_cells")[spare].isNull())
    value = lambda n: F.col("_cells").getField(n)
    text = [F.when(~value(n).isin(*NA_VALUES), value(n)).alias(n) for n in names]
    return kept.select(*text, "file_path", *FILE_ORDER[1:])


def narrowest_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """For each text column, the narrowest type that all its values accept: one aggregate, one row."""
    checks = []
    for c in columns:
        v = F.trim(F.col(f"`{c}`"))
        checks += [
            F.count(v),
            F.every(v.isNull() | (v.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull())),
            F.every(v.isNull() | (v.rlike(r"^[+-]?(\d|\.\d|inf)") & v.try_cast("double").isNotNull())),
            F.every(v.isNull() | v.isin("True", "False", "TRUE", "FALSE", "true", "false")),
            F.count(F.when(v.isNull(), 1)),
        ]
    row = df.agg(*[c.alias(f"_{i}") for i, c in enumerate(checks)]).first()
    kinds = {}
    for i, c in enumerate(columns):
        n, whole, real, flag, missing = row[5 * i : 5 * i + 5]
        if n == 0:
            kinds[c] = "double"
        elif whole:
            # An integer column with a gap becomes floating point.
            kinds[c] = "double" if missing else "bigint"
        elif real:
            kinds[c] = "double"
        elif flag and not missing:
            kinds[c] = "boolean"
        else:
            kinds[c] = "string"
    return kinds


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], dataset_id: bool = False, multiline: bool = True, ordered: bool = False
) -> DataFrame:
    """CSV as a typed table. ``dataset_id`` adds the file each row came from, ``ordered`` the columns FILE_ORDER.

    An unreadable source raises ``ValueError``.
    """
    try:
        raw = read_raw_csv(spark, paths, multiline)
        columns = [c for c in raw.columns if c not in ("file_path", *FILE_ORDER)]
        kinds = narrowest_types(raw, columns)
    except Exception as error:  # noqa: BLE001
        raise ValueError(f"Failed to read CSV file: {error}") from error
    typed = [F.trim(F.col(f"`{c}`")).cast(k).alias(c) if k != "string" else F.col(f"`{c}`") for c, k in kinds.items()]
    lead = [F.col("file_path").alias("dataset_id")] if dataset_id else []
    order = [F.col("file_path").alias(FILE_ORDER[0]), *FILE_ORDER[1:]] if ordered else []
    return raw.select(*lead, *typed, *order)


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSV files below ``folder`` in name order, from file listing alone."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .load(folder)
        .where("length > 0")
        .select("path")
    )
    return [r[0] for r in listing.orderBy("path").collect()]


def read_csv_folder(spark: SparkSession, folder: str, multiline: bool = True) -> list[DataFrame]:
    """One typed table per header found, each with ``dataset_id`` = file. Files without a line are ignored.

    Headers come from one job over all files, and files that share one are read together. Errors are raised.
    """
    groups: dict[str, list[str]] = {}
    files = csv_files(spark, folder)
    found = _scanned(spark, files)[2] if files else {}
    for path, line in sorted(found.items()):
        groups.setdefault(line, []).append(path)
    return [read_csv(spark, paths, dataset_id=True, multiline=multiline) for paths in groups.values()]


def read_first_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The first CSV of an unpacked bundle, by path, whole."""
    files = csv_files(spark, folder)
    if not files:
        raise FileNotFoundError("No CSV files found in the dataset.")
    return read_csv(spark, files[0])
