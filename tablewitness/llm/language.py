"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a tree of byte contexts up to ``order`` symbols is counted on labelled rows. A
symbol costs what an arithmetic coder would pay for it: in the longest known context, or an escape and
then the cost in the next shorter one, down to a uniform code. The counts stay frozen while scoring,
so that the code length of a text is a sum of table entries and all languages are scored at once.
The language with the shortest code wins; the score is its share of the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewitness.llm.textbytes import slices
from tablewitness.session import stage

UNDETERMINED = "und"


@dataclass
class Model:
    """Frozen trees of all languages.

    ``codes`` maps bytes to symbols, ``rows`` each context of ``order`` symbols to the row of its
    longest known suffix, ``bits[row, symbol, language]`` is the code length in bits.
    """

    languages: list[str]
    order: int
    codes: np.ndarray
    rows: np.ndarray
    bits: np.ndarray


def _fold() -> np.ndarray:
    """Letters without case; digits are one symbol, white space and controls another."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[:33] = 32
    table[48:58] = 48
    return table


#: Counts of strings that a task holds before it hands them on.
HELD_GRAMS = 1 << 20


def _grams(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Counts (lang, half, gram, n) of the (order + 1)-byte strings in a task; a text starts after blanks."""
    fold, held, size = _fold(), {}, 0
    blank = np.full(order, 32, np.uint8)

    def merged() -> None:
        for label, parts in held.items():
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            held[label] = [(keys, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64))]

    def rows() -> Iterator[pa.RecordBatch]:
        merged()
        for (lang, half), [(keys, n)] in held.items():
            columns = [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), half, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "half", "gram", "n"])

    for batch, data, offsets in slices(batches):
        data, labels = fold[data], {}
        for i, label in enumerate(zip(batch.column("lang").to_pylist(), batch.column("half").to_pylist())):
            labels.setdefault(label, []).append(i)
        for label, mine in labels.items():
            joined = np.concatenate([x for i in mine for x in (blank, data[offsets[i] : offsets[i + 1]])]).astype(np.uint32)
            if len(joined) <= order:
                continue
            keys = np.zeros(len(joined) - order, np.uint32)
            for k in range(order + 1):
                keys = (keys << np.uint32(8)) | joined[k : len(joined) - order + k]
            keys, n = np.unique(keys, return_counts=True)
            held.setdefault(label, []).append((keys, n))
            size += len(keys)
        if size > HELD_GRAMS:
            merged()
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > HELD_GRAMS // 2:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def quotas(counts: dict[str, int], total: int) -> dict[str, float]:
    """The share of its rows that each language keeps: small ones all, the others as many rows each, ``total`` in all."""
    left, out = total, {}
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        take = min(float(n), left / (len(counts) - k))
        out[lang], left = take / n, left - take
    return out


def _thinned(labelled: DataFrame, sample_rows: int) -> DataFrame:
    """Labelled rows, thinned by a hash of the row to about ``sample_rows``, as even between the languages as they allow."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(counts.values()) > sample_rows:
        share = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in labelled.columns)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        keep = F.create_map(*(F.lit(x) for item in sorted(quotas(counts, sample_rows).items()) for x in item))
        rows = rows.where(share < keep[F.col("lang")])
    return rows.select("lang", "text")


def _counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n0, n1): how often each string occurs in the rows (lang, text, half) of either half."""
    grams = rows.select("lang", "text", "half").mapInArrow(lambda b: _grams(b, order), "lang string, half int, gram bigint, n bigint")
    return grams.groupBy("lang", "gram").agg(*(F.sum(F.when(F.col("half") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))


def _counted(rows: DataFrame, order: int, min_context: int) -> Model | None:
    found = _counts(rows.withColumn("half", F.lit(0)), order).toPandas()
    return _trees(found, "n0", order, min_context)


def _common(counts: DataFrame, order: int, min_context: int) -> DataFrame:
    """Counts in which the strings after rare longest contexts are added up without their first byte (0 in its place).

    ``share`` weighs the languages. Contexts below ``min_context`` have no row of their own in any tree, so the trees are
    the same, and what the driver reads is bounded by the contexts, not by the rows that were counted.
    """
    if order == 1:
        return counts
    counts = counts.withColumn("context", F.shiftright("gram", 8))
    seen = F.sum((F.col("n0") + F.col("n1")) * F.col("share"))
    often = counts.groupBy("context").agg(seen.alias("seen")).where(F.col("seen") >= min_context).select("context", F.lit(True).alias("often"))
    gram = F.when(F.col("often"), F.col("gram")).otherwise(F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)))
    return counts.join(often, "context", "left").groupBy("lang", "share", gram.alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def fit(labelled: DataFrame, order: int = 3, sample_rows: int = 6000, min_context: int = 8) -> Model | None:
    """Count the context trees on the rows (lang, text) of ``labelled``; None without any labelled text.

    ``sample_rows`` bounds the training rows: a hash of the row thins larger inputs to about that
    many; a language with few rows keeps them all. ``min_context`` is how often the longest contexts must occur to get a row of their own.
    """
    if not 1 <= order <= 3:
        raise ValueError("order is 1, 2 or 3")
    return _counted(_thinned(labelled, sample_rows), order, min_context)


def _trees(found, column: str, order: int, min_context: int) -> Model | None:
    """The trees of the counts in ``column``, None without any; with a column ``share`` the rare contexts are told by weighted counts."""
    found = found[found[column] > 0].sort_values(["lang", "gram"])
    if found.empty:
        return None
    languages = sorted(found["lang"].unique())
    gram, n = found["gram"].to_numpy(np.int64), found[column].to_numpy(np.int64)
    weight = n * found["share"].to_numpy(float) if "share" in found else n
    which = np.searchsorted(languages, found["lang"].to_numpy())
    digits = np.stack([(gram >> (8 * k)) & 255 for k in range(order, -1, -1)], 1)
    known = np.unique(digits[digits > 0])  # no folded byte is 0, it stands for a first byte that was left out
    whole = digits[:, 0] > 0
    size = len(known) + 1  # the last symbol stands for bytes that were never seen
    codes = np.full(256, size - 1, np.uint8)
    codes[known] = np.arange(len(known))
    codes = codes[_fold()]
    symbols = np.searchsorted(known, digits)
    n_lang = len(languages)

    # Order 0: one context; an escape leads to the uniform code.
    counts = np.zeros((1, size, n_lang))
    np.add.at(counts[0], (symbols[:, order], which), n)
    bits = _code(counts, np.full((1, size, n_lang), np.log2(size)))
    suffix_row = np.zeros(1, np.int64)
    all_bits = [bits]
    base = 0
    for length in range(1, order + 1):
        context = np.zeros(len(gram), np.int64)
        for k in range(order - length, order):
            context = context * size + symbols[:, k]
        keys, inverse = np.unique(context, return_inverse=True)
        there = whole if length == order else np.ones(len(n), bool)
        seen = np.bincount(inverse, weights=weight * there)
        kept = seen >= min_context if length > 1 else seen > 0
        row_of_key = np.full(len(keys), -1, np.int64)
        row_of_key[kept] = np.arange(kept.sum())
        parent = suffix_row[keys % size ** (length - 1)]  # rows are numbered over all orders
        counts = np.zeros((int(kept.sum()), size, n_lang))
        take = kept[inverse] & there
        np.add.at(counts, (row_of_key[inverse[take]], symbols[take, order], which[take]), n[take])
        shorter = np.concatenate(all_bits)[parent[kept]]
        base = sum(len(b) for b in all_bits)
        all_bits.append(_code(counts, shorter))
        rows = np.tile(suffix_row, size)
        rows[keys[kept]] = base + np.arange(int(kept.sum()))
        suffix_row = rows
    return Model(languages, order, codes, suffix_row.astype(np.int32), np.concatenate(all_bits).astype(np.float32))


def _code(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Code lengths with escape method C: as many escapes as distinct symbols. An unseen context costs nothing."""
    total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    whole = np.maximum(total + distinct, 1)
    with np.errstate(divide="ignore"):
        own = -np.log2(counts / whole)
        escape = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / whole), 0.0)
    return np.where(counts > 0, own, escape + shorter)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row in each language."""
    n, size = len(data), model.bits.shape[1]
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    if not n:
        return out
    symbols = model.codes[data].astype(np.int32)
    blank = int(model.codes[32])
    context = np.zeros(n, np.int32)
    first = offsets[:-1][np.diff(offsets) > 0]
    for k in range(model.order, 0, -1):
        before = np.full(n, blank, np.int32)
        before[k:] = symbols[:-k] if k < n else symbols[:0]
        for j in range(k):  # the first symbols of a row have blanks before them
            at = first + j
            before[at[at < n]] = blank
        context = context * size + before
    cell = model.rows[context].astype(np.int64) * size + symbols
    flat = model.bits.reshape(-1, len(model.languages))
    for k in range(len(model.languages)):
        out[np.diff(offsets) > 0, k] = np.add.reduceat(flat[cell, k].astype(np.float64), first)
    return out


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to documents (a text column is needed; other columns stay).

    Null texts and texts without a letter get ``und`` and score 0, and so does all without a model.
    Ties go to the language that comes first by name.
    """
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    mark = max(kept, key=len) + "_letters"  # a name that none of them has
    rows = documents.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(has_letter(F.col("text")), F.lit(False)).alias(mark))
    schema = documents.select(*(F.col(f"`{c}`") for c in kept)).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            letters = batch.column(mark).to_numpy(zero_copy_only=False)
            lang, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None:
                bits = code_lengths(model, data, offsets)
                best = bits.argmin(1)
                share = 1.0 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0.0)).sum(1)
                lang = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
                score = np.where(letters, share, 0.0)
            columns = [batch.column(c) for c in kept] + [pa.array(lang, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Rows that are kept from training: remainder 1 of the checksum of the id; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_documents(documents: DataFrame, **options) -> DataFrame:
    """Fit on the labelled rows that are not held out, then identify every document."""
    learn = documents.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    model = fit(learn.select("doc_id", "lang", "text"), **options)
    return identify(documents, model)


def rates(model: Model, data: np.ndarray, offsets: np.ndarray, spare_bits: float) -> np.ndarray:
    """Bits per byte of each row in its best language, less ``spare_bits`` for the whole row; empty rows have 0."""
    return (code_lengths(model, data, offsets).min(1) - spare_bits) / np.maximum(np.diff(offsets), 1)


def rate_bound(rows: DataFrame, models: list[Model | None], quantile: float, spare_bits: float) -> float:
    """The ``quantile`` of the rates of labelled rows (text, half), each under the model of the half of the rows without it.

    A model knows the texts it was counted on too well for a bound on others. Equal texts are in one half. The quantile
    is a rank among n + 1, so at most its complement of rows like the labelled ones lies above it; with fewer
    rows than it takes for that the largest rate is the bound. Where most rows are so short that the spare bits
    pay for them, the bits per byte of all rows together are the bound. Only without two different texts to learn from and
    to measure there is none (infinity).
    """
    if None in models:
        return float("inf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            half = batch.column("half").to_numpy()
            own = np.zeros(len(half))
            for k in (0, 1):
                mine = np.flatnonzero(half == k)
                if len(mine):
                    own[mine] = rates(models[k], data, offsets, spare_bits)[mine]
            yield pa.RecordBatch.from_pydict({"rate": own, "size": np.diff(offsets)})

    found = stage(rows.where(has_letter(F.col("text"))).select("text", "half").mapInArrow(run, "rate double, size bigint"), "rates")
    n, bits, size = found.agg(F.count(F.lit(1)), F.sum(F.col("rate") * F.col("size") + F.lit(spare_bits)), F.sum("size")).first()
    if not n:
        return float("inf")
    rank = min(n, int(np.ceil((n + 1) * quantile)))
    edge = found.orderBy(F.desc("rate")).limit(n - rank + 1).agg(F.min("rate")).first()[0]
    return float(max(edge, bits / size))


def keep_known(
    documents: DataFrame, quantile: float = 0.999, margin: float = 2.0, spare_bits: float = 400.0, even_rows: int = 6000,
    order: int = 3, min_context: int = 8,
) -> DataFrame:
    """The documents, with their columns, that have a letter and fit a learned language.

    A text fits when its bits per byte in the best language are at most ``margin`` times ``rate_bound``: beyond the
    quantile there are clean texts still. ``spare_bits`` of each text do not count: one pasted key of 20
    bytes costs about so much, and shorter texts say too little. Without two different labelled texts all texts with a
    letter stay.

    All labelled rows that are not held out are counted and measured. Only the size of the trees is bounded: the longest contexts
    get a row of their own when ``even_rows`` rows, as even between the languages as they allow, would hold them ``min_context`` times.
    """
    learn = documents.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    learn = learn.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))
    lettered = documents.where(has_letter(F.col("text")))
    numbers = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not numbers:
        return lettered
    share = F.create_map(*(F.lit(x) for item in sorted(quotas(numbers, even_rows).items()) for x in item))[F.col("lang")]
    counts = stage(_counts(learn, order).withColumn("share", share), "grams")
    found = _common(counts, order, min_context).toPandas()
    bound = margin * rate_bound(learn, [_trees(found, n, order, min_context) for n in ("n1", "n0")], quantile, spare_bits)
    if bound == float("inf"):
        return lettered
    model = _trees(found.assign(n=found["n0"] + found["n1"]), "n", order, min_context)
    columns = [f"_{k}" for k in range(len(documents.columns))]  # so that no name clashes
    at = documents.columns.index("text")
    plain = lettered.toDF(*(c if k != at else "text" for k, c in enumerate(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            yield batch.filter(pa.array(rates(model, data, offsets, spare_bits) <= bound))

    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)
