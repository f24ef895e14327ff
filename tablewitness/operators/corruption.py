"""Table-to-table operators that imitate generated, tampered or damaged data.

All take an *indexed* table (``indexed``): ``dataset_id``, ``row_idx`` (position in row order) and
the data columns. They return the same shape, so ``row_idx`` remains the row order of the result.
Random choices are hashes of seed, column, dataset and row: repeatable, and equal on any cluster.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewitness.functions.scalars import normal_hash, shuffle_key, unit_hash
from tablewitness.operators.columns import (
    BROADCAST_GROUPS,
    as_text,
    beside,
    categorical_columns,
    nan_to_null,
    numeric_columns,
    with_dataset,
)
from tablewitness.operators.ordering import ordered_index
from tablewitness.operators.permutation import permuted_columns
from tablewitness.session import stage

BY = ["dataset_id"]
ROW = ["dataset_id", "row_idx"]
DRAWS_PER_KEY = 50_000


def indexed(df: DataFrame, order_cols: Sequence[str], dataset_id: str | None = None) -> DataFrame:
    """Give a table the row positions that the operators below work on."""
    df = nan_to_null(with_dataset(df, dataset_id))
    return ordered_index(df, order_cols, BY)


def data_columns(t: DataFrame) -> list[str]:
    return [c for c in t.columns if c not in ROW]


def numbers_of(t: DataFrame) -> list[str]:
    return numeric_columns(t, ROW)


def _with_stats(t: DataFrame, columns: Sequence[str], coins: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Extremes, mean, spread and counts per dataset next to each row, and what ``_coin`` gives for ``coins``."""
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        stats += [
            F.min(x).alias(f"_lo_{c}"), F.max(x).alias(f"_hi_{c}"), F.avg(x).alias(f"_mu_{c}"),
            F.stddev_samp(x).alias(f"_sd_{c}"), F.count(x).alias(f"_n_{c}"),
        ]
    return beside(t, _with_coins(t.groupBy(*BY).agg(F.count(F.lit(1)).alias("_rows"), *stats), coins, seed))


def _replace(t: DataFrame, source: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """The columns of ``t`` in their order, some computed anew from ``source``."""
    return source.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in t.columns])


def _coin(seed: int, tag: str) -> Column:
    """One random number per dataset."""
    return unit_hash(seed, tag, BY)


def _with_coins(stats: DataFrame, tags: Sequence[str], seed: int) -> DataFrame:
    """Random numbers of the datasets, hashed once for each of them instead of once for each row."""
    return stats.select("*", *[_coin(seed, tag).alias(f"_coin.{tag}") for tag in tags])


def _tossed(tag: str) -> Column:
    return F.col(f"`_coin.{tag}`")


def uniform(t: DataFrame, seed: int = 42, columns: Sequence[str] | None = None) -> DataFrame:
    """Every number drawn uniformly between the extremes of its column; gaps are filled too."""
    cols = list(columns or numbers_of(t))
    s = _with_stats(t, cols)
    lo_hi = lambda c: F.col(f"_lo_{c}") + unit_hash(seed, f"uniform.{c}", ROW) * (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
    return _replace(t, s, {c: lo_hi(c) for c in cols})


def shuffled(t: DataFrame, seed: int = 42, columns: Sequence[str] | None = None) -> DataFrame:
    """Every column permuted on its own: marginals stay, dependencies go."""
    cols = list(columns or data_columns(t))
    mixed = permuted_columns(t, cols, ROW, BY, seed)
    if len(cols) == len(data_columns(t)):
        return mixed.select(*t.columns)
    return t.drop(*cols).join(mixed, ROW[::-1]).select(*t.columns)


def places(t: DataFrame, coins: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Add ``_pos``, the 0-based position in row order, and ``_rows``, the rows of the dataset.

    Most tables still have all the positions they were numbered with; only others are sorted and numbered anew.
    """
    sizes = stage(t.groupBy(*BY).agg(F.count(F.lit(1)).alias("_rows"), F.min("row_idx").alias("_lo"), F.max("row_idx").alias("_hi")), "sizes")
    whole = sizes.where((F.col("_lo") != 0) | (F.col("_hi") != F.col("_rows") - 1)).isEmpty()
    placed = t.withColumn("_pos", F.col("row_idx")) if whole else ordered_index(t, ["row_idx"], BY, "_pos")
    return beside(placed, _with_coins(sizes.select(*BY, "_rows"), coins, seed))


def draw_cells(t: DataFrame, seed: int, columns: Sequence[str], distinct: Sequence[str]) -> DataFrame:
    """Add ``_d_<column>``: each cell drawn at random from its column's present values.

    Columns in ``distinct`` draw uniformly from their distinct values. Where these are few, they are broadcast and the rows stay in
    their tasks; all other columns are drawn by ``_draw_many``.
    """
    out, rest, once = t, list(columns), None
    if distinct:
        once = stage(_long_cells(t, distinct).select(*BY, "column", "cell").distinct(), "once")
        counts = {r["column"]: r["n"] for r in once.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        few = [c for c in columns if c in distinct and counts.get(c, 0) <= BROADCAST_GROUPS]
        rest = [c for c in columns if c not in few]
        place = F.row_number().over(Window.partitionBy(*BY, "column").orderBy("cell")).cast("long") - 1
        shelf = stage(once.where(F.col("column").isin(few or [""])).withColumn("_place", place), "shelf")
        sizes = shelf.groupBy(*BY).agg(*[F.count(F.when(F.col("column") == c, 1)).alias(f"_m{i}") for i, c in enumerate(few)]) if few else None
        out = out.join(F.broadcast(sizes), BY, "left") if few else out
        for i, c in enumerate(few):
            wished = F.floor(unit_hash(seed, "draw", [*ROW, "_column"]) * F.col(f"_m{i}"))
            mine = shelf.where(F.col("column") == c).select(*BY, "_place", F.col("cell").cast(t.schema[c].dataType).alias(f"_d_{c}"))
            out = out.withColumn("_column", F.lit(c)).withColumn("_place", wished)
            out = out.join(F.broadcast(mine), [*BY, "_place"], "left").drop("_column", "_place", f"_m{i}")
    if rest:
        out = out.join(_draw_many(t, seed, rest, once), ROW[::-1], "left")
    return out


def _long_cells(t: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(dataset_id, row_idx, column, cell)`` of the present cells, as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), as_text(t, c).alias("cell")) for c in columns])
    return t.select(*ROW, F.explode(cells).alias("_c")).select(*ROW, "_c.*").where(F.col("cell").isNotNull())


def _draw_many(t: DataFrame, seed: int, columns: Sequence[str], once: DataFrame | None) -> DataFrame:
    """``(dataset_id, row_idx, _d_<column>)``: cells drawn from pools of any size, by rank.

    Columns that ``once`` holds draw from their distinct values. A pool entry that many rows
    would ask for is repeated under a salt, so no join key serves more than about
    ``DRAWS_PER_KEY`` rows.
    """
    flat = [c for c in columns if once is not None and not once.where(F.col("column") == c).isEmpty()]
    pools = [_long_cells(t, [c for c in columns if c not in flat]).select(*BY, "column", "cell", F.col("row_idx").alias("_tie"))] if len(flat) < len(columns) else []
    if flat:
        pools.append(once.where(F.col("column").isin(flat)).withColumn("_tie", F.lit(0).cast("long")))
    pool = reduce(DataFrame.unionByName, pools)
    pool = ordered_index(pool, ["cell", "_tie"], [*BY, "column"], "pos", extra=("n",), drop=("_tie",))
    rows = t.groupBy(*BY).agg(F.count(F.lit(1)).alias("_rows"))
    sizes = pool.groupBy(*BY, "column").agg(F.max("n").alias("_m")).join(rows, BY)
    sizes = stage(sizes.withColumn("_salts", F.ceil(F.col("_rows") / F.col("_m") / F.lit(float(DRAWS_PER_KEY)))), "sizes")
    names = F.array(*[F.lit(c) for c in columns])
    wish = beside(t.select(*ROW, F.explode(names).alias("column")), sizes.drop("_rows"), on=[*BY, "column"])
    wish = wish.select(
        *ROW, "column",
        F.floor(unit_hash(seed, "draw", [*ROW, "column"]) * F.col("_m")).alias("pos"),
        F.pmod(F.col("row_idx"), F.col("_salts")).alias("_salt"),
    )
    shelf = beside(pool, sizes.select(*BY, "column", "_salts"), "pos", [*BY, "column"])
    shelf = shelf.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts", "n")
    # Joins sort by their first key before all others, so that is one that tells rows apart.
    drawn = wish.join(shelf, ["pos", "column", *BY, "_salt"])
    # Cells become values before they are put together: numbers need no sort there, texts do.
    value = lambda c: F.col("cell").cast(t.schema[c].dataType)
    return drawn.groupBy(*ROW).agg(*[F.max(F.when(F.col("column") == c, value(c))).alias(f"_d_{c}") for c in columns])


def marginal(t: DataFrame, seed: int = 42) -> DataFrame:
    """Numbers resampled from their column, categories drawn evenly from the distinct values."""
    cols = data_columns(t)
    drawn = draw_cells(t, seed, cols, categorical_columns(t, ROW))
    return drawn.select(*[F.col(f"_d_{c}").alias(c) if c in cols else F.col(c) for c in t.columns])


def normal(t: DataFrame, seed: int = 42) -> DataFrame:
    """Gaussian noise with the column's mean and spread; by a coin, squared and scaled by its maximum."""
    cols = numbers_of(t)
    s = _with_stats(t, cols)
    noise = {c: F.col(f"_mu_{c}") + normal_hash(seed, f"normal.{c}", ROW) * (F.col(f"_sd_{c}") + F.lit(1e-6)) for c in cols}
    noisy = _replace(t, s, noise)
    peaks = noisy.groupBy(*BY).agg(*[F.max(F.abs(F.col(c))).alias(f"_pk_{c}") for c in cols])
    peaks = _with_coins(peaks, [f"bend.{c}" for c in cols], seed)
    bent = lambda c: F.when(
        _tossed(f"bend.{c}") > 0.5, F.col(c) * F.col(c) / (F.col(f"_pk_{c}") + F.lit(1e-6))
    ).otherwise(F.col(c))
    return _replace(t, beside(noisy, peaks), {c: bent(c) for c in cols})


def linear_combo(t: DataFrame, seed: int = 42, noise: float = 0.05) -> DataFrame:
    """Each number becomes the average of two others plus noise; needs three numeric columns."""
    cols = numbers_of(t)
    if len(cols) <= 2:
        return t
    rng = random.Random(seed)
    changed = {}
    for c in cols:
        a, b = rng.sample([o for o in cols if o != c], 2)
        changed[c] = F.col(a) * 0.5 + F.col(b) * 0.5 + normal_hash(seed, f"combo.{c}", ROW) * F.lit(noise)
    return _replace(t, t, changed)


def resample(t: DataFrame, count: Column, seed: int, tag: str) -> DataFrame:
    """``count`` rows per dataset drawn with replacement, placed behind the table."""
    ends = t.groupBy(*BY).agg((F.max("row_idx") + 1).alias("_end"))
    placed = places(t)
    wish = beside(placed, ends).where(F.col("_pos") < count)
    wish = wish.select(
        *BY, (F.col("_end") + F.col("_pos")).alias("_new"), F.floor(unit_hash(seed, tag, ROW) * F.col("_rows")).alias("_pos")
    )
    drawn = wish.join(placed.drop("_rows"), ["_pos", *BY])
    return drawn.drop("row_idx", "_pos").withColumnRenamed("_new", "row_idx").select(*t.columns)


def blank_cells(t: DataFrame, share: float, seed: int, columns: Sequence[str], tag: str) -> DataFrame:
    """Remove a random share of the cells of ``columns``."""
    keep = lambda c: F.when(unit_hash(seed, f"{tag}.{c}", ROW) >= share, F.col(c))
    return _replace(t, t, {c: keep(c) for c in columns})


#: Rows of a dataset among which the last chosen one is looked for by sorting.
LAST_ROWS = 1 << 16


def chosen_exactly(t: DataFrame, want: DataFrame, seed: int, tag: str) -> DataFrame:
    """Add ``_chosen``: true for exactly ``_want`` rows of each dataset of ``want``, the first by a hash of the row.

    The hash of the last chosen row is found by selection: rows are counted by leading digits, the group of digits that holds the
    wanted rank is counted by the next ones, until few rows share them. The rows of the table stay where they are.
    """
    keys = t.select(*ROW, shuffle_key(seed, tag, ROW).alias("_h"))
    state, digits = want.where("_want > 0").select(*BY, "_want", F.lit("").alias("_lead")), 0
    while True:
        near = beside(keys, state).where(F.startswith("_h", F.col("_lead")))
        counts = near.groupBy(*BY, "_want", F.substring("_h", 1, digits + 4).alias("_lead")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*BY).orderBy("_lead"))
        found = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        state = stage(found.select(*BY, (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_want"), "_lead", "_n"), "digits")
        digits += 4
        if digits >= 32 or (state.agg(F.max("_n")).first()[0] or 0) <= LAST_ROWS:
            break
    near = beside(keys, state).where(F.startswith("_h", F.col("_lead")))
    last = near.withColumn("_place", F.row_number().over(Window.partitionBy(*BY).orderBy("_h", "row_idx"))).where("_place = _want")
    # Datasets that want more rows than they have keep all, those that want none have no last row.
    last = last.select(*BY, F.col("_h").alias("_last"), F.col("row_idx").alias("_last_idx"))
    last = want.join(last, BY, "left").select(*BY, "_want", "_last", "_last_idx")
    upto = (F.col("_h") < F.col("_last")) | ((F.col("_h") == F.col("_last")) & (F.col("row_idx") <= F.col("_last_idx")))
    out = beside(t.withColumn("_h", shuffle_key(seed, tag, ROW)), last)
    chosen = F.coalesce(upto, F.col("_want") > 0)
    return out.withColumn("_chosen", chosen).drop("_h", "_want", "_last", "_last_idx")


def duplicated(t: DataFrame, seed: int = 42) -> DataFrame:
    """Drop 40 % of the rows exactly, append as many drawn with replacement, blank 15 % of the numbers."""
    drop = t.groupBy(*BY).agg(F.round(F.count(F.lit(1)) * 0.4).cast("long").alias("_want"))
    kept = chosen_exactly(t, drop, seed, "drop").where("NOT _chosen").select(*t.columns)
    more = resample(t, F.round(F.col("_rows") * 0.4), seed, "repeat")
    return blank_cells(kept.unionByName(more), 0.15, seed, numbers_of(t), "gap")


def rounded(t: DataFrame, seed: int = 42) -> DataFrame:  # noqa: ARG001
    """Round to the magnitude of the column's mean, halves to even."""
    cols = numbers_of(t)
    s = _with_stats(t, cols)

    def snap(c: str) -> Column:
        scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.col(f"_mu_{c}")) + F.lit(1e-5))))
        return F.rint(F.col(c) / scale) * scale

    return _replace(t, s, {c: snap(c) for c in cols})


def outliers(t: DataFrame, seed: int = 42) -> DataFrame:
    """5 % of the numbers move ten standard deviations away, to one side per column."""
    cols = numbers_of(t)
    s = _with_stats(t, cols, [f"side.{c}" for c in cols], seed)

    def push(c: str) -> Column:
        side = F.when(_tossed(f"side.{c}") < 0.5, -1.0).otherwise(1.0)
        far = F.col(f"_mu_{c}") + 10.0 * F.col(f"_sd_{c}") * side
        return F.when(unit_hash(seed, f"far.{c}", ROW) < 0.05, far).otherwise(F.col(c))

    return _replace(t, s, {c: push(c) for c in cols})


def perfect_grid(t: DataFrame, seed: int = 42) -> DataFrame:  # noqa: ARG001
    """Evenly spaced values from minimum to maximum, in row order."""
    cols = numbers_of(t)
    s = _with_stats(places(t).drop("_rows"), cols)

    def line(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.when(F.col(f"_n_{c}") > 1, lo + F.col("_pos") * ((hi - lo) / (F.col("_rows") - 1))).otherwise(F.col(c))

    return _replace(t, s, {c: line(c) for c in cols})


def block_missing(t: DataFrame, seed: int = 42) -> DataFrame:
    """Blank one contiguous run of rows, a tenth to a quarter long, in one random column."""
    cols = data_columns(t)
    n = F.col("_rows")
    start = F.floor(_tossed("start") * (n - 10))
    low, high = F.greatest(F.lit(1), F.floor(n / 10)), F.greatest(F.lit(2), F.floor(n / 4))
    stop = start + low + F.floor(_tossed("length") * (high - low))
    chosen = F.floor(_tossed("column") * len(cols))
    hit = (n > 10) & (F.col("_pos") >= start) & (F.col("_pos") < stop)
    blank = lambda i, c: F.when(~(hit & (chosen == i)), F.col(c))
    return _replace(t, places(t, ["start", "length", "column"], seed), {c: blank(i, c) for i, c in enumerate(cols)})


METHODS: dict[str, Callable[..., DataFrame]] = {
    "uniform": uniform,
    "normal": normal,
    "rounded": rounded,
    "shuffled": shuffled,
    "duplicated": duplicated,
    "linear_combo": linear_combo,
    "outliers": outliers,
    "marginal": marginal,
    "perfect_grid": perfect_grid,
    "block_missing": block_missing,
}


def corrupt(
    df: DataFrame, method: str, order_cols: Sequence[str], dataset_id: str | None = None, seed: int = 42
) -> DataFrame:
    """Apply a named method; the result adds ``dataset_id`` and ``row_idx``. Unknown names change nothing."""
    t = indexed(df, order_cols, dataset_id)
    return METHODS[method](t, seed) if method in METHODS else t


def jitter(t: DataFrame, seed: int, share: float = 0.75) -> DataFrame:
    """Exactly 75 % of the rows, rounded, numbers moved by about 1 % of their spread. Row order is kept."""
    keep = t.groupBy(*BY).agg(F.bround(F.count(F.lit(1)) * F.lit(share)).cast("long").alias("_want"))
    part = stage(chosen_exactly(t, keep, seed, "keep").where("_chosen").select(*t.columns), "part")
    cols = numbers_of(t)
    s = _with_stats(part, cols)
    move = lambda c: F.col(c) + normal_hash(seed, f"jitter.{c}", ROW) * (
        F.coalesce(F.col(f"_sd_{c}"), F.lit(0.0)) * 0.01 + F.lit(1e-8)
    )
    return _replace(t, s, {c: move(c) for c in cols})


def augment(
    df: DataFrame, order_cols: Sequence[str], dataset_id: str | None = None, seeds: Sequence[int] = (42, 73, 101, 2024)
) -> list[DataFrame]:
    """Slightly changed versions of a real table, one per seed."""
    t = indexed(df, order_cols, dataset_id)
    return [jitter(t, seed) for seed in seeds]


def shuffle_some(t: DataFrame, level: float, seed: int) -> DataFrame:
    """Permute a random ``level`` share of the numeric columns, if there are two or more."""
    cols = numbers_of(t)
    count = int(len(cols) * level)
    if len(cols) < 2 or count == 0:
        return t
    return shuffled(t, seed, random.Random(seed).sample(cols, count))


def append_repeats(t: DataFrame, level: float, seed: int) -> DataFrame:
    """Above level 0.3, append level/2 of the rows drawn with replacement."""
    if level <= 0.3:
        return t
    return t.unionByName(resample(t, F.floor(F.col("_rows") * (level / 2)), seed, "append"))


def flatten_numbers(t: DataFrame, level: float, seed: int) -> DataFrame:
    """With probability ``level`` a numeric column is drawn anew between its extremes."""
    cols = numbers_of(t)
    s = _with_stats(t, cols, [f"flatten.{c}" for c in cols], seed)

    def flat(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        drawn = lo + unit_hash(seed, f"flat.{c}", ROW) * (hi - lo)
        return F.when((_tossed(f"flatten.{c}") < level) & lo.isNotNull(), drawn).otherwise(F.col(c).cast("double"))

    return _replace(t, s, {c: flat(c) for c in cols})


def round_to_tens(t: DataFrame, level: float, seed: int) -> DataFrame:
    """In half of the flattened columns, a ``level`` share of the cells is rounded to tens."""
    cols = numbers_of(t)
    s = beside(t, _with_coins(t.select(*BY).distinct(), [f"{tag}.{c}" for c in cols for tag in ("flatten", "tens")], seed))

    def tens(c: str) -> Column:
        on = (_tossed(f"flatten.{c}") < level) & (_tossed(f"tens.{c}") < 0.5)
        cell = unit_hash(seed, f"ten.{c}", ROW) < level
        return F.when(on & cell, F.rint(F.col(c) / 10.0) * 10.0).otherwise(F.col(c).cast("double"))

    return _replace(t, s, {c: tens(c) for c in cols})


def flatten_categories(t: DataFrame, level: float, seed: int) -> DataFrame:
    """With probability ``level`` a category column is drawn evenly from its distinct values."""
    cols = categorical_columns(t, ROW)
    if not cols:
        return t
    both = draw_cells(beside(t, _with_coins(t.select(*BY).distinct(), [f"even.{c}" for c in cols], seed)), seed, cols, cols)
    pick = lambda c: F.when(
        (_tossed(f"even.{c}") < level) & F.col(f"_d_{c}").isNotNull(), F.col(f"_d_{c}")
    ).otherwise(F.col(c))
    return _replace(t, both, {c: pick(c) for c in cols})


def blank_column(t: DataFrame, level: float, seed: int) -> DataFrame:
    """Above level 0.4, blank 40 % of one random column."""
    if level <= 0.4:
        return t
    cols = data_columns(t)
    chosen = F.floor(_coin(seed, "blank") * len(cols))
    gone = unit_hash(seed, "blank", ROW) < 0.4
    return _replace(t, t, {c: F.when(~((chosen == i) & gone), F.col(c)) for i, c in enumerate(cols)})


def back_to_size(t: DataFrame, sizes: DataFrame, seed: int, always: bool = False) -> DataFrame:
    """By a coin, a grown dataset is sampled back to ``sizes`` (``dataset_id, _target``) rows exactly."""
    t = stage(t, "grown")  # read by each count below
    chosen = chosen_exactly(t, sizes.select(*BY, F.col("_target").alias("_want")), seed, "shrink")
    coin = F.lit(True) if always else _coin(seed, "shrink") < 0.5
    return chosen.where(~coin | F.col("_chosen")).select(*t.columns)


def perturb(
    df: DataFrame, level: float, order_cols: Sequence[str], dataset_id: str | None = None, seed: int = 42
) -> DataFrame:
    """Damage a table by degree, 0 (not at all) to 1: shuffling, repeats, flattening, rounding, gaps."""
    t = indexed(df, order_cols, dataset_id)
    sizes = t.groupBy(*BY).agg(F.count(F.lit(1)).alias("_target"))
    for step in (shuffle_some, append_repeats, flatten_numbers, round_to_tens, flatten_categories, blank_column):
        done = step(t, level, seed)
        # The steps behind these two read the table several times, which would shuffle it anew each time.
        t = stage(done, "step") if step in (shuffle_some, append_repeats) and done is not t else done
    return back_to_size(t, sizes, seed)
