"""Ordered work on groups of any size.

A plain ordered window puts one group into one task. Here a group is cut into *blocks* that
follow the order (a day of a timestamp, a range of positions). Each block is first reduced
to one summary row; the summaries of the earlier blocks give the block's *seed*; the seed
enters the block as one extra row in front, and a window over (keys, block) then yields what
a window over (keys) would have yielded. Detail rows are shuffled once, on (keys, block).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowflow.operators.joins import broadcast_right
from rowflow.session import cut_lineage

BLOCK, ROW = "__block", "__row"


@dataclass(frozen=True)
class Scan:
    """``value`` is scanned, ``fold`` reduces a block, ``merge`` folds the earlier blocks,
    ``local`` runs over the seeded block."""

    value: Column
    fold: Callable[[Column, Column], Column]
    merge: Callable[[Column, Window], Column]
    local: Callable[[Column, Window], Column]


def _through(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def row_number() -> Scan:
    return running_sum(F.lit(1).cast("long"))


def running_sum(value: Column) -> Scan:
    return Scan(
        value,
        lambda v, order: F.sum(v),
        lambda v, w: F.sum(v).over(_before(w)),
        lambda v, w: F.sum(v).over(_through(w)),
    )


def group_total(value: Column) -> Scan:
    """Sum over the whole group, on each of its rows."""
    return Scan(
        value,
        lambda v, order: F.sum(v),
        lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        lambda v, w: F.first(v).over(_through(w)),
    )


def max_before(value: Column) -> Scan:
    """Largest value strictly before the row."""
    return Scan(
        value,
        lambda v, order: F.max(v),
        lambda v, w: F.max(v).over(_before(w)),
        lambda v, w: F.max(v).over(_before(w)),
    )


def last_before(value: Column) -> Scan:
    """Latest non-null value strictly before the row."""
    return Scan(
        value,
        lambda v, order: F.max_by(v, F.when(v.isNotNull(), order)),
        lambda v, w: F.last(v, ignorenulls=True).over(_before(w)),
        lambda v, w: F.last(v, ignorenulls=True).over(_before(w)),
    )


STATEMENTS = 1000


def by_position(statements: int = STATEMENTS) -> Column:
    """Scripts are cut into blocks of statements, so one long script is not one task."""
    return F.floor(F.col("pos") / statements)


def hot_keys(df: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """Keys with more than ``more_than`` rows, as ``__hot_<key>``, and their row counts ``__n``. There
    are at most rows / ``more_than`` of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > more_than)
    return counts.select(*[F.col(k).alias(f"__hot_{k}") for k in keys], "__n")


def with_hot_keys(df: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """``df`` with ``__n``, the row count of its key where that is beyond ``more_than``. The hot keys are
    few, so their counts go to the rows: a shuffle by the bare key would put a hot one into one task.
    Only beyond the bound of :func:`~rowflow.operators.joins.broadcast_right` rows meet by the key."""
    hot = cut_lineage(hot_keys(df, keys, more_than))
    match = [df[k].eqNullSafe(hot[f"__hot_{k}"]) for k in keys]
    return broadcast_right(df, hot, match, "left").select(*df.columns, "__n")


def _with_blocks(df: DataFrame, keys: list[str], block: Column, hot_rows: int | None) -> DataFrame:
    if hot_rows is None:
        return df.withColumn(BLOCK, block)
    is_hot = F.col("__n").isNotNull()
    return with_hot_keys(df, keys, hot_rows).select(*df.columns, F.when(is_hot, block).alias(BLOCK))


def seed_blocks(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    scans: dict[str, Scan],
    hot_rows: int | None = None,
) -> DataFrame:
    """``df`` with its blocks, and one more row (``__row`` = 0) in front of each block whose
    ``__v_<name>`` columns hold what the earlier blocks of the group amount to.

    With ``hot_rows`` only groups beyond that size are cut; the rest are one block each, so
    fine blocks cost ordinary groups nothing but a count of the keys.
    """
    values = {f"__v_{name}": s for name, s in scans.items()}
    base = _with_blocks(df, keys, block, hot_rows).withColumns({c: s.value for c, s in values.items()})
    position = F.struct(*order)
    if values:
        folded = base.groupBy(*keys, BLOCK).agg(
            *[s.fold(F.col(c), position).alias(c) for c, s in values.items()]
        )
    else:
        folded = base.select(*keys, BLOCK).distinct()
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    seeds = folded.select(
        *keys,
        BLOCK,
        *[s.merge(F.col(c), across).alias(c) for c, s in values.items()],
        F.lit(0).alias(ROW),
    )
    return base.withColumn(ROW, F.lit(1)).unionByName(seeds, allowMissingColumns=True)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    scans: dict[str, Scan],
    hot_rows: int | None = None,
) -> DataFrame:
    """Add one column per scan. ``order`` is a total ascending order inside ``keys``, and
    ``block`` must not decrease along it."""
    seeded = seed_blocks(df, keys, order, block, scans, hot_rows)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(ROW, *order)
    result = seeded.select(
        *df.columns,
        ROW,
        *[s.local(F.col(f"__v_{name}"), inside).alias(name) for name, s in scans.items()],
    )
    return result.filter(F.col(ROW) == 1).drop(ROW)


def scan_whole(df: DataFrame, keys: list[str], order: list[str], scans: dict[str, Scan]) -> DataFrame:
    """:func:`scan` of groups that are short enough for one window each, for scans that only look
    back (all but :func:`group_total`): rows are read once and shuffled once, on the keys."""
    values = df.withColumns({f"__v_{name}": s.value for name, s in scans.items()})
    inside = Window.partitionBy(*keys).orderBy(*order)
    return values.select(*df.columns, *[s.local(F.col(f"__v_{name}"), inside).alias(name) for name, s in scans.items()])


def rank(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    block: Column | None = None,
    names: tuple[str, str] = ("rank", "dense_rank"),
    descending: bool = False,
) -> DataFrame:
    """Rank and dense rank; ``descending`` is the direction of all order columns.

    Without ``block`` see :func:`_rank_by_range`. A ``block`` must be a function of the order
    columns that grows with them (a struct of the first and a range of the second, say), so rows
    that tie never lie in two blocks, and few enough per key for one window."""
    if block is None:
        return _rank_by_range(df, keys, order, names, descending)
    base = df.withColumn(BLOCK, block)
    ties = F.struct(*[c for c in order])
    folded = (
        base.withColumn("__tie", ties)
        .groupBy(*keys, BLOCK)
        .agg(F.count(F.lit(1)).alias("__n"), F.count_distinct("__tie").alias("__d"))
    )
    turn = F.col(BLOCK).desc() if descending else F.col(BLOCK).asc()
    across = _before(Window.partitionBy(*keys).orderBy(turn))
    seeds = folded.select(
        *keys,
        BLOCK,
        F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__n"),
        F.coalesce(F.sum("__d").over(across), F.lit(0)).alias("__d"),
        F.lit(0).alias(ROW),
    )
    seeded = base.withColumn(ROW, F.lit(1)).unionByName(seeds, allowMissingColumns=True)
    sort = [c.desc() if descending else c.asc() for c in order]
    inside = Window.partitionBy(*keys, BLOCK).orderBy(ROW, *sort)
    seed = lambda c: F.first(c).over(_through(inside))
    return (
        seeded.select(
            *df.columns,
            ROW,
            (F.rank().over(inside) - 1 + seed("__n")).alias(names[0]),
            (F.dense_rank().over(inside) - 1 + seed("__d")).alias(names[1]),
        )
        .filter(F.col(ROW) == 1)
        .drop(ROW)
    )


def _rank_by_range(df: DataFrame, keys: list[str], order: list[Column], names: tuple[str, str], descending: bool) -> DataFrame:
    """Ranks as a prefix sum on two levels. Rows that tie become one counted cell; the cells are
    sampled and dealt to tasks by range of (keys, order), so a key of any size lies in as many
    ranges as it needs. Per key only one summary per range meets in a window, and the cells of
    a range are numbered from what the ranges before it amount to. The cells' ranks are joined
    to their rows, where a value with very many ties is a skewed key that Spark splits."""
    turn = [(lambda x: x.desc()) if descending else (lambda x: x.asc())] * len(order)
    cols = [f"__o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(cols, order)))
    cells = rows.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("__n"))
    by = [F.col(k) for k in keys] + [t(F.col(c)) for t, c in zip(turn, cols)]
    cells = cut_lineage(cells.repartitionByRange(*by).withColumn(BLOCK, F.spark_partition_id()))
    sums = cells.groupBy(*keys, BLOCK).agg(F.sum("__n").alias("__rows"), F.count(F.lit(1)).alias("__cells"))
    across = _before(Window.partitionBy(*keys).orderBy(BLOCK))
    seeds = sums.select(
        *(F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)),
        F.col(BLOCK).alias("__range"),
        *(F.coalesce(F.sum(c).over(across), F.lit(0)).alias(c) for c in ("__rows", "__cells")),
    )
    same = [F.col(k).eqNullSafe(F.col(f"__s{i}")) for i, k in enumerate(keys)] + [F.col(BLOCK) == F.col("__range")]
    seeded = cells.join(seeds, same)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*(t(F.col(c)) for t, c in zip(turn, cols)))
    ranked = seeded.select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)),
        *(F.col(c).alias(f"__c{i}") for i, c in enumerate(cols)),
        (F.col("__rows") + F.coalesce(F.sum("__n").over(_before(inside)), F.lit(0)) + 1).alias(names[0]),
        (F.col("__cells") + F.row_number().over(inside)).alias(names[1]),
    )
    match = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    match += [F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate(cols)]
    return rows.join(ranked, match).select(*df.columns, *names)


def quantile_block(df: DataFrame, column: str, blocks: int = 256) -> Column:
    """A block expression from approximate quantiles of a numeric order column. Only the
    ``blocks - 1`` boundaries come to the driver."""
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = sorted(set(df.approxQuantile(column, cuts, 0.5 / blocks)))
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(b) for b in bounds])
    return F.size(F.filter(steps, lambda b: b <= F.col(column)))


def text_block(df: DataFrame, column: str, blocks: int = 64, sampled: int = 20_000) -> Column:
    """A block expression for a text order column: ranges between splitters that cut a sample of
    its distinct values (those with the smallest hashes) evenly. Only splitters are kept."""
    values = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull()).distinct()
    some = sorted(r[0] for r in values.orderBy(F.xxhash64("v"), "v").limit(sampled).collect())
    bounds = sorted({some[len(some) * i // blocks] for i in range(1, blocks)}) if some else []
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(column)))
