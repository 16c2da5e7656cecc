"""Aggregation: implicit grouping, list building, metric stacking, unordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowflow.operators.joins import broadcast_right
from rowflow.operators.ordered import group_total, row_number, running_sum, scan
from rowflow.session import cut_lineage


def implicit_group(
    df: DataFrame, keys: dict[str, Column], aggs: dict[str, Column], having: Column | None = None
) -> DataFrame:
    """The language has no GROUP BY: columns that are not aggregates are the keys."""
    grouped = df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        *[c.alias(n) for n, c in aggs.items()]
    )
    return grouped.filter(having) if having is not None else grouped


def first_of(value: Column, *order: Column) -> Column:
    """``FIRST(x)``: by a total order when one is given, any value otherwise."""
    return F.min_by(value, F.struct(*order)) if order else F.any_value(value)


def over_partition(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """``AGG() OVER (PARTITION BY keys)``. The group totals are partially aggregated and joined
    back, so a group that holds much of the data is never gathered in one window task: a small
    result is broadcast by AQE after its size is known, a large one is a skew-split join."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    renamed = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *list(aggs)
    )
    match = [df[k].eqNullSafe(renamed[f"__k{i}"]) for i, k in enumerate(keys)]
    return df.join(renamed, match, "left").select(*df.columns, *list(aggs))


def list_of(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    item: Column,
    block: Column,
    name: str = "items",
    chunk: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """``LIST(x)`` in a fixed order, whole and with ``part`` 0. With ``chunk`` a longer group continues
    in further rows (``part`` 0, 1, ...), so that no row and no task holds an unbounded group."""
    if chunk is None:
        each = df.select(*keys, F.struct(*order, item.alias("__v")).alias("__p"))
        whole = each.groupBy(*keys).agg(F.sort_array(F.collect_list("__p")).alias("__ps"))
        return whole.select(*keys, F.lit(0).cast("long").alias("part"), F.transform("__ps", lambda p: p["__v"]).alias(name))
    numbered = scan(df, keys, order, block, {"__n": row_number()}, hot_rows)
    part = F.floor((F.col("__n") - 1) / chunk)
    pairs = numbered.select(
        *keys, part.cast("long").alias("part"), F.struct(F.col("__n"), item.alias("v")).alias("__p")
    )
    packed = pairs.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("__p")).alias("__ps"))
    return packed.select(*keys, "part", F.transform("__ps", lambda p: p["v"]).alias(name))


def tagged_metrics(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """``Tag, Num`` rows for several metrics, computed in one pass and then unpivoted."""
    row = df.agg(*[c.cast("long").alias(n) for n, c in metrics.items()])
    return row.unpivot([], list(metrics), "Tag", "Num")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key. Spark trims every map task to ``n`` rows per key before
    the shuffle (WindowGroupLimit), so a hot key stays small."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rn).filter(F.col("rn") <= n)


def others_in_group(
    df: DataFrame, key: str, position: str, block: Column, amounts: dict[str, str]
) -> DataFrame:
    """A self join on ``key`` with ``position`` differing, folded into per-row totals: how many
    other rows the group has, how many lie at smaller positions, and the sum of each amount
    over the others. Works on counts per (key, position); no pair of rows is ever built."""
    cells = df.groupBy(key, position).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(n) for n, c in amounts.items()]
    )
    # Totals and running counts come from the same block summaries: one shuffle of the cells.
    done = scan(
        cells,
        [key],
        [position],
        block,
        {
            "__upto": running_sum(F.col("__n")),
            "__all": group_total(F.col("__n")),
            **{f"__t_{n}": group_total(F.col(n)) for n in amounts},
        },
    )
    return done.select(
        key,
        position,
        F.col("__n").alias("rows"),
        (F.col("__all") - F.col("__n")).alias("others"),
        (F.col("__upto") - F.col("__n")).alias("above"),
        *[(F.col(f"__t_{n}") - F.col(n)).alias(n) for n in amounts],
    )


def item_counts(df: DataFrame, key: str, items: Column, item: str, count: str) -> DataFrame:
    """``(key, item, count)``: how often each item stands in the arrays ``items`` of the rows of a key.

    Every array is counted in its row, sorted and read by runs, so nothing is shuffled but the
    keys, and the counts of those keys that have several rows. Null items don't count.
    """
    several = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    several = cut_lineage(several.select(F.col(key).alias("__key"), F.lit(True).alias("__several")))
    alone = several.isEmpty()
    marked = df.withColumn("__several", F.lit(None).cast("boolean")) if alone else broadcast_right(df, several, F.col(key).eqNullSafe(F.col("__key")), "left")
    rows = marked.select(key, "__several", F.sort_array(items).alias("__items"))
    places = F.when(F.size("__items") > 0, F.sequence(F.lit(0), F.size("__items") - 1))
    starts = F.filter(places, lambda i: (i == 0) | ~F.get("__items", i).eqNullSafe(F.get("__items", i - 1)))
    rows = rows.select("*", starts.alias("__starts"))

    def run(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("__starts", k + 1), F.size("__items"))
        return F.struct(F.get("__items", i).alias(item), (end - i).cast("long").alias(count))

    cells = rows.select(key, "__several", F.explode(F.transform("__starts", run)).alias("__run")).select(key, "__several", "__run.*").filter(F.col(item).isNotNull())
    single = cells.filter(F.col("__several").isNull()).select(key, item, count)
    return single if alone else single.unionByName(cells.filter("__several").groupBy(key, item).agg(F.sum(count).alias(count)))
