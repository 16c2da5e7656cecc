"""Joins. Equi-joins are left to Catalyst and AQE, which broadcast a side once its size is
known at run time and split skewed partitions; the functions below add what the script
language has beyond that."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F


def semi(left: DataFrame, right: DataFrame, on, anti: bool = False) -> DataFrame:
    """``LEFT SEMIJOIN`` / ``ANTISEMIJOIN``."""
    return left.join(right, on, "left_anti" if anti else "left_semi")


def right_semi(left: DataFrame, right: DataFrame, on, anti: bool = False) -> DataFrame:
    """``RIGHT SEMIJOIN``: keep rows of the right side, so the sides change places."""
    return semi(right, left, on, anti)


def not_in(df: DataFrame, key: Column, listed: DataFrame) -> DataFrame:
    """``key NOT IN (SELECT …)`` by the rules of null: an empty list keeps every row, a list with a
    null keeps none, and a null key is in no other list nor out of it. ``listed`` has one column.
    One row about the list decides which plain anti join is left, so nothing is a nested loop."""
    name = listed.columns[0]
    rows, nulls = listed.agg(F.count(F.lit(1)), F.count_if(F.col(f"`{name}`").isNull())).first()
    if not rows:
        return df
    if nulls:
        return df.limit(0)
    keyed = df.withColumn("__not_in", key).filter(F.col("__not_in").isNotNull())
    values = listed.select(F.col(f"`{name}`").alias("__listed"))
    return keyed.join(values, F.col("__not_in") == F.col("__listed"), "left_anti").drop("__not_in")


def is_small(df: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes as text; one pass that
    reads at most a row beyond the bound."""
    head = df.limit(max_rows + 1)
    wide = [F.octet_length(F.to_json(F.struct(F.col(f"`{c}`").alias("v")))) for c in df.columns]
    size = F.sum(sum(wide, F.lit(16)).cast("long"))
    rows, used = head.agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and (used or 0) <= max_bytes


def broadcast_right(
    left: DataFrame, right: DataFrame, on, how: str = "inner", max_rows: int = 1_000_000, max_bytes: int = 64 << 20
) -> DataFrame:
    """``BROADCASTRIGHT`` join: the hint is used only while the right side is within its bounds,
    otherwise the join is a plain shuffled one that AQE may still improve."""
    return left.join(F.broadcast(right) if is_small(right, max_rows, max_bytes) else right, on, how)


def hash_join(
    left: DataFrame, right: DataFrame, on, how: str = "inner", max_rows: int = 2_000_000, max_bytes: int = 256 << 20
) -> DataFrame:
    """``HASH`` / ``PAIR`` join: same rows as an equi-join, built as a shuffled hash join while the
    right side fits into one task even if all its rows share a key; beyond that Catalyst's
    choice, which can spill."""
    return left.join(right.hint("SHUFFLE_HASH") if is_small(right, max_rows, max_bytes) else right, on, how)


def attach_rows(df: DataFrame, config: DataFrame, max_rows: int = 1000, max_bytes: int = 1 << 20) -> DataFrame:
    """``CROSS JOIN`` of a fact rowset with a configuration rowset.

    A configuration within the bounds on rows and bytes becomes a literal array that each fact
    row explodes: no join and no shuffle. A larger one is packed into arrays of about
    ``max_rows`` rows; each fact row meets each array by its number and explodes it there.
    """
    fields = config.schema
    if is_small(config, max_rows, max_bytes):
        rows = config.collect()
        if not rows:
            return df.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        literals = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for r in rows]
        each = df.withColumn("__cfg", F.explode(F.array(*literals)))
        return each.select(*df.columns, "__cfg.*")
    arrays = ceil(config.count() / max_rows)
    row = F.struct(*[F.col(f"`{f.name}`") for f in fields])
    dealt = F.pmod(F.xxhash64(F.to_json(row), F.monotonically_increasing_id()), F.lit(arrays))
    packed = config.select(dealt.alias("__array"), row.alias("r")).groupBy("__array").agg(F.collect_list("r").alias("__rows"))
    met = df.withColumn("__array", F.explode(F.sequence(F.lit(0), F.lit(arrays - 1)).cast("array<bigint>"))).join(packed, "__array")
    return met.select(*df.columns, F.explode("__rows").alias("__cfg")).select(*df.columns, "__cfg.*")


def comma_tables(left: DataFrame, right: DataFrame, where: Column) -> DataFrame:
    """``FROM T1, T2 WHERE ...``: the condition must relate the two sides by equality."""
    return left.join(right, where)


def cross_apply(
    df: DataFrame, items: Column, name: str, position: str | None = None
) -> DataFrame:
    """``CROSS APPLY f(x).Items AS name``: one row per item, none for an empty list."""
    if position:
        return df.select("*", F.posexplode(items).alias(position, name))
    return df.select("*", F.explode(items).alias(name))


def range_lookup(
    df: DataFrame, key: Column, ranges: DataFrame, lo: str, hi: str, width: int
) -> DataFrame:
    """Find the range with ``lo <= key < hi`` (whole numbers). Each range is listed under every
    bin of ``width`` it touches, which makes the lookup an equi-join on the bin; without that
    it would compare each row with each range."""
    first, last = F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)
    binned = ranges.filter(F.col(lo) < F.col(hi)).withColumn(
        "__bin", F.explode(F.sequence(first, last))
    )
    keyed = df.withColumn("__key", key).withColumn("__bin", F.floor(F.col("__key") / width))
    inside = (F.col("__key") >= F.col(lo)) & (F.col("__key") < F.col(hi))
    return keyed.join(binned, "__bin").filter(inside).drop("__bin", "__key")
