"""User-defined rowset operators: PROCESS, REDUCE, COMBINE.

Column expressions are the fast path of PROCESS. Real user code runs on Arrow batches inside
tasks that Spark partitions; a REDUCE over groups of any size asks the user code for a
mergeable state, so that a large group is reduced block by block in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rowflow.operators.ordered import BLOCK, ROW, Scan, seed_blocks

RowsFn = Callable[[pd.DataFrame], pd.DataFrame]


def process(
    df: DataFrame,
    using: RowsFn | dict[str, Column],
    produce: str | T.StructType | None = None,
    having: Column | None = None,
) -> DataFrame:
    """``PROCESS X PRODUCE cols USING f HAVING p``. ``using`` is a dict of Columns (stays in the
    JVM) or a function of one batch of rows (then ``produce`` gives its schema)."""
    if isinstance(using, dict):
        result = df.select(*[c.alias(n) for n, c in using.items()])
    else:

        def batches(parts):
            for part in parts:
                yield using(part)

        result = df.mapInPandas(batches, produce)
    return result.filter(having) if having is not None else result


def whole_blocks(parts, start: str):
    """Regroup sorted batches so that each holds whole blocks; ``start`` marks first rows."""
    held: list[pd.DataFrame] = []
    for part in parts:
        starts = part.index[part[start]]
        if len(starts):
            cut = part.index.get_loc(starts[-1])
            ready = pd.concat([*held, part.iloc[:cut]], ignore_index=True)
            if len(ready):
                yield ready
            held = [part.iloc[cut:]]
        else:
            held.append(part)
    rest = pd.concat(held, ignore_index=True) if held else None
    if rest is not None and len(rest):
        yield rest


def reduce_rows(
    df: DataFrame,
    on: list[str],
    presort: list[str],
    block: Column,
    produce: str,
    using: RowsFn,
    state: dict[str, Scan] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """``REDUCE X ON k PRESORT cols PRODUCE cols USING f``.

    A group (with ``hot_rows``: a group beyond that size) is cut into blocks along the presort
    order (``block`` does not decrease along it), so one task never has to take all of it. What ``f`` must know about the rows
    before a block is its ``state``: each entry is a scan whose fold and merge run natively,
    and its value before the block comes with every row as a column of that name (null in
    the first block). ``f`` gets frames of many whole blocks, sorted, with the column
    ``group`` numbering the blocks of the frame, and works on them in a vectorised way.
    """
    seeded = seed_blocks(df, on, presort, block, state or {}, hot_rows)
    inside = Window.partitionBy(*on, BLOCK).orderBy(ROW, *presort)
    through = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ready = seeded.select(
        *df.columns,
        BLOCK,
        ROW,
        (F.lag(ROW).over(inside) == 0).alias("__start"),
        *[F.first(f"__v_{n}").over(through).alias(n) for n in state or {}],
    ).filter(F.col(ROW) == 1)
    ready = ready.sortWithinPartitions(*on, BLOCK, ROW, *presort).drop(BLOCK, ROW)

    def batches(parts):
        for rows in whole_blocks(parts, "__start"):
            rows["group"] = rows["__start"].cumsum()
            yield using(rows.drop(columns="__start"))

    return ready.mapInPandas(batches, produce)


def combine(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    produce: str,
    using: RowsFn,
    reduce_right: dict[str, Column],
    presort: list[str] | None = None,
    how: str = "left",
) -> DataFrame:
    """``COMBINE L WITH R ON keys PRESORT cols USING f``; without keys pass the PRESORT columns
    as ``on``.

    The right rows of a key are first reduced to one row (``reduce_right``, aggregated on the
    map side), so the combine is an equi-join that AQE can broadcast or split when a key is
    hot, and no pair of rows is built within a key. ``f`` gets frames of left rows with the
    right values as columns; the rows of a key follow each other in presort order.
    """
    right = right.groupBy(*on).agg(*[c.alias(n) for n, c in reduce_right.items()])
    joined = left.join(right, on, how)
    if presort:
        joined = joined.sortWithinPartitions(*on, *presort)

    def batches(parts):
        for rows in parts:
            yield using(rows)

    return joined.mapInPandas(batches, produce)


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup sorted Arrow batches so that each table holds whole groups; ``__start`` marks the first rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch["__start"].to_numpy(zero_copy_only=False))
        if len(starts):
            if held or starts[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
            batch, held = batch.slice(starts[-1]), []
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def combine_rows(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    produce: str,
    using: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    presort: list[str] | None = None,
    right_presort: list[str] | None = None,
    blocks: tuple[Column, Column] | None = None,
) -> DataFrame:
    """``COMBINE L WITH R ON keys PRESORT cols USING f`` where ``f`` sees the rows of both sides.

    Both rowsets are shuffled once, on the keys, and ``f`` gets two frames with the left and the
    right rows of many whole keys, sorted by the keys and the presorts, with the names they had.
    A key may be missing on either side; null keys match nothing, and their left rows come alone.
    A task holds one Arrow batch and the rest of a key. Where a key may be large, ``blocks`` gives
    the block of a left row and the array of blocks of the left side that need a right row; a
    block then takes the place of the key, so it is for the caller to say what must meet.
    """
    own, needed = blocks or (F.lit(0), F.array(F.lit(0)))

    def side(df: DataFrame, prefix: str, turn: int, block: Column) -> DataFrame:
        values = [F.col(c).alias(prefix + c) for c in df.columns if c not in on]
        return df.withColumn(BLOCK, block).select(*on, BLOCK, F.lit(turn).alias(ROW), *values)

    pair = side(right.dropna(subset=on), "__r_", 0, F.explode(needed)).unionByName(
        side(left, "__l_", 1, own), allowMissingColumns=True
    )
    order = [ROW, *[f"__r_{c}" for c in right_presort or []], *[f"__l_{c}" for c in presort or []]]
    first = F.row_number().over(Window.partitionBy(*on, BLOCK).orderBy(*order)) == 1
    ready = pair.withColumn("__start", first).sortWithinPartitions(*on, BLOCK, *order)

    def rows_of(part: pa.Table, prefix: str, turn: int) -> pd.DataFrame:
        names = [n for n in part.column_names if n in on or n.startswith(prefix)]
        rows = part.filter(pc.equal(part[ROW], turn)).select(names)
        return rows.rename_columns([n.removeprefix(prefix) for n in names]).to_pandas()

    target = T.StructType.fromDDL(produce) if isinstance(produce, str) else produce
    shape = to_arrow_schema(target)

    def batches(parts):
        for part in whole_keys(parts):
            made = using(rows_of(part, "__l_", 1), rows_of(part, "__r_", 0))
            yield from pa.Table.from_pandas(made, shape, preserve_index=False).to_batches()

    return ready.mapInArrow(batches, target)


def every_nth(numbered: DataFrame, column: str, n: int) -> DataFrame:
    """Per-group sample after presort: rows 1, n + 1, 2n + 1, ... of a row number."""
    return numbered.filter(F.pmod(F.col(column) - 1, F.lit(n)) == 0)
