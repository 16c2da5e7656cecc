"""Packing documents into fixed windows by non-negative least squares.

Documents are tokenized and cut into whole windows and a remainder. Lengths are counted in
steps of GRAIN tokens; every way of filling a window with up to three pieces is a pattern, and
non-negative least squares finds how often to repeat each pattern so that the pieces it uses
match the histogram. Rounded down, that gives whole windows; a greedy pass fills further ones
from what is left, and the last pieces follow each other and are cut where a window is full.

The histogram (at most 2048 / GRAIN numbers) is all that the driver sees. A piece finds its
place by its rank among the pieces of its length: rank in its task, plus the pieces of the
tasks before. No task holds all pieces of a length, however common it is.

Null texts are empty documents (one end id each); an empty table gives no rows; rows with equal
or null doc_id are separate documents.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowflow.session import scratch_path

GRAIN = 8
PIECES = (
    "task long, pos long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, rank_in_task long, ids binary"
)
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@functools.cache
def patterns(size: int) -> list[tuple[int, ...]]:
    """Every way to write ``size`` as a sum of one, two or three parts, largest first."""
    found = [(size,)]
    found += [(size - a, a) for a in range(1, size // 2 + 1)]
    found += [(size - a - b, b, a) for a in range(1, size // 3 + 1) for b in range(a, (size - a) // 2 + 1)]
    return found


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the smallest ||a x - b||, by active sets of columns."""
    x = np.zeros(a.shape[1])
    used = np.zeros(a.shape[1], dtype=bool)
    slope = a.T @ b
    for _ in range(3 * a.shape[0]):
        free = np.where(used, -np.inf, slope)
        best = int(np.argmax(free))
        if free[best] <= 1e-9:
            break
        used[best] = True
        while True:
            columns = np.flatnonzero(used)
            fit = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            if (fit > 1e-12).all():
                break
            low = fit <= 1e-12
            step = np.min(x[columns[low]] / np.maximum(x[columns[low]] - fit[low], 1e-300))
            x[columns] += step * (fit - x[columns])
            used[columns[x[columns] <= 1e-12]] = False
            x[~used] = 0
            if not used.any():
                return x
        x[:] = 0
        x[columns] = fit
        slope = a.T @ (b - a @ x)
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, how many windows), using no more pieces than ``histogram[length]`` has."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], most: int) -> int:
        parts, times = np.unique(pattern, return_counts=True)
        n = int(min(most, (left[parts] // times).min()))
        if n > 0:
            left[parts] -= n * times
            chosen.append((pattern, n))
        return n

    take((size,), int(left[size]))
    if left.sum():
        ways = [p for p in patterns(size) if len(p) > 1]
        a = np.zeros((size, len(ways)))
        for j, way in enumerate(ways):
            for part in way:
                a[part - 1, j] += 1
        x = nnls(a, left[1:] / left.sum()) * left.sum()
        for j in sorted(np.flatnonzero(x), key=lambda j: (-x[j], j)):
            take(ways[j], int(x[j] + 1e-6))
    for first in range(size - 1, 0, -1):  # greedy: the longest first, then the longest that still fit
        while left[first]:
            rest, pattern, have = size - first, [first], left.copy()
            have[first] -= 1
            while rest and (fits := np.flatnonzero(have[1 : rest + 1])).size:
                part = int(fits[-1]) + 1
                pattern.append(part)
                have[part] -= 1
                rest -= part
            if rest or not take(tuple(pattern), int(left[first])):
                break
    return chosen


def pieces(docs: DataFrame, encode: Callable[[Iterable[str]], Iterator[np.ndarray]], window: int) -> DataFrame:
    """Windows and remainders of every document; lazily, see PIECES."""

    def cut(frames):
        task, ranks, pos = TaskContext.get().partitionId(), np.zeros(window // GRAIN + 1, dtype=np.int64), itertools.count()
        owners: list = []

        def texts():
            for frame in frames:
                owners.extend(None if pd.isna(x) else int(x) for x in frame["doc_id"].tolist())
                yield from frame["text"].tolist()

        rows, at = [], 0
        for ids in encode(texts()):
            owner, owners[at] = owners[at], None
            at += 1
            data = ids.astype("<u4")
            for start in range(0, len(data), window):
                part = data[start : start + window].tobytes()
                kind = -(-len(part) // (4 * GRAIN))
                kept = None if len(part) == 4 * window else zlib.compress(part, 1)
                rows.append((task, next(pos), owner, start, len(part) // 4, zlib.crc32(part), len(data), kind, int(ranks[kind]), kept))
                ranks[kind] += 1
            if len(rows) >= 2000:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, PIECES)


def pack(docs: DataFrame, encode: Callable[[Iterable[str]], Iterator[np.ndarray]], window: int = 2048) -> DataFrame:
    """One row per piece: RESULT columns; offsets in a sequence are gapless from 0."""
    spark = docs.sparkSession
    size = window // GRAIN
    path = scratch_path(spark, "pieces")
    pieces(docs, encode, window).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(PIECES).parquet(path)
    plain = stored.drop("ids")
    counts = plain.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(size + 1, dtype=np.int64)
    for kind, n in counts.groupBy("class").agg(F.sum("n")).collect():
        histogram[kind] = n
    # where the pieces of a class go, in order of their ranks
    used, segments, sequences = np.zeros(size + 1, dtype=np.int64), [], 0
    for pattern, n in plan(histogram):
        for slot, part in enumerate(pattern):
            segments.append((part, int(used[part]), int(used[part]) + n, sequences - int(used[part]), slot))
            used[part] += n
        sequences += n
    segments += [(k, int(used[k]), int(histogram[k]), None, None) for k in range(1, size + 1) if histogram[k] > used[k]]
    places = F.broadcast(spark.createDataFrame(segments, "class int, low long, high long, shift long, slot int"))  # a bounded table
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    bases = counts.select("class", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = plain.join(bases, ["class", "task"]).withColumn("rank", F.col("base") + F.col("rank_in_task")).drop("base", "rank_in_task")
    placed = ranked.join(places, "class").where("rank >= low AND rank < high")

    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most a window's pieces
    planned = placed.where("slot IS NOT NULL").withColumn("sequence_id", F.col("rank") + F.col("shift"))
    planned = planned.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(RESULT)

    # the rest follow each other, task by task
    rest = placed.where("slot IS NULL").drop("class", "rank", "low", "high", "shift", "slot")
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    ahead = rest.groupBy("task").agg(F.sum("length").alias("n")).select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    along = Window.partitionBy("task").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("inner", F.coalesce(F.sum("length").over(along), F.lit(0))).join(ahead, "task").withColumn("at", F.col("ahead") + F.col("inner"))
    rest = rest.withColumn("sequence_id", F.lit(sequences) + F.expr(f"at DIV {window}")).withColumn("offset", F.col("at") % window)
    whole = rest.where(F.col("offset") + F.col("length") <= window).select(RESULT)
    crossing = rest.where(F.col("offset") + F.col("length") > window).select("task", "pos", *RESULT)
    crossing = crossing.join(stored.where("ids IS NOT NULL").select("task", "pos", "ids"), ["task", "pos"])

    def halves(frames):
        for frame in frames:
            rows = []
            for x in frame.itertuples(index=False):
                data, cut = zlib.decompress(x.ids), window - x.offset
                owner = None if pd.isna(x.doc_id) else int(x.doc_id)
                rows.append((owner, x.start, cut, zlib.crc32(data[: 4 * cut]), x.doc_tokens, x.sequence_id, x.offset))
                rows.append((owner, x.start + cut, x.length - cut, zlib.crc32(data[4 * cut :]), x.doc_tokens, x.sequence_id + 1, 0))
            yield pd.DataFrame(rows, columns=RESULT).astype({"doc_id": "Int64"})

    return planned.unionByName(whole).unionByName(crossing.mapInPandas(halves, ", ".join(f"{c} long" for c in RESULT)))
