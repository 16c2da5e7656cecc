"""Exact top-k inner products by block-at-a-time pruning.

Integer vectors are read as documents, their components as terms. Rows are put in an order in
which neighbours are alike (signs against fixed random directions) and cut into ranges of BLOCK
rows, each with a forward index (its matrix) and the largest and smallest value of every term. A
query takes the blocks in the order of their bounds - for each term the larger of the products
with those two values, summed - and scores whole blocks until the next bound is below its k-th
best score. Blocks with a bound equal to it are still scored, as ties go to smaller ids.

A task holds the blocks of one shard (SHARD rows) and at most QUERIES queries; the best of all
shards are merged. Every row meets every query through its bound, and nothing is left out.

Rows without an id and vectors that are null or hold null or non-finite components take no part;
vectors of different lengths are filled up with zeros; repeated rows are separate candidates,
but a query is never its own. Fewer candidates than k give all of them. Scores beyond 64 bits
are an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowflow.llm.vectors import kept_best, matrix, usable

BLOCK, SHARD, QUERIES, SIGNS = 256, 1 << 15, 4096, 12


def pruned_search(ids: np.ndarray, rows: np.ndarray, owners: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of queries, ids and scores of the best rows, and how many query-block pairs were
    scored. All numbers are whole, and all sums exact in 64-bit floats or Python integers."""
    starts = np.arange(0, len(rows), block)
    high, low = np.maximum.reduceat(rows, starts, axis=0), np.minimum.reduceat(rows, starts, axis=0)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    kth = np.full(len(queries), -np.inf, dtype=bounds.dtype)
    best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bounds.dtype))
    active, scored = np.arange(len(queries)), 0
    for turn in range(len(starts)):
        active = active[bounds[active, order[active, turn]] >= kth[active]]
        if not len(active):
            break
        new = [best]
        chosen = order[active, turn]
        by_block = np.argsort(chosen, kind="stable")
        cuts = np.flatnonzero(np.diff(chosen[by_block])) + 1
        for part in np.split(active[by_block], cuts):
            at = starts[order[part[0], turn]]
            scores = queries[part] @ rows[at : at + block].T
            row, column = np.nonzero(scores >= kth[part, None])
            other = owners[part[row]] != ids[at + column]
            row, column = row[other], column[other]
            new.append((part[row], ids[at + column], scores[row, column]))
        scored += len(active)
        query, found, score = (np.concatenate(x) for x in zip(*new))
        kept = kept_best(query, score, found, k)
        best = query[kept], found[kept], score[kept]
        full = np.bincount(best[0], minlength=len(queries)) == k
        last = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], True))  # the k-th of each query
        last = last[full[best[0][last]]]
        kth[best[0][last]] = best[2][last]
    return *best, scored


def search(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of floor(scale * x) vectors, for each row of ``queries``
    among the other rows of ``vectors`` (both with vec_id and embedding)."""
    schema = "query_id long, vec_id long, score long"
    rows, asked = usable(vectors), usable(queries)
    biggest = F.array_max(F.transform("values", lambda x: F.abs(x)))
    count, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("values")), F.max(biggest)).first()
    n_asked = asked.count()
    if not count or not n_asked or not width:
        empty = vectors.sparkSession.createDataFrame([], schema)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    exact = width * (scale * most + 1) ** 2 < 2**53
    shards, groups = max(1, -(-count // SHARD)), max(1, -(-n_asked // QUERIES))
    signs = np.random.default_rng(11).normal(size=(width, SIGNS))

    def alike(frames):
        for frame in frames:
            bits = matrix(frame["values"].tolist(), width) @ signs > 0
            yield frame.assign(code=(bits @ (1 << np.arange(SIGNS)[::-1])).astype(np.int64))

    coded = rows.mapInPandas(alike, "vec_id long, values array<double>, code long")
    placed = coded.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    probes = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def whole(lists) -> np.ndarray:
        x = np.floor(scale * matrix(lists, width))
        return x if exact else np.array([[int(v) for v in r] for r in x], dtype=object)

    def best(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if here.empty or there.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        here = here.sort_values(["code", "vec_id"])
        owners = there["vec_id"].to_numpy()
        query, found, score, _ = pruned_search(here["vec_id"].to_numpy(), whole(here["values"].tolist()), owners, whole(there["values"].tolist()), k)
        return pd.DataFrame({"query_id": owners[query], "vec_id": found, "score": [int(s) for s in score]})

    found = placed.groupBy("shard", "group").cogroup(probes.groupBy("shard", "group")).applyInPandas(best, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
