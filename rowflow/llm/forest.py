"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample (the SAMPLE ids with the smallest hashes, one row each): a
node's direction is the difference of two of its sample rows, its offset the median, until
leaves hold about LEAF rows of the whole table (at most DEPTH levels, so that the model has a
fixed size). For inner products a further component makes all vectors equally long. Every row
is put into its leaf of every tree.

A query walks all trees through one priority queue: the branch whose worst margin so far is the
least comes next, in whichever tree it is. How many leaves it takes is found on the sample: the
fewest that find TARGET of the true neighbours of the sample's own rows. The rows of those
leaves are ranked exactly, in double precision.

A leaf is searched in blocks of at most BLOCK rows for at most QUERIES queries, so neither a
leaf full of equal vectors nor a long list of queries meets in one task. The sample's k-th best
score of different ids is a lower bound of the answer's, which keeps short what blocks return.

Rows without an id and vectors that are null, zero, or hold null or non-finite components take
no part; vectors of different lengths are filled up with zeros; of rows with the same id the
nearest counts, and a query is never its own neighbour. Fewer candidates than k give all of them.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowflow.llm.vectors import kept_best, matrix, usable

TREES, LEAF, DEPTH, SAMPLE, TARGET = 8, 1024, 12, 8192, 0.95
BLOCK, QUERIES, CALIBRATED = 4096, 8192, 256
SLACK = 1e-9


@dataclass
class Forest:
    width: int
    longest: float  # squared
    directions: list[np.ndarray]  # per tree: inner nodes x (width + 1), in heap order
    offsets: list[np.ndarray]
    depth: int
    visits: int
    ids: np.ndarray  # of the sample
    rows: np.ndarray

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def stretched(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest - (rows * rows).sum(axis=1), 0))
        return np.concatenate([rows, rest[:, None]], axis=1)

    def leaf(self, tree: int, rows: np.ndarray) -> np.ndarray:
        node, at = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        sides = self.stretched(rows) @ self.directions[tree].T > self.offsets[tree]
        for _ in range(self.depth):
            node = 2 * node + 1 + sides[at, node]
        return node - (self.leaves - 1)

    def walk(self, row: np.ndarray) -> list[int]:
        """tree * leaves + leaf in the order of the shared queue."""
        queries = np.append(row, 0.0)
        margins = [(d @ queries - o).tolist() for d, o in zip(self.directions, self.offsets)]
        queue = [(0.0, t, 0) for t in range(len(margins))]
        inner, found = self.leaves - 1, []
        while queue and len(found) < self.visits:
            far, tree, node = heapq.heappop(queue)
            while node < inner:
                m = margins[tree][node]
                near = 2 * node + 1 + (m > 0)
                heapq.heappush(queue, (max(far, abs(m)), tree, 4 * node + 3 - near))
                node = near
            found.append(tree * self.leaves + node - inner)
        return found


def fit(rows: DataFrame, k: int, trees: int = TREES, leaf: int = LEAF, target: float = TARGET, seed: int = 7) -> Forest | None:
    """``rows``: usable vectors. None for an empty table."""
    squares = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)
    count, width, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("values")), F.max(squares)).first()
    if not count:
        return None
    order = [F.xxhash64("vec_id"), F.col("vec_id")]
    chosen = rows.select("vec_id").distinct().orderBy(*order).limit(SAMPLE)
    taken = rows.join(F.broadcast(chosen), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("values").alias("values")).orderBy(*order).collect()
    ids, sample = np.array([r.vec_id for r in taken]), matrix([r["values"] for r in taken], width)
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(count / leaf)))))
    rng = np.random.default_rng(seed)
    forest = Forest(width, longest, [], [], depth, trees << depth, ids, sample)
    tall = forest.stretched(sample)
    for _ in range(trees):
        directions, offsets = np.zeros(((1 << depth) - 1, width + 1)), np.zeros((1 << depth) - 1)
        node = np.zeros(len(tall), dtype=np.int64)
        for n in range(len(offsets)):
            own = np.flatnonzero(node == n)
            pair = tall[rng.choice(own, 2, replace=False)] if len(own) > 1 else rng.normal(size=(2, width + 1))
            way = pair[0] - pair[1]
            if not way.any():
                way = rng.normal(size=width + 1)
            directions[n] = way / np.linalg.norm(way)
            along = tall[own] @ directions[n]
            offsets[n] = np.median(along) if len(own) else 0.0
            node[own] = 2 * n + 1 + (along > offsets[n])
        forest.directions.append(directions)
        forest.offsets.append(offsets)
    # how many leaves the queue must give for the sample's own neighbours
    asked = np.arange(min(CALIBRATED, len(sample)))
    near = sample[asked] @ sample.T
    near[asked, asked] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    placed = [t * forest.leaves + forest.leaf(t, sample) for t in range(trees)]
    needed = []
    for i in asked:
        turn = np.zeros(trees * forest.leaves, dtype=np.int64)
        turn[forest.walk(sample[i])] = np.arange(trees * forest.leaves)
        needed.append(np.min([turn[p[best[i]]] for p in placed], axis=0) + 1)
    needed = np.concatenate(needed)
    if len(needed):
        forest.visits = int(np.quantile(needed, target, method="higher"))
    return forest


def best_ids(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """``kept_best`` of different ids: of a query's rows with the same id the best one counts."""
    order = np.lexsort((-score, ids, query))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (query[order[1:]] != query[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])
    own = order[new]
    return own[kept_best(query[own], score[own], ids[own], k)]


def search(vectors: DataFrame, queries: DataFrame, k: int, forest: Forest | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row of
    ``queries`` among the other rows of ``vectors`` (both with vec_id and embedding)."""
    schema = "query_id long, vec_id long, score double"
    rows, asked = usable(vectors, zero=False), usable(queries, zero=False)
    forest = forest or fit(rows, k)
    if forest is None:
        empty = vectors.sparkSession.createDataFrame([], schema)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    groups = max(1, -(-asked.count() // QUERIES))
    width, trees = forest.width, len(forest.directions)

    def place(frames):
        for frame in frames:
            x = matrix(frame["values"].tolist(), width)
            data = [r.tobytes() for r in x]
            for t in range(trees):
                yield pd.DataFrame({"leaf": t * forest.leaves + forest.leaf(t, x), "vec_id": frame["vec_id"], "data": data})

    placed = rows.mapInPandas(place, "leaf long, vec_id long, data binary")
    counts = rows.mapInPandas(lambda frames: (f[["leaf"]] for f in place(frames)), "leaf long").groupBy("leaf").count()
    blocks = {leaf: -(-n // BLOCK) for leaf, n in counts.collect()}  # a number per leaf of the model

    def ask(frames):
        for frame in frames:
            x = matrix(frame["values"].tolist(), width)
            for i, own in enumerate(frame["vec_id"].tolist()):
                least = -np.inf
                others = forest.rows[forest.ids != own]
                if len(others) >= k:
                    least = np.partition(others @ x[i], len(others) - k)[len(others) - k] - SLACK
                found = [(leaf, b) for leaf in forest.walk(x[i]) for b in range(blocks.get(leaf, 0))]
                yield pd.DataFrame({"leaf": [f[0] for f in found], "block": [f[1] for f in found], "query_id": own, "least": least, "data": [x[i].tobytes()] * len(found)})

    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    sizes = F.udf(lambda leaf: blocks.get(leaf, 1), "int") if any(n > 1 for n in blocks.values()) else None
    placed = placed.withColumn("block", (spread % (sizes("leaf") if sizes else F.lit(1))).cast("long"))
    placed = placed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    probes = asked.mapInPandas(ask, "leaf long, block long, query_id long, least double, data binary")
    probes = probes.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))

    def rank(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if here.empty or there.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v = np.frombuffer(b"".join(here["data"]), dtype=np.float64).reshape(-1, width)
        q = np.frombuffer(b"".join(there["data"]), dtype=np.float64).reshape(-1, width)
        ids, owners, least = here["vec_id"].to_numpy(), there["query_id"].to_numpy(), there["least"].to_numpy()
        out = []
        for at in range(0, len(q), 512):
            near = q[at : at + 512] @ v.T
            row, column = np.nonzero(near >= least[at : at + 512, None])
            other = owners[at + row] != ids[column]
            row, column = row[other], column[other]
            score = (q[at + row] * v[column]).sum(axis=1)  # equal for equal vectors
            best = best_ids(row, score, ids[column], k)
            out.append(pd.DataFrame({"query_id": owners[at + row[best]], "vec_id": ids[column[best]], "score": score[best]}))
        return pd.concat(out)

    def of_sample(frames):
        for frame in frames:
            x, owners = matrix(frame["values"].tolist(), width), frame["vec_id"].to_numpy()
            for at in range(0, len(x), 256):
                near = x[at : at + 256] @ forest.rows.T
                near[owners[at : at + 256, None] == forest.ids] = -np.inf
                least = np.partition(near, len(forest.ids) - k, axis=1)[:, len(forest.ids) - k] if len(forest.ids) > k else np.full(len(near), -np.inf)
                row, column = np.nonzero((near >= least[:, None] - SLACK) & (near > -np.inf))
                score = (x[at + row] * forest.rows[column]).sum(axis=1)
                best = best_ids(row, score, forest.ids[column], k)
                yield pd.DataFrame({"query_id": owners[at + row[best]], "vec_id": forest.ids[column[best]], "score": score[best]})

    keys = ["leaf", "block", "group"]
    found = placed.groupBy(keys).cogroup(probes.groupBy(keys)).applyInPandas(rank, schema).unionByName(asked.mapInPandas(of_sample, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
