"""Centroid clustering of integer vectors through dictionaries of subvectors.

Vectors become whole numbers floor(scale * x). A chunk of CHUNK vectors is cut into blocks of
BLOCK dimensions, and each block keeps only its distinct subvectors and, per vector, the code
of the one it holds: a lossless dictionary encoding, made once and written as a table. A round
computes the exact squared distance of every distinct subvector to the centroids once, sums
those partial distances by code, and adds up the new centroids from how often each cluster
holds each code. Only the centroids (a few rows) and one row of sums per cluster and dimension
ever leave the tasks; a chunk is one row, so no task holds more than the chunks of its file.

Starting centroids are the vectors with the smallest sha256 of ``1:<vec_id>`` (ties by their
components, rows without an id last). Fewer vectors than centroids give fewer centroids, an
empty table gives no rows. Null vectors, vectors of another width and vectors with a null or
non-finite component take no part. Repeated rows are separate vectors, rows without an id take
part, other columns are ignored. Numbers are 64-bit integers: a component beyond LARGEST after
scaling is an error, as its squared distances could not be told in 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowflow.session import scratch_path

CHUNK, BLOCK, LARGEST = 1 << 14, 2, 1 << 27
ENCODED = "chunk long, ids array<long>, known array<boolean>, codes binary, sizes array<int>, entries binary"


def encode(rows: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes (rows x blocks) and per block its distinct subvectors."""
    codes, entries = [], []
    for at in range(0, rows.shape[1], block):
        part, code = rows[:, at : at + block], np.zeros(len(rows), dtype=np.int64)
        for values in part.T:
            _, own = np.unique(values, return_inverse=True)
            _, first, code = np.unique(code * len(rows) + own, return_index=True, return_inverse=True)
        codes.append(code)
        entries.append(part[first])
    return np.stack(codes, axis=1), entries


def nearest(codes: np.ndarray, entries: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row (ties: the smaller number) and its squared distance."""
    total, at = np.zeros((len(codes), len(centroids)), dtype=np.int64), 0
    for code, distinct in zip(codes.T, entries):
        width = distinct.shape[1]
        apart = distinct[:, None, :] - centroids[None, :, at : at + width]
        total += (apart * apart).sum(axis=2)[code]
        at += width
    best = total.argmin(axis=1)
    return best, total[np.arange(len(total)), best]


def summed(codes: np.ndarray, entries: list[np.ndarray], cluster: np.ndarray, k: int) -> np.ndarray:
    """Per cluster the componentwise sums of its rows, and their number as last column."""
    sums = []
    for code, distinct in zip(codes.T, entries):
        held = np.bincount(cluster * len(distinct) + code, minlength=k * len(distinct)).reshape(k, -1)
        sums.append(held @ distinct)
    return np.concatenate([*sums, np.bincount(cluster, minlength=k)[:, None]], axis=1)


def whole_vectors(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """vec_id and values (array<double> of whole numbers) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    bad = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("values").isNotNull() & (F.size("values") == width) & ~bad)
    return rows.select("vec_id", F.transform("values", lambda x: F.rint(F.floor(x * scale))).alias("values"))


def encoded(rows: DataFrame, width: int, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """One row per chunk of vectors: their ids, codes and dictionaries."""

    def run(frames):
        held, count, serial = [], 0, 0

        def closed(parts: list[pd.DataFrame]) -> pd.DataFrame:
            nonlocal serial
            frame = pd.concat(parts) if len(parts) > 1 else parts[0]
            x = np.array(frame["values"].tolist()).reshape(-1, width)
            if np.abs(x).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST} has no 64-bit squared distance")
            codes, entries = encode(x.astype(np.int64), block)
            known = frame["vec_id"].notna().to_numpy()
            row = {
                "chunk": [(TaskContext.get().partitionId() << 32) + serial],
                "ids": [frame["vec_id"].fillna(0).to_numpy(dtype=np.int64)],
                "known": [known],
                "codes": [codes.astype("<u2" if len(x) <= 1 << 16 else "<u4").tobytes()],
                "sizes": [np.array([len(e) for e in entries], dtype=np.int32)],
                "entries": [np.concatenate([e.ravel() for e in entries]).astype("<i8").tobytes()],
            }
            serial += 1
            return pd.DataFrame(row)

        for frame in frames:
            for at in range(0, len(frame), chunk):
                part = frame.iloc[at : at + chunk]
                while count + len(part) >= chunk:
                    yield closed([*held, part.iloc[: chunk - count]])
                    part, held, count = part.iloc[chunk - count :], [], 0
                if len(part):
                    held.append(part)
                    count += len(part)
        if held:
            yield closed(held)

    spark = rows.sparkSession
    path = scratch_path(spark, "subvectors")
    text_ids = rows.withColumn("vec_id", F.col("vec_id").cast("string"))
    text_ids.mapInPandas(lambda frames: run(read_ids(frames)), ENCODED).write.parquet(path)
    return spark.read.schema(ENCODED).parquet(path)


def read_ids(frames):
    """Frames whose vec_id came as text (no digit of a 64-bit id is lost beside nulls)."""
    for frame in frames:
        yield frame.assign(vec_id=pd.array([None if x is None else int(x) for x in frame["vec_id"].tolist()], dtype="Int64"))


def decoded(row, width: int, block: int = BLOCK) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes and dictionaries of one encoded row."""
    n = len(row.ids)
    codes = np.frombuffer(row.codes, dtype="<u2" if n <= 1 << 16 else "<u4").reshape(n, -1).astype(np.int64)
    flat, entries, at = np.frombuffer(row.entries, dtype="<i8").astype(np.int64), [], 0
    for i, size in enumerate(row.sizes):
        wide = min(block, width - i * block)
        entries.append(flat[at : at + size * wide].reshape(size, wide))
        at += size * wide
    return codes, entries


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, width, scale)
    first = rows.orderBy(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "values").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not first:
        none = spark.createDataFrame([], schema)
        return none.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    centroids = np.array([[int(x) for x in r["values"]] for r in first], dtype=np.int64)
    table = encoded(rows, width, chunk, block)

    def sums_by(now: np.ndarray):
        def run(frames):
            for frame in frames:
                for row in frame.itertuples():
                    codes, entries = decoded(row, width, block)
                    sums = summed(codes, entries, nearest(codes, entries, now)[0], len(now))
                    yield pd.DataFrame({"cluster": np.arange(len(now), dtype=np.int32), "sums": list(sums)})

        return run

    for _ in range(rounds):
        parts = table.mapInPandas(sums_by(centroids), "cluster int, sums array<long>")
        found = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("total")).collect()
        totals = {(r.cluster, r.pos): r.total for r in found}  # k x (width + 1) numbers
        centroids = np.array([[totals[i, d] // totals[i, width] for d in range(width)] if totals[i, width] else c.tolist() for i, c in enumerate(centroids)], dtype=np.int64)

    def assign(frames):
        for frame in frames:
            for row in frame.itertuples():
                best, apart = nearest(*decoded(row, width, block), centroids)
                ids = pd.array(row.ids, dtype="Int64")
                ids[~np.asarray(row.known, dtype=bool)] = pd.NA
                yield pd.DataFrame({"vec_id": ids, "cluster": best.astype(np.int32), "distance": apart})

    path = scratch_path(spark, "clusters")
    table.mapInPandas(assign, schema).write.parquet(path)
    done = spark.read.schema(schema).parquet(path)
    spread = {r.cluster: int(r.total) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    names = {i: hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest() for i in spread}

    def of(values: dict):
        return F.element_at(F.create_map(*(F.lit(x) for i, v in values.items() for x in (i, v))), F.col("cluster"))

    return done.select("*", of(spread).cast("long").alias("cluster_inertia"), F.lit(sum(spread.values())).cast("long").alias("inertia"), of(names).alias("centroid_sha256"))
