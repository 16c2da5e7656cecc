"""OUTPUT: stored tables with clustering, sorting, partitioning and expiry, and text."""

from __future__ import annotations

from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowflow.operators.ordered import with_hot_keys

EXPIRES = "_expires_on"
SHARE_ROWS = 1_000_000


def cluster(df: DataFrame, column: str | list[str], files: int | None = None, target_rows: int = SHARE_ROWS) -> DataFrame:
    """``[HASH] CLUSTERED BY``: a key of n rows lies in at most ceil(n / ``target_rows``) files, so a
    very large one isn't one long task. Without ``files`` the number of files follows from the
    amount of data: Spark merges small shuffle partitions at run time, which keeps keys whole."""
    columns = [column] if isinstance(column, str) else column
    shares = F.ceil(F.coalesce("__n", F.lit(1)) / target_rows)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), shares)
    shared = with_hot_keys(df, columns, target_rows).select(*df.columns, spread.alias("__share"))
    keys = [*columns, "__share"]
    return (shared.repartition(files, *keys) if files else shared.repartition(*keys)).drop("__share")


def output(
    df: DataFrame,
    path: str,
    where: Column | None = None,
    clustered_by: str | None = None,
    files: int | None = None,
    sorted_by: str | None = None,
    partitioned_by: str | None = None,
    expires: tuple[date, int] | None = None,
    target_rows: int = SHARE_ROWS,
) -> str:
    """``OUTPUT X TO path ...``. ``expires`` is (written on, days to keep). The rows of a partition
    value are dealt to tasks by their number: n rows give at most ceil(n / ``target_rows``) files,
    however many tasks held some of them."""
    if where is not None:
        df = df.filter(where)
    if clustered_by:
        df = cluster(df, clustered_by, files)
    elif partitioned_by:
        df = cluster(df, partitioned_by, files, target_rows)
    if sorted_by:
        df = df.sortWithinPartitions(sorted_by)
    parts = [partitioned_by] if partitioned_by else []
    if expires:
        written, days = expires
        df = df.withColumn(EXPIRES, F.lit(written + timedelta(days=days)))
        parts = [EXPIRES, *parts]
    writer = df.write.mode("append" if expires else "overwrite")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return path


def output_bucketed(df: DataFrame, name: str, column: str, buckets: int, sorted_by: str | None = None) -> None:
    """Clustered output as a catalog table, so that later joins on ``column`` need no shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, column)
    (writer.sortBy(sorted_by) if sorted_by else writer).saveAsTable(name)


def output_by_expiry_column(df: DataFrame, path: str, expires_on: Column) -> str:
    """Expiry that differs by row."""
    cluster(df.withColumn(EXPIRES, expires_on), EXPIRES).write.mode("append").partitionBy(EXPIRES).parquet(path)
    return path


def purge_expired(spark: SparkSession, path: str, today: date) -> list[str]:
    """Delete the partitions under ``path`` whose expiry day is before ``today``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{EXPIRES}=") and name.split("=", 1)[1] < today.isoformat():
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def file_order(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``(file, rows, in_order)`` of the stored files: whether ``column`` never falls along the rows of
    a file (nulls first). Each task reads its part of the files in order and reports one row per
    part; only these rows are brought together, so a file of any size is checked."""
    stored = spark.read.parquet(path)
    kind = stored.schema[column].dataType.simpleString()
    rows = stored.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), F.col(column).alias("v")
    )

    def run(frames):
        parts: dict[str, dict] = {}  # one file or a piece of one, as a rule
        for frame in frames:
            for file, own in frame.groupby("file", sort=False):
                known = own["v"].notna().to_numpy()
                seen = own["v"].to_numpy()[known]
                new = {"file": file, "at": int(own["at"].iloc[0]), "rows": 0, "good": True, "low": None, "high": None, "nulls": False}
                part = parts.setdefault(file, new)
                rises = (known[1:] >= known[:-1]).all() and (seen[1:] >= seen[:-1]).all()
                follows = part["high"] is None or known.all() and seen[0] >= part["high"]
                part["rows"] += len(own)
                part["good"] = bool(part["good"] and rises and follows)
                part["nulls"] = bool(part["nulls"] or not known.all())
                if len(seen):
                    part["low"] = seen[0] if part["low"] is None else part["low"]
                    part["high"] = seen[-1]
        yield pd.DataFrame(list(parts.values()), columns=["file", "at", "rows", "good", "low", "high", "nulls"])

    found = rows.mapInPandas(run, f"file string, at long, rows long, good boolean, low {kind}, high {kind}, nulls boolean")
    of_file = found.groupBy("file").agg(
        F.sum("rows").alias("rows"), F.min("good").alias("good"), F.sort_array(F.collect_list(F.struct("at", "low", "high", "nulls"))).alias("p")
    )

    def falls(i: Column) -> Column:
        before, here = F.get("p", i - 1), F.get("p", i)
        return F.coalesce((here["low"] < before["high"]) | (here["nulls"] & before["high"].isNotNull()), F.lit(False))

    later = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: i > 0)
    return of_file.select("file", "rows", (F.col("good") & ~F.exists(later, falls)).alias("in_order"))


def output_csv(df: DataFrame, path: str, header: bool = True) -> str:
    df.write.mode("overwrite").option("header", header).csv(path)
    return path


def schema_rows(df: DataFrame) -> DataFrame:
    """Schema outputter: one row per column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "pos int, column string, type string")
