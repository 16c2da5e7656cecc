"""Stored tables and dated / numbered sets of them."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Pattern token -> digits it stands for in a path.
PATTERN_TOKENS = {"%Y": 4, "%m": 2, "%d": 2, "%H": 2, "%h": 2, "%n": 0}


def read_stream_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _as_datetime(value: str | date | datetime) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(value)


def members(pattern: str, kind: str, low, high) -> list[str]:
    """Relative paths of a streamset, first to last, one per number, day, hour or year. A range of
    years may be given by days or by the years alone."""
    if kind == "__serialnum":
        return [pattern.replace("%n", str(i)) for i in range(int(low), int(high) + 1)]
    if kind == "__year":
        low, high = (f"{x}{rest}" if re.fullmatch(r"\d{4}", str(x)) else x for x, rest in ((low, "-01-01"), (high, "-12-31")))
    step = timedelta(hours=1) if kind in ("__hour", "__datetime") else timedelta(days=1)
    at, end, paths = _as_datetime(low), _as_datetime(high), []
    while at <= end:
        path = at.strftime(pattern.replace("%h", "%H"))
        if not paths or paths[-1] != path:
            paths.append(path)
        at += step
    return paths


def _token(pattern: str, token: str) -> Column:
    """Text that ``token`` (a pair of % and letter) has in the path of the row's file."""
    parts = re.split("(%[YmdHhn])", pattern)
    at = parts.index(token)
    digits = lambda t: r"\d{%d}" % PATTERN_TOKENS[t] if PATTERN_TOKENS[t] else r"\d+"
    expr = "".join(
        f"({digits(p)})" if i == at else digits(p) if p in PATTERN_TOKENS else re.escape(p)
        for i, p in enumerate(parts)
    )
    return F.regexp_extract(F.col("_metadata.file_path"), expr, 1)


def virtual_column(pattern: str, kind: str) -> Column:
    """The streamset's virtual column, taken from the file path."""
    if kind == "__serialnum":
        return _token(pattern, "%n").cast("int")
    if kind == "__year":
        return _token(pattern, "%Y").cast("int")
    day = F.concat_ws("-", _token(pattern, "%Y"), _token(pattern, "%m"), _token(pattern, "%d"))
    if kind in ("__date", "__day"):
        return F.to_date(day)
    hour = _token(pattern, "%H" if "%H" in pattern else "%h")
    return F.to_timestamp_ntz(F.concat(day, F.lit(" "), hour, F.lit(":00:00")))


def read_streamset(
    spark: SparkSession, base: str, pattern: str, kind: str, low, high, sparse: bool = False
) -> DataFrame:
    """``SSTREAM STREAMSET base PATTERN p RANGE kind=[low, high]`` as one scan of many paths.

    Members must exist unless ``sparse``: then they are read through one path alternation,
    which the file listing resolves to those that do exist.
    """
    paths = members(pattern, kind, low, high)
    if sparse:
        source = spark.read.parquet(f"{base}/{{{','.join(paths)}}}")
    else:
        source = spark.read.parquet(*[f"{base}/{p}" for p in paths])
    return source.select("*", virtual_column(pattern, kind).alias(kind))


def read_dated_path(spark: SparkSession, path: str) -> DataFrame:
    """``base/…%Y-%m-%d…?date=a...b&hour=h&sparsestreamset=true``."""
    location, _, text = path.partition("?")
    options = dict(item.split("=", 1) for item in text.split("&") if "=" in item)
    low, _, high = options.get("date", "").partition("...")
    cut = location.find("%")
    at = location.rfind("/", 0, cut) if cut >= 0 else len(location)
    base, pattern = location[:at], location[at + 1 :]
    if not low or not pattern:
        return spark.read.parquet(location)
    if "hour" in options:
        hour = int(options["hour"])
        low, high = f"{low} {hour:02d}:00:00", f"{high or low} {hour:02d}:00:00"
    sparse = options.get("sparsestreamset", "false").lower() == "true"
    return read_streamset(spark, base, pattern, "__date", low, high or low, sparse)


def file_inventory(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """Files under ``folder`` by suffix, with their age; file contents are not read. Spark's readers
    skip empty files, so those are listed by the file system."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}")
        .load(folder)
        .select("path", "length", F.unix_timestamp("modificationTime").alias("at"))
    )
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed, empty = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while listed.hasNext():
        file = listed.next()
        if file.getLen() == 0 and file.getPath().getName().endswith(suffix):
            empty.append((file.getPath().toString(), 0, file.getModificationTime() // 1000))
    if empty:
        files = files.unionAll(spark.createDataFrame(empty, "path string, length long, at long"))
    age = F.unix_timestamp(F.current_timestamp()) - F.col("at")
    return files.select("path", "length", age.alias("age_seconds"))
