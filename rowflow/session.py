"""Session helpers: where a job may put shared intermediate data, and how it cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rowflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is tested under (UTC, AQE on)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever they run; once per application. The
    archive lies in the folder from which Spark hands files to executors."""
    home = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.join(SparkFiles.getRootDirectory(), "shipped")
    path = os.path.join(folder, "rowflow_package.zip")
    if not os.path.isdir(home) or os.path.exists(path):
        return
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(path, "w") as archive:
        for at, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(at, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(home)))
    spark.sparkContext.addPyFile(path)


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a ``local`` master, where executors share the driver's disk, may fall back to a
    fresh temporary folder; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="rowflow-")
    context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other job uses."""
    return f"{shared_root(spark)}/rowflow/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that losing an executor never replays the plan above."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Give heavy per-row work enough tasks: a source with fewer partitions than there are
    cores is spread over them, any other is left where it is (no shuffle on a large input)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *columns) if df.rdd.getNumPartitions() < cores else df


#: Rows that a task of heavy work takes, where their number is known.
TASK_ROWS = 100_000


def partitioned(df: DataFrame, *columns: str, rows: int = 0) -> DataFrame:
    """``df`` dealt by ``columns`` to as many tasks as shuffles have, and one per core at least.
    For work that is heavy for its bytes: unlike another shuffle it is not merged by size. With
    the number of ``rows`` the tasks grow with the input, and what one of them holds does not."""
    return df.repartition(task_count(df.sparkSession, rows), *columns)


def task_count(spark: SparkSession, rows: int = 0) -> int:
    few = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(few, -(-rows // TASK_ROWS))
