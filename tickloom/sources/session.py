"""Session defaults and the shared folder for settled tables."""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # recording a Python call site per column is slow for wide feature sets
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
_local_folder: list[str] = []


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "tickloom") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a ``local[...]`` session, where driver and executors are one process, may leave it
    unset: it gets a temporary folder that goes when the process ends. Elsewhere a missing setting is an
    error, since each executor would write to its own disk. The caller's session is not changed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="tickloom-"))
        atexit.register(shutil.rmtree, _local_folder[0], ignore_errors=True)
    return _local_folder[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tickloom/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and read it back.

    It fixes the content against task retries, cuts the lineage, and lets the planner see the
    table's real size: Spark broadcasts it only under ``spark.sql.autoBroadcastJoinThreshold``
    and otherwise joins by shuffle. Meant for tables that are read more than once.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
