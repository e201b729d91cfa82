"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; a cluster's own settings win.

    Joins carry no broadcast hint: Spark broadcasts a side only when its measured size is
    below ``spark.sql.autoBroadcastJoinThreshold``, and AQE splits skewed join partitions.
    Shuffled rows of a panel are pairs, which unfold into one row per month after the
    shuffle, so partitions are kept smaller than by default.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def with_package(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where it lies.

    On a cluster it is installed on the executors, or sent there with the job.
    """
    context = spark.sparkContext
    known = context.environment.get("PYTHONPATH", "")
    if context.master.startswith("local[") and ROOT not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster must
    name one, since a folder of one machine is lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir(context.applicationId)


@lru_cache(maxsize=None)
def _local_dir(application: str) -> str:
    """A folder of this process for a local session, gone when the process ends."""
    folder = tempfile.mkdtemp(prefix="panelforge-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/panelforge/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under this application's part of the shared folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder.

    For the end of a job: DataFrames that read those tables cannot be used afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so that what follows neither recomputes ``df`` nor depends on an
    executor that may be lost, and gives the planner the true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
