"""Session helpers: table access, checkpoint folder, tables written to cut lineage."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_log = logging.getLogger(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset and driver and
    executors are one process (tests, a single machine) a folder of our own is created and
    set. On a cluster an unset folder is an error: a local one would lose rows."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"cartulary-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
        _written.append((spark, at))
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back: cuts the
    lineage, computes it once and survives the loss of executors. Removed at exit."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: for work that costs far more
    than moving its rows, over tables of a few files. Larger tables stay where they are, and
    so does what comes out of a shuffle."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder, removed at exit."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, at))
    return at


def drop_materialized() -> None:
    """Remove the tables that ``materialize`` wrote."""
    while _written:
        spark, at = _written.pop()
        if spark.sparkContext._jsc is None:  # stopped: a mounted folder can still be cleared
            local = at.removeprefix("file://")
            if local.startswith("/"):
                shutil.rmtree(local, ignore_errors=True)
            else:
                _log.warning("%s stays: its session has ended", at)
            continue
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        try:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception as failed:
            _log.warning("%s stays: %s", at, failed)


atexit.register(drop_materialized)
