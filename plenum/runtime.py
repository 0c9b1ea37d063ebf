"""Session helpers shared by every operator: table access, lineage cuts, reliable storage."""

from __future__ import annotations

import os
import tempfile

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``base`` (a file or a folder of files)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    ``spark.checkpoint.dir`` names it on a cluster; only where that is unset (tests, a laptop) a
    temporary local folder is used, and only with a local master.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "plenum-checkpoints")
    sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written reliably to the shared folder, its lineage cut (survives a lost executor)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the broadcasts, shuffles and cuts that nothing names any more: the driver only finds them when it collects garbage."""
    spark.sparkContext._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of ``df`` in bytes (file sizes for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ship(spark: SparkSession, thing: object) -> Broadcast:
    """Broadcast an object of this package (a fitted model of bounded size); ``received`` opens it in a worker."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def received(sent: Broadcast) -> object:
    """The object that ``ship`` sent, opened once per worker process."""
    opened = globals().setdefault("_opened", {})
    key = hash(sent.value)
    if key not in opened:
        opened.clear()
        opened[key] = cloudpickle.loads(sent.value)
    return opened[key]
