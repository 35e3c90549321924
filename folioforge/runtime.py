"""Session plumbing: table reads, code shipping, checkpoints."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "folioforge.shipped"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; Catalyst prunes its columns."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per context.

    A cluster's workers need not have the package installed, nor share the driver's working folder.
    """
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return spark
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="folioforge-")) / "folioforge_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(str(target))
    setattr(context, _SHIPPED, True)
    return spark


def spread(frame: DataFrame) -> DataFrame:
    """The frame over all cores, for work that costs far more than moving its rows.

    Only a scan with fewer splits than the cluster has cores is moved, so at scale this is the frame itself.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    execution = frame._jdf.queryExecution()
    if execution.executedPlan().nodeName().startswith("Adaptive"):
        return frame  # it is shuffled anyway; asking for its partitions would run it
    splits = execution.toRdd().getNumPartitions()
    return frame if splits >= cores else frame.repartition(cores)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only in local mode, and only where none is named.

    On a cluster a folder of one machine would lose rows, so a session that names none is refused. What is written is removed
    once nothing refers to it any more.
    """
    context = spark.sparkContext
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "folioforge-checkpoints")
    context.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """Write an intermediate result to the checkpoint folder; it survives the loss of executors.

    It is written when this is called, so building a query that cuts runs jobs.
    """
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
