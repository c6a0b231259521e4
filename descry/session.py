"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "descry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partition count is left to the cluster's own setting; AQE coalesces small
    ones and splits skewed joins. Arrow batches are bounded in bytes as well as rows
    because a row may hold thousands of descriptors.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="descry-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    Survives the loss of executors, which a local checkpoint would not.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def max_tasks(spark: SparkSession) -> int:
    """Upper bound on the tasks of a pass whose every task emits a block of partial sums. The
    configured shuffle width counts too: cores may still be few when executors come and go."""
    return max(3 * spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_descry_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isfile(root):  # already imported from a shipped archive
        return
    base = os.path.join(tempfile.mkdtemp(prefix="descry-ship-"), "descry")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "descry"))
    sc._descry_shipped = True
