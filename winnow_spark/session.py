"""Reading tables and cutting lineage, for every operator of the package."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Tasks for each core when slim results are written.
WAVES = 3


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, so that any store Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Take the cluster's shared folder from ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests, a laptop)
    a local folder is made; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="winnow_checkpoint_"))


def cut_lineage(df: DataFrame, slim: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the copy.

    A ``slim`` one (ids and the like, far fewer bytes than the input) is written
    by ``WAVES`` tasks for each core of the cluster at most, so that small
    results don't become very many files.
    """
    use_checkpoint_dir(df.sparkSession)
    if slim:
        df = df.coalesce(WAVES * df.sparkSession.sparkContext.defaultParallelism)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more.

    Spark's cleaner only sees them when the driver collects its garbage, which in
    a loop of small steps may come after the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
