"""Where intermediate rows are: reliable checkpoints in the folder that the cluster shares, and small inputs dealt out to all cores."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session without one gets its own."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not path:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="hazmill-")
        sc.setCheckpointDir(path)
    return path or sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The table, computed once, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of files for each core below which an input may be read by a few tasks only (a split of Spark's).
SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt out evenly if their files are too small to be split among the cores: for steps that cost far more a row than a shuffle.

    What is shuffled has at most a split's bytes for each core; a larger input is read in enough parts as it is.
    """
    sc = df.sparkSession.sparkContext
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return df.repartition(sc.defaultParallelism) if total < SPLIT * sc.defaultParallelism else df
