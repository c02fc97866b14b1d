"""Table scans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder, by Spark's reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt evenly over all cores: a small file is one task, whatever its rows cost to compute."""
    return df.repartition(max(16, df.sparkSession.sparkContext.defaultParallelism))


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the session's shared `spark.checkpoint.dir` and read from there; only where that is unset
    (tests, one machine) the folder is our own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)
