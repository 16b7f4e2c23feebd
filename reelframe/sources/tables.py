"""Parquet tables of a folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name; columns and filters of the query are pushed into its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df once to the session's spark.checkpoint.dir and go on from there; lost executors cost no recomputation.

    A local session without the setting gets a temporary folder; a cluster has to name a folder that all its machines share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp()
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
