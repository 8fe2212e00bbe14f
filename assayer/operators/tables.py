"""Intermediate tables in the folder that the cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without one gets a temporary folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="assayer-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores, for costly work on it: a small file holds many rows, which one task reads."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: no lineage grows, and nothing is computed twice."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
