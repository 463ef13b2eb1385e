"""Cutting the lineage of a frame that several branches read, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors reach. Where it is unset, a local session gets a folder of its own and any other an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(base)
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written to a shared folder and read back, so that they are computed once and survive lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
