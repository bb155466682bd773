"""Tables that cut a lineage: written once to the folder that driver and executors share, then read."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, below the working directory in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or 'file://' + os.path.abspath('spark-warehouse/checkpoints')).rstrip('/')}/weftlink-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _folder(spark, path)
    return fs.exists(folder)


def delete(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)


def materialized(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows from a written table: later plans start here, and no lost executor undoes it."""
    path = path or shared_folder(df.sparkSession)
    df.write.parquet(f"{path}/table")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/table")
