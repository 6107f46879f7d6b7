"""Tables in the shared folder: computed once, read by several steps, and safe from lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, on one machine, a folder of our own, which is then set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.environ.get("LEAFMILL_SCRATCH") or tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def place(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{folder(spark)}/leafmill-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """df written once and read back."""
    path = place(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
