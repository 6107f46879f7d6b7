"""Tables written to the shared folder, so that lost executors cost no lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, on one machine, a folder of our own, which is then set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.environ.get("LEAFMILL_SCRATCH") or tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in lineage that survives lost executors.

    The files go when the driver ends, if `discard` hasn't deleted them before.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/leafmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _place(spark, path)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that `written` returned and that nothing reads any more."""
    for df in tables:
        files, at = _place(df.sparkSession, df.written_at)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


def free(df: DataFrame, name: str) -> str:
    """name, or the first of _name, __name ... that is no column of df, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bytes of a table up to which it is broadcast; larger ones are joined by shuffling.
BROADCAST_BYTES = 48 << 20


def small(df: DataFrame, bytes_a_row: int = 32) -> DataFrame:
    """df (read from a written table, so counting is cheap) with a broadcast hint if it is surely small, else as it is."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df
