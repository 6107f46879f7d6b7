"""Trees as a stream of files: each document arrives whole, in one micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from leafmill import schemas
from leafmill.operators import nodes
from leafmill.sources.sinks import without_done


def tree_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Document rows of the tree files that appear in folder."""
    df = spark.readStream.schema(schemas.DOCUMENT).option("multiLine", True).option("maxFilesPerTrigger", files_a_batch).json(folder)
    return df.withColumn("doc_id", F.col("_metadata.file_path")).drop("_corrupt")


def sections_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start writing section texts of new documents to path; a document that is there already is passed over."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = nodes.section_report(nodes.attach_sections(nodes.explode_nodes(batch)))
        try:
            rows = without_done(rows, spark.read.schema(rows.schema).parquet(path), ["doc_id"])
            rows.write.mode("append").parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
