"""A training corpus from raw documents, in five stages.

Quality selection, boilerplate lines, near duplicates, benchmark leaks, tokens.  Each stage
takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the
documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, decontaminate, line_dup, near_dup, quality
from leafmill.llm._store import written

#: SQL can express neither the fitted models nor the hashed searches; tests hold every stage against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn by importance resampling; the others go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; n_chars follows the text."""
    out = line_dup.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each near-duplicate group."""
    return near_dup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) of the documents that are left."""
    return bpe.encoded(docs)


STAGES = [
    ("1 quality resampling", quality_stage),
    ("3 line dedup", lines_stage),
    ("10 near duplicates", near_duplicates_stage),
    ("6 benchmark decontamination", decontamination_stage),
    ("7 byte-level BPE", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
