"""The subpackage's queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, chat, decontaminate, lattice, line_dup, media, near_dup, quality, secrets, suffix_dup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.selected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dup.drop_boilerplate(table(spark, sf_dir, "documents"), count_col="n_dropped").select("doc_id", "source", "text", "n_dropped")


OP3_SQL = f"""
WITH split AS (
    SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), seen AS (
    SELECT source, line, count(*) AS c
    FROM (SELECT DISTINCT doc_id, source, trim(part) AS line FROM (SELECT doc_id, source, unnest(parts) AS part FROM split))
    WHERE line <> '' AND source IS NOT NULL GROUP BY source, line
), total AS (
    SELECT source, count(*) AS n FROM documents GROUP BY source
), bad AS (
    SELECT source, list(line) AS lines FROM seen JOIN total USING (source)
    WHERE c >= {line_dup.MIN_PAGES} AND c::DOUBLE / n::DOUBLE > {line_dup.RATIO}::DOUBLE GROUP BY source
), kept AS (
    SELECT doc_id, split.source, text, parts, list_filter(parts, lambda x: NOT list_contains(coalesce(lines, []), trim(x))) AS good
    FROM split LEFT JOIN bad ON split.source = bad.source
)
SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(good, chr(10)), '') END AS text,
       coalesce(len(parts) - len(good), 0)::BIGINT AS n_dropped FROM kept
"""


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dup.repeated_passages(table(spark, sf_dir, "documents"))


#: The tables hold no media: SHOTS vectors in a row make a file, each a shot of FRAMES frames of 4 x 4 blocks.
SHOTS, FRAMES = 8, 6


def _video(rows: pa.Table) -> pa.Table:
    rows = sorted(zip(rows.column("vec_id").to_pylist(), rows.column("embedding").to_pylist()))
    coded = []
    for _, vector in rows:
        x = np.nan_to_num(np.array(vector, float))
        level = 110 * np.tanh(2 * np.resize(x if len(x) else np.zeros(1), 16) / max(np.abs(x).max(initial=0), 1e-9))
        for t in range(FRAMES):
            blocks = np.zeros((4, 4, 64), np.int64)
            blocks[..., 0] = np.rint(8 * np.clip(level + t, -127, 127)).reshape(4, 4)
            blocks[..., 1] = t
            coded.append(media.jpeg(blocks, tables=t % 2 == 0))
    return pa.table({"video_id": pa.array([rows[0][0] // SHOTS], pa.int64()), "data": pa.array([media.avi(coded, 32, 32)], pa.binary())})


def videos(embeddings: DataFrame) -> DataFrame:
    """(video_id, data): AVI files drawn from vectors."""
    e = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return e.withColumn("v", F.floor(F.col("vec_id") / SHOTS)).groupBy("v").applyInArrow(_video, "video_id bigint, data binary")


def op5_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.clip_rows(videos(table(spark, sf_dir, "embeddings")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(chat.turn_events(table(spark, sf_dir, "conversations")))


OP8_SQL = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), one AS (
    SELECT conv_id, turn, role, text FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1
), marked AS (
    SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM one
), final AS (
    SELECT conv_id, turn, role, text FROM marked WHERE following IS NULL OR following <> role
)
SELECT conv_id, count(*) AS n_messages,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn) AS rendered
FROM final GROUP BY conv_id
"""


def op9_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.language_model(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


_ALL = (
    op1_quality_resampling, op2_secret_scan, op3_line_dedup, op4_suffix_array_dedup, op5_media_clips,
    op6_benchmark_decontamination, op7_bpe_tree, op8_chat_format, op9_lattice_likelihood, op10_near_duplicates,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op3_line_dedup": OP3_SQL, "op8_chat_format": OP8_SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
