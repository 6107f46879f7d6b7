"""Scans of trees, phrases, answers, questions, texts, results and file inventories."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.functions import layout, text


def read_trees(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """One row a document tree with its path as doc_id; a file that can't be parsed has no nodes.

    With lines, a tree a line as `sinks.write_trees` leaves them, each with its own doc_id.
    """
    schema = schemas.DOCUMENT + (", doc_id string" if lines else "")
    df = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return (df if lines else df.withColumn("doc_id", F.col("_metadata.file_path"))).drop("_corrupt")


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Any JSON objects or arrays of objects, one row each."""
    return spark.read.option("multiLine", True).json(path)


def read_phrases(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Extracted words or phrases with boxes; doc_id is the file."""
    return spark.read.schema(schemas.PHRASE).option("multiLine", True).json(path).withColumn("doc_id", F.col("_metadata.file_path"))


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """The wide answer table, all strings; empty strings stay apart from nulls."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").csv(path)


def first_object(spark: SparkSession, path: str, limit: int = 300) -> str:
    """The first object of a JSON file (of its array, or itself), strings cut to `limit` characters and dots; empty for an empty array."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"))
    first = F.coalesce(F.get_json_object("value", "$[0]"), F.when(~F.ltrim("value").startswith("["), F.col("value")))
    text_ = whole.select(first.alias("x")).first()[0]
    return json.dumps(_cut(json.loads(text_), limit), ensure_ascii=False, indent=2) if text_ else ""


def _cut(x: object, limit: int) -> object:
    if isinstance(x, dict):
        return {k: _cut(v, limit) for k, v in x.items()}
    if isinstance(x, list):
        return [_cut(v, limit) for v in x]
    return x[:limit] + "..." if isinstance(x, str) and len(x) > limit else x


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Provenance results written before, from all folders below path."""
    return spark.read.schema(schemas.RESULT).option("recursiveFileLookup", True).json(path)


def parse_questions(lines: DataFrame, order_col: str = "line_no", line_col: str = "line", by: list[str] | None = None) -> DataFrame:
    """Question records from the numbered lines of a catalogue (or of several, told apart by `by`).

    A line of digits opens a record; ``Category:``, ``Description:``, ``Answer Format:`` and
    ``Group:`` set its fields to what stands before the prefix occurs again; other lines
    mean nothing, the last of repeated fields counts, and fields before the first record
    make one without an id.
    """
    by = by or []
    s = F.trim(F.col(line_col))
    opens = s.rlike("^[0-9]+$")
    order = Window.partitionBy(*by).orderBy(order_col)
    rows = lines.withColumn("_s", s).where("_s <> ''").withColumn("_record", F.sum(opens.cast("int")).over(order))

    def field(prefix: str):
        value = F.trim(F.element_at(F.split("_s", prefix), 2))
        return F.max_by(value, F.when(F.col("_s").startswith(prefix), F.col(order_col)))

    out = rows.groupBy(*by, "_record").agg(
        F.max(F.when(F.col("_s").rlike("^[0-9]+$"), F.col("_s").try_cast("int"))).alias("id"),
        field("Category:").alias("category"), field("Description:").alias("description"),
        field("Answer Format:").alias("answer_format"), field("Group:").alias("group"),
    )
    known = F.coalesce(F.col("id").cast("string"), "category", "description", "answer_format", "group").isNotNull()
    return out.where(known).drop("_record")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue file as question records."""
    whole = read_texts(spark, path).select("path", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    return parse_questions(whole, by=["path"]).select("id", "category", "description", "answer_format", "group")


def inventory(spark: SparkSession, folder: str, pattern: str = r"(?i)\.pdf$") -> DataFrame:
    """(filename, full_path, size) of the files below folder whose path matches, by name and path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.where(F.col("path").rlike(pattern)).select(text.basename(F.col("path")).alias("filename"), F.col("path").alias("full_path"), F.col("length").alias("size")).distinct().orderBy("filename", "full_path")


def pdf_names(spark: SparkSession, folder: str) -> DataFrame:
    return inventory(spark, folder).select("filename")


def count_files(spark: SparkSession, folder: str, suffix: str | None = None, folders: bool = False) -> int:
    """Files below folder, of a suffix in any case if one is given; with folders, folders below it too."""
    if folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at)
        return found.getFileCount() + found.getDirectoryCount() - 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return (files.where(F.lower("path").endswith(suffix.lower())) if suffix else files).count()


def extract_text(files: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text) of (path, content): the extractor's pages joined by newlines, null where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    out.append("".join(page + "\n" for page in extractor(content)).strip())
                except Exception:  # noqa: BLE001 - whatever a file does to the extractor, the others go on
                    out.append(None)
            yield pd.DataFrame({"path": batch["path"], "text": out})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def extract_folder(spark: SparkSession, folder: str, extractor: Callable[[bytes], list[str]], pattern: str = r"(?i)\.pdf$") -> DataFrame:
    """(path, text, text_path) of the files below folder: extracted text and where it belongs."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(pattern))
    return extract_text(found, extractor).withColumn("text_path", text.raw_text_path(F.col("path")))


def is_scanned(first_page: F.Column, threshold: int = 100) -> F.Column:
    """Whether a document's first page has so little text that it must be an image."""
    return F.coalesce(F.length(text.stripped(first_page)) < threshold, F.lit(True))


def word_phrases(words: DataFrame, width_col: str = "page_width") -> DataFrame:
    """Phrase rows of extracted words (doc_id, id, phrase, x0, y0, x1, y1, page, font, size, page width): blank ones go, flags are added."""
    w = words.where(~text.is_blank(F.col("phrase")))
    order = Window.partitionBy("doc_id").orderBy("id")
    return w.select(
        "doc_id", (F.row_number().over(order) - 1).alias("id"), "phrase", "x0", "y0", "x1", "y1", "page", "font", "size",
        layout.is_bold(F.col("font")).alias("bold"), layout.has_underline(F.col("phrase")).alias("is_underline"), layout.is_all_caps(F.col("phrase")).alias("all_cap"),
        layout.starts_with_number(F.col("phrase")).alias("num_st"), layout.is_centred(F.col("x0"), F.col("x1"), F.col(width_col)).alias("is_center"),
    )


def ocr_phrases(words: DataFrame, scale: float = 2.0, confidence: float = 30.0) -> DataFrame:
    """Phrase rows of OCR words (doc_id, id and the columns of schemas.OCR_WORD), boxes scaled back; sure and large words count as bold."""
    w = words.where(text.is_valid_phrase(F.col("text")) & (F.col("conf") > confidence))
    x0, y0 = F.col("left") / scale, F.col("top") / scale
    x1, y1 = (F.col("left") + F.col("width")) / scale, (F.col("top") + F.col("height")) / scale
    size = y1 - y0
    return w.select(
        "doc_id", "id", F.col("text").alias("phrase"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), "page", F.lit("OCR_Detected").alias("font"), size.alias("size"),
        ((F.col("conf") > 70) & (size > 20)).cast("int").alias("bold"), F.lit(0).alias("is_underline"), layout.is_all_caps(F.col("text")).alias("all_cap"),
        layout.starts_with_number(F.col("text")).alias("num_st"), layout.is_centred(x0, x1, F.col("page_width"), 0.2).alias("is_center"),
    )


def phrases_of(pages: DataFrame, words: DataFrame, ocr: DataFrame) -> DataFrame:
    """Phrases of each document: those of OCR where its first page (doc_id, first_page) is scanned, else the words'."""
    scanned = pages.where(is_scanned(F.col("first_page"))).select("doc_id").distinct()
    return words.join(scanned, "doc_id", "left_anti").unionByName(ocr.join(scanned, "doc_id", "left_semi"))
