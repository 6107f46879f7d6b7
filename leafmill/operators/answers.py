"""Ground truth: answers by document and question, inventories against it, groups of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text


def unpivot_answers(wide: DataFrame, filename_col: str = "Filename") -> DataFrame:
    """(filename, category, answer, provenance, found) of the wide table, its first row for each file.

    found tells that either column of the category exists, also where the value is null.
    Rows of one file are told apart by their order in the input.
    """
    names = [c for c in wide.columns if c != filename_col]
    categories = list(dict.fromkeys(c.removesuffix("-Answer") for c in names))
    none = F.lit(None).cast("string")
    cells = F.array(*(F.struct(F.lit(c).alias("category"), (F.col(f"`{c}-Answer`") if f"{c}-Answer" in names else none).cast("string").alias("answer"), (F.col(f"`{c}`") if c in names else none).cast("string").alias("provenance")) for c in categories))
    first = Window.partitionBy("filename").orderBy("_at")
    rows = wide.select(F.col(f"`{filename_col}`").alias("filename"), cells.alias("cells"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.select("filename", F.explode("cells").alias("c")).select("filename", "c.category", "c.answer", "c.provenance", F.lit(True).alias("found"))


def lookup(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """pairs (filename, category) with answer, provenance and found; unknown ones have found false."""
    return pairs.join(answers, ["filename", "category"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def document_answers(filenames: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each document and question: answer, provenance, answer_format, group."""
    pairs = filenames.select("filename").distinct().crossJoin(questions.select("category", "answer_format", "group"))
    return lookup(pairs, answers)


def answered(doc_answers: DataFrame) -> DataFrame:
    """(filename, total_questions, found_questions): questions with an answer or provenance, empty ones included."""
    return doc_answers.groupBy("filename").agg(F.count("*").alias("total_questions"), F.count_if(F.coalesce("answer", "provenance").isNotNull()).alias("found_questions"))


def reconcile(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """(key, status): matched in both, unmatched only in have, missing only in want; each key once, nulls left out."""
    a = have.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    b = want.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unmatched").otherwise("matched")
    return a.join(b, key, "full").select(key, status.alias("status"))


def reconcile_summary(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """One row: rows on either side before duplicates go, and the three counts."""
    s = reconcile(have, want, key).agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("matched", "unmatched", "missing")))
    n = have.agg(F.count("*").alias("total_have")).crossJoin(want.agg(F.count("*").alias("total_want")))
    return n.crossJoin(s)


def group_by_folder(files: DataFrame, path_col: str = "full_path") -> DataFrame:
    """(root_folder_path, pdf_paths): sorted paths of each folder, by folder."""
    return files.groupBy(text.dirname(F.col(path_col)).alias("root_folder_path")).agg(F.array_sort(F.collect_set(path_col)).alias("pdf_paths")).orderBy("root_folder_path")


def with_tree_paths(files: DataFrame, trees: DataFrame, path_col: str = "full_path") -> DataFrame:
    """files with tree_path: the first of two places that trees (path) holds, the first if neither."""
    there = trees.select(F.col("path").alias("_t")).distinct()
    a, b = text.tree_path(F.col(path_col)), text.nested_tree_path(F.col(path_col))
    df = files.withColumn("_a", a).withColumn("_b", b)
    df = df.join(there.withColumnRenamed("_t", "_x"), F.col("_a") == F.col("_x"), "left").join(there.withColumnRenamed("_t", "_y"), F.col("_b") == F.col("_y"), "left")
    return df.withColumn("tree_path", F.when(F.col("_x").isNotNull(), F.col("_a")).otherwise(F.coalesce("_y", "_a"))).drop("_a", "_b", "_x", "_y")
