"""Sinks: JSON lines, texts, results by folder and category, and whole trees with sections attached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.functions import text


def write_json(df: DataFrame, path: str) -> bool:
    """df as JSON lines; nothing is written, and False returned, for an empty table."""
    if not df.take(1):
        return False
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return True


def write_texts(texts: DataFrame, path: str) -> None:
    """(path, text) as text files, a folder for each source file's stem; null texts are left out."""
    texts.where("text IS NOT NULL").select(text.stem(F.col("path")).alias("stem"), F.col("text").alias("value")).write.mode("overwrite").partitionBy("stem").text(path)


def write_document_answers(answers: DataFrame, path: str) -> None:
    """Answers (with a filename column) in a folder `<stem>_answers` for each document."""
    answers.withColumn("document", F.concat(text.stem(F.col("filename")), F.lit("_answers"))).write.mode("overwrite").partitionBy("document").json(path)


def write_results(results: DataFrame, path: str, folder_col: str = "folder", category_col: str = "question_category") -> None:
    """Results by full folder and sanitised category, so equal folder names don't collide."""
    keyed = results.withColumn("folder", F.col(folder_col)).withColumn("category", text.sanitised(F.col(category_col)))
    keyed.write.mode("append").partitionBy("folder", "category").json(path)


def trees_of(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """The trees with sections attached: everything of `trees`, its arrays in reading order with the parents and children of `with_children`.

    Nodes keep all their fields (cells and grids, character spans, markers, levels); a node
    outside any section keeps its own parent.  A tree without nodes keeps its empty arrays.
    """
    kind = nodes.schema["node"].dataType
    one = lambda ref: F.when(ref.isNotNull(), F.struct(ref.alias("$ref"))).cast(kind["parent"].dataType)
    kids = F.transform("children", lambda x: F.struct(x.alias("$ref"))).cast(kind["children"].dataType)
    node = F.col("node").withField("parent", one(F.coalesce("section_ref", "parent_ref"))).withField("children", kids)
    whole = [F.transform(F.array_sort(F.collect_list(F.when(F.col("array_type") == a, F.struct("ord", node.alias("node")))), lambda x, y: x["ord"] - y["ord"]), lambda x: x["node"]).alias(f"_{a}") for a in schemas.ARRAYS]
    made = nodes.groupBy("doc_id").agg(*whole)
    arrays = {a: F.coalesce(F.when(F.size(f"_{a}") > 0, F.col(f"_{a}")), F.col(a)).alias(a) for a in schemas.ARRAYS}
    return trees.join(made, "doc_id", "left").select(*(arrays.get(c, F.col(c)) for c in trees.columns))


def write_trees(nodes: DataFrame, trees: DataFrame, path: str) -> None:
    """`trees_of` as JSON lines, a tree a line; `read_trees` with lines=True reads them back."""
    trees_of(nodes, trees).write.mode("overwrite").json(path)


def write_phrases(phrases: DataFrame, path: str) -> None:
    phrases.write.mode("overwrite").partitionBy("doc_id").json(path)


def conversion_counts(status: DataFrame, status_col: str = "status") -> DataFrame:
    """(success, partial, failure): documents by the outcome of their conversion."""
    n = lambda *kinds: F.count_if(F.lower(F.col(status_col)).isin(*kinds))
    return status.agg(n("success").alias("success"), n("partial_success", "partial").alias("partial"), n("failure").alias("failure"))


def without_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work whose keys no finished result has."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
