"""Provenance: which sections, and which sentences in them, support a known answer."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.batches import slices, small
from leafmill.functions import text
from leafmill.operators import models, nodes
from leafmill.store import written


def search(pairs: DataFrame, sections: DataFrame, model: str = "containment") -> DataFrame:
    """The sections whose answer is equivalent to the known one.

    pairs has (doc_id, question, answer), sections (doc_id, self_ref, complete_text, ...).
    Null answers and blank sections are left out before any call, blank replies before the
    judgement.
    """
    asked = models.ask(pairs.where("answer IS NOT NULL").join(sections, "doc_id"), "question", "complete_text", "llm_answer", model)
    # the section's text comes back for the hits alone
    replied = asked.where(~text.is_blank(F.col("llm_answer"))).drop("complete_text")
    hits = models.judged(replied, "answer", "llm_answer", model=model).where("is_equivalent").drop("is_equivalent")
    return hits.join(sections.select("doc_id", "self_ref", "complete_text"), ["doc_id", "self_ref"])


def provenance(attached: DataFrame, pairs: DataFrame, raw_texts: DataFrame, tables: DataFrame | None = None, model: str = "containment") -> DataFrame:
    """One row for each (doc_id, question): the model's answer from the raw text, and provenance_nodes in id order.

    raw_texts has (doc_id, raw_text); pairs without an answer get an empty list.  What calls
    a model is written at once, so that Python gets batches of few bytes.
    """
    with small(pairs.sparkSession):
        pairs, sections = written(pairs), written(nodes.section_texts(attached, tables))
        found = written(models.supported(search(pairs, sections.drop("page_no"), model), "question", "llm_answer", "complete_text", model=model))
        # a pair without an answer has no text to ask, so no call
        given = pairs.join(raw_texts, "doc_id", "left").withColumn("raw_text", F.when(F.col("answer").isNotNull(), F.col("raw_text")))
        everything = written(models.ask(given, "question", "raw_text", "llm_global_answer", model).drop("raw_text"))
    info = nodes.positions(attached)
    hits = found.join(info, ["doc_id", "self_ref"])
    node = F.struct(
        F.col("rank").alias("_rank"), F.col("self_ref").alias("node_id"), F.col("complete_text").alias("node_text"), "llm_answer", "node_summary", F.col("text").alias("header_text"),
        F.col("page_no").cast("int").alias("page_no"), F.col("total_pages").cast("int").alias("total_pages"), F.col("rank").cast("int").alias("tree_node"), F.col("total").cast("int").alias("tree_header_num"),
    )
    per = hits.groupBy("doc_id", "question").agg(F.transform(F.sort_array(F.collect_list(node)), lambda x: x.dropFields("_rank")).alias("provenance_nodes"))
    empty = F.array().cast(per.schema["provenance_nodes"].dataType)
    return everything.join(per, ["doc_id", "question"], "left").withColumn("provenance_nodes", F.coalesce("provenance_nodes", empty))


def node_counts(results: DataFrame) -> DataFrame:
    """results with the number of their provenance nodes."""
    return results.withColumn("n_nodes", F.size("provenance_nodes"))


def flat(results: DataFrame) -> DataFrame:
    """A row for each provenance node."""
    keep = [c for c in results.columns if c != "provenance_nodes"]
    return results.select(*keep, F.explode("provenance_nodes").alias("n")).select(*keep, "n.*")


def document_questions(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """Every question for every document; questions are the small side by their nature, and Spark weighs it."""
    return documents.crossJoin(questions)


#: Characters of passages up to which every task holds all of them in one automaton (some 50 bytes a character).
HELD = 2 << 20


@functools.lru_cache(1)
def _automaton(passages: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, p in enumerate(passages):
        a.add_word(p, i)
    a.make_automaton()
    return a


def _holding(passages: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _automaton(passages)
        for batch in slices(batches):
            row, place = [], []
            for k, s in enumerate(batch.column("text").to_pylist()):
                found = sorted({i for _, i in own.iter(s)}) if s else ()
                row += [k] * len(found)
                place += found
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(place, pa.int64())], ["doc_id", "_place"])

    return run


def containing(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, passage) where a document (doc_id, text) holds a passage (item_id, passage) to the letter.

    Up to HELD characters of passages go to every task, which looks for all of them in one
    walk over each text; nothing is shuffled.  More are found by `_containing_many`.
    """
    passages = passages.select("item_id", "passage").where("passage IS NOT NULL")
    size = passages.agg(F.coalesce(F.sum(F.length("passage") + 8), F.lit(0))).first()[0]
    if size > HELD:
        return _containing_many(documents, passages)
    held = [(r.item_id, r.passage) for r in passages.collect()]
    texts = tuple(sorted({p for _, p in held if p}))
    kind = documents.schema["doc_id"].dataType.simpleString()
    found = documents.select("doc_id", "text").mapInArrow(_holding(texts), f"doc_id {kind}, _place bigint")
    at = {p: i for i, p in enumerate(texts)}
    spark, item = documents.sparkSession, passages.schema["item_id"].dataType.simpleString()
    names = spark.createDataFrame([(at.get(p, -1), i, p) for i, p in held], f"_place bigint, item_id {item}, passage string")
    empty = documents.where("text IS NOT NULL").select("doc_id", F.lit(-1).cast("bigint").alias("_place")) if any(not p for _, p in held) else None
    found = found.unionByName(empty) if empty is not None else found
    return found.join(F.broadcast(names), "_place").select("doc_id", "item_id", "passage")  # HELD bounds it


def _containing_many(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """`containing` by a join.

    A document that holds a passage has each of its inner words between blanks, so the
    pairs come from a hash join on the passage's longest inner word, and only those are
    compared; passages of fewer than three words are compared with every document.
    """
    words = F.split("passage", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    keyed = passages.select("item_id", "passage", longest["w"].alias("word"))
    held = documents.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    near = held.join(keyed.where("word IS NOT NULL"), "word").select("doc_id", "item_id", "passage")
    found = documents.select("doc_id", "text").join(near, "doc_id").where(F.contains("text", "passage"))
    short = documents.select("doc_id", "text").join(keyed.where("word IS NULL"), F.contains("text", "passage"))
    return found.select("doc_id", "item_id", "passage").unionByName(short.select("doc_id", "item_id", "passage"))


def first_hits(flat_results: DataFrame) -> DataFrame:
    """The first provenance node of each document."""
    w = Window.partitionBy("doc_id").orderBy("tree_node", "node_id")
    return flat_results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
