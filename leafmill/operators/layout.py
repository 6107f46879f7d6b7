"""Phrases: merging of runs, and matching to headers by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import layout
from leafmill.operators.nodes import HEADER


def flat_boxes(phrases: DataFrame) -> DataFrame:
    """Phrase rows with bbox as four columns."""
    return phrases.select("*", *(F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1")))).drop("bbox")


def islands(rows: DataFrame, starts: Column, by: str, order: list[str], name: str = "island") -> DataFrame:
    """rows numbered by run: a run begins where `starts` holds, and at the first row."""
    w = Window.partitionBy(by).orderBy(*order)
    flagged = rows.withColumn("_start", F.coalesce(starts.cast("int"), F.lit(1)))
    return flagged.withColumn(name, F.sum("_start").over(w) - 1).drop("_start")


def merge_runs(phrases: DataFrame, page_width: float = 612.0, right_margin: float = 50.0) -> DataFrame:
    """Phrases merged with the one before where page, font, size, bold and underline agree.

    Bold ones on different rows (centres over half a size apart) only merge where the one
    before ends within right_margin of the page's edge, underlined bold ones never.
    """
    order = Window.partitionBy("doc_id").orderBy("id")
    p = lambda c: F.lag(c).over(order)
    same = F.lit(True)
    for c in ("page", "font", "size", "bold", "is_underline"):
        same = same & F.col(c).eqNullSafe(p(c))
    apart = F.abs((F.col("y0") + F.col("y1")) / 2 - (p("y0") + p("y1")) / 2) > F.col("size") * 0.5
    bold = (F.col("bold") == 1) & (p("bold") == 1)
    split = ((F.col("bold") == 1) & (F.col("is_underline") == 1) & apart) | (bold & apart & (page_width - p("x1") > right_margin))
    start = F.when(p("id").isNull(), True).otherwise(~same | F.coalesce(split, F.lit(False)))
    runs = islands(phrases.withColumn("_s", start), F.col("_s"), "doc_id", ["id"]).drop("_s")
    return merge_groups(runs)


def merge_groups(runs: DataFrame) -> DataFrame:
    """One phrase an island: joined text, covering box, the first one's looks; flags of the text anew unless it is alone."""
    first = lambda c: F.min_by(c, "id").alias(c)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "phrase"))), lambda x: x["phrase"]), " ")
    g = runs.groupBy("doc_id", "island").agg(
        text.alias("phrase"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"),
        *(first(c) for c in ("page", "font", "size", "bold", "is_underline", "is_center", "all_cap", "num_st")),
    )
    alone = F.col("n") == 1
    return g.select(
        "doc_id", F.col("island").cast("int").alias("id"), "phrase", "x0", "y0", "x1", "y1", "page", "font", "size", "bold", "is_underline",
        F.when(alone, F.col("all_cap")).otherwise(layout.is_all_caps(F.col("phrase"))).alias("all_cap"), F.when(alone, F.col("num_st")).otherwise(layout.starts_with_number(F.col("phrase"))).alias("num_st"), "is_center",
    )


def best_matches(left: DataFrame, right: DataFrame, key: list[str], on: list[str], threshold: float = 0.5, condition: Column | None = None, order: str = "id") -> DataFrame:
    """For each left box (key, on, ax0 .. ay1) the right box (on, order, bx0 .. by1) of the greatest overlap at or above threshold; the first of equal ones."""
    met = left.join(right, on)
    met = met.where(condition) if condition is not None else met
    a, b = (tuple(F.col(s + c) for c in ("x0", "y0", "x1", "y1")) for s in "ab")
    met = met.withColumn("iou", layout.iou(a, b)).where((F.col("iou") >= threshold) & (F.col("iou") > 0))
    w = Window.partitionBy(*key).orderBy(F.desc("iou"), order)
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def enrich_headers(nodes: DataFrame, phrases: DataFrame, pages: DataFrame | None = None, page_height: float | None = 792.0, threshold: float = 0.5) -> DataFrame:
    """nodes with visual_pattern on the headers that a phrase matches in text and place.

    Boxes from the bottom are turned by page_height; None takes each page's own height from
    pages (doc_id, page_no, height).
    """
    heads = nodes.where((F.col("label") == HEADER) & F.col("page_no").isNotNull() & F.col("t").isNotNull())
    if page_height is None:
        heads = heads.join(pages.select("doc_id", "page_no", "height"), ["doc_id", "page_no"], "left")
    else:
        heads = heads.withColumn("height", F.lit(page_height))
    left = heads.select("doc_id", "array_idx", "array_pos", F.coalesce("text", F.lit("")).alias("header"), (F.col("page_no") - 1).alias("page"), F.col("l").alias("ax0"), (F.col("height") - F.col("t")).alias("ay0"), F.col("r").alias("ax1"), (F.col("height") - F.col("b")).alias("ay1"))
    looks = ["font", "size", "bold", "all_cap", "num_st", "is_center", "is_underline"]
    right = phrases.select("doc_id", "page", "id", F.coalesce("phrase", F.lit("")).alias("phrase"), *looks, *(F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")))
    best = best_matches(left, right, ["doc_id", "array_idx", "array_pos"], ["doc_id", "page"], threshold, layout.texts_match(F.col("header"), F.col("phrase")))
    return nodes.join(best.select("doc_id", "array_idx", "array_pos", F.struct(*looks).alias("visual_pattern")), ["doc_id", "array_idx", "array_pos"], "left")


def page_sizes(trees: DataFrame) -> DataFrame:
    """(doc_id, page_no, width, height) of document rows."""
    return trees.select("doc_id", F.explode("pages").alias("key", "p")).select("doc_id", F.coalesce("p.page_no", F.col("key").try_cast("int")).alias("page_no"), "p.size.width", "p.size.height")
