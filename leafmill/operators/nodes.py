"""Nodes of document trees: reading order, sections, headers, lookups, section text.

Every operator takes and gives tables with one row a node; nothing walks a tree.  One
exchange by document serves all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.functions import text

HEADER = "section_header"


def explode_nodes(trees: DataFrame) -> DataFrame:
    """The long node table of document rows: all six arrays in one pass, first box, sort key (0, 0, 0) without a box."""
    arrays = F.array(*(F.struct(F.lit(i).alias("array_idx"), F.lit(a).alias("array_type"), F.col(a).alias("items")) for i, a in enumerate(schemas.ARRAYS)))
    rows = trees.select("doc_id", F.explode(arrays).alias("a")).select("doc_id", "a.array_idx", "a.array_type", F.posexplode("a.items").alias("array_pos", "node"))
    prov = F.try_element_at("node.prov", F.lit(1))
    box = prov["bbox"]
    return rows.select(
        "doc_id", "array_idx", "array_type", "array_pos", "node.self_ref", text.last_number(F.col("node.self_ref")).alias("id_num"), "node.label", "node.text", "node.marker", "node.enumerated", "node.level", "node.key", "node.value",
        prov["page_no"].alias("page_no"), box["l"].alias("l"), box["t"].alias("t"), box["r"].alias("r"), box["b"].alias("b"),
        F.coalesce(prov["page_no"], F.lit(0)).alias("sort_page"), (-F.coalesce(box["t"], F.lit(0.0))).alias("sort_y"), F.coalesce(box["l"], F.lit(0.0)).alias("sort_x"),
        F.col("node.parent")["$ref"].alias("parent_ref"), F.transform("node.children", lambda c: c["$ref"]).alias("orig_children"), F.col("node.data").alias("data"), "node",
    )


def _reading(by: Column | str = "doc_id") -> Window:
    return Window.partitionBy(by).orderBy("sort_page", "sort_y", "sort_x", "array_idx", "array_pos")


def reading_order(nodes: DataFrame) -> DataFrame:
    """nodes with ord, from 1: by page, from top to bottom, from left to right; arrays and positions break ties."""
    return nodes.withColumn("ord", F.row_number().over(_reading()))


def attach_sections(nodes: DataFrame) -> DataFrame:
    """nodes in reading order with section_ref: the latest header before each node that is none, null before the first.

    The hierarchy is flat: headers attach to nothing, whatever their level.  section_ord is
    the header's place, for a header its own.
    """
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.col("label") == HEADER
    last = F.last(F.when(header, F.struct("self_ref", "ord")), ignorenulls=True).over(order)
    df = (nodes if "ord" in nodes.columns else reading_order(nodes)).withColumn("_last", last)
    return df.withColumn("section_ref", F.when(~F.coalesce(header, F.lit(False)), F.col("_last.self_ref"))).withColumn("section_ord", F.col("_last.ord")).drop("_last")


def section_edges(attached: DataFrame) -> DataFrame:
    """(doc_id, section_ref, children): each header's nodes in reading order."""
    kids = F.transform(F.sort_array(F.collect_list(F.struct("ord", "self_ref"))), lambda x: x["self_ref"])
    return attached.where("section_ref IS NOT NULL").groupBy("doc_id", "section_ref").agg(kids.alias("children"))


def with_children(attached: DataFrame) -> DataFrame:
    """attached with each node's children: its section's for a header, what the file says for others."""
    edges = section_edges(attached).withColumnRenamed("section_ref", "self_ref")
    empty = F.array().cast("array<string>")
    kids = F.when(F.col("label") == HEADER, F.coalesce("children", empty)).otherwise(F.coalesce("orig_children", empty))
    return attached.join(edges, ["doc_id", "self_ref"], "left").withColumn("children", kids)


def find_node(nodes: DataFrame, ref: str) -> DataFrame:
    """Each document's first node of a reference, in order of arrays and positions."""
    order = Window.partitionBy("doc_id").orderBy("array_idx", "array_pos")
    return nodes.where(F.col("self_ref") == ref).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def own_text(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", "self_ref", F.coalesce("text", F.lit("")).alias("text"))


def node_text(array_type: Column, own: Column, table: Column, key: Column, value: Column) -> Column:
    """What stands for a node by its kind: text, rendered table or a placeholder."""
    return (
        F.when(array_type == "texts", F.coalesce(own, F.lit("")))
        .when(array_type == "tables", F.coalesce(table, F.lit("[NO TABLE CONTENT FOUND]")))
        .when(array_type == "pictures", "[IMAGE]")
        .when(array_type == "groups", F.coalesce(own, F.lit("[GROUP]")))
        .when(array_type.isin("key_value_items", "form_items"), F.coalesce(own, F.concat(key, F.lit(": "), value), F.lit("[FORM_ITEM]")))
        .otherwise(F.coalesce(own, F.lit("")))
    )


def node_texts(nodes: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """nodes with content; tables has (doc_id, self_ref, table_text)."""
    df = nodes.join(tables, ["doc_id", "self_ref"], "left") if tables is not None else nodes.withColumn("table_text", F.lit(None).cast("string"))
    return df.withColumn("content", node_text(F.col("array_type"), F.col("text"), F.col("table_text"), F.col("key"), F.col("value"))).drop("table_text")


def child_type(ref: Column) -> Column:
    """A node's kind by its reference."""
    name = F.regexp_extract(ref, "^#/([a-z_]+)/", 1)
    known = F.create_map(*(F.lit(x) for pair in (("texts", "text"), ("tables", "table"), ("pictures", "picture"), ("groups", "group"), ("key_value_items", "key_value_item"), ("form_items", "form_item")) for x in pair))
    return F.coalesce(F.try_element_at(known, name), F.lit("unknown"))


def children_info(attached: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, self_ref, pos, child_ref, child_type, preview): every child of every node; unresolved ones have an empty preview."""
    edges = with_children(attached).select("doc_id", "self_ref", F.posexplode("children").alias("pos", "child_ref"))
    target = node_texts(attached, tables).select("doc_id", F.col("self_ref").alias("child_ref"), "content")
    return edges.join(target, ["doc_id", "child_ref"], "left").select("doc_id", "self_ref", "pos", "child_ref", child_type(F.col("child_ref")).alias("child_type"), F.coalesce(text.preview(F.col("content")), F.lit("")).alias("preview"))


def section_texts(attached: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, self_ref, id_num, ord, page_no, text, complete_text, n_children) for each header.

    The complete text is the header's own and, after a blank, that of its children in
    reading order, one level deep, without empty ones.
    """
    header = F.coalesce(F.col("label") == HEADER, F.lit(False))
    kids = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~header & (F.col("content") != ""), F.struct("ord", "content")))), lambda x: x["content"]), " ")
    head = F.max(F.when(header, F.struct("ord", "self_ref", "id_num", "array_idx", "page_no", F.coalesce("text", F.lit("")).alias("text"))))
    # the window's partitioning by document serves this aggregation too
    sections = node_texts(attached, tables).where("section_ord IS NOT NULL").groupBy("doc_id", "section_ord").agg(head.alias("h"), kids.alias("kids"), F.count_if(~header).alias("n_children"))
    own, some = F.col("h.text"), ~text.is_blank(F.col("kids"))
    complete = F.when(some & ~text.is_blank(own), F.concat(own, F.lit(" "), F.col("kids"))).when(some, F.col("kids")).otherwise(own)
    return sections.select("doc_id", "h.self_ref", "h.id_num", "h.array_idx", "h.ord", "h.page_no", own.alias("text"), complete.alias("complete_text"), "n_children")


def section_report(attached: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """The headers in id order with texts, page (or ?) and number of children."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("id_num", "array_idx", "ord")) - 1
    return section_texts(attached, tables).select("doc_id", rank.alias("rank"), "self_ref", "text", "complete_text", F.coalesce(F.col("page_no").cast("string"), F.lit("?")).alias("page"), "n_children")


def headers_by_id(nodes: DataFrame) -> DataFrame:
    """(doc_id, rank, self_ref, text, total): headers by the last number of their reference; rank from 0."""
    w = Window.partitionBy("doc_id")
    heads = nodes.where(F.col("label") == HEADER)
    return heads.select("doc_id", (F.row_number().over(w.orderBy("id_num", "array_idx", "ord")) - 1).alias("rank"), "self_ref", "text", F.count("*").over(w).alias("total"))


def headers_by_page(nodes: DataFrame) -> DataFrame:
    """As headers_by_id, in reading order."""
    w = Window.partitionBy("doc_id")
    heads = nodes.where(F.col("label") == HEADER)
    return heads.select("doc_id", (F.row_number().over(w.orderBy("ord")) - 1).alias("rank"), "self_ref", "text", F.count("*").over(w).alias("total"))


def node_ranks(nodes: DataFrame) -> DataFrame:
    """(doc_id, self_ref, rank, total): each node's place among the headers by id, -1 for others."""
    w = Window.partitionBy("doc_id")
    header = F.coalesce(F.col("label") == HEADER, F.lit(False))
    place = F.sum(header.cast("int")).over(w.orderBy("id_num", "array_idx", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return nodes.select("doc_id", "self_ref", F.when(header, place).otherwise(-1).alias("rank"), F.sum(header.cast("int")).over(w).alias("total"))


def page_info(nodes: DataFrame) -> DataFrame:
    """(doc_id, self_ref, page_no, total_pages): own page or -1, the document's greatest or 0."""
    return nodes.select("doc_id", "self_ref", F.coalesce("page_no", F.lit(-1)).alias("page_no"), F.coalesce(F.max("page_no").over(Window.partitionBy("doc_id")), F.lit(0)).alias("total_pages"))


def positions(nodes: DataFrame) -> DataFrame:
    """page_info and node_ranks in one pass: (doc_id, self_ref, page_no, total_pages, rank, total)."""
    w = Window.partitionBy("doc_id")
    header = F.coalesce(F.col("label") == HEADER, F.lit(False))
    place = F.sum(header.cast("int")).over(w.orderBy("id_num", "array_idx", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return nodes.select(
        "doc_id", "self_ref", F.coalesce("page_no", F.lit(-1)).alias("page_no"), F.coalesce(F.max("page_no").over(w), F.lit(0)).alias("total_pages"),
        F.when(header, place).otherwise(-1).alias("rank"), F.sum(header.cast("int")).over(w).alias("total"),
    )


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes that are no header and whose file gives them no parent."""
    return nodes.where((F.coalesce("label", F.lit("")) != HEADER) & F.col("parent_ref").isNull())


def unattached(attached: DataFrame) -> DataFrame:
    """Nodes that are no header and belong to no section."""
    return attached.where((F.coalesce("label", F.lit("")) != HEADER) & F.col("section_ref").isNull())


def node_ids(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, self_ref) in reading order; unknown_<n> where a node has none."""
    return nodes.select("doc_id", "ord", F.coalesce("self_ref", F.concat(F.lit("unknown_"), F.col("ord") - 1)).alias("self_ref"))


def tree_report(attached: DataFrame) -> DataFrame:
    """Headers in order of arrays with their children, one row a child (or one with nulls), texts cut to 60."""
    heads = with_children(attached).where(F.col("label") == HEADER)
    rows = heads.select("doc_id", "array_idx", F.col("ord").alias("header_ord"), "self_ref", text.truncated(F.col("text"), 60).alias("header"), F.coalesce(F.col("page_no").cast("string"), F.lit("?")).alias("page"), F.size("children").alias("n_children"), F.posexplode_outer("children").alias("pos", "child_ref"))
    kids = attached.select("doc_id", F.col("self_ref").alias("child_ref"), F.col("label").alias("child_label"), text.truncated(F.coalesce("text", F.lit("")), 60).alias("child_text"))
    return rows.join(kids, ["doc_id", "child_ref"], "left").select("doc_id", "array_idx", "header_ord", "self_ref", "header", "page", "n_children", "pos", "child_ref", "child_label", "child_text")


def top_nodes(nodes: DataFrame, n: int = 1) -> DataFrame:
    """The first n nodes of each document in reading order."""
    return nodes.where(F.col("ord") <= n)
