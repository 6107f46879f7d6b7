"""The named queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import layout as look
from leafmill.functions import text
from leafmill.operators import answers, layout, models, nodes, provenance, tables
from leafmill.plans import adapters as ad
from leafmill.sources import files, sinks
from leafmill.store import place

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its name with its equivalent."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _long(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines' widths agree."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


TURNS = """turns AS (
    SELECT conv_id AS doc_id, turn, '#/texts/' || turn AS self_ref, CASE WHEN role = 'user' THEN 'section_header' ELSE 'text' END AS label,
           text, turn // 4 + 1 AS page_no, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord FROM conversations
), attached AS (
    SELECT *, CASE WHEN label = 'text' THEN last_value(CASE WHEN label <> 'text' THEN self_ref END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY turn) END AS section_ref FROM turns
), kids AS (
    SELECT doc_id, section_ref, count(*) AS n, string_agg(text, ' ' ORDER BY turn) FILTER (text <> '') AS kids FROM attached WHERE section_ref IS NOT NULL GROUP BY ALL
)"""
LINES = """split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), lines AS (
    SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS text FROM split
), nodes AS (
    SELECT doc_id, pos, pos * 7 % 101 AS id_num, '#/texts/' || (pos * 7 % 101) AS self_ref, pos % 5 = 0 AS header, text, pos // 10 + 1 AS page_no,
           row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord FROM lines
)"""
ORDER_LINES = """rows AS (
    SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_discount) AS d, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY ALL
)"""
CELLS = ORDER_LINES + """, headed AS (
    SELECT *, l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) AS head FROM rows
), cells AS (
    SELECT l_orderkey AS doc_id, l_linenumber, c, head, [CAST(CAST(q AS INT) AS VARCHAR), flag, status][c + 1] AS text,
           CASE WHEN head THEN 'column_header' WHEN c = 0 THEN 'row_header' ELSE 'table_cell' END AS label FROM headed, range(3) AS r(c)
), kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, c) - 1 AS cell FROM cells WHERE trim(text) <> '')"""


# Nodes and sections


@query(r"""WITH tags AS (SELECT page_id, regexp_extract_all(html, '<(?:h1|p|li)>(.*?)</(?:h1|p|li)>', 1) AS t FROM pages), rows AS (
    SELECT page_id AS doc_id, unnest(range(len(t))) AS array_pos, unnest(t) AS text FROM tags)
SELECT doc_id, array_pos, text, row_number() OVER (PARTITION BY doc_id ORDER BY array_pos // 10, array_pos * 3 % 5, length(text) % 7, array_pos) AS ord FROM rows""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(nodes.reading_order(ad.tag_nodes(spark, sf_dir)).select("doc_id", "array_pos", "text", "ord"))


@query(f"WITH {TURNS} SELECT doc_id, ord, self_ref, label, section_ref FROM attached")
def section_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(ad.conversation_nodes(spark, sf_dir).select("doc_id", "ord", "self_ref", "label", "section_ref"))


@query(f"WITH {TURNS} SELECT doc_id, section_ref, string_agg(self_ref, ',' ORDER BY turn) AS children FROM attached WHERE section_ref IS NOT NULL GROUP BY ALL")
def section_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.section_edges(ad.conversation_nodes(spark, sf_dir)).withColumn("children", F.array_join("children", ","))


COMPLETE = "CASE WHEN trim(coalesce(kids, '')) = '' THEN coalesce(text, '') WHEN trim(coalesce(text, '')) = '' THEN kids ELSE text || ' ' || kids END"


@query(f"WITH {TURNS} SELECT a.doc_id, self_ref, {COMPLETE} AS complete_text FROM attached a LEFT JOIN kids k ON a.doc_id = k.doc_id AND a.self_ref = k.section_ref WHERE label <> 'text'")
def section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.section_texts(ad.conversation_nodes(spark, sf_dir)).select("doc_id", "self_ref", "complete_text")


@query(f"""WITH {TURNS} SELECT a.doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY turn) - 1 AS rank, self_ref, coalesce(text, '') AS text, {COMPLETE} AS complete_text,
CAST(page_no AS VARCHAR) AS page, coalesce(n, 0) AS n_children FROM attached a LEFT JOIN kids k ON a.doc_id = k.doc_id AND a.self_ref = k.section_ref WHERE label <> 'text'""")
def section_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(nodes.section_report(ad.conversation_nodes(spark, sf_dir)))


@query(f"WITH {TURNS} SELECT doc_id, self_ref, ord FROM attached WHERE label = 'text' AND section_ref IS NULL")
def true_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(nodes.unattached(ad.conversation_nodes(spark, sf_dir)).select("doc_id", "self_ref", "ord"))


@query("SELECT conv_id AS doc_id, '#/texts/' || turn AS self_ref FROM conversations WHERE turn % 3 = 1 AND role IS DISTINCT FROM 'user'")
def parentless_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ad.conversation_nodes(spark, sf_dir).withColumn("parent_ref", F.when(F.col("array_pos") % 3 != 1, F.col("parent_ref")))
    return nodes.orphans(n).select("doc_id", "self_ref")


HEADERS = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {}) - 1 AS rank, self_ref, text, count(*) OVER (PARTITION BY doc_id) AS total FROM nodes WHERE header"


@query(f"WITH {LINES} {HEADERS.format('id_num, ord')}")
def headers_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(nodes.headers_by_id(ad.line_nodes(spark, sf_dir)))


@query(f"WITH {LINES} {HEADERS.format('ord')}")
def headers_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(nodes.headers_by_page(ad.line_nodes(spark, sf_dir)))


@query(f"""WITH {LINES} SELECT doc_id, ord, CASE WHEN header THEN sum(header::INT) OVER (PARTITION BY doc_id ORDER BY id_num, ord)::BIGINT - 1 ELSE -1 END AS rank,
(sum(header::INT) OVER (PARTITION BY doc_id))::BIGINT AS total FROM nodes""")
def header_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ad.line_nodes(spark, sf_dir)
    ranked = nodes.node_ranks(n.withColumn("self_ref", F.col("ord")))
    return _long(ranked.select("doc_id", F.col("self_ref").alias("ord"), "rank", "total"))


@query(f"WITH {LINES} SELECT doc_id, ord, page_no, max(page_no) OVER (PARTITION BY doc_id) AS total_pages FROM nodes")
def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ad.line_nodes(spark, sf_dir).withColumn("self_ref", F.col("ord"))
    return _long(nodes.page_info(n).withColumnRenamed("self_ref", "ord"))


@query(f"WITH {TURNS} SELECT doc_id, self_ref, label, coalesce(text, '') AS text FROM attached WHERE self_ref = '#/texts/1'")
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.find_node(ad.conversation_nodes(spark, sf_dir), "#/texts/1").select("doc_id", "self_ref", "label", F.coalesce("text", F.lit("")).alias("text"))


KINDS = "['texts', 'tables', 'pictures', 'groups', 'key_value_items', 'form_items']"


@query(rf"""WITH tags AS (SELECT page_id, regexp_extract_all(html, '<(?:h1|p|li)>(.*?)</(?:h1|p|li)>', 1) AS t FROM pages), rows AS (
    SELECT page_id AS doc_id, unnest(range(len(t))) AS array_pos, unnest(t) AS tag FROM tags), kinds AS (
    SELECT *, {KINDS}[array_pos % 6 + 1] AS kind, CASE WHEN array_pos % 4 <> 3 THEN tag END AS own FROM rows)
SELECT doc_id, array_pos, kind AS array_type, CASE kind WHEN 'texts' THEN coalesce(own, '') WHEN 'tables' THEN '[NO TABLE CONTENT FOUND]' WHEN 'pictures' THEN '[IMAGE]'
WHEN 'groups' THEN coalesce(own, '[GROUP]') ELSE coalesce(own, '[FORM_ITEM]') END AS content FROM kinds""")
def node_text_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("texts", "tables", "pictures", "groups", "key_value_items", "form_items")))
    n = ad.tag_nodes(spark, sf_dir).withColumn("array_type", F.get(kinds, (F.col("array_pos") % 6).cast("int"))).withColumn("text", F.when(F.col("array_pos") % 4 != 3, F.col("text")))
    return nodes.node_texts(n).select("doc_id", "array_pos", "array_type", "content")


@query(f"""WITH {TURNS} SELECT a.doc_id, a.section_ref AS self_ref, row_number() OVER (PARTITION BY a.doc_id, a.section_ref ORDER BY turn) - 1 AS pos, a.self_ref AS child_ref, 'text' AS child_type,
CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE coalesce(text, '') END AS preview FROM attached a WHERE section_ref IS NOT NULL""")
def children_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(nodes.children_info(ad.conversation_nodes(spark, sf_dir)))


@query(f"""WITH {TURNS}, heads AS (SELECT a.*, coalesce(n, 0) AS n_children FROM attached a LEFT JOIN kids k ON a.doc_id = k.doc_id AND a.self_ref = k.section_ref WHERE label <> 'text')
SELECT h.doc_id, h.self_ref, CASE WHEN length(h.text) > 60 THEN substring(h.text, 1, 60) || '...' ELSE h.text END AS header, CAST(h.page_no AS VARCHAR) AS page, n_children,
c.self_ref AS child_ref, c.label AS child_label, CASE WHEN length(c.text) > 60 THEN substring(c.text, 1, 60) || '...' ELSE c.text END AS child_text
FROM heads h LEFT JOIN attached c ON c.doc_id = h.doc_id AND c.section_ref = h.self_ref""")
def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(nodes.tree_report(ad.conversation_nodes(spark, sf_dir)).select("doc_id", "self_ref", "header", "page", "n_children", "child_ref", "child_label", "child_text"))


@query(f"WITH {TURNS} SELECT doc_id, ord, self_ref FROM attached")
def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(nodes.node_ids(ad.conversation_nodes(spark, sf_dir)))


@query(f"WITH {TURNS} SELECT doc_id, self_ref, coalesce(text, '') AS text FROM attached")
def own_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.own_text(ad.conversation_nodes(spark, sf_dir))


@query(f"WITH {LINES} SELECT doc_id, text FROM nodes WHERE ord = 1")
def top_node_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.top_nodes(ad.line_nodes(spark, sf_dir)).select("doc_id", "text")


# Tables


@query(f"WITH {CELLS} SELECT doc_id, cell, text, label, CAST(l_linenumber AS BIGINT) AS row_idx, c AS col_idx FROM kept")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(ad.order_cells(spark, sf_dir).select("doc_id", "cell", "text", "label", "row_idx", "col_idx"))


@query(f"""WITH {CELLS}, lines AS (SELECT doc_id, l_linenumber, string_agg(text, ' | ' ORDER BY c) AS line FROM kept GROUP BY ALL)
SELECT doc_id, 'The below is a table, table starts:' || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber) || chr(10) || 'This is the end of the table.' AS table_text FROM lines GROUP BY doc_id""")
def table_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.plain_text(ad.order_cells(spark, sf_dir)).select("doc_id", "table_text")


@query(f"WITH {CELLS} SELECT doc_id, string_agg(text, ' ' ORDER BY cell) AS table_text FROM kept GROUP BY doc_id")
def table_positional_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.positional_text(ad.order_cells(spark, sf_dir)).select("doc_id", "table_text")


@query(f"WITH {CELLS} SELECT label, count(*) AS n FROM kept GROUP BY label")
def table_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.label_counts(ad.order_cells(spark, sf_dir))


# Typography and layout


@query(r"""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)
SELECT word, (contains(lower(word), 'b') OR contains(lower(word), 'heavy'))::BIGINT AS bold, (regexp_matches(word, '^\p{L}+$') AND upper(word) = word AND lower(word) <> word)::BIGINT AS all_cap,
regexp_matches(word, '^\p{Nd}')::BIGINT AS num_st, (abs((length(word) + length(word) * 2) / 2.0 - 20.0) <= 4.0)::BIGINT AS is_center, 0::BIGINT AS is_underline,
regexp_matches(regexp_replace(word, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '[^\p{C}\p{Z}\s]')::BIGINT AS valid FROM w""")
def visual_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ad.table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    n = F.length("word")
    return _long(w.select(
        "word", look.is_bold(F.col("word")).alias("bold"), look.is_all_caps(F.col("word")).alias("all_cap"), look.starts_with_number(F.col("word")).alias("num_st"), look.is_centred(n.cast("double"), n * 2.0, F.lit(40.0)).alias("is_center"),
        look.has_underline(F.col("word")).alias("is_underline"), text.is_valid_phrase(F.col("word")).cast("int").alias("valid"),
    ))


@query("""WITH marked AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), runs AS (
    SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS island FROM marked)
SELECT user_id, island, event_type, count(*) AS n, min(event_id) AS first_event FROM runs GROUP BY ALL""")
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    changed = ~F.col("event_type").eqNullSafe(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    runs = layout.islands(e.withColumn("_c", changed), F.col("_c"), "user_id", ["ts", "event_id"])
    return _long(runs.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")))


@query(f"""WITH {ORDER_LINES}, p AS (SELECT l_orderkey AS doc_id, l_linenumber AS id, flag, status, q AS x0, round(d * 100) AS y0, q + 20 AS x1, round(d * 100) + 5 AS y1, (flag = 'R')::INT AS bold FROM rows),
m AS (SELECT *, CASE WHEN lag(id) OVER w IS NULL THEN 1 WHEN lag(flag) OVER w <> flag OR lag(status) OVER w <> status THEN 1
  WHEN bold = 1 AND lag(bold) OVER w = 1 AND abs((y0 + y1) / 2 - (lag(y0) OVER w + lag(y1) OVER w) / 2) > 5.0 AND 612.0 - lag(x1) OVER w > 550.0 THEN 1 ELSE 0 END AS start FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY id)),
g AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY id)::BIGINT - 1 AS g FROM m)
SELECT doc_id, g AS id, string_agg(id::VARCHAR, ' ' ORDER BY id) AS phrase, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY doc_id, g""")
def phrase_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.round(F.col("d") * 100)
    p = ad.order_lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").cast("string").alias("phrase"), F.col("q").alias("x0"), d.alias("y0"), (F.col("q") + 20).alias("x1"), (d + 5).alias("y1"),
        F.col("flag").alias("font"), F.col("status").alias("page"), F.lit(10.0).alias("size"), (F.col("flag") == "R").cast("int").alias("bold"), F.lit(0).alias("is_underline"), F.lit(0).alias("is_center"), F.lit(0).alias("all_cap"), F.lit(0).alias("num_st"),
    )
    return _long(layout.merge_runs(p, right_margin=550.0).select("doc_id", "id", "phrase", "x0", "y0", "x1", "y1"))


BOXES = f"""WITH {ORDER_LINES}, box AS (SELECT l_orderkey, l_linenumber::BIGINT AS line, q AS x0, round(d * 100) AS y0, q + 20 AS x1, round(d * 100) + 5 AS y1 FROM rows), met AS (
    SELECT a.l_orderkey, a.line, b.line AS id, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h FROM box a JOIN box b ON a.l_orderkey = b.l_orderkey AND a.line <> b.line
), scored AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN w * h / (200.0::DOUBLE - w * h) ELSE 0.0 END AS iou FROM met)"""


@query(f"{BOXES} SELECT l_orderkey, line, id, round(iou, 6) AS iou FROM scored")
def bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = ad.order_boxes(spark, sf_dir, "a").join(ad.order_boxes(spark, sf_dir, "b"), "l_orderkey").where("line <> id")
    a, b = (tuple(F.col(s + c) for c in ("x0", "y0", "x1", "y1")) for s in "ab")
    return met.select("l_orderkey", "line", "id", F.round(look.iou(a, b), 6).alias("iou"))


@query(f"{BOXES} SELECT l_orderkey, line, id, round(iou, 6) AS iou FROM scored WHERE iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY l_orderkey, line ORDER BY iou DESC, id) = 1")
def best_spatial_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = layout.best_matches(ad.order_boxes(spark, sf_dir, "a"), ad.order_boxes(spark, sf_dir, "b"), ["l_orderkey", "line"], ["l_orderkey"], condition=F.col("line") != F.col("id"))
    return best.select("l_orderkey", "line", "id", F.round("iou", 6).alias("iou"))


@query(r"""WITH p AS (SELECT DISTINCT p_size, p_name, p_type FROM part), met AS (SELECT DISTINCT a.p_name, b.p_type FROM p a JOIN p b ON a.p_size = b.p_size),
l AS (SELECT *, lower(p_name) AS h, lower(trim(p_type)) AS t, list_filter(string_split_regex(lower(trim(p_type)), '\s+'), lambda w: w <> '') AS words FROM met)
SELECT p_name, p_type, (h = t OR starts_with(h, t) OR starts_with(t, h) OR (len(words) >= 2 AND len(list_filter(words, lambda w: contains(h, w))) > 0) OR t = replace(h, ' ', ''))::BIGINT AS matched FROM l""")
def text_match_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.table(spark, sf_dir, "part")
    met = p.select("p_size", "p_name").distinct().join(p.select("p_size", "p_type").distinct(), "p_size").select("p_name", "p_type").distinct()
    return met.select("p_name", "p_type", look.texts_match(F.col("p_name"), F.col("p_type")).cast("bigint").alias("matched"))


# Answers, files and sets

UNPIVOT = """answers AS (SELECT doc_id AS filename, 'quality' AS category, quality::VARCHAR AS answer, NULL::VARCHAR AS provenance FROM labels
UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR, 'label' FROM labels)"""
ASKED = f"""WITH {UNPIVOT}, q AS (SELECT * FROM (VALUES ('quality', 'number', '1'), ('toxic', 'number', '2'), ('topic', 'text', '-')) AS v(category, answer_format, "group")),
asked AS (SELECT d.doc_id AS filename, q.category, answer_format, "group", answer, provenance, a.filename IS NOT NULL AS found FROM documents d CROSS JOIN q LEFT JOIN answers a ON a.filename = d.doc_id AND a.category = q.category)"""


def _document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = spark.createDataFrame([("quality", "number", "1"), ("toxic", "number", "2"), ("topic", "text", "-")], "category string, answer_format string, `group` string")
    return answers.document_answers(ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filename")), questions, answers.unpivot_answers(ad.wide_labels(spark, sf_dir)))


@query(f"WITH {UNPIVOT} SELECT filename, category, answer, provenance FROM answers")
def wide_answers_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.unpivot_answers(ad.wide_labels(spark, sf_dir)).select("filename", "category", "answer", "provenance")


@query(f'{ASKED} SELECT filename, category, answer_format, "group", answer, provenance, found FROM asked')
def doc_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_answers(spark, sf_dir).select("filename", "category", "answer_format", "group", "answer", "provenance", "found")


@query(f"{ASKED} SELECT filename, count(*) AS total_questions, count(*) FILTER (coalesce(answer, provenance) IS NOT NULL) AS found_questions FROM asked GROUP BY filename")
def answer_found_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.answered(_document_answers(spark, sf_dir))


RECONCILED = """WITH a AS (SELECT DISTINCT page_id AS doc_id FROM pages), b AS (SELECT DISTINCT doc_id FROM labels), s AS (
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'unmatched' ELSE 'matched' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ad.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), ad.table(spark, sf_dir, "labels")


@query(f"{RECONCILED} SELECT doc_id FROM s WHERE status = 'matched'")
def reconcile_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.reconcile(*_sides(spark, sf_dir), "doc_id").where("status = 'matched'").select("doc_id")


@query(f"{RECONCILED} SELECT doc_id FROM s WHERE status = 'unmatched'")
def reconcile_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.reconcile(*_sides(spark, sf_dir), "doc_id").where("status = 'unmatched'").select("doc_id")


@query(f"{RECONCILED} SELECT doc_id FROM s WHERE status = 'missing'")
def reconcile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.reconcile(*_sides(spark, sf_dir), "doc_id").where("status = 'missing'").select("doc_id")


@query(f"""{RECONCILED} SELECT (SELECT count(*) FROM pages) AS total_have, (SELECT count(*) FROM labels) AS total_want,
count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'unmatched') AS unmatched, count(*) FILTER (status = 'missing') AS missing FROM s""")
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.reconcile_summary(*_sides(spark, sf_dir), "doc_id")


PATHS = "paths AS (SELECT doc_id, source, '/corpus/data/' || source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.PDF' ELSE '.pdf' END AS full_path FROM documents)"


@query(f"WITH {PATHS} SELECT regexp_replace(full_path, '/[^/]*$', '') AS folder, count(DISTINCT full_path) AS n, min(full_path) AS first_path, max(full_path) AS last_path FROM paths GROUP BY ALL")
def folder_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = answers.group_by_folder(ad.pdf_paths(spark, sf_dir))
    return _long(g.select(F.col("root_folder_path").alias("folder"), F.size("pdf_paths").alias("n"), F.get("pdf_paths", F.lit(0)).alias("first_path"), F.element_at("pdf_paths", -1).alias("last_path")))


@query(f"""WITH {PATHS} SELECT doc_id, regexp_extract(full_path, '[^/]+$') AS filename, regexp_replace(regexp_extract(full_path, '[^/]+$'), '\\.[^.]*$', '') AS stem, regexp_replace(full_path, '/[^/]*$', '') AS folder,
regexp_replace(replace(full_path, '/data/', '/out/'), '\\.pdf$', '.json', 'i') AS tree_path, regexp_replace(replace(full_path, '/data/', '/out/'), '\\.pdf$', '.txt', 'i') AS text_path, replace(source || '/' || doc_id, '/', '_') AS category FROM paths""")
def path_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("full_path")
    return ad.pdf_paths(spark, sf_dir).select(
        "doc_id", text.basename(p).alias("filename"), text.stem(p).alias("stem"), text.dirname(p).alias("folder"), text.tree_path(p).alias("tree_path"), text.raw_text_path(p).alias("text_path"),
        text.sanitised(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("category"),
    )


@query(f"""WITH {PATHS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND NOT doc_id % 4 = 0 THEN '/corpus/out/' || regexp_extract(full_path, 'data/(.*)\\.', 1) || '/' || doc_id || '.json'
ELSE '/corpus/out/' || regexp_extract(full_path, 'data/(.*)\\.', 1) || '.json' END AS tree_path FROM paths""")
def tree_path_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ad.pdf_paths(spark, sf_dir)
    there = p.where("doc_id % 4 = 0").select(text.tree_path(F.col("full_path")).alias("path")).union(p.where("doc_id % 2 = 0").select(text.nested_tree_path(F.col("full_path"))))
    return answers.with_tree_paths(p, there).select("doc_id", "tree_path")


@query("SELECT coalesce(source, '?') AS folder, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size FROM documents GROUP BY ALL")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as text files in a folder a source, and the inventory of these."""
    at = place(spark)
    d = ad.table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("?")).alias("folder"), F.coalesce("text", F.lit("")).alias("value"))
    d.write.partitionBy("folder").text(at)
    found = files.inventory(spark, at, r"\.txt$")
    folder = F.replace(F.regexp_extract("full_path", "folder=([^/]*)", 1), F.lit("%3F"), F.lit("?"))
    return found.groupBy(folder.alias("folder")).agg(F.sum("size").alias("size"))


# Written and read back


@query(f"""WITH {TURNS} SELECT doc_id::VARCHAR AS doc_id, self_ref, ord, label, coalesce(section_ref, '#/body') AS parent, (SELECT count(*) FROM attached k WHERE k.doc_id = a.doc_id AND k.section_ref = a.self_ref) AS n_children,
text, CASE WHEN label = 'text' THEN 'assistant' ELSE 'user' END = (SELECT min(role) FROM conversations c WHERE c.conv_id = a.doc_id AND c.turn = a.turn) AS own_marker, length(text)::BIGINT AS span, page_no FROM attached a""")
def tree_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees written with sections attached, read again and exploded: every field is there."""
    at = place(spark)
    source = ad.turn_trees(spark, sf_dir)
    source.write.json(f"{at}/given")
    trees = files.read_trees(spark, f"{at}/given", lines=True)
    sinks.write_trees(nodes.with_children(nodes.attach_sections(nodes.explode_nodes(trees))), trees, f"{at}/made")
    n = nodes.reading_order(nodes.explode_nodes(files.read_trees(spark, f"{at}/made", lines=True)))
    expected = F.when(F.col("label") == "text", "assistant").otherwise("user")
    return _long(n.select("doc_id", "self_ref", "ord", "label", F.col("parent_ref").alias("parent"), F.size("orig_children").alias("n_children"), "text", (expected == F.col("marker")).alias("own_marker"), F.element_at(F.col("node.prov")[0]["charspan"], 2).alias("span"), "page_no"))


@query("SELECT item_id::VARCHAR AS name, text || chr(10) AS text FROM benchmark WHERE text IS NOT NULL")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written to a folder a file, and read as whole files."""
    at = place(spark)
    sinks.write_texts(ad.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("/corpus/data/"), F.col("item_id").cast("string"), F.lit(".pdf")).alias("path"), "text"), at)
    return files.read_texts(spark, f"{at}/*").select(F.regexp_extract("path", "stem=([^/]*)/", 1).alias("name"), "text")


@query(f"WITH {UNPIVOT} SELECT filename::VARCHAR AS filename, category, answer, provenance FROM answers")
def wide_answers_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide answer table as a CSV file, read and unpivoted."""
    at = place(spark)
    ad.wide_labels(spark, sf_dir).write.option("header", True).option("escape", '"').csv(at)
    return answers.unpivot_answers(files.read_answers(spark, at)).select("filename", "category", "answer", "provenance")


@query("SELECT item_id || '_answers' AS document, item_id || '.pdf' AS filename, 'length' AS category, length(text)::VARCHAR AS answer FROM benchmark")
def document_answer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in a folder a document, read back."""
    at = place(spark)
    b = ad.table(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".pdf")).alias("filename"), F.lit("length").alias("category"), F.length("text").cast("string").alias("answer"))
    sinks.write_document_answers(b, at)
    return spark.read.schema("filename string, category string, answer string, document string").json(at).select("document", "filename", "category", "answer")


@query("SELECT n_regionkey::BIGINT AS doc_id, n_nationkey::BIGINT AS id, n_name AS phrase, [n_nationkey / 2.0, 0.0, 1.0, 2.0][1]::DOUBLE AS x0, (n_nationkey % 2)::BIGINT AS bold FROM nation")
def phrase_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in a folder a document, read back."""
    at = place(spark)
    n = ad.table(spark, sf_dir, "nation")
    box = F.array(F.col("n_nationkey") / 2.0, F.lit(0.0), F.lit(1.0), F.lit(2.0)).cast("array<double>")
    sinks.write_phrases(n.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("phrase"), box.alias("bbox"), (F.col("n_nationkey") % 2).cast("int").alias("bold")), at)
    back = spark.read.schema("doc_id bigint, id int, phrase string, bbox array<double>, bold int").json(at)
    return _long(back.select("doc_id", "id", "phrase", F.col("bbox")[0].alias("x0"), "bold"))


@query("""SELECT '/corpus/' || item_id AS doc_path, 'Cat/' || item_id % 3 AS question_category, 'Cat_' || item_id % 3 AS category, 'f/' || item_id % 5 AS folder, text AS true_answer, '#/texts/' || item_id AS node_id, item_id::BIGINT AS page_no FROM benchmark""")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by folder and category, read back from all of them."""
    at = place(spark)
    item = F.col("item_id").cast("string")
    node = F.struct(F.concat(F.lit("#/texts/"), item).alias("node_id"), F.col("item_id").cast("int").alias("page_no"))
    made = ad.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("/corpus/"), item).alias("doc_path"), F.concat(F.lit("Cat/"), (F.col("item_id") % 3).cast("string")).alias("question_category"), F.col("text").alias("true_answer"), F.concat(F.lit("f/"), (F.col("item_id") % 5).cast("string")).alias("at"), F.array(node).alias("provenance_nodes"))
    sinks.write_results(made, at, folder_col="at")
    back = files.read_results(spark, at).withColumn("p", F.col("_metadata.file_path"))
    part = lambda name: F.url_decode(F.url_decode(F.regexp_extract("p", f"{name}=([^/]*)/", 1)))
    return _long(provenance.flat(back.select("doc_path", "question_category", part("category").alias("category"), part("folder").alias("folder"), "true_answer", "provenance_nodes")).select("doc_path", "question_category", "category", "folder", "true_answer", "node_id", "page_no"))


@query("SELECT count(*) FILTER (event_type = 'purchase') AS success, count(*) FILTER (event_type = 'click') AS partial, count(*) FILTER (event_type NOT IN ('purchase', 'click')) AS failure FROM events")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "click", "partial_success").when(F.col("event_type").isNotNull(), "failure")
    return sinks.conversion_counts(ad.table(spark, sf_dir, "events").select(status.alias("status")))


@query("""SELECT item_id, item_id::BIGINT AS id, 'Cat ' || item_id % 7 AS category, trim(split_part(replace(text, chr(10), ' '), 'Description:', 1)) AS description, 'Yes/No' AS answer_format, CASE WHEN item_id % 2 = 0 THEN (item_id % 5)::VARCHAR ELSE '-' END AS "group"
FROM benchmark""")
def question_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ad.table(spark, sf_dir, "benchmark")
    s = lambda x: F.lit(x)
    item = F.col("item_id")
    block = F.concat(item.cast("string"), s("\n\nCategory: Cat "), (item % 7).cast("string"), s("\nDescription: "), F.replace("text", s("\n"), s(" ")), s("\nnothing\nAnswer Format: Yes/No\nGroup: "), F.when(item % 2 == 0, (item % 5).cast("string")).otherwise("-"))
    lines = b.select("item_id", F.posexplode(F.split(block, "\n")).alias("line_no", "line"))
    return _long(files.parse_questions(lines, by=["item_id"]))


# Texts and provenance


@query(r"""SELECT doc_id, length(text) AS n_chars, len(list_filter(string_split_regex(text, '[ \n\t\r\f]+'), lambda w: w <> '')) AS n_words, len(string_split(text, chr(10))) AS n_lines,
len(list_filter(string_split(text, chr(10)), lambda s: regexp_replace(s, '[ \n\t\r\f]+', '', 'g') <> '')) AS n_nonempty_lines,
round(len(list_filter(string_split_regex(text, '[ \n\t\r\f]+'), lambda w: w <> ''))::DOUBLE / len(string_split(text, chr(10))), 6) AS words_per_line,
round(length(regexp_replace(text, '[ \n\t\r\f]+', '', 'g'))::DOUBLE / nullif(len(list_filter(string_split_regex(text, '[ \n\t\r\f]+'), lambda w: w <> '')), 0), 6) AS chars_per_word FROM documents WHERE text IS NOT NULL""")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", *(c.alias(n) for n, c in text.text_statistics(F.col("text")).items()))


@query("SELECT doc_id, lang, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END AS text FROM documents")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.truncated_strings(ad.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \n\t\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \n\t\r\f]+|[ \n\t\r\f]+$', '', 'g')), lambda s: s <> '')"""


@query(f"WITH s AS (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents) SELECT doc_id, unnest(range(1, len(s) + 1)) AS sentence_id, unnest(s) AS sentence FROM s")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    return d.select("doc_id", (F.col("i") + 1).cast("bigint").alias("sentence_id"), "sentence")


PAIRS = "pairs AS (SELECT doc_id, item_id, d.text, b.text AS question, coalesce(source, '?') AS source FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


@query(f"""WITH {PAIRS}, s AS (SELECT *, list_filter({SENTENCES.format('text')}, lambda x: contains(x, question) OR contains(question, x)) AS s FROM pairs)
SELECT doc_id, item_id, coalesce(array_to_string(s, ' '), '') AS evidence FROM s""")
def sentence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ad.known_answers(spark, sf_dir).join(ad.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return models.supported(pairs, "question", "answer", "text", "evidence").select("doc_id", "item_id", "evidence")


@query(f"WITH {PAIRS} SELECT d.doc_id, count(*) AS n_open, min(b.item_id) AS first_open FROM documents d CROSS JOIN benchmark b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = d.doc_id AND p.item_id = b.item_id) GROUP BY d.doc_id")
def doc_question_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = provenance.document_questions(ad.table(spark, sf_dir, "documents").select("doc_id"), ad.table(spark, sf_dir, "benchmark").select("item_id"))
    left = sinks.without_done(everything, ad.known_answers(spark, sf_dir), ["doc_id", "item_id"])
    return left.groupBy("doc_id").agg(F.count("*").alias("n_open"), F.min("item_id").alias("first_open"))


@query(f"WITH {PAIRS} SELECT doc_id, item_id FROM pairs")
def provenance_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = provenance.search(ad.known_answers(spark, sf_dir), nodes.section_texts(ad.document_nodes(spark, sf_dir)))
    return found.select("doc_id", "item_id")


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ad.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))
    return provenance.provenance(ad.document_nodes(spark, sf_dir), ad.asked_pairs(spark, sf_dir), raw)


RESULT = f"""WITH {PAIRS}, n AS (SELECT *, 'From ' || source || ' ' || text AS node_text FROM pairs), s AS (
    SELECT *, list_filter({SENTENCES.format('node_text')}, lambda x: contains(x, question) OR contains(question, x)) AS s FROM n)
SELECT doc_id, item_id, question AS llm_global_answer, '#/texts/0' AS node_id, node_text, question AS llm_answer, coalesce(array_to_string(s, ' '), '') AS node_summary, 'From ' || source AS header_text,
1::BIGINT AS page_no, 1::BIGINT AS total_pages, 0::BIGINT AS tree_node, 1::BIGINT AS tree_header_num FROM s"""


@query(RESULT)
def provenance_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(provenance.flat(_provenance(spark, sf_dir)).drop("question", "answer"))


@query(f"WITH {PAIRS} SELECT doc_id, item_id, 1::BIGINT AS n_nodes FROM pairs UNION ALL SELECT doc_id, -1, 0 FROM documents")
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(provenance.node_counts(_provenance(spark, sf_dir)).select("doc_id", "item_id", "n_nodes"))
