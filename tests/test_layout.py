import random

import trees as tr
from pyspark.sql import functions as F

from leafmill.functions import layout as look
from leafmill.functions import text
from leafmill.operators import layout, nodes, tables
from leafmill.sources import files


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_flags(spark):
    fonts = ["ABCDEF+Times-Bold", "ZKBHBU+TimesRoman", "Heavy", "Arial", None]
    assert column(spark, fonts, look.is_bold) == [1, 1, 1, 0, 0]
    assert column(spark, fonts, lambda c: look.is_bold(c, strict=True)) == [1, 0, 1, 0, 0]
    texts = ["ABC", "AB C", "Abc", "A1", "ÉÀ", "", None, "日本"]
    assert column(spark, texts, look.is_all_caps) == [int(bool(t) and t.isupper() and t.isalpha()) for t in texts]
    assert column(spark, ["1a", "a1", "", "٣x", None], look.starts_with_number) == [1, 0, 0, 1, 0]
    assert column(spark, ["a", " ", "", None, "​﻿", "\x00\x07", " ", " x "], text.is_valid_phrase) == [True, False, False, False, False, False, False, True]
    assert column(spark, ["One. Two!  Three", "  ", None, "no end"], text.sentences) == [["One.", "Two!", "Three"], [], [], ["no end"]]
    assert column(spark, ["#/texts/12", "#/x", None, "a1b22"], text.last_number) == [12, 0, 0, 22]
    assert column(spark, ["/a/data/b/c.PDF", "x.pdf"], text.tree_path) == ["/a/out/b/c.json", "x.json"]
    assert column(spark, ["/a/data/c.pdf"], text.nested_tree_path) == ["/a/out/c/c.json"]


def test_centred_and_iou(spark):
    df = spark.createDataFrame([(0.0, 10.0, 10.0), (0.0, 4.0, 10.0), (2.0, 6.0, 10.0), (None, 1.0, 2.0)], "a double, b double, w double")
    assert [r[0] for r in df.select(look.is_centred(F.col("a"), F.col("b"), F.col("w"))).collect()] == [1, 0, 1, 0]
    boxes = [((0, 0, 2, 2), (1, 1, 3, 3), 1 / 7), ((0, 0, 1, 1), (1, 0, 2, 1), 0.0), ((0, 0, 1, 1), (0, 0, 1, 1), 1.0), ((0, 0, 0, 0), (0, 0, 1, 1), 0.0)]
    df = spark.createDataFrame([tuple(map(float, a + b)) for a, b, _ in boxes], ", ".join(f"c{i} double" for i in range(8)))
    got = df.select(look.iou(tuple(F.col(f"c{i}") for i in range(4)), tuple(F.col(f"c{i}") for i in range(4, 8)))).collect()
    assert all(abs(g[0] - w) < 1e-12 for g, (_, _, w) in zip(got, boxes))


def merged(phrases, width=612, margin=50):
    """Runs of one document in plain Python."""
    groups = []
    for p in phrases:
        q = groups[-1][-1] if groups else None
        ok = q is not None and all(p[c] == q[c] for c in ("page", "font", "size", "bold", "is_underline"))
        apart = q is not None and abs((p["y0"] + p["y1"]) / 2 - (q["y0"] + q["y1"]) / 2) > p["size"] * 0.5
        if ok and p["is_underline"] == 1 and p["bold"] == 1 and apart:
            ok = False
        if ok and p["bold"] == 1 and q["bold"] == 1 and apart and width - q["x1"] > margin:
            ok = False
        groups[-1].append(p) if ok else groups.append([p])
    return [" ".join(p["phrase"] for p in g) for g in groups]


def test_runs_against_plain_python(spark):
    rng, rows = random.Random(1), []
    for d in range(40):
        for i in range(rng.randint(1, 20)):
            x, y = rng.choice((10.0, 590.0)), float(rng.choice((0, 3, 20)))
            rows.append({"doc_id": d, "id": i, "phrase": rng.choice(("A", "b", "1", "Up")), "x0": x, "y0": y, "x1": x + 5, "y1": y + 10, "page": rng.choice((0, 0, 0, 1)), "font": "f", "size": 10.0, "bold": rng.choice((0, 1, 1)), "is_underline": rng.choice((0, 0, 1)), "is_center": 0, "all_cap": 0, "num_st": 0})
    kind = "doc_id int, id int, phrase string, x0 double, y0 double, x1 double, y1 double, page int, font string, size double, bold int, is_underline int, is_center int, all_cap int, num_st int"
    got = {}
    for r in layout.merge_runs(spark.createDataFrame([tuple(r.values()) for r in rows], kind)).orderBy("doc_id", "id").collect():
        got.setdefault(r.doc_id, []).append(r.phrase)
    assert got == {d: merged([r for r in rows if r["doc_id"] == d]) for d in range(40)}


def test_headers_take_the_first_best_phrase(spark, tmp_path):
    t = tr.tree(texts=[tr.node("#/texts/0", "section_header", "1 Introduction", 1, 792.0, 0.0), tr.node("#/texts/1", "section_header", "Elsewhere", 1, 100.0)])
    tr.write(tmp_path, {"d": t})
    n = nodes.explode_nodes(files.read_trees(spark, str(tmp_path)))
    doc = n.first().doc_id
    looks = (12.0, 1, 0, 1, 0, 0)
    rows = [(doc, 0, 0, "INTRODUCTION now", "f0", 0.0, 0.0, 50.0, 10.0), (doc, 0, 1, "1 introduction", "f1", 0.0, 0.0, 50.0, 10.0), (doc, 0, 2, "1 Introduction", "f2", 0.0, 0.0, 50.0, 9.0), (doc, 1, 3, "1 Introduction", "f3", 0.0, 0.0, 50.0, 10.0), (doc, 0, 4, "other text", "f4", 0.0, 0.0, 50.0, 10.0)]
    p = spark.createDataFrame([(*r[:5], *looks, *r[5:]) for r in rows], "doc_id string, page int, id int, phrase string, font string, size double, bold int, all_cap int, num_st int, is_center int, is_underline int, x0 double, y0 double, x1 double, y1 double")
    got = {r.self_ref: r.visual_pattern for r in layout.enrich_headers(n, p).collect()}
    assert got["#/texts/0"].font == "f0" and got["#/texts/1"] is None
    sized = layout.enrich_headers(n, p, layout.page_sizes(files.read_trees(spark, str(tmp_path))), page_height=None).where("visual_pattern IS NOT NULL")
    assert sized.count() == 0


def test_tables(spark, tmp_path):
    cells = [tr.cell(" x ", 1, 0, 5.0, 1.0, row_header=True), tr.cell("h1", 0, 0, 9.0, 1.0, column_header=True, row_header=True), tr.cell("", 1, 1, 5.0, 9.0), tr.cell("h2", 0, 1, 9.0, 9.0, column_header=True), tr.cell("s", 2, 0, 1.0, 1.0, row_section=True), {**tr.cell("late", 1, 1, 0.0, 0.0), "bbox": None}]
    t = tr.tree(tables=[tr.node("#/tables/0", "table", None, 1, 9.0, data={"table_cells": cells, "num_rows": 3, "num_cols": 2}), tr.node("#/tables/1", "table", None, 1, 8.0, data={"table_cells": []}), {**tr.node("#/tables/2", "table", None, 1, 7.0), "children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/1"}]}, {**tr.node("#/tables/3"), "children": [{"$ref": "#/none"}]}], texts=[tr.node("#/texts/0", text="low", page=1, t=5.0), tr.node("#/texts/1", text="high", page=1, t=50.0)])
    tr.write(tmp_path, {"d": t})
    n = nodes.reading_order(nodes.explode_nodes(files.read_trees(spark, str(tmp_path))))
    rows = tables.cell_rows(tables.explode_cells(n)).orderBy("cell").collect()
    assert [(r.text, r.label) for r in rows] == [("h1", "column_header"), ("h2", "column_header"), ("x", "row_header"), ("s", "row_section"), ("late", "table_cell")]
    assert {r.self_ref: r.table_text for r in tables.table_texts(n).collect()} == {"#/tables/0": "The below is a table, table starts:\nh1 | h2\nx | late\ns\nThis is the end of the table."}
    assert {r.self_ref: r.table_text for r in tables.table_texts_by_position(n).collect()} == {"#/tables/0": "h1 h2 x s late", "#/tables/1": "[EMPTY TABLE - NO CHILDREN]", "#/tables/2": "high low", "#/tables/3": "[NO TEXT CELLS FOUND IN CHILDREN]"}
    assert {r.self_ref: r.n_cells for r in tables.table_details(n).collect()} == {"#/tables/0": 6, "#/tables/1": 0, "#/tables/2": 0, "#/tables/3": 0}
    assert {r.label: r.n for r in tables.label_counts(tables.cell_rows(tables.explode_cells(n))).collect()} == {"column_header": 2, "row_header": 1, "row_section": 1, "table_cell": 1}
