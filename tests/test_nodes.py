import pytest
import trees as tr

from leafmill.operators import nodes, tables
from leafmill.sources import files, sinks


@pytest.fixture(scope="module")
def forest(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("trees")
    made = {f"t{i}": tr.random_tree(i) for i in range(25)}
    made["empty"], made["bad"] = tr.tree(), '{"texts": [{"self_ref": '
    tr.write(folder, made)
    rows = nodes.explode_nodes(files.read_trees(spark, str(folder)))
    rows = rows.withColumn("doc_id", nodes.F.regexp_extract("doc_id", r"([^/]+)\.json$", 1)).persist()
    return made, rows


def by_doc(rows, order, *columns):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r[order])):
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def test_order_and_sections_against_plain_python(forest):
    made, rows = forest
    got = by_doc(nodes.attach_sections(rows), "ord", "self_ref", "section_ref")
    want = {k: tr.attached(t)[0] for k, t in made.items() if not isinstance(t, str) and any(t[a] for a in tr.ARRAYS)}
    assert got == want


def test_edges_against_plain_python(forest):
    made, rows = forest
    got = {(r.doc_id, r.section_ref): r.children for r in nodes.section_edges(nodes.attach_sections(rows)).collect()}
    assert got == {(k, h): c for k, t in made.items() if not isinstance(t, str) for h, c in tr.attached(t)[1].items() if c}


def content(t, ref):
    a, n = next((a, n) for a in tr.ARRAYS for n in t[a] if n["self_ref"] == ref)
    if a == "texts":
        return n.get("text") or ""
    if a == "tables":
        return "[NO TABLE CONTENT FOUND]"
    return "[IMAGE]" if a == "pictures" else n.get("text", "[GROUP]" if a == "groups" else "[FORM_ITEM]")


def test_section_texts_against_plain_python(forest):
    made, rows = forest
    got = {(r.doc_id, r.self_ref): (r.complete_text, r.n_children) for r in nodes.section_texts(nodes.attach_sections(rows)).collect()}
    want = {}
    for k, t in made.items():
        if isinstance(t, str):
            continue
        own = {n["self_ref"]: n.get("text") or "" for a in tr.ARRAYS for n in t[a]}
        for h, kids in tr.attached(t)[1].items():
            below = " ".join(x for x in (content(t, c) for c in kids) if x)
            full = own[h]
            if below.strip():
                full = full + " " + below if full.strip() else below
            want[k, h] = full, len(kids)
    assert got == want


def test_headers_ranks_and_pages(spark, tmp_path):
    t = tr.tree(texts=[tr.node("#/texts/9", "section_header", "B", 1, 10.0), tr.node("#/texts/2", "section_header", "A", 2, 10.0), tr.node("#/texts/3", "text", "x", 3, 5.0)], groups=[tr.node("#/groups/0", "list")])
    tr.write(tmp_path, {"d": t})
    n = nodes.reading_order(nodes.explode_nodes(files.read_trees(spark, str(tmp_path))))
    assert [r.self_ref for r in nodes.headers_by_id(n).orderBy("rank").collect()] == ["#/texts/2", "#/texts/9"]
    assert [r.self_ref for r in nodes.headers_by_page(n).orderBy("rank").collect()] == ["#/texts/9", "#/texts/2"]
    assert {r.self_ref: (r.rank, r.total) for r in nodes.node_ranks(n).collect()} == {"#/texts/9": (1, 2), "#/texts/2": (0, 2), "#/texts/3": (-1, 2), "#/groups/0": (-1, 2)}
    assert {r.self_ref: (r.page_no, r.total_pages) for r in nodes.page_info(n).collect()} == {"#/texts/9": (1, 3), "#/texts/2": (2, 3), "#/texts/3": (3, 3), "#/groups/0": (-1, 3)}
    assert n.first().self_ref == "#/groups/0"
    (r,) = nodes.find_node(n, "#/texts/3").collect()
    assert r.text == "x" and nodes.find_node(n, "#/none").collect() == []
    report = nodes.section_report(nodes.attach_sections(n)).orderBy("rank").collect()
    assert [(r.text, r.complete_text, r.page, r.n_children) for r in report] == [("A", "A x", "2", 1), ("B", "B", "1", 0)]


def test_kinds_children_and_key_values(spark, tmp_path):
    t = tr.tree(
        texts=[tr.node("#/texts/0", "section_header", "H" * 70, 1, 90.0), tr.node("#/texts/1", "text", "y" * 120, 1, 80.0)],
        pictures=[tr.node("#/pictures/0", "picture", None, 1, 70.0)], key_value_items=[tr.node("#/key_value_items/0", "kv", None, 1, 60.0, key="k", value="v")], form_items=[tr.node("#/form_items/0", "f", None, 1, 50.0)],
        tables=[tr.node("#/tables/0", "table", None, 1, 40.0, data={"table_cells": [tr.cell("b", 0, 1, 9.0, 5.0), tr.cell("a", 0, 0, 9.0, 1.0)], "num_rows": 1, "num_cols": 2})],
    )
    tr.write(tmp_path, {"d": t})
    n = nodes.attach_sections(nodes.explode_nodes(files.read_trees(spark, str(tmp_path))))
    kids = nodes.children_info(n, tables.table_texts(n)).where("self_ref = '#/texts/0'").orderBy("pos").collect()
    assert [(k.child_type, k.preview) for k in kids] == [
        ("text", "y" * 100 + "..."), ("picture", "[IMAGE]"), ("key_value_item", "k: v"), ("form_item", "[FORM_ITEM]"),
        ("table", "The below is a table, table starts:\na | b\nThis is the end of the table."),
    ]
    report = nodes.tree_report(n).orderBy("pos").collect()
    assert len(report) == 5 and report[0].header == "H" * 60 + "..." and report[0].n_children == 5
    assert nodes.orphans(n).count() == 0 and nodes.unattached(n).count() == 0
    trees = files.read_trees(spark, str(tmp_path))
    written = sinks.trees_of(nodes.with_children(n), trees).first()
    assert [c["$ref"] for c in written.texts[0].children] == [k.child_ref for k in kids]
    assert written.pictures[0].parent["$ref"] == "#/texts/0"


def test_whole_trees_round_trip(spark, tmp_path):
    """Only parents, children and the order within arrays change; all other fields come back as they were."""
    made = {f"t{i}": tr.random_tree(i) for i in range(12)} | {"empty": tr.tree()}
    box = tr.cell("b", 0, 1, 9.0, 5.0)
    more = {"content_layer": "body", "orig": "O", "marker": "-", "enumerated": True, "level": 3}
    made["full"] = tr.tree(
        texts=[tr.node("#/texts/1", "list_item", "x", 2, 5.0, **more), tr.node("#/texts/0", "section_header", "H", 1, 5.0, **more)],
        tables=[tr.node("#/tables/0", "table", None, 1, 4.0, captions=[{"$ref": "#/texts/1"}], footnotes=[], references=[], annotations=[{"k": "v"}], data={"table_cells": [box], "num_rows": 1, "num_cols": 2, "grid": [[box, box]]})],
    )
    (tmp_path / "in").mkdir()
    tr.write(tmp_path / "in", made)
    trees = files.read_trees(spark, str(tmp_path / "in")).withColumn("doc_id", nodes.F.regexp_extract("doc_id", r"([^/]+)\.json$", 1))
    sinks.write_trees(nodes.with_children(nodes.attach_sections(nodes.explode_nodes(trees))), trees, str(tmp_path / "out"))
    back = {r.doc_id: r.asDict(True) for r in files.read_trees(spark, str(tmp_path / "out"), lines=True).collect()}
    given = {r.doc_id: r.asDict(True) for r in trees.collect()}
    assert back.keys() == given.keys() == made.keys()
    for name, t in made.items():
        order, kids = tr.attached(t)
        place = {ref: i for i, (ref, _) in enumerate(order)}
        section = dict(order)
        for a in tr.ARRAYS:
            for n in given[name][a]:
                header = n["label"] == "section_header"
                n["parent"] = {"$ref": section[n["self_ref"]]} if section[n["self_ref"]] else n["parent"]
                n["children"] = [{"$ref": c} for c in kids[n["self_ref"]]] if header else n["children"]
            given[name][a].sort(key=lambda n: place[n["self_ref"]])
        assert back[name] == given[name], name
    assert back["full"]["tables"][0]["data"]["grid"][0][1]["text"] == "b" and back["full"]["texts"][1]["prov"][0]["charspan"] == [0, 1]


def test_hash_beyond_64_bits(spark, tmp_path):
    tr.write(tmp_path, {"d": tr.tree()})
    r = files.read_trees(spark, str(tmp_path)).first()
    assert int(r.origin.binary_hash) == 17150447383450905414 and r.pages["1"].size.height == 842.0


def test_stream_passes_over_what_is_there(spark, tmp_path):
    from leafmill.streaming import trees as st

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    tr.write(src, {f"t{i}": tr.random_tree(i) for i in range(3)})
    for name in ("a", "b"):  # the second run has no memory of the first but what it wrote
        st.sections_to(st.tree_stream(spark, str(src)), out, str(tmp_path / name)).awaitTermination()
    got = spark.read.parquet(out)
    want = nodes.section_report(nodes.attach_sections(nodes.explode_nodes(files.read_trees(spark, str(src)))))
    assert got.count() == want.count() > 0
    tr.write(src, {"t9": tr.random_tree(4)})
    st.sections_to(st.tree_stream(spark, str(src)), out, str(tmp_path / "b")).awaitTermination()
    assert spark.read.parquet(out).count() > got.count() or not tr.attached(tr.random_tree(4))[1]
