"""Real trees and phrases with their finished forms, in a folder that LEAFMILL_GOLDEN names; skipped without it."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafmill import schemas
from leafmill.operators import layout, nodes, tables
from leafmill.sources import sinks

FOLDER = Path(os.environ.get("LEAFMILL_GOLDEN", "/nowhere"))
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="LEAFMILL_GOLDEN names no folder")
ARRAYS = ("texts", "tables", "pictures", "groups", "key_value_items", "form_items")


def found(suffix):
    return sorted(FOLDER.rglob(f"*{suffix}"))


def base(path, suffix):
    """A finished file's own tree, which is named like its folder or like itself."""
    return next(p for p in (path.with_name(path.name.replace(suffix, ".json")), path.parent / f"{path.parent.name}.json") if p.exists())


@pytest.fixture(scope="module")
def forest(spark):
    paths = [p for p in FOLDER.rglob("*.json") if "texts" in json.loads(p.read_text()) and not p.stem.endswith(("_processed", "_enriched"))]
    names = spark.createDataFrame([(str(p), p.read_text()) for p in paths], "doc_id string, value string")
    trees = names.select("doc_id", F.from_json("value", schemas.DOCUMENT).alias("t")).select("doc_id", "t.*").drop("_corrupt")
    return trees.persist(), nodes.attach_sections(nodes.explode_nodes(trees)).persist()


def test_sections_of_processed_trees(forest):
    """Every node's parent and children; where the finished file is in an older order, the same children."""
    made = {r.doc_id: r.asDict(True) for r in sinks.trees_of(nodes.with_children(forest[1]), forest[0]).collect()}
    exact = 0
    for p in found("_processed.json"):
        want, got = json.loads(p.read_text()), made[str(base(p, "_processed.json"))]
        edges = lambda t: {n["self_ref"]: ((n["parent"] or {}).get("$ref"), [c["$ref"] for c in n["children"]]) for a in ARRAYS for n in t[a] or []}
        a, b = edges(want), edges(got)
        assert {k: (x, sorted(y)) for k, (x, y) in a.items()} == {k: (x, sorted(y)) for k, (x, y) in b.items()}
        exact += a == b
    assert exact >= 1


def test_finished_phrases_stay_as_they_are(spark):
    for p in found("_visual_pattern.json"):
        rows = json.loads(p.read_text())
        df = spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").select(F.lit("d").alias("doc_id"), F.from_json("v", schemas.PHRASE).alias("p")).select("doc_id", "p.*")
        got = layout.merge_runs(layout.flat_boxes(df)).orderBy("id").collect()
        assert [(r.phrase, r.bold, r.all_cap, r.num_st, r.is_center, [r.x0, r.y0, r.x1, r.y1]) for r in got] == [(r["phrase"], r["bold"], r["all_cap"], r["num_st"], r["is_center"], r["bbox"]) for r in rows]


def test_matches_of_headers_and_phrases(spark, forest):
    """None at the usual threshold; three where it is low and the page's true height is used."""
    trees, attached = forest
    p = max(found("_visual_pattern.json"), key=lambda p: p.stat().st_size)
    doc = str(base(p, "_visual_pattern.json"))
    df = spark.createDataFrame([(json.dumps(r),) for r in json.loads(p.read_text())], "v string").select(F.lit(doc).alias("doc_id"), F.from_json("v", schemas.PHRASE).alias("p")).select("doc_id", "p.*")
    own = attached.where(F.col("doc_id") == doc)
    count = lambda **k: layout.enrich_headers(own, layout.flat_boxes(df), layout.page_sizes(trees), **k).where("visual_pattern IS NOT NULL").count()
    assert [count(), count(page_height=842.0), count(page_height=None, threshold=0.24)] == [0, 0, 3]


def test_the_document_with_a_table(forest):
    _, attached = forest
    (doc,) = [r[0] for r in attached.where("array_type = 'tables'").select("doc_id").distinct().collect()]
    own = attached.where(F.col("doc_id") == doc)
    assert tables.explode_cells(own).count() == 14
    (r,) = tables.table_texts(own).collect()
    assert r.table_text.startswith("The below is a table, table starts:\n") and " | " in r.table_text
    by_id, by_page = ([x.self_ref for x in f(own).orderBy("rank").collect()] for f in (nodes.headers_by_id, nodes.headers_by_page))
    assert by_id != by_page and sorted(by_id) == sorted(by_page)
