import tracemalloc

import numpy as np
import pyarrow as pa
from conftest_llm import ODD

from leafmill.llm import _text as tx
from leafmill.llm import decontaminate as dc


def words(text):
    return tx.words(*tx.utf8(pa.array([text], pa.string()))).hash


def test_distance_is_the_least_over_all_runs():
    rng = np.random.default_rng(0)

    def edit(a, b):
        d = np.arange(len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(d[j] + (x != y), d[j + 1] + 1, new[-1] + 1))
            d = np.array(new)
        return d[-1]

    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 7)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 10)).astype(np.uint64)
        assert dc.distance(a, b)[0] == min(edit(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


def fixture(prose):
    rng = np.random.default_rng(3)
    items = [(i, " ".join(prose(int(n), 900 + i))) for i, n in enumerate(rng.integers(1, 60, 100))]
    docs = []
    for d in range(240):
        text = prose(int(rng.integers(0, 200)), d)
        if d % 2 == 0:
            item = items[int(rng.integers(0, 100))][1].split()
            held = dc.edited(np.arange(len(item)), int(rng.integers(0, int(dc.MAX_EDIT * len(item)) + 1)), rng)
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = [item[int(x)] if x < len(item) else f"new{x}" for x in held]
        docs.append((d, " ".join(text)))
    return items, docs


def test_recall_and_precision_against_brute_force(spark, make, prose):
    items, docs = fixture(prose)
    rows = docs + ODD
    truth = set()
    for d, text, *_ in rows:
        h = words(text)
        for i, t in items:
            w = words(t)
            if d is not None and dc.distance(w, h)[0] <= int(dc.MAX_EDIT * len(w) + 1e-9):
                truth.add((d, i))
    bench = spark.createDataFrame([*items, (500, None), (501, ""), (None, "x y z"), (502, "?!")], "item_id bigint, text string")
    got = dc.leaks(make(rows), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found) == len(got) and found <= truth
    assert len(found & truth) >= 0.95 * len(truth)


def test_blocks_of_items_give_the_same(spark, make, prose, monkeypatch):
    items, docs = fixture(prose)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {tuple(r) for r in dc.leaks(make(docs), bench).collect()}
    monkeypatch.setattr(dc, "BLOCK", 37)
    assert {tuple(r) for r in dc.leaks(make(docs), bench).collect()} == whole


def test_leaking_documents_go(spark, make, prose):
    item = " ".join(prose(30, 1))
    df = make([(1, "before " + item.upper() + ". After"), (2, " ".join(prose(60, 2))), *ODD])
    kept = dc.decontaminated(df, spark.createDataFrame([(7, item)], "item_id bigint, text string"))
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted([2, *(x[0] or -1 for x in ODD)])


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.leaks(make([(1, "a b c")]), none).collect() == []
    assert dc.leaks(make([]), spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")).collect() == []


def test_gathering_windows_piece_by_piece_gives_the_same(spark, make, prose, monkeypatch):
    items, docs = fixture(prose)
    index = dc.Index([i for i, _ in items], [t for _, t in items], dc.MAX_EDIT)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["id", "text"])
    rows = lambda: {tuple(r.values()) for b in dc._scan(index)(iter([batch])) for r in b.to_pylist()}
    whole = rows()
    monkeypatch.setattr(dc, "HELD", 1)
    monkeypatch.setattr(tx, "CHUNK", 500)
    monkeypatch.setattr(tx.chunks, "__defaults__", (500,))
    assert rows() == whole


def test_clashing_columns(spark, prose):
    item = " ".join(prose(30, 1))
    rows = [(1, "before " + item, 5, 6, "x"), (2, " ".join(prose(60, 2)), 5, 6, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, leak int, `_Leak` int, `a.b` string").withColumnRenamed("doc_id", "the.id")
    kept = dc.decontaminated(df, spark.createDataFrame([(7, item, 1)], "item_id bigint, text string, leak int"), id_col="the.id")
    assert kept.columns == df.columns and [r[0] for r in kept.collect()] == [2]


def test_items_too_long_to_embed_are_aligned(spark, make, prose, monkeypatch):
    monkeypatch.setattr(dc, "LONG", 20)
    monkeypatch.setattr(dc, "LIMIT", 1)
    items, docs = fixture(prose)
    truth = {(d, i) for d, text in docs for i, t in items for w in [words(t)] if dc.distance(w, words(text))[0] <= int(dc.MAX_EDIT * len(w) + 1e-9)}
    index = dc.Index([i for i, _ in items], [t for _, t in items], dc.MAX_EDIT)
    assert sum(x is None for x in index.repeat.values()) > 30
    got = {(r.doc_id, r.item_id) for r in dc.leaks(make(docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == truth


def test_windows_of_a_repeating_document_take_bounded_memory(prose, monkeypatch):
    monkeypatch.setattr(dc, "HELD", 1 << 20)
    item = " ".join(prose(100, 3))
    index = dc.Index([1], [item], dc.MAX_EDIT)
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([" ".join([item] * 200)])], ["id", "text"])
    tracemalloc.start()
    rows = [r for b in dc._scan(index)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in rows} == {(5, 1, 0)}
    assert peak < 80 * len(item) * 200  # all windows at once would take 320 bytes a byte of text
