import math
import re

import numpy as np
import pytest
from conftest_llm import ODD
from pyspark.sql import functions as F

from leafmill.llm import _text as tx
from leafmill.llm import quality as q


@pytest.fixture(scope="module")
def corpus(prose):
    """(id, text, source) and labels: clean prose, prose with marks after each word, prose with insults."""
    rows, labels = [], []
    for i in range(900):
        w = prose(60 + i % 50, i)
        kind = i % 6
        if kind == 0:
            w = [x + "***" for x in w]
        if kind == 1:
            for k in range(4):
                w[(7 * k + i) % len(w)] = ["idiot", "scum", "moron"][(i + k) % 3]
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(kind != 0), int(kind == 1)))
        elif i % 9 == 0:
            labels.append((i, int(kind != 0), int(kind == 1)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark, make, corpus):
    rows, labels = corpus
    seen = {i for i, *_ in labels}
    # as many as are clean: these labels are no random sample, of which the default share would be an estimate
    got = {r.doc_id for r in q.selected(make(rows), label_table(spark, labels), k=600).collect()}
    clean = [i for i, _ in rows if i % 6 > 1 and i not in seen]
    bad = [i for i, _ in rows if i % 6 == 0 and i not in seen]
    rude = [i for i, _ in rows if i % 6 == 1]
    assert np.mean([i in got for i in clean]) > 0.97
    assert np.mean([i in got for i in bad]) < 0.03
    assert np.mean([i in got for i in rude]) < 0.1


def brute(rows, labels):
    """(tokens, log weight) of each row by its own counter of exact n-grams."""
    good = {i for i, a, b in labels if a == 1 and b == 0} - {i for i, a, b in labels if not (a == 1 and b == 0)}
    cut = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+", (t or "").encode())
    counts = [{}, {}]
    for i, t in rows:
        w = cut(t)
        for kind, items in enumerate((w, list(zip(w, w[1:])))):
            for x in items:
                c = counts[kind].setdefault(x, [0, 0])
                c[0] += 1
                c[1] += i in good
    total = [[sum(c[k] for c in own.values()) for k in (0, 1)] for own in counts]
    out = []
    for _, t in rows:
        w, s = cut(t), 0.0
        for items, own, (r, g), top, weight in zip((w, list(zip(w, w[1:]))), counts, total, (q.CEILING, q.PAIR_CEILING), (1, q.PAIR_WEIGHT)):
            for x in items:
                s += weight * (min(math.log((own[x][1] + q.SMOOTH) / (own[x][0] * g / r + q.SMOOTH)), top) - top)
        out.append((len(w), q.LENGTH * s / max(1, len(w))))
    return out


def test_weights_against_an_independent_counter(spark, make):
    rng = np.random.default_rng(1)
    parts = ["good", "fine", "plain", "é", "bad", "worse", "!!", "***", "a1", "_", "日本"]
    rows = [(i, None if i == 7 else "".join(str(x) + str(rng.choice(["", " ", "\n"])) for x in rng.choice(parts, rng.integers(0, 40)))) for i in range(80)]
    labels = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 80, 2)] + [(4, 0, 0), (6, 1, 0)]
    want = brute(rows, labels)
    got = {r.id: r for r in q.fit(make(rows), label_table(spark, labels))[1].collect()}
    for (i, _), (n, w) in zip(rows, want):
        assert got[i].tokens == n and (got[i].weight is None if not n else abs(got[i].weight - w) < 2e-3 * max(1, abs(w)))


def test_top_k_is_exact(spark, make, corpus):
    rows, labels = corpus
    for k in (None, 0, 1, 100, 10_000):
        model, table = q.fit(make(rows), label_table(spark, labels), k=k)
        all_ = table.collect()
        good = {i for i, a, b in labels if a == 1 and b == 0}
        n = round(len(rows) * len(good) / len(labels)) if k is None else min(k, len(rows))
        best = sorted((r.key for r in all_), reverse=True)[:n]
        got = {r.doc_id for r in q.selected(make(rows), label_table(spark, labels), k=k).collect()}
        assert got == {r.id for r in all_ if best and r.key >= best[-1]} and len(got) == n


def test_draws_follow_the_weights(spark, make):
    """Of two kinds of documents, the share drawn of each over many seeds is that of their weights."""
    rows = [(i, "a b") for i in range(200)] + [(i, "c d") for i in range(200, 400)]
    model, table = q.fit(make(rows), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    ids = spark.range(400)
    weight = F.when(F.col("id") < 200, F.log(F.lit(3.0))).otherwise(F.lit(0.0))
    first = 0
    for seed in range(30):
        top = ids.withColumn("key", weight + q.gumbel(F.col("id"), seed)).orderBy(F.desc("key")).limit(40).collect()
        first += sum(r.id < 200 for r in top)
    assert abs(first / (30 * 40) - 0.74) < 0.05  # without replacement, a little under 3 to 1


def test_dotted_and_clashing_columns(spark, make, corpus):
    rows, labels = corpus
    df = spark.createDataFrame([(i, t, i) for i, t in rows[:300]], "`doc.id` bigint, `the text` string, q_key bigint")
    kept = q.kept(df, label_table(spark, labels), id_col="doc.id", text_col="the text")
    assert kept.columns == df.columns and 100 < kept.count() < 300


def test_very_long_text(spark, make, corpus):
    rows, labels = corpus
    long = " ".join(t for _, t in rows if "*" not in t) * 30
    assert len(long) > 5_000_000
    assert 7777 in {r.doc_id for r in q.selected(make([*rows[:300], (7777, long)]), label_table(spark, labels), k=290).collect()}


def test_kth_largest(spark):
    x = [1.0, 2.0, 2.0, 2.0, 5.0, -3.0, 1e9]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    for k in range(1, 8):
        assert q.kth_largest(df, "v", k) == sorted(x, reverse=True)[k - 1]
    assert q.kth_largest(df, "v", 0) == np.inf
    assert q.kth_largest(df.limit(0), "v", 3) == -np.inf


def test_rejected_rows_go_and_columns_stay(spark, make, corpus):
    rows, labels = corpus
    df, marks = make(rows[200:] + ODD), label_table(spark, [*labels, (None, 1, 0), (3, None, 0)])
    kept = q.kept(df, marks)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not {101, 102, 103, 109} & set(ids)
    assert sorted(i for i in ids if i is not None) == sorted(r.doc_id for r in q.selected(df, marks).collect() if r.doc_id is not None)


def test_without_labels_all_with_words_stay(spark, make):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = sorted(r.doc_id or -1 for r in q.selected(make([(1, "a b"), (2, None), (3, " ")]), none).collect())
    assert got == [1]
    assert q.selected(make([]), none).collect() == []


def test_gumbel_noise(spark):
    x = np.array([r[0] for r in spark.range(20000).select(q.gumbel(F.col("id"), 7)).collect()])
    assert abs(x.mean() - 0.5772) < 0.03 and abs(x.std() - np.pi / 6**0.5) < 0.03


def test_tokens_split_words_and_marks():
    buf = np.frombuffer(b"ab*** cd\xc3\xa9!", np.uint8)
    doc, one, two = q.grams(buf, np.array([0, len(buf)]))
    assert len(one) == 4 and (two >= 0).sum() == 3
    h = [int(tx.span_hash(buf, np.array([a]), np.array([b]))[0] >> tx.U64(64 - q.BITS)) for a, b in ((0, 2), (2, 5), (6, 10), (10, 11))]
    assert one.tolist() == h
