import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD

from leafmill.llm import _text as tx
from leafmill.llm import _graph, near_dup
from leafmill.llm._graph import components


def sets(rows):
    out = {}
    for i, text, *_ in rows:
        v, _, _ = near_dup.shingles(*tx.utf8(pa.array([text], pa.string())))
        if i is not None and len(v):
            out[i] = set(v.tolist())
    return out


def brute(rows, threshold=near_dup.THRESHOLD):
    s = sets(rows)
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


def edited(words, rate, seed):
    rng = np.random.default_rng(seed)
    return [f"new{rng.integers(9**9)}" if rng.random() < rate else w for w in words]


def test_groups_against_brute_force(spark, make, prose):
    rows = [(i, " ".join(prose(200 + 20 * (i % 7), i))) for i in range(60)]
    for g in range(12):  # copies from exact to barely alike
        base = prose(300, 1000 + g)
        rows += [(1000 + 50 * g + k, " ".join(edited(base, 0.02 * g, 100 * g + k))) for k in range(8)]
    rows += ODD
    got = {r.doc_id: r.group_id for r in near_dup.near_duplicates(make(rows)).collect()}
    pairs = brute(rows)
    found = [p for p in pairs if got.get(p[0], -1) == got.get(p[1], -2)]
    assert len(found) >= 0.97 * len(pairs)
    edges = components(spark.createDataFrame(sorted(pairs), "a bigint, b bigint"))
    whole = {r.id: r.root for r in edges.collect()}
    assert set(got) <= set(whole)  # nothing is grouped that brute force leaves alone
    assert all(whole[i] == whole[g] for i, g in got.items())
    assert not {101, 102, 103, 104} & set(got)


def test_thousands_of_near_copies_are_one_group(make, prose):
    base = prose(120, 5)
    rows = [(i, " ".join(edited(base, 0.03, i))) for i in range(1500)]
    got = near_dup.near_duplicates(make(rows, clash=False)).collect()
    assert {r.group_id for r in got} == {0} and len(got) >= 1490


def test_pairs_among_thousands_that_share_a_passage(spark, make, prose):
    passage = prose(132, 7)
    rng = np.random.default_rng(3)
    own = lambda n: [f"own{x}" for x in rng.integers(0, 10**12, n)]
    rows = [(i, " ".join(passage + own(100))) for i in range(3000)]  # similarity 0.39 with each other
    pairs = []
    for k in range(60):  # 0.48 within a pair, below the threshold with all others
        extra = own(20)
        a, b = 10_000 + 2 * k, 10_001 + 2 * k
        rows += [(x, " ".join(passage + extra + own(80))) for x in (a, b)]
        pairs.append((a, b))
    bands = {}
    for batch in near_dup._sketch([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[3000:])], ["id", "text"])]):
        bands |= dict(zip(batch.column("id").to_pylist(), map(set, batch.column("bands").to_pylist())))
    meet = [(a, b) for a, b in pairs if bands[a] & bands[b]]
    assert len(meet) >= 54
    got = {r.doc_id: r.group_id for r in near_dup.near_duplicates(make(rows, clash=False)).collect()}
    assert [p for p in meet if got.get(p[0]) == got.get(p[1]) == p[0]] == meet
    assert len(got) == 2 * len(meet)  # and nobody else


def test_joins_against_brute_force():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 2**48, 60)
    sets = [np.unique(np.concatenate([rng.choice(common, rng.integers(20, 60), replace=False), rng.integers(0, 2**48, 15)])).astype(np.uint64) for _ in range(80)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    s, before = [set(x.tolist()) for x in sets], np.arange(80) // 2

    def groups(edges):
        of = before.tolist()
        for a, b in edges:
            of = [of[a] if g == of[b] else g for g in of]
        return {frozenset(k for k in range(80) if of[k] == g) for g in of}

    for threshold in (0.45, 0.6, 0.7):
        for ask in (np.arange(80), np.arange(0, 80, 3)):
            got = near_dup.joins(np.concatenate(sets), first, before, ask, threshold)
            alike = [(a, b) for a in ask for b in range(80) if a != b and len(s[a] & s[b]) >= threshold * len(s[a] | s[b])]
            assert set(got) <= set(alike) and groups(got) == groups(alike)


def test_blocks_of_a_bucket_meet(monkeypatch, make, prose):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    test_pairs = [(100 + 2 * k, 101 + 2 * k) for k in range(10)]
    passage = prose(132, 8)
    rows = [(i, " ".join(passage + prose(100, 500 + i))) for i in range(90)]
    for k, p in enumerate(test_pairs):
        rows += [(x, " ".join(passage + prose(60, 900 + k) + prose(40, 2000 + x))) for x in p]
    got = {r.doc_id: r.group_id for r in near_dup.near_duplicates(make(rows, clash=False)).collect()}
    assert all(got.get(a) == got.get(b) == a for a, b in test_pairs) and len(got) == 20


def test_one_of_each_group_stays(make, prose):
    a, b = " ".join(prose(50, 1)), " ".join(prose(50, 2))
    df = make([(5, a), (3, a), (9, b), *ODD])
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 100) == [3, 9]
    assert kept.where("doc_id IS NULL").count() == 1 and kept.where("doc_id = 101").count() == 1


def test_empty_table(make):
    assert near_dup.near_duplicates(make([])).collect() == []
    assert near_dup.drop_near_duplicates(make([])).collect() == []


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**48, 800).astype(np.uint64), rng.integers(0, 2**48, 800).astype(np.uint64)
    both = np.concatenate([a, b])
    k = [near_dup.registers(np.sort(x), np.array([0]))[0] for x in (a, b, both)]
    assert (near_dup.merge(k[0], k[1]) == k[2]).all()
    for j in (0.2, 0.5, 0.8, 0.95):
        n = 1000
        same = int(2 * n * j / (1 + j))
        out = []
        for t in range(40):
            x = np.random.default_rng(t).integers(0, 2**48, 2 * n).astype(np.uint64)
            u, v = x[:n], np.concatenate([x[:same], x[n : 2 * n - same]])
            ku, kv = (near_dup.registers(np.sort(s), np.array([0])) for s in (u, v))
            out.append(near_dup.similarity(ku.astype(int), kv.astype(int), np.array([1.0 * n]), np.array([1.0 * n]))[0])
        assert abs(np.mean(out) - j) < 0.03
        assert np.std(out) < near_dup.MARGIN / 2.5


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(_graph, "FEW", few)
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(5, 5), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.id: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 110, 20000).astype(np.uint8)
    buf[rng.integers(0, 20000, 2500)] = 32
    buf[5000:9000] = 97
    whole = tx.words(buf, np.array([0, 3000, 20000]))
    for block in (64, 1000, 3999, 4000, 4001):
        monkeypatch.setattr(tx, "BLOCK", block)
        assert (tx.words(buf, np.array([0, 3000, 20000])).hash == whole.hash).all()


@pytest.mark.parametrize("block", [near_dup.BLOCK, 16])
def test_strangers_in_every_bucket_cost_no_pair(monkeypatch, make, prose, block):
    """All bands fall into ten buckets, so each document meets every other one and the least id is a stranger to nearly all."""
    sketch = near_dup._sketch

    def coarse(batches):
        for b in sketch(batches):
            band = [[x % 10 for x in own] for own in b.column("bands").to_pylist()]
            yield b.set_column(b.schema.get_field_index("bands"), "bands", pa.array([sorted(set(x)) for x in band], pa.list_(pa.int64())))

    monkeypatch.setattr(near_dup, "_sketch", coarse)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = [(i, " ".join(prose(150, i))) for i in range(150)]
    for g in range(30):
        base = prose(200, 1000 + g)
        rows += [(1000 + 10 * g + k, " ".join(edited(base, 0.003 * g, 100 * g + k))) for k in range(3)]
    got = {r.doc_id: r.group_id for r in near_dup.near_duplicates(make(rows, clash=False)).collect()}
    pairs = brute(rows)
    ids, top = _graph.roots(*map(np.array, zip(*pairs)))
    assert len(pairs) > 60 and got == dict(zip(ids.tolist(), top.tolist()))


def test_signatures_turn_strangers_away_and_keep_the_like():
    rng = np.random.default_rng(6)
    kept = {0.0: 0, near_dup.THRESHOLD: 0}
    for j in kept:
        for _ in range(300):
            n = 400
            same = int(2 * n * j / (1 + j))
            x = rng.integers(0, 2**48, 2 * n).astype(np.uint64)
            k = [near_dup.registers(np.sort(s), np.array([0])) for s in (x[:n], np.concatenate([x[:same], x[n : 2 * n - same]]))]
            a, b = (np.stack(near_dup.signatures(r), 1).view(np.uint64) for r in k)
            kept[j] += int(near_dup.alike(a, b)[0, 0])
    assert kept[0.0] <= 9 and kept[near_dup.THRESHOLD] >= 296


def test_a_very_long_text_and_its_copy(make, prose):
    base = prose(200_000, 1)
    rows = [(1, " ".join(base)), (2, " ".join(edited(base, 0.05, 2))), (3, " ".join(prose(200_000, 3)))]
    assert {tuple(r) for r in near_dup.near_duplicates(make(rows, clash=False)).collect()} == {(1, 1), (2, 1)}
