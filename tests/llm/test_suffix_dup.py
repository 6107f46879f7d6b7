from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import _text as tx
from leafmill.llm import suffix_dup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_and_common_prefixes(values):
    t = np.array([*values, 0], np.uint64)
    sa, rank = suffix_dup.suffix_array(t)
    x = t.tolist()
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    assert (rank[sa] == np.arange(len(x))).all()
    common = suffix_dup.kasai(t, sa)
    for k in range(1, len(x)):
        i, j, n = sa[k - 1], sa[k], 0
        while i + n < len(x) and j + n < len(x) and x[i + n] == x[j + n]:
            n += 1
        assert common[k] == n


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=6, max_size=60), st.integers(1, 6))
def test_every_window_has_an_anchor(values, w):
    g = np.array(values, np.uint64)
    at = suffix_dup.lowest(g, w)
    for s in range(len(g) - w + 1):
        low = [i for i in range(s, s + w) if g[i] == g[s : s + w].min()]
        assert set(low) <= set(at.tolist())


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 50)), st.sets(st.integers(0, 50)))
def test_merge_by_binary_search(a, b):
    run = lambda s, d: (np.array(sorted(s), np.uint64), np.full(len(s), d), np.full(len(s), d))
    keys, low, high = suffix_dup.merged(run(a, 1), run(b, 2))
    assert keys.tolist() == sorted(a | b)
    assert low.tolist() == [1 if k in a else 2 for k in sorted(a | b)]
    assert high.tolist() == [2 if k in b else 1 for k in sorted(a | b)]


def brute(rows, n):
    held, where = [], defaultdict(set)
    for i, text, *_ in rows:
        if i is None:
            continue
        w = tx.words(*tx.utf8(pa.array([text], pa.string()))).hash.tolist()
        held.append((i, w))
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add(i)
    out = []
    for i, w in held:
        k = 0
        while k <= len(w) - n:
            ids = where[tuple(w[k : k + n])]
            if len(ids) < 2:
                k += 1
                continue
            start, least = k, min(ids)
            while k <= len(w) - n and len(where[tuple(w[k : k + n])]) > 1:
                least = min(least, *where[tuple(w[k : k + n])])
                k += 1
            out.append((i, start, k - 1 - start + n, least))
    return sorted(out)


@pytest.mark.parametrize("shard", [300, 1 << 20])
def test_spans_against_brute_force(make, prose, monkeypatch, shard):
    monkeypatch.setattr(suffix_dup, "SHARD_WORDS", shard)
    passages = [prose(n, n) for n in (19, 20, 21, 45, 80)]
    rows = []
    for i in range(40):
        words = prose(30 + i, 500 + i)
        if i % 2:
            words[i % 20 : i % 20] = passages[i % 5]
        if i % 8 == 1:
            words += passages[3] + passages[4]
        rows.append((i, " ".join(words)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), *ODD, (120, "w " * 500)]
    got = sorted(tuple(r) for r in suffix_dup.repeated_passages(make(rows), min_words=20).collect())
    assert got == brute(rows, 20)


def test_repeats_within_one_document_do_not_count(make, prose):
    p = " ".join(prose(70, 1))
    assert suffix_dup.repeated_passages(make([(1, p + " and " + p), (2, None), (3, "short")])).collect() == []


def test_empty_table_and_bad_parameter(make):
    assert suffix_dup.repeated_passages(make([])).collect() == []
    with pytest.raises(ValueError):
        suffix_dup.repeated_passages(make([]), min_words=1)


def test_ranges_follow_the_keys(make, prose, monkeypatch):
    rows = [(i, " ".join(prose(120, i % 20) + prose(30, 100 + i))) for i in range(40)]
    whole = sorted(map(tuple, suffix_dup.repeated_passages(make(rows)).collect()))
    monkeypatch.setattr(suffix_dup, "RANGE", 64)
    assert sorted(map(tuple, suffix_dup.repeated_passages(make(rows)).collect())) == whole and len(whole) == 40


def test_very_long_texts(make, prose):
    shared = prose(60_000, 1)
    rows = [(1, " ".join(prose(100_000, 2) + shared)), (2, " ".join(shared + prose(150_000, 3))), (3, " ".join(prose(1000, 4)))]
    assert sorted(map(tuple, suffix_dup.repeated_passages(make(rows)).collect())) == [(1, 100_000, 60_000, 1), (2, 0, 60_000, 1)]
