import pytest
from conftest_llm import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import bpe

SMALL = bpe.Codec(bpe.VOCABULARY, leaf=7)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t'rvesdmlt19!é日  \x1f\U0001f600aZ")), max_size=150))
def test_tree_equals_encoding_at_once(text):
    tokens = SMALL.encode(text)
    assert tokens.tolist() == SMALL.whole(text).tolist()
    assert SMALL.decode(tokens) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_text_round_trips(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    tokens = SMALL.encode(text)
    assert tokens.tolist() == SMALL.whole(text).tolist() and SMALL.decode(tokens) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000 + "x", "ab " * 4000, "'re" * 900, "\n" * 3000])
def test_long_runs(text):
    assert SMALL.encode(text).tolist() == SMALL.whole(text).tolist()


def test_joining_is_associative():
    text = "It's we'll  see\n\n 12 ab'r e  x" * 3
    whole = SMALL.whole(text).tolist()
    for a in range(1, len(text), 5):
        for b in range(a + 1, len(text), 7):
            x, y, z = (SMALL.whole(t) for t in (text[:a], text[a:b], text[b:]))
            left = SMALL.join(text, 0, b, len(text), SMALL.join(text, 0, a, b, x, y), z)
            right = SMALL.join(text, 0, a, len(text), x, SMALL.join(text, a, b, len(text), y, z))
            assert left.tolist() == right.tolist() == whole


def test_tables(make):
    rows = [*ODD, (1, "hello world " * 2000)]
    got = bpe.encoded(make(rows))
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert by[101].tokens is None and by[101].n_tokens is None and by[102].tokens == [] and by[1].exact
    back = {r.doc_id: r.text for r in bpe.decoded(got).collect()}
    assert all(back[r[0]] == r[1] for r in rows)
    assert bpe.encoded(make([])).collect() == [] and bpe.decoded(bpe.encoded(make([]))).collect() == []
