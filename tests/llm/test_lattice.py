import collections
import math
import re

import numpy as np
import pytest
from conftest_llm import ODD

from leafmill.llm import lattice as la
from leafmill.llm import _text as tx


@pytest.fixture(scope="module")
def toy():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"aba", b"bb", "é".encode(), b" ab"]
    rng = np.random.default_rng(0)
    p = rng.random(len(pieces) + 256)
    ids = np.arange(256) + len(pieces)
    return la.Vocabulary(pieces + [b""] * 256, ids, np.log(p / p.sum())), pieces


def segmentations(word, pieces, byte_ids):
    """All ways to cut a word into pieces; characters that aren't pieces into bytes."""
    if not word:
        yield ()
        return
    first = word.decode()[0].encode() if (word[0] & 0xC0) != 0x80 else b""
    if first and first not in pieces:
        for rest in segmentations(word[len(first) :], pieces, byte_ids):
            yield (*(int(byte_ids[b]) for b in first), *rest)
    for i, p in enumerate(pieces):
        if word.startswith(p):
            for rest in segmentations(word[len(p) :], pieces, byte_ids):
                yield (i, *rest)


def lattice(voc, words):
    off = np.cumsum([0] + [len(w) for w in words])
    return la.Lattice(voc, np.frombuffer(b"".join(words), np.uint8), off)


def test_marginals_and_counts_against_enumeration(toy):
    voc, pieces = toy
    words = [x.encode() for x in (" a", " ab", " ababb", " bbabé", " ü", " aüb", " é日a", " aaaaaaa")]
    count = np.arange(1.0, len(words) + 1)
    z, expected = [], np.zeros(voc.size)
    for w, c in zip(words, count):
        ways = list(segmentations(w, pieces, voc.byte_ids))
        p = np.array([math.exp(sum(voc.initial[i] for i in way)) for way in ways])
        z.append(math.log(p.sum()))
        for way, x in zip(ways, p / p.sum()):
            for i in way:
                expected[i] += c * x
    own = lattice(voc, words)
    assert np.allclose(own.probability(voc.initial), z)
    assert np.allclose(own.expected(voc.initial, count), expected)


def test_very_long_words_do_not_underflow(toy):
    voc, _ = toy
    (x,) = lattice(voc, [b" " + b"ab" * 3000]).probability(voc.initial)
    assert np.isfinite(x) and x < -1000


UNIT = re.compile(r"[\t\n\v\f]| *[^ \t\n\v\f]+| +")


def units(text):
    return [u.encode() for u in UNIT.findall(" " + text)] if text else []


def test_units_of_the_corpus_are_all_counted(make):
    rows = [(1, "the cat\tthe\n\n"), (2, "the  dog "), (3, "  "), (4, "\r\n x\r"), *ODD]
    got = {bytes(r.word): r.n for r in la.word_table(make(rows)).collect()}
    want = collections.Counter(u for _, t, *_ in rows for u in units(t))
    assert got == want and got[b" the"] == 2 and got[b"\n"] > 2 and got[b" w"] == 3000


def test_whole_texts_against_enumeration():
    """The sum over all segmentations of the whole text, with blanks, runs of them and newlines, is that of its units."""
    pieces = [b" ", b"  ", b"    ", b"a", b"ab", b" a", b" ab", b"b", b"a\r", b" \r"]
    p = np.random.default_rng(1).random(len(pieces) + 256)
    voc = la.Vocabulary(pieces + [b""] * 256, np.arange(256) + len(pieces), np.log(p / p.sum()))
    for text in ("ab  a", " a", "  ", "\n\na b", "a\r\n  ab", "b \n", "a    b\t ", "\x0b a"):
        ways = segmentations(b" " + text.encode(), pieces, voc.byte_ids)
        want = math.log(sum(math.exp(sum(voc.initial[i] for i in way)) for way in ways))
        buf, start, end, _, first = la._units(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert [buf[a:b].tobytes() for a, b in zip(start, end)] == units(text) and first.tolist() == [0, len(start)]
        assert abs(la.Lattice(voc, *la._packed(buf, start, end)).probability(voc.initial).sum() - want) < 1e-9


def test_scores_against_one_document_at_a_time(make, prose):
    rows = [(i, "  ".join(prose(40, i)) + "\n\n") for i in range(30)] + ODD
    df = make(rows)
    voc = la.vocabulary(la.VOCABULARY)
    adapted = la.trained(la.word_table(df))
    live = np.isfinite(voc.initial)
    for score in (voc.initial, adapted):
        assert abs(np.exp(score[live]).sum() - 1) < 1e-9
    got = la.language_model(df).collect()
    assert len(got) == len(rows)
    for name, score in (("log_prob", voc.initial), ("corpus_log_prob", adapted)):
        want = {i: float(lattice(voc, units(text)).probability(score).sum()) if text else 0.0 for i, text, *_ in rows}
        for r in got:
            assert abs(r[name] - want[r.doc_id]) < 1e-6 * max(1, abs(want[r.doc_id]))
    for r in got:
        assert (r.bits_per_byte is None) == (r.corpus_bits_per_byte is None) == (r.n_bytes == 0)


def test_own_scores_do_not_depend_on_the_corpus(make, prose):
    rows = [(i, " ".join(prose(40, i))) for i in range(5)]
    alone = la.language_model(make(rows[:1])).first()
    (within,) = la.language_model(make(rows + [(9, "zz qq " * 500)])).where("doc_id = 0").collect()
    assert alone.log_prob == within.log_prob and alone.corpus_log_prob != within.corpus_log_prob


def test_white_space_is_scored(make):
    got = {r.doc_id: r for r in la.language_model(make([(1, "word"), (2, "word" + "\n" * 5000), (3, " " * 500), (4, "word" + "\n" * 2500)])).collect()}
    assert abs(got[2].log_prob - got[1].log_prob - 2 * (got[4].log_prob - got[1].log_prob)) < 1e-6 * abs(got[2].log_prob) and got[4].log_prob < got[1].log_prob - 2500
    assert all(got[i].bits_per_byte > 0.5 for i in got)


def test_a_very_long_text_is_scored_whole(make, prose):
    text = " ".join(prose(2000, 1))
    got = {r.doc_id: r for r in la.language_model(make([(1, text), (2, " ".join([text] * 300)), (3, "x" * 40_000)])).collect()}
    assert abs(got[2].log_prob - 300 * got[1].log_prob) < 1e-6 * abs(got[2].log_prob)
    assert got[3].n_bytes == 40_000 and np.isfinite(got[3].log_prob)


def test_training_raises_the_likelihood(make, prose):
    df = make([(i, " ".join(prose(60, i))) for i in range(40)])
    words = la.word_table(df).persist()
    total = [la.scored(df, {"": la.trained(words, iterations=k)}).agg({"log_prob": "sum"}).first()[0] for k in range(4)]
    assert total[0] < total[1] < total[2] < total[3]


def test_empty_table(make):
    assert la.language_model(make([])).collect() == []


def test_hash_of_packed_words():
    buf = np.frombuffer(b"ab cde", np.uint8)
    flat, off = la._packed(buf, np.array([0, 3]), np.array([2, 6]))
    assert flat.tobytes() == b"abcde" and off.tolist() == [0, 2, 5]
    assert tx.span_hash(flat, np.array([0]), np.array([2]))[0] == tx.span_hash(buf, np.array([0]), np.array([2]))[0]
