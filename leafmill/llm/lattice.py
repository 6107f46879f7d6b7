"""Operator 9: the marginal probability of a document under a subword unigram model.

The pieces of an existing vocabulary, weighted by the vocabulary's own scores, span a
lattice over the whole text, white space included; the forward recursion in log space sums
over all segmentations.  The text, with the vocabulary's word mark before it, is cut where
no piece can cross: before a run of blanks, and on either side of white space that occurs
in no longer piece.  A document's log probability is the sum of these units', and each
distinct unit is scored once a task.

A merge-ordered vocabulary scores pieces by rank, which are weights but no probabilities:
a piece of rank r weighs 1 / r, normalised.  Beside it stands the probability under
weights adapted to the corpus: expectation-maximisation starts from the vocabulary's and
counts pieces, over all segmentations, in all documents.  The corpus is gathered into a
table of distinct units with counts; iterations read only that table.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._store import written

U64 = np.uint64
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ITERATIONS = 2
#: Expected counts added to each piece, so that unseen ones stay possible.
PRIOR = 0.1
#: Units and bytes of a lattice pass, bytes of text of a chunk.
UNITS, BYTES, CHUNK = 1 << 15, 1 << 20, 2 << 20
_FILTER = 20
#: White space that no piece holds beside other characters (tested when a vocabulary is loaded).
_ALONE = np.zeros(256, bool)
_ALONE[[9, 10, 11, 12]] = True


class Vocabulary:
    """Pieces as bytes (word mark as a blank), byte pieces and initial log probabilities."""

    def __init__(self, pieces: list[bytes], byte_ids: np.ndarray, scores: np.ndarray):
        self.byte_ids, self.size = byte_ids, len(scores)
        self.initial = np.asarray(scores, float)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(p) for p in pieces])
        for n in sorted(set(lengths[lengths > 0].tolist())):
            ids = np.flatnonzero(lengths == n)
            buf = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8)
            at = np.arange(len(ids)) * n
            h = tx.span_hash(buf, at, at + n)
            order = np.argsort(h)
            seen = np.zeros(1 << _FILTER, bool)
            seen[(h >> U64(64 - _FILTER)).astype(np.int64)] = True
            self.by_length[n] = h[order], ids[order], seen


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, bytes_, weight = [], np.zeros(256, np.int64), np.full(n, -np.inf)
    for i in range(n):
        if sp.is_byte(i):
            bytes_[int(sp.id_to_piece(i)[3:5], 16)] = i
            weight[i] = 1 / n
        plain = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        pieces.append(sp.id_to_piece(i).replace("▁", " ").encode() if plain else b"")
        if plain:
            weight[i] = 1 / (1 - sp.get_score(i)) if sp.get_score(i) <= 0 else 1.0
        if any(len(pieces[i]) > 1 and b in pieces[i] for b in b"\t\n\v\f") or b" " in pieces[i].lstrip(b" "):
            raise ValueError(f"piece {i} of {path} crosses the cuts before blanks or beside white space")
    total = weight[weight > 0].sum()
    return Vocabulary(pieces, bytes_, np.where(weight > 0, np.log(np.maximum(weight, 1e-300) / total), -np.inf))


class Lattice:
    """All segmentations of words given as one buffer; word w is bytes off[w] to off[w + 1]."""

    def __init__(self, voc: Vocabulary, buf: np.ndarray, off: np.ndarray):
        n, self.words = len(buf), len(off) - 1
        word = np.repeat(np.arange(self.words), np.diff(off))
        at = np.arange(n) - off[word]
        left = off[word + 1] - np.arange(n)  # bytes from here to the word's end
        p, q = tx.powers(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(tx._TABLE[buf] * p[:-1], out=total[1:])
        lead = (buf & 0xC0) != 0x80
        wide = np.where(buf >= 0xF0, 4, np.where(buf >= 0xE0, 3, np.where(buf >= 0xC0, 2, 1)))
        known = ~lead
        starts, lengths, pieces = [], [], []
        for size, (hashes, ids, seen) in voc.by_length.items():
            s = np.flatnonzero((left >= size) & lead)
            h = tx.mix((total[s + size] - total[s]) * q[s])
            hit = seen[(h >> U64(64 - _FILTER)).astype(np.int64)]
            s, h = s[hit], h[hit]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[k] == h
            s, k = s[hit], k[hit]
            if size <= 4:
                known[s[wide[s] == size]] = True
            starts.append(s), lengths.append(np.full(len(s), size)), pieces.append(ids[k])
        bare = np.flatnonzero(~known)  # characters that aren't pieces fall back to bytes
        for k in range(4):
            s = bare[wide[bare] > k] + k
            s = s[s < n]
            starts.append(s), lengths.append(np.ones(len(s), np.int64)), pieces.append(voc.byte_ids[buf[s]])
        s, size, self.piece = (np.concatenate(x) for x in (starts, lengths, pieces))
        end = at[s] + size
        order = np.argsort(end * (n + self.words + 1) + s + word[s])
        s, size, end, self.piece = s[order], size[order], end[order], self.piece[order]
        self.word = word[s]
        self.tail = s + self.word  # nodes: one before each byte, one after each word
        self.head = self.tail + size
        self.steps = np.searchsorted(end, np.arange(1, int(np.diff(off).max(initial=0)) + 2))
        self.nodes, self.first, self.last = n + self.words, off[:-1] + np.arange(self.words), off[1:] + np.arange(self.words)

    def forward(self, score: np.ndarray) -> np.ndarray:
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.first] = 0
        weight = score[self.piece]
        for a, b in zip(self.steps[:-1], self.steps[1:]):
            if a < b:
                # edges of a step end at its own nodes only, but are in order of their starts
                _add(alpha, self.head[a:b], alpha[self.tail[a:b]] + weight[a:b])
        return alpha

    def backward(self, score: np.ndarray) -> np.ndarray:
        beta = np.full(self.nodes, -np.inf)
        beta[self.last] = 0
        weight = score[self.piece]
        place = self.tail - self.first[self.word]
        order = np.argsort(place * self.nodes + self.tail)
        cut = np.searchsorted(place[order], np.arange(int(place.max(initial=0)) + 2))
        for a, b in zip(cut[:-1][::-1], cut[1:][::-1]):
            if a < b:
                e = order[a:b]
                _add(beta, self.tail[e], beta[self.head[e]] + weight[e])
        return beta

    def probability(self, score: np.ndarray) -> np.ndarray:
        """Log probability of each word."""
        return self.forward(score)[self.last]

    def expected(self, score: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected number of each piece over the words' segmentations, words weighted by count."""
        alpha, beta = self.forward(score), self.backward(score)
        z = alpha[self.last][self.word]
        share = np.exp(alpha[self.tail] + score[self.piece] + beta[self.head] - z) * count[self.word]
        return np.bincount(self.piece, np.nan_to_num(share), len(score))


def _add(total: np.ndarray, node: np.ndarray, x: np.ndarray) -> None:
    """total[node] = log of the sum of exp(x) of equal nodes, which are neighbours or nearly so."""
    if len(node) > 1 and (node[1:] < node[:-1]).any():
        order = np.argsort(node, kind="stable")
        node, x = node[order], x[order]
    new = np.ones(len(node), bool)
    new[1:] = node[1:] != node[:-1]
    at = np.flatnonzero(new)
    top = np.maximum.reduceat(x, at)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        total[node[at]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, np.diff(np.append(at, len(node))))), at))


def _units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, hash, document's first unit) of the units; the bytes are those of the texts, a blank before each that isn't empty."""
    n = np.diff(off)
    mark = np.repeat(off[:-1], n > 0)
    flat = np.insert(buf, mark, 32)
    first = off + np.concatenate([[0], np.cumsum(n > 0)])
    blank, alone = flat == 32, _ALONE[flat]
    begin = np.ones(len(flat), bool)
    begin[1:] = alone[1:] | alone[:-1] | (blank[1:] & ~blank[:-1])
    begin[first[:-1][n > 0]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(flat))[: len(start)]
    return flat, start, end, tx.span_hash(flat, start, end), np.searchsorted(start, first)


def _packed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans as one buffer and their offsets."""
    n = end - start
    off = np.concatenate([[0], np.cumsum(n)])
    return buf[np.repeat(start - off[:-1], n) + np.arange(off[-1])], off


def _slices(n: np.ndarray) -> Iterator[slice]:
    """Runs of units of n bytes each, UNITS at most and about BYTES together."""
    off, lo = np.concatenate([[0], np.cumsum(n)]), 0
    while lo < len(n):
        hi = min(lo + UNITS, max(lo + 1, int(np.searchsorted(off, off[lo] + BYTES, "right")) - 1))
        yield slice(lo, hi)
        lo = hi


class _Seen:
    """Distinct units of a task with `width` values each, sorted by hash."""

    def __init__(self, width: int = 1):
        self.hash, self.value = np.zeros(0, U64), np.zeros((0, width))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hash, h)
        ok = at < len(self.hash)
        ok[ok] = self.hash[at[ok]] == h[ok]
        return at, ok

    def insert(self, h: np.ndarray, value: np.ndarray) -> None:
        at = np.searchsorted(self.hash, h)
        self.hash, self.value = np.insert(self.hash, at, h), np.insert(self.value, at, value, 0)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, held = _Seen(), []

    def flush() -> pa.RecordBatch:
        hashes, texts = np.concatenate([h for h, _ in held]), pa.concat_arrays([t for _, t in held])
        return pa.RecordBatch.from_arrays([texts, pa.array(seen.value[np.searchsorted(seen.hash, hashes), 0].astype(np.int64))], ["word", "n"])

    for batch in batches:
        for _, _, buf, off in tx.chunks(batch.column(0), CHUNK):
            buf, start, end, h, _ = _units(buf, off)
            if not len(h):
                continue
            h, at, n = np.unique(h, return_index=True, return_counts=True)
            where, ok = seen.find(h)
            seen.value[where[ok], 0] += n[ok]
            new = ~ok
            if new.any():
                flat, cut = _packed(buf, start[at[new]], end[at[new]])
                held.append((h[new], pa.Array.from_buffers(pa.binary(), int(new.sum()), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])))
                seen.insert(h[new], n[new, None])
        if len(seen.hash) > 2_000_000:
            yield flush()
            seen, held = _Seen(), []
    if held:
        yield flush()


def _expectation(path: str, score: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, total = vocabulary(path), np.zeros(len(score))
        for batch in batches:
            count = batch.column(1).to_numpy().astype(float)
            buf, off = tx.utf8(batch.column(0))
            for own in _slices(np.diff(off)):
                cut = off[own.start : own.stop + 1]
                total += Lattice(voc, buf[cut[0] : cut[-1]], cut - cut[0]).expected(score, count[own])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    return run


def _sum(part: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x) for x in part.column("total").to_pylist()], 0)
    return pa.table({"part": pa.array([0], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})


def word_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): every distinct unit of the corpus, most of them words after a blank, and how often it occurs."""
    return docs.select(F.col(f"`{text_col}`")).mapInArrow(_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def trained(words: DataFrame, path: str = VOCABULARY, iterations: int = ITERATIONS) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces by expectation-maximisation over a word table."""
    voc = vocabulary(path)
    score = voc.initial
    for _ in range(iterations):
        got = words.mapInArrow(_expectation(path, score), "part int, total binary").groupBy("part").applyInArrow(_sum, "part int, total binary").collect()
        count = np.frombuffer(got[0].total) if got else np.zeros(len(score))
        count = np.where(np.isfinite(voc.initial), count + PRIOR, 0)
        with np.errstate(divide="ignore"):
            score = np.log(count / count.sum())
    return score


def _scores(path: str, scores: list[np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, seen = vocabulary(path), _Seen(len(scores))
        for batch in batches:
            for i, j, text, off in tx.chunks(batch.column(1), CHUNK):
                buf, start, end, h, first = _units(text, off)
                one, at, back = np.unique(h, return_index=True, return_inverse=True)
                _, ok = seen.find(one)
                new = np.flatnonzero(~ok)
                for part in _slices((end - start)[at[new]]):
                    own = new[part]
                    lattice = Lattice(voc, *_packed(buf, start[at[own]], end[at[own]]))
                    seen.insert(one[own], np.stack([lattice.probability(x) for x in scores], 1))
                value = seen.value[np.searchsorted(seen.hash, one)][back]
                doc = np.repeat(np.arange(j - i), np.diff(first))
                total = [pa.array(np.bincount(doc, x, j - i)) for x in value.T]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off)), *total], ["doc_id", "n_bytes", *(f"p{k}" for k in range(len(total)))])
            if len(seen.hash) > 3_000_000:
                seen = _Seen(len(scores))

    return run


def scored(docs: DataFrame, scores: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes) and for each name of piece scores (name + log_prob, name + bits_per_byte).

    Every row gives a row, whatever its id.  Null and empty texts have log probability 0 and
    null bits per byte.  All bytes of a text are scored, white space too, and a word however
    long it is.  Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    got = docs.mapInArrow(_scores(path, list(scores.values())), "doc_id bigint, n_bytes bigint, " + ", ".join(f"p{k} double" for k in range(len(scores))))
    bits = lambda k: F.when(F.col("n_bytes") > 0, -F.col(f"p{k}") / F.lit(float(np.log(2))) / F.col("n_bytes"))
    return got.select("doc_id", "n_bytes", *(c for k, x in enumerate(scores) for c in (F.col(f"p{k}").alias(x + "log_prob"), bits(k).alias(x + "bits_per_byte"))))


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, iterations: int = ITERATIONS) -> DataFrame:
    """`scored` under the vocabulary's own scores (log_prob, bits_per_byte) and those adapted to docs (corpus_log_prob, corpus_bits_per_byte)."""
    adapted = trained(written(word_table(docs, text_col)), path, iterations)
    return scored(docs, {"": vocabulary(path).initial, "corpus_": adapted}, id_col, text_col, path)
