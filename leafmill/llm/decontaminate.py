"""Operator 6: documents that hold passages of a benchmark, up to edits.

A passage of n words is held by a document where some run of the document's words is
within edit distance k = floor(max_edit * n) of it (insertions, deletions and
substitutions of words).

1. *Necessary condition.*  k edits change at most 2k of an item's n - 1 word 2-grams, so a
   window of n words at the match holds at least n - 1 - 2k of the 2-grams of the items of
   n words.
   Windows below that are passed over; none that could match is.
2. *Embedding.*  The others go through the CGK random walk, which maps edit distance to
   Hamming distance: step t copies the current word and moves on by a random bit of
   (t, word).  Repeated bit-sampling LSH, each repetition with its own walk and sample of
   coordinates, compares windows with the items of their length.  Items so long that no
   number of repetitions within LIMIT reaches the recall go without: for them every window
   that passes the count is aligned.
3. *Verification.*  Each pair that collides is aligned exactly (Sellers' dynamic program
   over the region around the window).

The benchmark's index goes to each task in blocks of at most BLOCK items, so its size is
bounded however many items there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._store import free, small, written

U64 = np.uint64
MAX_EDIT = 0.15
RECALL = 0.95
SAMPLE = 4
#: Items whose index a task holds at once (some 4 MB); a larger benchmark takes one pass a block.
BLOCK = 20_000
#: Items of more than LONG words, or that would take over LIMIT repetitions, aren't embedded: all windows that pass the count are aligned.
LONG, LIMIT = 1000, 400
#: Bytes of windows that a task gathers before it embeds them.
HELD = 64 << 20


def edited(words: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """words after k random insertions, deletions and substitutions."""
    out = words.tolist()
    for _ in range(k):
        at, kind = int(rng.integers(0, max(1, len(out)))), int(rng.integers(0, 3))
        new = int(rng.integers(1, 2**62))
        out[at : at + (kind < 2)] = [] if kind == 0 else [new]
    return np.array(out, U64)


def repetitions(n: int, k: int, recall: float = RECALL) -> int | None:
    """Repetitions that the recall aimed at takes for strings k edits apart, found by simulation on 200 pairs; None beyond LIMIT."""
    if k == 0:
        return 1
    if n > LONG:
        return None
    rng = np.random.default_rng([n, k])
    a = rng.integers(1, 2**62, (200, n)).astype(U64)
    b = np.stack([np.concatenate([edited(x, k, rng), rng.integers(1, 2**62, k).astype(U64)])[:n] for x in a])
    found = np.zeros(200, bool)
    for r, (x, y) in enumerate(zip(tables(a, n, k, LIMIT), tables(b, n, k, LIMIT))):
        found |= x == y
        if found.mean() >= recall:
            return r + 1
    return None


def embed(words: np.ndarray, n: int, seed: int, steps: np.ndarray) -> np.ndarray:
    """CGK embeddings of rows of n word hashes, at the sampled steps (0 past the end)."""
    rows = np.arange(len(words))
    at = np.zeros(len(words), np.int64)
    padded = np.concatenate([words, np.zeros((len(words), 1), U64)], 1)
    out = np.zeros((len(words), len(steps)), U64)
    coin = np.random.default_rng(seed).integers(1, 2**63, int(steps.max()) + 1, dtype=np.int64).view(U64) | U64(1)
    order = {int(s): k for k, s in enumerate(steps)}
    for t in range(int(steps.max()) + 1):
        x = padded[rows, at]
        if t in order:
            out[:, order[t]] = x
        at = np.minimum(at + ((x * coin[t]) >> U64(63)).astype(np.int64), n)
    return out


def tables(words: np.ndarray, n: int, k: int, repeat: int) -> Iterator[np.ndarray]:
    """For each repetition, the LSH key of every row of n words."""
    for r in range(repeat):
        rng = np.random.default_rng([n, r])
        steps = rng.choice(2 * n, min(SAMPLE, 2 * n), replace=False) if k else np.arange(2 * n)  # later ones are mostly past the end
        key = np.full(len(words), U64(r + 1))
        for column in embed(words, n, 1000 * n + r, steps).T:
            key = tx.mix(key * U64(31) + column)
        yield key


def distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(least edit distance of item to a run of region, the run's end): Sellers' algorithm."""
    row = np.zeros(len(region) + 1, np.int64)
    step = np.arange(len(region) + 1)
    for i, x in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != x))
        row = np.minimum.accumulate(new - step) + step
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """A block of benchmark items, as tasks need it."""

    def __init__(self, ids: list[int], texts: list[str], max_edit: float):
        self.words, self.ids = [], []
        for i, w in zip(ids, texts):
            h = tx.words(*tx.utf8(pa.array([w], pa.string()))).hash
            if len(h):
                self.ids.append(i)
                self.words.append(h)
        self.edits = {n: int(max_edit * n + 1e-9) for n in {len(w) for w in self.words}}
        self.repeat = {n: repetitions(n, k) for n, k in self.edits.items()}
        self.by_length = {n: np.flatnonzero([len(w) == n for w in self.words]) for n in self.edits}
        self.whole, self.buckets = {}, {}
        for n, own in self.by_length.items():
            rows = np.stack([self.words[i] for i in own])
            if self.edits[n] == 0:
                self.whole[n] = np.unique(np.concatenate([tx.ngram(r, n) for r in rows]))
            self.buckets[n] = []
            for key in tables(rows, n, self.edits[n], self.repeat[n] or 0):
                order = np.argsort(key)
                self.buckets[n].append((key[order], own[order]))
        # for each bucket of 2-grams, a bit for each length of the items that hold one (modulo 64)
        self.bits = max(12, (16 * sum(len(w) for w in self.words)).bit_length())
        self.grams = np.zeros(1 << self.bits, U64)
        for w in self.words:
            np.bitwise_or.at(self.grams, self._bucket(w), U64(1 << (len(w) % 64)))

    def _bucket(self, words: np.ndarray) -> np.ndarray:
        return (tx.ngram(words, 2) >> U64(64 - self.bits)).astype(np.int64)

    def windows(self, w: tx.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length n, document, first word, words around) of the chunk's windows that may match, in slices; around: n before, the window, n + k after."""
        h, doc, total = w.hash, w.doc, len(w.hash)
        if not total:
            return
        mask = self.grams[self._bucket(h)] if total > 1 else np.zeros(0, U64)
        at = np.flatnonzero(mask)
        at = at[doc[at] == doc[np.minimum(at + 1, total - 1)]]
        found = mask[at]
        for n, k in self.edits.items():
            if k:
                start = _dense(at[(found & U64(1 << (n % 64))) != 0], n, max(1, n - 1 - 2 * k))
                # windows may pass a document's end by the k words that deletions save
                start = start[start + n - k <= w.first[doc[start] + 1]]
            else:
                g = tx.ngram(h, n)
                start = np.flatnonzero(doc[: len(g)] == doc[n - 1 :])
                x = g[start]
                near = np.minimum(np.searchsorted(self.whole[n], x), len(self.whole[n]) - 1)
                start = start[self.whole[n][near] == x]
            step = max(1, HELD // (32 * (3 * n + k)))
            for i in range(0, len(start), step):
                own = start[i : i + step]
                d = doc[own]
                place = own[:, None] + np.arange(-n, 2 * n + k)
                inside = (place >= w.first[d][:, None]) & (place < w.first[d + 1][:, None])
                yield n, d, own - w.first[d], np.where(inside, h[np.clip(place, 0, total - 1)], U64(0))

    def matches(self, n: int, doc: np.ndarray, start: np.ndarray, around: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, distance, first word) of the verified pairs among windows for items of n words, the best of each."""
        k, best, pairs = self.edits[n], {}, defaultdict(list)
        if self.repeat[n] is None:
            for r, d in enumerate(doc.tolist()):
                for item in self.by_length[n]:
                    pairs[(d, int(item))].append(r)
        for key, (sorted_, own) in zip(tables(around[:, n : 2 * n], n, k, self.repeat[n] or 0), self.buckets[n]):
            a, b = np.searchsorted(sorted_, key), np.searchsorted(sorted_, key, "right")
            for r in np.flatnonzero(b > a):
                for item in own[a[r] : b[r]]:
                    pairs[(int(doc[r]), int(item))].append(int(r))
        for (d, item), rows in pairs.items():
            done = -1
            for r in sorted(set(rows), key=lambda r: start[r]):
                s = int(start[r])
                if s <= done:  # inside a region that was aligned already
                    continue
                done = s + n // 2
                e, stop = distance(self.words[item], around[r])
                found = (e, max(0, s + stop - 2 * n))
                name = (d, self.ids[item])
                if e <= k and (name not in best or found < best[name]):
                    best[name] = found
        return [(*name, *found) for name, found in best.items()]


def _dense(grams: np.ndarray, n: int, need: int) -> np.ndarray:
    """First words of the windows of n words that hold `need` of the 2-grams, given where those begin."""
    if len(grams) < need:
        return grams[:0]
    low, high = grams[: len(grams) - need + 1], grams[need - 1 :]
    ok = high - low <= n - 2
    if not ok.any():
        return grams[:0]
    low, high = low[ok], high[ok]
    begin = np.maximum(high - n + 2, 0)  # the windows begin from here to low; low and begin both increase
    begin = np.maximum(begin, np.concatenate([[0], low[:-1] + 1]))
    size = low - begin + 1
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _scan(index: Index) -> Callable:
    def moved(i: int, w: tx.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for n, d, start, around in index.windows(w):
            yield n, d + i, start, around

    def found(ids: np.ndarray, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        rows = [x for n, parts in held.items() for x in index.matches(n, *map(np.concatenate, zip(*parts)))]
        if rows:
            d, item, e, s = map(np.array, zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(item), pa.array(e), pa.array(s)], ["doc_id", "item_id", "edits", "start_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, waiting = tx.int64(batch.column(0)), defaultdict(list), 0
            for n, d, start, around in (x for i, _, buf, off in tx.chunks(batch.column(1)) for x in moved(i, tx.words(buf, off))):
                held[n].append((d, start, around))
                waiting += around.nbytes
                if waiting > HELD:
                    yield from found(ids, held)
                    held, waiting = defaultdict(list), 0
            yield from found(ids, held)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_edit: float = MAX_EDIT) -> DataFrame:
    """(doc_id, item_id, edits, start_word): the benchmark items that a document holds up to floor(max_edit * words) word edits.

    One row for each document and item, with the least distance found and about where the
    match begins (in words from 0).  Case and punctuation don't matter.  Items and documents
    that are null or hold no word match nothing; rows without an id are left out.  Rows that
    repeat an id count as one document or item with several texts.  Other columns are
    ignored, and either table may be empty.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text <> ''")
    items = benchmark.select(F.col(f"`{item_col}`").cast("bigint").alias("i"), F.col(f"`{item_text_col}`").alias("t")).where("i IS NOT NULL AND t <> ''").distinct()
    out, held = None, []
    kind = "doc_id bigint, item_id bigint, edits bigint, start_word bigint"

    def block() -> DataFrame:
        index = Index([r.i for r in held], [r.t for r in held], max_edit)
        found = docs.mapInArrow(_scan(index), kind)
        return found if out is None else out.union(found)

    for row in items.toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            out, held = block(), []
    if held or out is None:
        out = block()
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start_word")).alias("m")).select("doc_id", "item_id", "m.edits", "m.start_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edit: float = MAX_EDIT) -> DataFrame:
    """docs without the documents that hold a benchmark item; every column stays as it is.

    Rows without an id stay, as do null and empty texts.
    """
    leak = free(docs, "leak")
    found = written(leaks(docs, benchmark, id_col, text_col, max_edit=max_edit).select(F.col("doc_id").alias(leak)).distinct())
    return docs.join(small(found), F.col(f"`{id_col}`").cast("bigint") == F.col(leak), "left_anti")
