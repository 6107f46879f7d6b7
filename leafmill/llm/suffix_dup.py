"""Operator 4: passages that repeat across documents, by suffix arrays.

1. *Anchors.*  Every 26 consecutive 25-grams of words choose the one of least hash.  A
   passage of 50 words contains a chosen 25-gram, the same in each of its occurrences, so
   documents without a shared anchor hold no repeat: they need no suffix array.
2. *Shards.*  The other documents are cut into shards.  Each shard's suffix array is
   sorted by Larsson-Sadakane doubling, which only touches suffixes that are still tied;
   Kasai's inequality gives the common prefixes; neighbours that share 50 words form the
   shard's classes of equal passages.
3. *Merging.*  Each shard's classes are a sorted run of keys.  Runs are cut at the same
   splitting keys, so a bucket holds one range of keys of all shards, and merged two by two
   by binary search.  A class occurs in two documents in the whole table or it doesn't;
   that verdict and the least document go back to the shards, which hold whole documents
   and so turn positions into spans without another shuffle.

Only keys and positions travel, in blobs of one row per shard and range.  Shards are
written to the shared folder, so a lost executor costs no recomputation of the whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._store import small, written

U64 = np.uint64
MIN_WORDS = 50
#: Words of a shard; one document may be longer, and is then a shard of its own.
SHARD_WORDS = 1 << 19
#: Bytes of keys that a task merges, about; with documents it holds some eight times as much.
RANGE = 16 << 20
_TOP = U64(1 << 63)


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: (suffix array, rank of each suffix) of t, whose last value must occur once."""
    n = len(t)
    sa = np.argsort(t)
    x = t[sa]
    new = np.ones(n, bool)
    new[1:] = x[1:] != x[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(start, size)
    todo = np.flatnonzero(np.repeat(size, size) > 1)
    h = 1
    while len(todo):
        suffix = sa[todo]
        group, key = rank[suffix], rank[suffix + h]
        pair = group * n + key
        order = np.argsort(pair)
        suffix, pair = suffix[order], pair[order]
        sa[todo] = suffix
        new = np.ones(len(todo), bool)
        new[1:] = pair[1:] != pair[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(todo)))
        rank[suffix] = np.repeat(todo[start], size)
        todo = todo[np.repeat(size, size) > 1]
        h *= 2
    return sa, rank


def kasai(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in sa (0 for the first).

    In text order the prefix shrinks by at most one a step (Kasai).  Where the preceding
    value of a suffix and of its predecessor agree it shrinks by exactly one, so only the
    other suffixes are compared value by value, all at once.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (t[:-1] == t[before[1:] - 1])
    head = np.flatnonzero(~follows)
    length = np.zeros(n, np.int64)
    at = head[before[head] >= 0]
    step = 0
    while len(at):
        a, b = at + step, before[at] + step
        ok = (a < n) & (b < n)
        ok[ok] = t[a[ok]] == t[b[ok]]
        length[at[~ok]] = step
        at = at[ok]
        step += 1
    last = np.maximum.accumulate(np.where(follows, 0, i))
    length = np.where(follows, length[last] - (i - last), length)
    return length[sa]


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every w consecutive values, in constant time each."""
    n = len(x)
    rows = -(-n // w)
    pad = np.full(rows * w, x[-1])
    pad[:n] = x
    block = pad.reshape(rows, w)
    ahead = best.accumulate(block, 1).ravel()
    back = best.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return best(back[: n - w + 1], ahead[w - 1 : n])


def lowest(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the values that are the least of some w consecutive ones; all of equal ones."""
    low = _sliding(g, w, np.minimum)
    edge = np.zeros(w - 1, U64)
    return np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), w, np.maximum) == g)


SHARD = "shard string, size binary, keys binary, docs binary, pos binary"


def _shard(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """A shard's sorted run: keys, the number of members of each, and the members' documents and positions."""
    order = np.argsort(key, kind="stable")
    key, doc, pos = key[order], doc[order], pos[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key))).astype(np.int32)
    blobs = [size, key[start], doc, pos.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["shard", "size", "keys", "docs", "pos"])


def _gathered(batches: Iterator[pa.RecordBatch], of: Callable) -> Iterator[tuple[np.ndarray, ...]]:
    """What `of` makes of chunks of documents, gathered until it has SHARD_WORDS words."""
    held, words = [], 0
    for batch in batches:
        for i, j, buf, off in tx.chunks(batch.column(1)):
            w = tx.words(buf, off)
            held.append(of(batch.slice(i, j - i), w))
            words += len(w.hash)
            if words >= SHARD_WORDS:
                yield [np.concatenate(x) for x in zip(*held)]
                held, words = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _anchor_shards(min_words: int) -> Callable:
    k = max(1, min_words // 2)
    w = min_words - k + 1

    def of(batch: pa.RecordBatch, words: tx.Words) -> tuple[np.ndarray, ...]:
        ids, doc = tx.int64(batch.column(0)), words.doc
        g = tx.ngram(words.hash, k)
        if len(g) < w:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos = lowest(g, w)
        pos = pos[doc[pos] == doc[pos + k - 1]]  # a passage's window lies in one document, and so does its anchor
        return g[pos], ids[doc[pos]], pos - words.first[doc[pos]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, doc, pos in _gathered(batches, of):
            if len(key):
                yield _shard(key, doc, pos)

    return run


def _class_shards(min_words: int) -> Callable:
    k = max(1, min_words // 2)

    def of(batch: pa.RecordBatch, words: tx.Words) -> tuple[np.ndarray, ...]:
        ids, n = tx.int64(batch.column(0)), words.count
        here = np.zeros(len(words.hash) + len(n), bool)
        place = words.first[:-1] + np.arange(len(n))  # with a separator after each document
        text = np.empty(len(here), U64)
        word = np.ones(len(here), bool)
        word[place + n] = False
        text[word], text[~word] = words.hash | _TOP, 0
        owner = np.repeat(ids, n + 1)
        at = np.arange(len(here)) - np.repeat(place, n + 1)
        for d, blob in enumerate(batch.column(2).to_pylist()):
            p = np.frombuffer(blob, np.int32).astype(np.int64)
            p = p[p + k <= n[d]]
            if n[d] < min_words or not len(p):
                continue
            mark = np.zeros(n[d] + 2, np.int64)  # windows that contain an anchor
            np.add.at(mark, np.maximum(p + k - min_words, 0), 1)
            np.add.at(mark, np.minimum(p, n[d] - min_words) + 1, -1)
            here[place[d] : place[d] + n[d]] = np.cumsum(mark)[: n[d]] > 0
            here[place[d] + n[d] - min_words + 1 : place[d] + n[d]] = False
        return text, owner, at, here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, owner, at, here in _gathered(batches, of):
            if not here.any():
                continue
            gap = np.flatnonzero(text == 0)
            text[gap] = np.arange(len(gap))  # separators differ from each other and from words
            sa, _ = suffix_array(text)
            common = kasai(text, sa)
            first = np.maximum.accumulate(np.where(common < min_words, np.arange(len(sa)), 0))  # each class's first suffix
            keep = here[sa]
            first, member = first[keep], sa[keep]
            grams = tx.ngram(text, min_words)
            yield _shard(grams[sa[first]], owner[member], at[member])

    return run


def _blob(column: pa.Array, row: int, kind: type) -> np.ndarray:
    """A binary cell as numbers, without a copy."""
    x = column[row].as_buffer()
    return np.frombuffer(x, kind) if x.size else np.zeros(0, kind)


def _ranges(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                shard = batch.column("shard")[row].as_py()
                size, keys, docs = (_blob(batch.column(c), row, kind) for c, kind in (("size", np.int32), ("keys", U64), ("docs", np.int64)))
                start = np.cumsum(size) - size
                low, high = np.minimum.reduceat(docs, start), np.maximum.reduceat(docs, start)
                cut = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.zeros(1, np.int64)
                cut = np.append(cut, len(keys))
                has = np.flatnonzero(np.diff(cut))
                blob = lambda x: pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in has], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(has), pa.string()), pa.array(has.astype(np.int32)), blob(keys), blob(low), blob(high)], ["shard", "bucket", "keys", "low", "high"])

    return run


def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Merge two sorted runs (keys, low, high) without repeated keys by binary search; equal keys unite."""
    at = np.searchsorted(a[0], b[0])
    same = (at < len(a[0])) & (a[0][np.minimum(at, len(a[0]) - 1)] == b[0]) if len(a[0]) else np.zeros(len(b[0]), bool)
    low, high = a[1].copy(), a[2].copy()
    low[at[same]] = np.minimum(low[at[same]], b[1][same])
    high[at[same]] = np.maximum(high[at[same]], b[2][same])
    rest = ~same
    place = at[rest] + np.arange(rest.sum())
    old = np.ones(len(a[0]) + len(place), bool)
    old[place] = False
    out = []
    for x, y in zip((a[0], low, high), b):
        z = np.empty(len(old), x.dtype)
        z[old], z[place] = x, y[rest]
        out.append(z)
    return tuple(out)


def _merge(part: pa.Table) -> pa.Table:
    runs = [tuple(np.frombuffer(x, k) for x, k in zip(row, (U64, np.int64, np.int64))) for row in zip(*(part.column(c).to_pylist() for c in ("keys", "low", "high")))]
    tree = runs
    while len(tree) > 1:
        tree = [merged(*tree[i : i + 2]) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
    keys, low, high = tree[0]
    out, sole = [], low == high
    for run in runs:
        at = np.searchsorted(keys, run[0])
        out.append((np.packbits(~sole[at]).tobytes(), low[at][~sole[at]].tobytes()))
    return pa.table({"shard": part.column("shard"), "bucket": part.column("bucket"), "n": pa.array([len(r[0]) for r in runs], pa.int32()), "shared": pa.array([x for x, _ in out], pa.binary()), "least": pa.array([y for _, y in out], pa.binary())})


def _members(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, least document) of the members of a shard's shared classes."""
    parts = sorted(batch.column("parts")[row].as_py(), key=lambda p: p["bucket"])
    shared = np.concatenate([np.unpackbits(np.frombuffer(p["shared"], np.uint8))[: p["n"]] for p in parts]).astype(bool)
    least = np.zeros(len(shared), np.int64)
    least[shared] = np.concatenate([np.frombuffer(p["least"], np.int64) for p in parts])
    size, docs, pos = (_blob(batch.column(c), row, kind) for c, kind in (("size", np.int32), ("docs", np.int64), ("pos", np.int32)))
    keep = np.repeat(shared, size)
    return docs[keep], pos[keep].astype(np.int64), np.repeat(least, size)[keep]


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            doc, pos, _ = _members(batch, row)
            order = np.argsort(doc, kind="stable")
            doc, pos = doc[order], pos[order].astype(np.int32)
            ids, start = np.unique(doc, return_index=True)
            cut = np.append(start, len(doc))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([pos[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["doc_id", "pos"])


def _spans(min_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                doc, pos, least = _members(batch, row)
                if not len(doc):
                    continue
                order = np.lexsort((pos, doc))
                doc, pos, least = doc[order], pos[order], least[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)
                start = np.flatnonzero(new)
                last = np.append(start[1:], len(doc)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(doc[start]), pa.array(pos[start]), pa.array(pos[last] - pos[start] + min_words), pa.array(np.minimum.reduceat(least, start))], ["doc_id", "start_word", "n_words", "first_doc_id"])

    return run


def _judged(shards: DataFrame) -> DataFrame:
    """shards with column parts: the verdicts on their classes, by range of keys."""
    total = shards.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0]
    # as many ranges as keep a range within RANGE, and all tasks busy
    bits = max(total // RANGE, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2 - 1, 1).bit_length()
    verdict = (
        shards.select("shard", "size", "keys", "docs").mapInArrow(_ranges(bits), "shard string, bucket int, keys binary, low binary, high binary")
        .groupBy("bucket").applyInArrow(_merge, "shard string, bucket int, n int, shared binary, least binary")
        .groupBy("shard").agg(F.collect_list(F.struct("bucket", "n", "shared", "least")).alias("parts"))
    )
    return shards.join(verdict, "shard")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id): every maximal run of words of a document each of whose windows of min_words words occurs in another document too.

    Positions count words from 0; case and punctuation don't matter.  first_doc_id is the
    least document that holds any of the run's windows: where it is doc_id itself, the run
    is a first occurrence and may stay.  Repeats within one document (or among rows of one
    id) don't count.  Rows without an id, and null, empty or shorter texts, give nothing;
    rows that repeat an id may give the same span twice, once for each row.  Other columns
    are ignored; an empty table gives an empty result.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text <> ''")
    first = written(docs.mapInArrow(_anchor_shards(min_words), SHARD))
    held = written(_judged(first).mapInArrow(_by_document, "doc_id bigint, pos binary").groupBy(F.col("doc_id").alias("id")).agg(F.array_join(F.collect_list(F.hex("pos")), "").alias("h")).select("id", F.unhex("h").alias("pos")))
    size = held.agg(F.coalesce(F.sum(F.length("pos")), F.lit(0))).first()[0]
    candidates = docs.join(small(held, 32 + size // max(1, held.count())), "id")
    shards = written(candidates.select("id", "text", "pos").mapInArrow(_class_shards(min_words), SHARD))
    return _judged(shards).mapInArrow(_spans(min_words), "doc_id bigint, start_word bigint, n_words bigint, first_doc_id bigint")
