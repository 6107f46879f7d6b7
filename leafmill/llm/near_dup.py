"""Operator 10: near duplicates by SetSketch registers.

A document is the set of its word 3-grams (shorter ones: all their words as one).  A
SetSketch keeps, for each of m hash functions, the truncated exponent
K = floor(1 - log_b(x)) of the least of the set's Exp(a) hash values: minima on an
exponentially spaced scale, mergeable by maximum and locality-sensitive.  Bands of
registers give candidates, the joint maximum-likelihood estimate of the Jaccard similarity
from the two register vectors discards the clearly different ones, and exact similarity of
the 3-gram sets decides.

1. A band's bucket is compared with its least id first, so these candidates are linear in
   the documents.  A 128-bit signature that travels with each band (four bits of 32
   registers) turns away documents that met by chance, of which a bucket holds the more the
   larger the corpus is, before any registers move.  Each document's best estimate is
   verified, and then the best one between any two of the groups that this made.
2. Documents that share a passage or a template meet in buckets whose least id is not
   similar to them, and so do strangers.  In each bucket that still holds several groups,
   the members outside the least id's group are compared with all members, in hashed
   blocks: by signature first, and what has a plausible partner exactly.  Every pair that
   meets in any bucket is in one group or was compared.  That is quadratic only in
   members of one bucket that lie in different groups and have like signatures.

Each step works on the groups of the one before it as single vertices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._graph import components
from ._store import discard, free, small, written

U64 = np.uint64
#: Words of a shingle.
GRAM = 3
REGISTERS = 256
ROWS = 4
BASE = 1.02
RATE = 20.0
THRESHOLD = 0.45
#: The estimate's error allowed for before exact verification: three standard deviations at 256 registers.
MARGIN = 0.1
#: Signatures: registers, of which four bits each are kept, and the least number that agree.  Of sets at the threshold 0.1 % agree in fewer, of unrelated ones 3 % at most in as many.
SIGNED, MATCH = 32, 7
#: Members of a bucket that are compared with each other, or with as many others, in one piece.
BLOCK = 1024
_MULT = np.random.default_rng(10).integers(1, 2**63, REGISTERS, dtype=np.int64).view(U64) | U64(1)
_48 = U64((1 << 48) - 1)


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct word 3-grams as sorted 48-bit hashes: (values, document of each, first of each document)."""
    w = tx.words(buf, off)
    n, doc = w.count, w.doc
    values, docs = [], []
    for k in range(1, GRAM + 1):
        g = tx.ngram(w.hash, k)
        own = doc[: len(g)]
        keep = np.flatnonzero((own == doc[k - 1 :][: len(g)]) & (n[own] >= GRAM if k == GRAM else n[own] == k))
        values.append(g[keep]), docs.append(own[keep])
    value, doc = np.concatenate(values), np.concatenate(docs)
    key = np.sort((doc.astype(U64) << U64(48)) | (value >> U64(16)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    doc = (key >> U64(48)).astype(np.int64)
    return key & _48, doc, np.searchsorted(doc, np.arange(len(off)))


def registers(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers (documents x m, uint16) of non-empty sets."""
    h = tx.mix(value)
    low = np.empty((REGISTERS, len(first)), np.float64)
    for r in range(REGISTERS):
        low[r] = np.minimum.reduceat(h * _MULT[r], first)
    x = -np.log1p(-(low + 0.5) / 2.0**64)
    k = np.floor(1 - np.log(np.maximum(x, 1e-300) / RATE) / np.log(BASE))
    return np.clip(k, 0, 65535).astype(np.uint16).T.copy()


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def similarity(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of register rows ka, kb of sets of na and nb members."""
    above, below = (ka > kb).sum(1), (ka < kb).sum(1)
    equal = ka.shape[1] - above - below
    u = na / (na + nb)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return above * np.log(a) + below * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    ratio = (5**0.5 - 1) / 2
    for _ in range(24):
        c, d = high - ratio * (high - low), low + ratio * (high - low)
        left = likelihood(c) > likelihood(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return (low + high) / 2


SKETCH = "id bigint, n int, f1 bigint, f2 bigint, s1 bigint, s2 bigint, regs binary, bands array<bigint>"


def signatures(k: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit halves of the low four bits of one register in each of the first bands."""
    nibble = (k[:, : ROWS * SIGNED : ROWS] & 15).astype(U64)
    place = U64(4) * np.arange(SIGNED // 2, dtype=U64)
    return [np.bitwise_or.reduce(x << place, 1).view(np.int64) for x in np.split(nibble, 2, axis=1)]


def agreeing(x: Column, y: Column) -> Column:
    """How many of 16 groups of four bits are equal."""
    d = x.bitwiseXOR(y)
    d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
    d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
    return 16 - F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the signatures (rows x 2) of x agree with those of y, each with each."""
    off = np.zeros((len(x), len(y)), np.uint8)
    for h in range(2):
        d = x[:, h, None] ^ y[None, :, h]
        d |= d >> U64(1)
        d |= d >> U64(2)
        off += np.bitwise_count(d & U64(0x1111111111111111))
    return off <= SIGNED - MATCH


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = REGISTERS // ROWS
    salt = tx.mix(np.arange(1, bands + 1, dtype=U64))
    for batch in batches:
        ids = tx.int64(batch.column(0))
        for at in range(0, len(ids), 60000):  # the document takes 16 bits of a key
            for i, j, buf, off in tx.chunks(batch.column(1).slice(at, 60000)):
                value, doc, first = shingles(buf, off)
                n = np.diff(first)
                has = np.flatnonzero(n)
                if not len(has):
                    continue
                first = first[:-1][has]
                k = registers(value, first)
                f = [np.add.reduceat(tx.mix(value ^ U64(x)), first).view(np.int64) for x in (0x5555, 0xAAAA0000)]
                band = np.zeros((len(has), bands), U64)
                for r in range(ROWS):
                    band = tx.mix(band * U64(31) + k[:, r::ROWS])
                band = tx.mix(band ^ salt).view(np.int64).ravel()
                sig = signatures(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at + i : at + j][has]), pa.array(n[has].astype(np.int32)), pa.array(f[0]), pa.array(f[1]), pa.array(sig[0]), pa.array(sig[1]), pa.array([x.tobytes() for x in k], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(band) + 1, bands, dtype=np.int32)), pa.array(band))],
                    ["id", "n", "f1", "f2", "s1", "s2", "regs", "bands"],
                )


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        ka, kb = (tx.utf8(batch.column(c))[0].view(np.uint16).reshape(-1, REGISTERS) for c in ("ka", "kb"))
        na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similarity(ka, kb, na, nb))], ["a", "b", "estimate"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 60000):
            part = batch.slice(at, 60000)
            for i, j, buf, off in tx.chunks(part.column(2)):
                value, _, first = shingles(buf, off)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), part.column(1).slice(i, j - i), pa.array([value[x:y].tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())], ["a", "b", "s"])


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        out = np.zeros(len(batch))
        (x_buf, x_off), (y_buf, y_off) = tx.utf8(batch.column("sa")), tx.utf8(batch.column("sb"))
        for k in range(len(batch)):
            x, y = x_buf[x_off[k] : x_off[k + 1]].view(U64), y_buf[y_off[k] : y_off[k + 1]].view(U64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            same = int((both[1:] == both[:-1]).sum())
            out[k] = same / max(1, len(both) - same)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "jaccard"])


def _verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b), a written table, whose 3-gram sets reach the threshold; a is the least id of a bucket, so few."""
    kind = "a bigint, b bigint, s binary"
    left = docs.join(small(pairs.select(F.col("a").alias("id")).distinct()), "id").select(F.col("id").alias("a"), F.col("id").alias("b"), "text").mapInArrow(_sets, kind).select("a", F.col("s").alias("sa"))
    right = docs.join(small(pairs.select(F.col("b").alias("id"), "a")), "id").select("a", F.col("id").alias("b"), "text").mapInArrow(_sets, kind).select("a", "b", F.col("s").alias("sb"))
    return written(right.join(left, "a").mapInArrow(_jaccard, "a bigint, b bigint, jaccard double").where(F.col("jaccard") >= threshold).select("a", "b"))


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 60000):
            part = batch.slice(at, 60000)
            for i, j, buf, off in tx.chunks(part.column("text")):
                value, _, first = shingles(buf, off)
                s = pa.array([value[x:y].tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c).slice(i, j - i) for c in PIECE), s], [*PIECE, "s"])


PIECE = {"key": "bigint", "band": "bigint", "i": "bigint", "j": "bigint", "ask": "boolean", "id": "bigint", "root": "bigint", "s1": "bigint", "s2": "bigint"}
_PIECE = ", ".join(f"{c} {t}" for c, t in PIECE.items())


def _pieces(rows: pa.Table) -> Iterator[np.ndarray]:
    """Rows of each piece (band, i, j) of a group."""
    band, i, j = (rows.column(c).to_numpy() for c in ("band", "i", "j"))
    order = np.lexsort((j, i, band))
    if len(order):
        yield from np.split(order, np.flatnonzero(np.any([x[order][1:] != x[order][:-1] for x in (band, i, j)], axis=0)) + 1)


def _plausible(rows: pa.Table) -> pa.Table:
    """The rows that have a partner of another group and a like signature in their piece."""
    ask, root = rows.column("ask").to_numpy(zero_copy_only=False), rows.column("root").to_numpy()
    sig = np.stack([rows.column(c).to_numpy() for c in ("s1", "s2")], 1).view(U64)
    keep = np.zeros(len(rows), bool)
    for piece in _pieces(rows):
        asks, others = piece[ask[piece]], piece[~ask[piece]]
        for at in range(0, len(asks), 256):
            own = asks[at : at + 256]
            near = alike(sig[own], sig[others]) & (root[own][:, None] != root[others][None])
            keep[own] |= near.any(1)
            keep[others] |= near.any(0)
    return rows.filter(pa.array(keep))


def joins(value: np.ndarray, first: np.ndarray, group: np.ndarray, ask: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of sets that reach the threshold and join all groups that any such pair of a set of `ask` with another joins."""
    n, out = np.diff(first), []
    doc = np.repeat(np.arange(len(n)), n)
    order = np.argsort(value, kind="stable")
    at = np.empty(len(value), np.int64)
    new = np.concatenate([[True], value[order][1:] != value[order][:-1]])[: len(value)]
    at[order] = np.cumsum(new) - 1
    begin = np.append(np.flatnonzero(new), len(value))
    holder, many = doc[order], np.diff(begin)
    group = np.unique(group, return_inverse=True)[1]
    for i in ask.tolist():
        term = at[first[i] : first[i + 1]]
        term = term[many[term] > 1]
        size = many[term]
        if not len(size):
            continue
        where = np.arange(int(size.sum())) + np.repeat(begin[term] - np.cumsum(size) + size, size)
        same = np.bincount(holder[where], minlength=len(n))
        found = np.flatnonzero((same / np.maximum(1, n + n[i] - same) >= threshold) & (group != group[i]))
        for g, k in zip(*np.unique(group[found], return_index=True)):
            out.append((i, int(found[k])))
            group[group == g] = group[i]
    return out


def _compared(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        ask, ids, root = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("ask", "id", "root"))
        buf, off = tx.utf8(rows.column("s"))
        a, b = [], []
        for piece in _pieces(rows):
            sets = [buf[off[k] : off[k + 1]].view(U64) for k in piece.tolist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            for x, y in joins(np.concatenate(sets), first, root[piece], np.flatnonzero(ask[piece]), threshold):
                a.append(int(ids[piece[x]])), b.append(int(ids[piece[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rooted(df: DataFrame, column: str, root: DataFrame) -> DataFrame:
    """df with the root of an id in a column r<column>; ids that root leaves out are their own."""
    r = root.select(F.col("id").alias(column), F.col("root").alias("_r"))
    return df.join(small(r), column, "left").withColumn(f"r{column}", F.coalesce("_r", column)).drop("_r")


def _joined(root: DataFrame, edges: DataFrame) -> DataFrame:
    """root (id, root; none of an id that is a root) after its groups are joined by edges between any members; written."""
    met = _rooted(_rooted(edges, "a", root), "b", root).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    up = written(components(met).where("id <> root"))
    return written(_rooted(root.withColumnRenamed("root", "t"), "t", up).select("id", F.col("rt").alias("root")).union(up))


def _rest(docs: DataFrame, members: DataFrame, leaders: DataFrame, root: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) between different groups whose members meet in a bucket; written."""
    met = _rooted(_rooted(members.select("band", "a", "b", "s1", "s2"), "a", root), "b", root).select("band", F.col("b").alias("id"), F.col("rb").alias("root"), "s1", "s2", F.col("ra").alias("top"))
    met = written(met.union(_rooted(leaders, "a", root).select("band", F.col("a").alias("id"), F.col("ra").alias("root"), "s1", "s2", F.col("ra").alias("top"))))
    blocks = lambda n: F.ceil(n / BLOCK)
    mixed = met.groupBy("band").agg(blocks(F.count("*")).alias("n"), blocks(F.count_if(F.col("root") != F.col("top"))).alias("m")).where("m > 0")
    each = met.join(small(written(mixed)), "band")
    place = lambda n: F.pmod(F.xxhash64("id"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    kept = ("id", "root", "s1", "s2")
    rows = each.select("band", every(F.col("m")).alias("i"), place(F.col("n")).alias("j"), F.lit(False).alias("ask"), *kept)
    asks = each.where("root <> top").select("band", place(F.col("m")).alias("i"), every(F.col("n")).alias("j"), F.lit(True).alias("ask"), *kept)
    each = written(rows.union(asks))
    pieces = F.lit(1 + each.count() // (2 * BLOCK)).cast("bigint")
    key = F.pmod(F.xxhash64("band", "i", "j"), pieces).alias("key")
    likely = written(each.select(key, *list(PIECE)[1:]).groupBy("key").applyInArrow(_plausible, _PIECE))
    sets = docs.join(small(likely, 96), "id").select(*PIECE, "text").mapInArrow(_with_sets, _PIECE + ", s binary")
    found = written(sets.groupBy("key").applyInArrow(_compared(threshold), "a bigint, b bigint"))
    discard(met, each, likely)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id) for every document of a group of two or more near duplicates.

    Groups are the connected components of the pairs with Jaccard similarity >= threshold
    of their word 3-gram sets; group_id is the least id of the group.  Documents without a
    word (null, empty, punctuation) and rows without an id belong to no group.  Rows that
    repeat an id are one document with any of their texts.  Other columns are ignored.  An empty table gives an
    empty result.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL")
    sketches = written(docs.mapInArrow(_sketch, SKETCH))
    # equal sets collapse before the shuffle, so a set of many copies is no hot key
    best = F.min_by(F.struct("s1", "s2", "regs", "bands"), "id").alias("s")
    reps = written(sketches.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), best).select("f1", "f2", "n", "id", "s.*"))
    same = written(sketches.join(reps.select("f1", "f2", "n", F.col("id").alias("rep")), ["f1", "f2", "n"]).where("id <> rep").select("id", F.col("rep").alias("root")).distinct())
    discard(sketches)
    bucket = reps.select("id", "s1", "s2", F.explode("bands").alias("band"))
    # least ids by aggregation, which combines a hot bucket before it is shuffled
    leaders = written(bucket.groupBy("band").agg(F.min(F.struct("id", "s1", "s2")).alias("m"), F.count("*").alias("n")).where("n > 1").select("band", F.col("m.id").alias("a"), "m.s1", "m.s2"))
    near = (agreeing(F.col("s1"), F.col("t1")) + agreeing(F.col("s2"), F.col("t2")) >= MATCH).alias("near")
    members = written(bucket.join(small(leaders.withColumnsRenamed({"s1": "t1", "s2": "t2"}), 48), "band").where("a <> id").select("band", "a", F.col("id").alias("b"), "s1", "s2", near))
    half = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"k{x}"))
    pairs = members.where("near").select("a", "b").distinct()
    left = written(pairs.join(half("b"), "b").join(half("a"), "a").mapInArrow(_estimate, "a bigint, b bigint, estimate double").where(F.col("estimate") >= threshold - MARGIN))
    likeliest = lambda df, *by: written(df.groupBy(*by).agg(F.max_by(F.struct("a", "b"), F.struct("estimate", -F.col("a"), -F.col("b"))).alias("m")).select("m.*"))
    first = likeliest(left, "b")
    root = written(components(_verified(docs, first, threshold)).where("id <> root"))
    open_ = _rooted(_rooted(left, "a", root), "b", root).where("ra <> rb")
    second = likeliest(open_, F.least("ra", "rb"), F.greatest("ra", "rb"))
    root = _joined(root, _verified(docs, second, threshold))
    root = _joined(root, _rest(docs, members, leaders, root, threshold))
    all_ = written(_rooted(same.withColumnRenamed("root", "t"), "t", root).select("id", F.col("rt").alias("root")).union(root).distinct())
    discard(reps, same, leaders, members, left, first, second)
    return all_.union(all_.select(F.col("root").alias("id"), "root").distinct()).select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the members of each near-duplicate group other than its least id; every column stays as it is.

    Rows without an id and documents without a word stay.  Of rows that repeat an id all
    stay or all go.
    """
    groups = near_duplicates(docs, id_col, text_col, threshold).where("doc_id <> group_id")
    gone = free(docs, "gone")
    return docs.join(small(written(groups.select(F.col("doc_id").alias(gone)))), F.col(f"`{id_col}`").cast("bigint") == F.col(gone), "left_anti")
