"""Operator 1: quality selection by importance resampling.

Two generative models over hashed n-grams (words and punctuation runs, and pairs of them)
are counted: the target's from the labelled good documents, the raw one from all documents.
A document's log weight is the logarithm of their ratio: summed over its n-grams, a pair
counting PAIR_WEIGHT of a token, and taken to LENGTH tokens, so that documents of all
lengths compare.  A single n-gram speaks for the target by no more than its ceiling, else
the many ordinary words of a long document would outweigh what the target never says; it
may speak against it without bound.  Gumbel top-k then draws k documents, without
replacement and in proportion to their weights; k is a parameter, by default the labels'
share of good documents among all.

Counting and scoring are maps; only the count tables (fixed size) and two numbers a
document move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from ._store import small, written

U64 = np.uint64
#: Buckets of words and of pairs, as powers of two.
BITS, PAIR_BITS = 19, 17
SIZE = (1 << BITS) + (1 << PAIR_BITS)
SMOOTH = 1.0
#: Most that a token's and a pair's log ratio counts for, and a pair's weight in tokens.
CEILING, PAIR_CEILING, PAIR_WEIGHT = -0.7, -1.5, 0.5
#: Tokens that log weights are taken to.
LENGTH = 1000
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each token, buckets of tokens, buckets of pairs; a pair belongs to its first token, -1 where it has none)."""
    kind = _CLASS[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    change = np.ones(len(buf) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change |= edge
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    h = tx.span_hash(buf, start, end)
    doc = np.searchsorted(off, start, "right") - 1
    one = (h >> U64(64 - BITS)).astype(np.int64)
    two = np.full(len(h), -1, np.int64)
    if len(h) > 1:
        inside = doc[1:] == doc[:-1]
        two[:-1][inside] = ((tx.ngram(h, 2) >> U64(64 - PAIR_BITS)).astype(np.int64) + (1 << BITS))[inside]
    return doc, one, two


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, SIZE), np.int64)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, _, buf, off in tx.chunks(batch.column(0)):
            doc, one, two = grams(buf, off)
            for own in (one, two):
                keep = own >= 0
                total[0] += np.bincount(own[keep], minlength=SIZE)
                keep &= good[i + doc]
                total[1] += np.bincount(own[keep], minlength=SIZE)
    parts = 16  # of the table, added up in parallel
    size = SIZE // parts
    if total[0].any():
        cut = total.reshape(2, parts, size)  # a task's counts fit in 32 bits
        cut = cut.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), *(pa.array([cut[k, p].tobytes() for p in range(parts)], pa.binary()) for k in range(2))], ["part", "raw", "good"])


def _add(part: pa.Table) -> pa.Table:
    sums = [np.sum([np.frombuffer(x, np.uint32) for x in part.column(c).to_pylist()], 0, np.int64).tobytes() for c in ("raw", "good")]
    return pa.table({"part": part.column("part")[:1], "raw": pa.array([sums[0]], pa.binary()), "good": pa.array([sums[1]], pa.binary())})


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log of good's share over raw's share of each bucket, for tokens and for pairs, smoothed by SMOOTH expected counts."""
    out = []
    for r, g in zip(np.split(raw.astype(float), [1 << BITS]), np.split(good.astype(float), [1 << BITS])):
        out.append(np.log((g + SMOOTH) / (r * (g.sum() / max(1.0, r.sum())) + SMOOTH)))
    return np.concatenate(out).astype(np.float32)


def log_weights(buf: np.ndarray, off: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, log weight) of each document."""
    doc, one, two = grams(buf, off)
    docs = len(off) - 1
    n = np.bincount(doc, minlength=docs)
    pair = np.where(two >= 0, np.minimum(ratio[two], PAIR_CEILING) - PAIR_CEILING, 0)
    total = np.bincount(doc, np.minimum(ratio[one], CEILING) - CEILING + PAIR_WEIGHT * pair, docs)
    return n, LENGTH * total / np.maximum(n, 1)


def _score(ratio: np.ndarray, text: str, added: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            got = [log_weights(buf, off, ratio) for _, _, buf, off in tx.chunks(batch.column(text))]
            n, x = (np.concatenate(c) for c in zip(*got))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(x)], [*batch.schema.names, *added])

    return run


class Model:
    """Log ratios of the n-grams, the noise's seed, and the least key drawn."""

    def __init__(self, ratio: np.ndarray, seed: int):
        self.ratio, self.seed, self.least = ratio, seed, -np.inf

    def scored(self, docs: DataFrame, id_col: str, text_col: str, prefix: str) -> DataFrame:
        """docs with columns prefix + tokens, weight (its logarithm) and key, both null where there is no token."""
        tokens, weight = prefix + "tokens", prefix + "weight"
        schema = T.StructType([*docs.schema.fields, T.StructField(tokens, T.LongType()), T.StructField(weight, T.DoubleType())])
        df = docs.mapInArrow(_score(self.ratio, text_col, [tokens, weight]), schema).withColumn(weight, F.when(F.col(tokens) > 0, F.col(weight)))
        return df.withColumn(prefix + "key", F.col(weight) + gumbel(F.col(f"`{id_col}`"), self.seed))


def gumbel(id_: Column, seed: int) -> Column:
    """Standard Gumbel noise, a function of the id and the seed."""
    u = (F.pmod(F.xxhash64(id_.cast("bigint"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, by histograms that narrow down to at most 50,000 values."""
    if k <= 0:
        return np.inf
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return -np.inf
    above, inside = 0, df
    while low < high:
        width = (high - low) / 512
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(511)) if width > 0 else F.lit(0)
        n = {r.bin: (r.n, r.least, r.most) for r in inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).collect()}
        for b in sorted(n, reverse=True):
            if above + n[b][0] >= k:
                break
            above += n[b][0]
        low, high = n[b][1], n[b][2]
        inside = df.where(F.col(column).between(low, high))
        if n[b][0] <= 50_000:
            values = sorted((r[0] for r in inside.select(column).collect()), reverse=True)
            return values[min(len(values), k - above) - 1]
    return low


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, k: int | None = None) -> tuple[Model, DataFrame]:
    """The model, and the table (id, tokens, weight, key) of all documents.

    A label is good where all rows of its document have quality 1 and toxic 0; rows with
    nulls are left out.  Counts take all documents, and all good ones for the target.  k is
    the number of documents to draw, by default the share of good labels of those that hold
    a token.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("i"), "quality", "toxic").dropna().groupBy("i").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    marks = written(marks)
    of, good = marks.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = marks.where("good = 1").select(F.col("i").alias("id"), F.lit(True).alias("good"))
    counted = texts.join(small(written(chosen)), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    table = counted.mapInArrow(_count, "part int, raw binary, good binary").groupBy("part").applyInArrow(_add, "part int, raw binary, good binary").orderBy("part").collect()
    raw, target = (np.concatenate([np.frombuffer(r[c], np.int64) for r in table]) if table else np.zeros(SIZE, np.int64) for c in ("raw", "good"))
    model = Model(log_ratios(raw, target if good else raw), seed)
    first = written(model.scored(texts, "id", "text", "").drop("text"))
    if k is None and 0 < good < of:
        k = round(first.where("tokens > 0").count() * good / of)
    if k is not None:
        model.least = kth_largest(first.where("key IS NOT NULL"), "key", k)
    return model, first


def selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, k: int | None = None) -> DataFrame:
    """(doc_id, log_weight, key) of the documents drawn.

    Ties at the threshold all stay.  Documents without a token (null or blank) give no
    evidence and are rejected.  Where the labels don't hold both kinds and no k is given,
    all others stay.  Rows that repeat an id are judged each by its own text, with the same
    noise; a null id is an id like another.  Other columns are ignored; an empty table gives an empty result.
    """
    model, table = fit(docs, labels, id_col, text_col, seed, k)
    return table.where(F.col("key") >= float(model.least)).select(F.col("id").alias("doc_id"), F.col("weight").alias("log_weight"), "key")


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, k: int | None = None) -> DataFrame:
    """The rows of docs that `selected` draws, with the columns of docs, whatever their names.

    Scores once more, in a map: that costs less than a join of all texts with their keys.
    """
    model, _ = fit(docs, labels, id_col, text_col, seed, k)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = model.scored(docs.toDF(*names.values()), names[id_col], names[text_col], "q_").where(F.col("q_key") >= float(model.least))
    return plain.select(*(F.col(x).alias(c) for c, x in names.items()))
