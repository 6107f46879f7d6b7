"""Operator 7: byte-level BPE encoding and decoding as a reduction over a tree.

A text is cut into halves down to leaves of LEAF characters, which the vocabulary's encoder
takes whole.  Two neighbours are joined by encoding again a window around the cut, which
doubles until it reaches, on either side, a place where a non-space is followed by a blank
or newline.  No pre-token of the splitting pattern crosses such a place, and none looks
beyond it from the left; so the tokens outside the window are the same for the joined text
whatever the window holds, and joining is associative: the result equals the encoding of
the text at once.  Decoding concatenates bytes up a tree of the same shape.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public splitting pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 2048
_STOP = re.compile(r"\S(?=[ \n])")


class Codec:
    """A vocabulary file of ranks with encode and decode."""

    def __init__(self, path: str, leaf: int = LEAF):
        with open(path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
        self.leaf = leaf
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.size = np.array([len(x) for x in self.pieces])
        self._bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return self._bpe.encode_to_numpy(text, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        """Token ids of text."""
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self.whole(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        width = 32
        while True:
            a, b = max(lo, mid - width), min(hi, mid + width)
            before = [m.end() for m in _STOP.finditer(text, a, mid)]
            after = _STOP.search(text, mid, b)
            if (before or a == lo) and (after or b == hi):
                break
            width *= 2
        start = before[-1] if before else lo
        stop = after.end() if after else hi
        n = len(left) - self._tokens(left[::-1], len(text[start:mid].encode()))
        m = self._tokens(right, len(text[mid:stop].encode()))
        return np.concatenate([left[:n], self.whole(text[start:stop]), right[m:]])

    def _tokens(self, tokens: np.ndarray, n: int) -> int:
        """How many of the first tokens make up n bytes."""
        return int(np.searchsorted(np.cumsum(self.size[tokens[:n]]), n)) + 1 if n else 0

    def decode(self, tokens: np.ndarray) -> bytes:
        """Bytes of the tokens."""
        if len(tokens) <= self.leaf:
            return b"".join(map(self.pieces.__getitem__, tokens.tolist()))
        mid = len(tokens) // 2
        return self.decode(tokens[:mid]) + self.decode(tokens[mid:])


@functools.lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                off, ids, exact = [0], [], []
                for text in part.column(1).to_pylist():
                    tokens = own.encode(text or "")
                    exact.append(None if text is None else own.decode(tokens) == text.encode())
                    ids.append(tokens)
                    off.append(off[-1] + len(tokens))
                missing = np.array([x is None for x in exact])
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.array(off, np.int32)), flat, mask=pa.array(missing))
                n = pa.array(np.diff(off).astype(np.int64), mask=missing)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, n, pa.array(exact, pa.bool_())], ["doc_id", "tokens", "n_tokens", "exact"])

    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact): the ids of each text, and whether decoding them gives the text back.

    Every row gives a row, whatever its id.  A null text gives nulls, an empty one no
    tokens.  Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return docs.mapInArrow(_encoder(path), "doc_id bigint, tokens array<int>, n_tokens bigint, exact boolean")


def _decoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            text = [None if t is None else own.decode(np.array([x for x in t if x is not None], np.int64)).decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return run


def decoded(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of token lists: null for null, empty for empty; null ids in a list are passed over.

    Ids outside the vocabulary raise an error.
    """
    docs = tokens.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("tokens"))
    return docs.mapInArrow(_decoder(path), "doc_id bigint, text string")
