from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, source]) with extra columns whose names the operators use themselves."""

    def of(rows, clash=True):
        df = spark.createDataFrame([(*r, "s")[:3] if len(r) < 3 else r for r in rows], DOC)
        if clash:
            for c in ("id", "host", "lines", "a", "b", "n", "q_key", "tokens", "key", "pos", "word"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return of


@pytest.fixture(scope="session")
def prose():
    """Random prose: prose(words, seed) gives words of a large vocabulary."""
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(3, 9))) for _ in range(5000)]

    def of(n, seed):
        return list(np.random.default_rng(seed).choice(vocabulary, n))

    return of
