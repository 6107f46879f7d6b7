"""Connected components by alternating large-star and small-star passes, or in one task where the edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import discard, written


#: Edges (16 bytes each) up to which one task finds the components.
FEW = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, least vertex of each one's component) of edges a to b."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(place, 2)
    top = np.arange(len(ids))
    while (top[x] != top[y]).any():
        np.minimum.at(top, np.maximum(top[x], top[y]), np.minimum(top[x], top[y]))
        while (top[top] != top).any():
            top = top[top]
    return ids, ids[top]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(*map(np.concatenate, zip(*held)))], ["id", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of edges (a, b): root is the least id of its component.

    Null ends are left out, loops and repeated edges do no harm; without edges the result
    is empty.  Each pass shuffles the edges twice and holds no vertex's neighbours in
    memory; the number of passes grows with the logarithm of the longest path.  No more
    than FEW edges go to one task instead.
    """
    least = F.least("a", F.min("b").over(Window.partitionBy("a")))
    e = written(edges.select("a", "b").where("a <> b").distinct())
    if e.count() <= FEW:
        return e.coalesce(1).mapInArrow(_whole, "id bigint, root bigint")
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        m = F.min("b").over(Window.partitionBy("a"))
        met = down.withColumn("m", m)
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(met.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old, e = e, written(small)
        discard(old)
        parted = e.groupBy("a").count().where("count > 1").limit(1).count()
        if not parted and not e.select("b").distinct().join(e.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("id"), "root").distinct())
