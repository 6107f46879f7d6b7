"""Operator 3: lines that many of a host's pages share.

A line's frequency is the share of its host's pages that hold it.  Lines above RATIO, on at
least MIN_PAGES pages, are boilerplate and dropped.  Only hashes of lines are shuffled; the
few boilerplate lines of each host go back to the pages in a map where they are surely
small, else by a join that adaptive execution splits at hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import BROADCAST_BYTES, free, written

RATIO = 0.05
MIN_PAGES = 5


def host_of(url: Column) -> Column:
    """The host of a URL in small letters, null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): the 64-bit hashes of each host's boilerplate lines."""
    p = pages.select(F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{text_col}`").alias("text")).where("host IS NOT NULL")
    hashes = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))
    seen = p.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count("*").alias("c")).where(F.col("c") >= min_pages)
    total = p.groupBy("host").agg(F.count("*").alias("n"))
    return seen.join(total, "host").where(F.col("c") / F.col("n") > ratio).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, count_col: str | None = None) -> DataFrame:
    """pages, the boilerplate lines of each text dropped; all rows and other columns stay.

    Lines are compared without spaces at their ends; blank ones are never boilerplate.  A
    line counts once a page however often it occurs, every row is a page (repeated rows
    too), and pages with null texts count in their host's total.  A text that is all
    boilerplate becomes empty; null texts stay null.  Pages without a host keep their text.
    count_col, if given, names a new column with the number of lines dropped.  An empty
    table gives an empty result.
    """
    bad = written(boilerplate(pages, host_col, text_col, ratio, min_pages))
    host, lines, text = (free(pages, x) for x in ("host", "lines", "text"))
    bad = bad.select(F.col("host").alias(host), F.col("lines").alias(lines))
    size = bad.agg(F.coalesce(F.sum(F.size(lines) * 8 + 64), F.lit(0))).first()[0]
    joined = pages.join(F.broadcast(bad) if size <= BROADCAST_BYTES else bad, F.col(f"`{host_col}`").cast("string") == F.col(host), "left")
    own = F.col(f"`{text_col}`")
    kept = F.filter(F.split(own, "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains(lines, F.xxhash64(F.trim(x))))
    joined = joined.withColumn(text, F.when(F.col(lines).isNotNull(), kept))
    dropped = F.coalesce(F.size(F.split(own, "\n")) - F.when(F.col(text).isNotNull(), F.size(text)), F.lit(0))
    columns = [F.when(F.col(text).isNotNull(), F.array_join(text, "\n")).otherwise(own).alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns]
    return joined.select(*columns, *([dropped.cast("bigint").alias(count_col)] if count_col else []))

