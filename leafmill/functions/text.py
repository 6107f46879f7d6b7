"""Scalar expressions on strings and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that both Java and RE2 regular expressions know by this class.
SPACE = r"[ \n\t\r\f]"


def stripped(x: Column) -> Column:
    """x without Unicode white space at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(stripped(x) == "", F.lit(True))


def is_valid_phrase(x: Column) -> Column:
    """Whether anything printable is left without control and zero-width characters."""
    clean = F.regexp_replace(x, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\u200B-\\u200D\\uFEFF]", "")
    return F.coalesce((stripped(clean) != "") & clean.rlike(r"[^\p{C}\p{Z}]|\x20"), F.lit(False))


def truncated(x: Column, n: int, limit: int | None = None) -> Column:
    """The first n characters and dots where x is longer than n (or than limit)."""
    return F.when(F.length(x) > (limit or n), F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def truncated_strings(df: DataFrame, n: int = 300) -> DataFrame:
    """df with every string longer than n, at any depth, cut to n characters and dots."""

    def cut(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return truncated(x, n)
        if isinstance(kind, T.ArrayType):
            return F.transform(x, lambda y: cut(y, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(x, lambda _, y: cut(y, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(x.isNotNull(), F.struct(*(cut(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return x

    return df.select(*(cut(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def preview(x: Column) -> Column:
    return truncated(x, 100)


def sentences(x: Column, space: str = SPACE) -> Column:
    """Sentences, stripped; a text without any is one, a blank text none."""
    parts = F.filter(F.transform(F.split(x, rf"(?<=[.!?]){space}+"), lambda s: F.regexp_replace(s, rf"^{space}+|{space}+$", "")), lambda s: s != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def normalised(x: Column) -> Column:
    """Small letters, runs of white space as one blank, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(x, r"[ \n\t\r]+", " ")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def tree_path(pdf: Column) -> Column:
    """Where the tree of a PDF lies: /data/ to /out/, .pdf in any case to .json."""
    return F.regexp_replace(F.replace(pdf, F.lit("/data/"), F.lit("/out/")), r"(?i)\.pdf$", ".json")


def nested_tree_path(pdf: Column) -> Column:
    """The other place: a folder named like the file."""
    json = tree_path(pdf)
    return F.concat(F.regexp_replace(json, r"\.json$", "/"), basename(json))


def raw_text_path(pdf: Column) -> Column:
    return F.regexp_replace(F.replace(pdf, F.lit("/data/"), F.lit("/out/")), r"(?i)\.pdf$", ".txt")


def sanitised(category: Column) -> Column:
    """A category as part of a path."""
    return F.replace(category, F.lit("/"), F.lit("_"))


def last_number(ref: Column) -> Column:
    """The last integer in a reference, 0 without one."""
    return F.coalesce(F.regexp_extract(ref, r"(\d+)\D*$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def text_statistics(x: Column) -> dict[str, Column]:
    """Characters, words, lines, non-empty lines, words a line (of all), characters a word (without white space)."""
    words = F.filter(F.split(x, rf"{SPACE}+"), lambda w: w != "")
    lines = F.split(x, "\n")
    n = F.size(words).cast("bigint")
    return {
        "n_chars": F.length(x).cast("bigint"),
        "n_words": n,
        "n_lines": F.size(lines).cast("bigint"),
        "n_nonempty_lines": F.size(F.filter(lines, lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+$", "") != "")).cast("bigint"),
        "words_per_line": F.round(n / F.size(lines), 6),
        "chars_per_word": F.round(F.length(F.regexp_replace(x, rf"{SPACE}+", "")) / F.nullif(n, F.lit(0).cast("bigint")), 6),
    }
