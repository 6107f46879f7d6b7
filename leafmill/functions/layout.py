"""Scalar expressions on fonts and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_bold(font: Column, strict: bool = False) -> Column:
    """1 for a bold face by its name.

    By default any b counts, also one in a subset prefix; strict takes the prefix off and
    asks for bold, heavy or black.
    """
    if strict:
        return F.coalesce(F.lower(F.regexp_replace(font, r"^[A-Z]{6}\+", "")).rlike("bold|heavy|black"), F.lit(False)).cast("int")
    return F.coalesce(F.lower(font).rlike("b|heavy"), F.lit(False)).cast("int")


def is_all_caps(x: Column) -> Column:
    """1 for letters only, all capital: a blank, digit or hyphen makes it 0."""
    return F.coalesce(x.rlike(r"^\p{L}+$") & (F.upper(x) == x) & (F.lower(x) != x), F.lit(False)).cast("int")


def starts_with_number(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^\p{Nd}"), F.lit(False)).cast("int")


def is_centred(x0: Column, x1: Column, width: Column, tolerance: float = 0.1) -> Column:
    return F.coalesce(F.abs((x0 + x1) / 2 - width / 2) <= width * tolerance, F.lit(False)).cast("int")


def has_underline(x: Column) -> Column:
    """0: extractors don't report underlines."""
    return F.when(x.isNull(), 0).otherwise(0)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 where they only touch or have no area."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when((w > 0) & (h > 0) & (union > 0), both / union).otherwise(0.0)


def texts_match(header: Column, phrase: Column) -> Column:
    """Whether a header and a phrase may be the same text, in any of five ways.

    They are equal, one begins the other, the phrase has two words or more one of which the
    header contains, or it is the header without blanks; case doesn't matter.
    """
    h, p = F.lower(header), F.lower(F.trim(phrase))
    words = F.filter(F.split(p, r"\s+"), lambda w: w != "")
    return (h == p) | h.startswith(p) | p.startswith(h) | ((F.size(words) >= 2) & F.exists(words, lambda w: F.contains(h, w))) | (p == F.replace(h, F.lit(" "), F.lit("")))
