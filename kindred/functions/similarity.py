"""Comparison of two sets of values; a set that is empty or null is unknown, and so is what comes of it (null)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.spec import Feature


def _known(a: Column, b: Column, value: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), value)


def binary_match(a: Column, b: Column) -> Column:
    return _known(a, b, F.arrays_overlap(a, b))


def number_matches(a: Column, b: Column) -> Column:
    return _known(a, b, F.size(F.array_intersect(a, b)))


def _least(a: Column, b: Column, f) -> Column:
    """The least f(x, y) over all pairs of values; null if there are none."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: f(x, y)))))


def numerical_difference(a: Column, b: Column) -> Column:
    return _least(a, b, lambda x, y: F.abs(x - y))


def _seconds(x: Column) -> Column:
    return F.floor(F.unix_micros(x.cast("timestamp")) / 1_000_000)


def date_difference(a: Column, b: Column) -> Column:
    """Seconds from y to x within a day, from 0 to 86399: whole days are left out, so it isn't symmetric."""
    return _least(a, b, lambda x, y: F.pmod(_seconds(x) - _seconds(y), F.lit(86400)))


def date_difference_total(a: Column, b: Column) -> Column:
    """Seconds between x and y, symmetric."""
    return _least(a, b, lambda x, y: F.abs(_seconds(x) - _seconds(y)))


def levenshtein(a: Column, b: Column) -> Column:
    return _least(a, b, F.levenshtein)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def weak_feature(f: Feature, a: Column, b: Column) -> Column:
    """Smaller is more similar, whatever the use."""
    if f.use == "binary_match":
        return 1 - binary_match(a, b).cast("double")
    if f.use == "numerical_difference":
        return numerical_difference(a, b).cast("double")
    if f.use == "number_matches":
        return F.exp(-number_matches(a, b).cast("double"))
    if f.use == "special_date_difference":
        return date_difference(a, b).cast("double")
    if f.use == "levenshtein":
        return F.log(F.lit(math.e) + levenshtein(a, b))
    raise ValueError(f"{f.name}: unknown use {f.use!r}")


def strong_match(features: list[Feature], a: str = "a", b: str = "b") -> Column:
    """Whether any strong feature overlaps; null if none is known on both sides, or there is none."""
    found = []
    for f in features:
        if f.strength == "strong":
            f.check()
            x, y = F.col(f"{a}.{f.column}"), F.col(f"{b}.{f.column}")
            found.append(binary_match(x, y) if f.use == "binary_match" else number_matches(x, y) > 0)
    if not found:
        return F.lit(None).cast("boolean")
    any_ = F.lit(False)
    for m in found:
        any_ = any_ | F.coalesce(m, F.lit(False))
    return F.when(F.coalesce(*found).isNotNull(), any_)
