"""Fuzzy similarity of strings and of a reference to a candidate work.

Longest common subsequences are bit-parallel over whole Python integers, so a comparison costs
one short step for each character of one side.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


@lru_cache(maxsize=4096)
def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    masks, full = _masks(a), (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """Share of characters that need no insertion or deletion."""
    if a == b:
        return 1.0
    total = len(a) + len(b)
    return 2 * common_length(a, b) / total if a and b else 0.0


def token_set(a: str, b: str) -> float:
    """Similarity of sorted token sets: shared tokens against shared and own ones."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, own_a, own_b = sorted(left & right), sorted(left - right), sorted(right - left)
    if both and not (own_a and own_b):
        return 1.0
    first, second = " ".join(both + own_a), " ".join(both + own_b)
    best = indel(first, second) if both else indel(" ".join(own_a), " ".join(own_b))
    if both:
        shared = " ".join(both)
        best = max(best, indel(shared, first), indel(shared, second))
    return best


def partial(a: str, b: str) -> float:
    """Best similarity of the shorter string to a window of the longer one, cut at its ends too."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    n, chars = len(a), set(a)
    best = 0.0
    for start in range(1 - n, len(b)):
        lo, hi = max(0, start), min(len(b), start + n)
        # a window that begins or ends with a foreign character is beaten by a shifted one
        if b[hi - 1] not in chars and start + n <= len(b) or 2 * (hi - lo) / (n + hi - lo) <= best:
            continue
        best = max(best, indel(a, b[lo:hi]))
    return best


def _pairs(function, a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if None in pair:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = function(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype=object)


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(indel, a, b)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(token_set, a, b)


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(partial, a, b)


@F.pandas_udf(DoubleType())
def best_ratio(value: pd.Series, others: pd.Series) -> pd.Series:
    """The best indel ratio to any of an array; null for an empty array."""
    out = [None if v is None or o is None or not len(o) else max(indel(v, x) for x in o if x is not None) for v, o in zip(value, others, strict=True)]
    return pd.Series(out, dtype=object)


@F.pandas_udf(LongType())
def near_count(visible: pd.Series, present: pd.Series) -> pd.Series:
    """How many of an array's strings are in the other or within 90 per cent of one of it."""
    out = []
    for v, p in zip(visible, present, strict=True):
        known = set(p)
        out.append(sum(x in known or any(indel(x, y) >= 0.9 for y in known) for x in v))
    return pd.Series(out)


def year_similarity(years: Column, year: Column) -> Column:
    """1, 0.7, 0.3 for a distance of 0, 1, 2 years, else 0; null if either is missing."""
    away = F.array_min(F.transform(years, lambda y: F.abs(y - year)))
    score = F.when(away == 0, 1.0).when(away == 1, 0.7).when(away == 2, 0.3).otherwise(0.0)
    return F.when(away.isNotNull(), score)


def author_similarity(visible: Column, present: Column) -> Column:
    """Share of visible surnames that a work has; null without visible ones.

    Only surnames that aren't found exactly go through the fuzzy function.
    """
    exact = F.size(F.filter(visible, lambda v: F.array_contains(present, v)))
    rest = F.array_except(visible, present)
    fuzzy = F.when((F.size(rest) > 0) & (F.size(present) > 0), near_count(rest, present)).otherwise(F.lit(0))
    return F.when(F.size(visible) > 0, F.when(F.size(present) == 0, 0.0).otherwise((exact + fuzzy) / F.size(visible)))


WEIGHTS = (("title", 0.64), ("author", 0.21), ("year", 0.11), ("venue", 0.04))


def combined_score(title: Column, author: Column, year: Column, venue: Column) -> Column:
    """Weighted mean of the parts that are known; a poor title scales the whole down."""
    parts = {"title": title, "author": author, "year": year, "venue": venue}
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in WEIGHTS:
        total = total + F.when(parts[name].isNotNull(), F.lit(w) * parts[name]).otherwise(0.0)
        weight = weight + F.when(parts[name].isNotNull(), w).otherwise(0.0)
    score = total / weight
    score = F.when(title < 0.45, score * (title / 0.45)).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
