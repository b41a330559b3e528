"""String similarities that Spark lacks, as Arrow UDFs over batches. Filter by length before them: they are the slow path."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F


@lru_cache(maxsize=200_000)
def osa(a: str, b: str) -> int:
    """Edit distance in which swapping neighbours costs one."""
    if a == b:
        return 0
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        two, one = one, now
    return one[-1]


def osa_similarity(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    most = max(len(a), len(b))
    return 1.0 - osa(a, b) / most if most else 1.0


@lru_cache(maxsize=200_000)
def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the first string."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float | None:
    """100 times twice the common subsequence over both lengths; two empty strings are alike."""
    if a is None or b is None:
        return None
    both = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / both if both else 100.0


def token_sort_ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str | None, b: str | None) -> float | None:
    """The best of the shared words against either side's words, and of both sides against each other."""
    if a is None or b is None:
        return None
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (shared, " ".join(sorted(s))))) for s in (x - y, y - x))
    if shared and (left == shared or right == shared):
        return 100.0
    best = ratio(left, right)
    return max(best, ratio(shared, left), ratio(shared, right)) if shared else best


def place_likeness(a: str | None, b: str | None) -> float | None:
    """Likeness of two place keys; 0 if their numbers differ, or if both have several words and one is unlike all of the other's. A `city` behind is passed over."""
    if a is None or b is None:
        return None
    if re.findall(r"\d+", a) != re.findall(r"\d+", b):
        return 0.0
    x, y = a.split(), b.split()
    if len(x) > 1 and len(y) > 1 and any(max(osa_similarity(v, w) for w in y) < 0.6 for v in x):
        return 0.0
    bare = [re.sub(r"\s+c+ity$", "", k) for k in (a, b)]
    return max(osa_similarity(a, b), osa_similarity(*bare))


def _udf(f: Callable, kind: str = "double"):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def osa_udf():
    return _udf(osa_similarity)


def place_udf():
    return _udf(place_likeness)


def ratio_udf():
    return _udf(ratio)


def token_sort_udf():
    return _udf(token_sort_ratio)


def token_set_udf():
    return _udf(token_set_ratio)
