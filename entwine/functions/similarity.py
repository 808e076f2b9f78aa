"""String and set similarities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PREFIX, PREFIX_WEIGHT, BOOST_FROM = 4, 0.1, 0.7


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared over the smaller set's distinct elements; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edits over the longer length; 0 if one is empty."""
    none = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(none, 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def length_ratio(a: Column, b: Column) -> Column:
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 0.0).otherwise(F.least(F.length(a), F.length(b)) / longer)


def _padded(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in strings])
    out = np.zeros((len(strings), max(1, int(sizes.max(initial=0)))), np.uint32)
    for i, s in enumerate(strings):
        out[i, : sizes[i]] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def jaro_winkler_many(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of pairs, all pairs of a batch a character at a time; 0 if one is empty."""
    a, na = _padded(left)
    b, nb = _padded(right)
    reach = np.maximum(0, np.maximum(na, nb) // 2 - 1)
    in_b = np.arange(b.shape[1])
    used, hit = np.zeros(b.shape, bool), np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        near = (in_b >= (i - reach)[:, None]) & (in_b <= (i + reach)[:, None]) & (in_b < nb[:, None])
        same = near & ~used & (b == a[:, i : i + 1]) & (i < na)[:, None]
        some = same.any(1)
        rows = np.flatnonzero(some)
        used[rows, same[rows].argmax(1)] = True
        hit[:, i] = some
    m = hit.sum(1)
    # the hits of either side in their own order, moved to the left
    width = int(m.max(initial=0))
    first, second = np.zeros((len(m), width), np.uint32), np.zeros((len(m), width), np.uint32)
    for flags, chars, out in ((hit, a, first), (used, b, second)):
        r, c = np.nonzero(flags)
        out[r, (np.cumsum(flags, 1) - 1)[r, c]] = chars[r, c]
    half = (first != second).sum(1) // 2
    safe = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(na, 1) + m / np.maximum(nb, 1) + (m - half) / safe) / 3, 0.0)
    k = min(PREFIX, a.shape[1], b.shape[1])
    equal = (a[:, :k] == b[:, :k]) & (np.arange(k) < np.minimum(na, nb)[:, None])
    prefix = np.cumprod(equal, 1).sum(1)
    return np.where(jaro > BOOST_FROM, jaro + prefix * PREFIX_WEIGHT * (1 - jaro), jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each distinct pair of the batch once, in groups of alike lengths."""
    pairs = pd.DataFrame({"a": a.fillna(""), "b": b.fillna("")})
    code, keys = pd.factorize(pd.MultiIndex.from_frame(pairs))
    left, right = [x[0] for x in keys], [x[1] for x in keys]
    order = np.argsort([max(len(x), len(y)) for x, y in zip(left, right, strict=True)], kind="stable")
    out = np.zeros(len(left))
    at = 0
    while at < len(order):
        longest = max(len(left[order[at]]), len(right[order[at]]), 16)
        rows = order[at : at + max(1, min(2000, 400_000 // longest))]
        out[rows] = jaro_winkler_many([left[i] for i in rows], [right[i] for i in rows])
        at += len(rows)
    return pd.Series(out[code])
