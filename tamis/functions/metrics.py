"""Field scores of two records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """Jaro similarity; half transpositions are kept as halves."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), -1)
        if j >= 0:
            taken[j] = True
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m, moved = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2.0
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3.0


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with a bonus for up to four equal first letters, from 0.7 on."""
    x = jaro(a, b)
    if x < 0.7:
        return x
    prefix = next((i for i, (c, d) in enumerate(zip(a[:4], b[:4], strict=False)) if c != d), min(4, len(a), len(b)))
    return x + prefix * 0.1 * (1.0 - x)


#: Letters that fit the bits of a word.
_BITS = 64


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings, padded with zeros, and lengths."""
    width = max(1, max(map(len, strings), default=1))
    return np.array(strings, f"<U{width}").view(np.uint32).reshape(len(strings), width), np.array([len(s) for s in strings], np.int64)


def jaro_winklers(left: list[str], right: list[str]) -> np.ndarray:
    """jaro_winkler of pairs of strings of at most 64 letters, side by side: the free places of the right strings are bits."""
    a, n = _codes(left)
    b, m = _codes(right)
    rows, one = np.arange(len(left)), np.uint64(1)
    below = lambda k: np.where(k >= _BITS, ~np.uint64(0), (one << np.minimum(k, _BITS - 1).astype(np.uint64)) - one)
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    free = below(m)
    matched = np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        equal = np.zeros((len(left), 8), np.uint8)
        packed = np.packbits(b == a[:, i : i + 1], axis=1, bitorder="little")
        equal[:, : packed.shape[1]] = packed
        window = below(np.minimum(i + reach + 1, _BITS)) & ~below(np.maximum(i - reach, 0))
        hits = equal.view("<u8")[:, 0] & window & free
        hits[i >= n] = 0
        free ^= hits & (~hits + one)  # the first place that fits is taken
        matched[:, i] = hits != 0
    taken = np.unpackbits((below(m) & ~free).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : b.shape[1]].astype(bool)
    both = matched.sum(1)
    moved = np.bincount(np.repeat(rows, both), weights=a[matched] != b[taken], minlength=len(left)) / 2.0
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(both > 0, (both / n + both / m + (both - moved) / both) / 3.0, 0.0)
    x[(n == 0) & (m == 0)] = 1.0
    w = min(4, a.shape[1], b.shape[1])
    same = np.cumprod((a[:, :w] == b[:, :w]) & (a[:, :w] != 0), axis=1).sum(1)
    return np.where(x < 0.7, x, x + same * 0.1 * (1.0 - x))


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each pair of different names of a batch is scored once."""
    codes, names = pd.factorize(pd.concat([a.fillna(""), b.fillna("")], ignore_index=True))
    pairs, back = np.unique(codes[: len(a)].astype(np.int64) * max(1, len(names)) + codes[len(a) :], return_inverse=True)
    left, right = (names.take(x).tolist() for x in np.divmod(pairs, max(1, len(names))))
    out = np.zeros(len(pairs))
    short = np.array([len(x) <= _BITS and len(y) <= _BITS and "\0" not in x + y for x, y in zip(left, right, strict=True)], bool)
    pick = lambda some, at: [some[k] for k in at]
    fit, rest = np.flatnonzero(short), np.flatnonzero(~short)
    if len(fit):
        out[fit] = jaro_winklers(pick(left, fit), pick(right, fit))
    out[rest] = [jaro_winkler(left[k], right[k]) for k in rest]
    return pd.Series(out[back.reshape(-1)], dtype="float64")


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def token_jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def dob_score(a: Column, b: Column) -> Column:
    """Null where a date is missing."""
    year = F.year(a) == F.year(b)
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when(a == b, 1.0)
        .when(year & (F.dayofmonth(a) == F.month(b)) & (F.month(a) == F.dayofmonth(b)), 0.85)
        .when(year & (F.month(a) == F.month(b)), 0.60)
        .when(year, 0.30)
        .when(F.abs(F.year(a) - F.year(b)) == 1, 0.15)
        .otherwise(0.0)
    )


def phone_score(a: Column, b: Column) -> Column:
    """Of phone keys; null where one is empty."""
    d = levenshtein(a, b)
    return F.when((a == "") | (b == ""), None).when(d == 0, 1.0).when(d == 1, 0.70).when(d == 2, 0.35).otherwise(0.0)
