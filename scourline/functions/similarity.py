"""Normalised similarities of two texts, from 0 to 1, and 1 for two empty texts.

Hamming, MLIPNS, Levenshtein, Jaccard, overlap and cosine are built-in expressions; the two common
sequence measures and match rating need dynamic programs and run as Arrow-batched pandas functions.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: MLIPNS accepts up to so many mismatches as not being there, and this share of the rest.
MLIPNS_MISMATCHES, MLIPNS_SHARE = 2, 0.25


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _longest(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def _mismatches(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(_chars(a), _chars(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda n, x: n + x
    )


def hamming(a: Column, b: Column) -> Column:
    """1 less the share of positions that differ, those beyond the shorter text included."""
    return 1 - _share_zero(_mismatches(a, b), _longest(a, b))


def hamming_budget(size: int, threshold: float) -> int:
    """The most positions of a longer text of ``size`` that may differ for a Hamming value over the threshold; 0 if none."""
    return max((d for d in range(size + 1) if 1 - d / size > threshold), default=0)


def _share_zero(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def mlipns(a: Column, b: Column) -> Column:
    """1 if few positions differ once a few mismatches are left out, else 0."""
    size, wrong = _longest(a, b), _mismatches(a, b)
    hit = size == 0
    for m in range(MLIPNS_MISMATCHES + 1):
        hit = hit | (size <= m) | (wrong - m <= MLIPNS_SHARE * (size - m))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(hit, 1.0).otherwise(0.0))


def levenshtein(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text."""
    return 1 - _share_zero(F.levenshtein(a, b), _longest(a, b))


def _common(a: Column, b: Column) -> Column:
    """Characters in common, each as often as both texts hold it."""
    left, right = _chars(a), _chars(b)
    count = lambda text, x: F.size(F.filter(text, lambda y: y == x))
    return F.aggregate(
        F.transform(F.array_distinct(left), lambda x: F.least(count(left, x), count(right, x))), F.lit(0), lambda n, x: n + x
    )


def jaccard(a: Column, b: Column) -> Column:
    """Common characters as a share of all, counted with repeats."""
    both = _common(a, b)
    return _share(both, F.length(a) + F.length(b) - both)


def overlap(a: Column, b: Column) -> Column:
    """Common characters as a share of the shorter text."""
    shorter = F.least(F.length(a), F.length(b))
    return F.when(_longest(a, b) == 0, 1.0).when(shorter == 0, 0.0).otherwise(_common(a, b) / shorter)


def cosine(a: Column, b: Column) -> Column:
    """Common characters as a share of the geometric mean of the lengths."""
    product = F.length(a) * F.length(b)
    return F.when(_longest(a, b) == 0, 1.0).when(product == 0, 0.0).otherwise(_common(a, b) / F.sqrt(product))


def _pairwise(score: Callable[[str, str], float]):
    active = SparkSession.getActiveSession()
    if active is not None:
        ship(active)

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else score(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")

    return run


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    row = (1 << len(a)) - 1
    full = row
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def common_substring(a: str, b: str) -> int:
    """Length of the longest common substring."""
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                row[j + 1] = last[j] + 1
        best, last = max(best, *row), row
    return best


def rating_code(text: str) -> str:
    """Match-rating code: first letter, then consonants, repeats squeezed, first and last three."""
    text = text.upper()
    kept = text[:1] + "".join(x for x in text[1:] if x not in "AEIOU")
    code = "".join(x for x, _ in groupby(kept))
    return code if len(code) <= 6 else code[:3] + code[-3:]


def match_rating(a: str, b: str) -> float:
    """Letters matched from the left, then from the right, as a share of the longer code."""
    one, two = rating_code(a), rating_code(b)
    longest = max(len(one), len(two))
    if not longest:
        return 1.0
    if abs(len(one) - len(two)) > 2:
        return 0.0
    for _ in range(2):
        pairs = list(zip(one, two, strict=False))
        size = len(pairs)
        one = ("".join(x for x, y in pairs if x != y) + one[size:])[::-1]
        two = ("".join(y for x, y in pairs if x != y) + two[size:])[::-1]
    return (longest - max(len(one), len(two))) / longest


def lcsseq(a: Column, b: Column) -> Column:
    """Longest common subsequence as a share of the longer text."""
    return _pairwise(lambda x, y: common_subsequence(x, y) / max(len(x), len(y)) if x or y else 1.0)(a, b)


def lcsstr(a: Column, b: Column) -> Column:
    """Longest common substring as a share of the longer text."""
    return _pairwise(lambda x, y: common_substring(x, y) / max(len(x), len(y)) if x or y else 1.0)(a, b)


def mra(a: Column, b: Column) -> Column:
    """Match-rating similarity."""
    return _pairwise(match_rating)(a, b)


METHODS = {
    "hamming": hamming, "mlipns": mlipns, "levenshtein": levenshtein, "jaccard": jaccard, "overlap": overlap,
    "cosine": cosine, "lcsseq": lcsseq, "lcsstr": lcsstr, "mra": mra,
}
#: Methods whose value can't exceed the shorter length as a share of the longer one.
LENGTH_BOUND = frozenset({"hamming", "levenshtein", "jaccard", "lcsseq", "lcsstr"})


def similarity(method: str) -> Callable[[Column, Column], Column]:
    if method not in METHODS:
        raise ValueError(f"unknown similarity {method!r}; one of {sorted(METHODS)}")
    return METHODS[method]
