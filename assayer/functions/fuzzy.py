"""String similarity from the published definition of the Indel distance, as Arrow UDFs.

similarity = 200 * LCS / (|a| + |b|). Call these on distinct pairs that no exact test has settled.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    free = all_ = (1 << len(a)) - 1
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & all_
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The shared words against each side's; 100 if one side's words are among the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and not (left and right):
        return 100.0
    one, two = f"{shared} {left}".strip(), f"{shared} {right}".strip()
    best = ratio(one, two)
    return max(best, ratio(shared, one), ratio(shared, two)) if shared else best


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer that is no longer than it."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    for i in range(1 - n, len(long)):
        part = long[max(0, i) : i + n]
        if part and (part[0] in short or part[-1] in short):
            best = max(best, ratio(short, part))
    return best


def end_distances(pattern: str, long: str) -> np.ndarray:
    """At each position of long, the fewest insertions and deletions between pattern and some stretch that ends there.

    A column of the table of distances, in one bit for each character of pattern, is carried along long: where the
    distance falls, stays or rises from one row to the next (down, level), and from one column to the next (less, even).
    """
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    all_ = (1 << len(pattern)) - 1
    top, now = 1 << len(pattern) - 1, len(pattern)
    down = level = 0  # at first every row costs one more than the one before
    found = np.empty(len(long), np.int64)
    for j, c in enumerate(long):
        match = where.get(c, 0)
        up = all_ ^ down ^ level
        less = (((up + (match & up)) ^ up) | match) & up
        start = level & (match | less << 1)
        run = up & ~less
        even = start | ((run + (((start << 1) | 1) & run)) ^ run) & run
        now += -1 if less & top else 0 if even & top else 1
        even_in = ((even << 1) | 1) & all_
        more_in = all_ ^ even_in ^ ((less << 1) & all_)
        level, down = (match & even_in) | (~match & ((down & even_in) | (level & more_in))), more_in & (match | down)
        found[j] = now
    return found


def reaches(a: str, b: str, threshold: float) -> bool:
    """partial(a, b) >= threshold: only stretches that end where the carried distance is small enough are compared.

    Of those, the common subsequence grows by 1 at most from one stretch to the next and what is needed falls by at
    most threshold / 200, so a stretch that is short of it by a gap rules out those after it.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short or short in long:
        return partial(short, long) >= threshold
    n = len(short)
    starts = np.concatenate([np.arange(1 - n, 0), full_stretches(short, long, threshold), np.arange(len(long) - n + 1, len(long))])
    # stretches that overlap are searched as one text; a stretch of a far one begins with a column of its own
    breaks = np.flatnonzero(np.diff(starts) > n) + 1
    near = []
    for part in np.split(starts, breaks):
        first, ends = max(0, int(part[0])), np.minimum(part + n, len(long))
        off = end_distances(short, long[first : int(ends[-1])])[ends - first - 1]
        near.append(part[off <= (1 - threshold / 100) * (n + ends - np.maximum(part, 0)) + 1e-6])
    starts = np.concatenate(near)
    at = 0
    while at < len(starts):
        i = int(starts[at])
        part = long[max(0, i) : i + n]
        common = lcs(short, part)
        if 200.0 * common / (n + len(part)) >= threshold and (part[0] in short or part[-1] in short):
            return True
        gap = threshold * (n + len(part)) / 200 - common
        at = max(at + 1, int(np.searchsorted(starts, i + math.floor(gap / (1 + threshold / 200)))))
    return False


def _grams(text: str) -> np.ndarray:
    """16-bit hashes of the stretches of four characters."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = cp[:-3] * np.uint32(0x9E3779B1) ^ cp[1:-2] * np.uint32(0x85EBCA6B) ^ cp[2:-1] * np.uint32(0xC2B2AE35) ^ cp[3:] * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def full_stretches(short: str, long: str, threshold: float) -> np.ndarray:
    """Where a stretch of long, as long as short, may begin that reaches the threshold.

    k characters missing and k others in their place leave all but 7 k of the n - 3 stretches of four
    characters of short whole, and threshold allows k up to (1 - threshold / 100) n.
    """
    n, every = len(short), np.arange(len(long) - len(short) + 1)
    least = n - 3 - 7 * math.floor((1 - threshold / 100) * n + 1e-6)
    if least <= 0:
        return every
    known = np.zeros(1 << 16, np.int64)
    known[_grams(short)] = 1
    upto = np.append(0, np.cumsum(known[_grams(long)]))
    return every[upto[n - 3 :] - upto[: len(upto) - n + 3] >= least]


def may_be_same(a: Column, b: Column, threshold: float) -> Column:
    """False where same_value is false for sure: a bound from lengths and from characters that only one side has."""
    n, m = F.length(a), F.length(b)
    left = lambda x, y: F.length(F.call_function("translate", x, y, F.lit("")))
    k, l = n - left(a, b), m - left(b, a)
    near = 200 * F.least(k, l) >= threshold * (n + m)
    words = F.arrays_overlap(F.split(a, " "), F.split(b, " "))
    short, long = F.least(n, m), F.greatest(n, m)
    inside = F.when(n <= m, k).otherwise(l)
    part = (short >= 8) & (long > 1.2 * short) & (200 * inside >= threshold * (short + inside))
    return words | near | part


@lru_cache(maxsize=1 << 16)
def same_value(a: str, b: str, threshold: float) -> bool:
    """Normed strings that name the same thing: by their words, or one within the other."""
    if a == b:
        return True
    if token_set(a, b) >= threshold:
        return True
    short, long = sorted((len(a), len(b)))
    return short >= 8 and long > 1.2 * short and reaches(a, b, threshold)


def _udf(function):
    @F.pandas_udf(types.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


plain_ratio, token_sort_ratio, token_set_ratio, partial_ratio = (_udf(f) for f in (ratio, token_sort, token_set, partial))


def stands_in(threshold: float):
    """UDF: an excerpt stands in a source word for word, or nearly in the best stretch of the whole source."""

    @F.pandas_udf(types.BooleanType())
    def run(excerpt: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([None if e is None or s is None else e in s or reaches(e, s, threshold) for e, s in zip(excerpt, source, strict=True)], dtype="object")

    return run


def mismatch_class(truth: str, predicted: str) -> str:
    """How a predicted value, folded like the true one, differs from it."""
    # fixed values: the classes, their order and thresholds
    if not truth or not predicted:
        return "both_empty" if truth == predicted else "hallucination" if predicted else "missing_value"
    if truth == predicted:
        return "identical_after_fold"
    near = ratio(predicted, truth)
    if near >= 95:
        return "near_identical"
    if token_sort(predicted, truth) >= 95:
        return "word_order_only"
    if near >= 80:
        return "minor_diff"
    if reaches(predicted, truth, 90):
        return "substring"
    if predicted.lower() == truth.lower():
        return "case_only"
    short, long = sorted((len(predicted), len(truth)))
    return "abbreviation_or_truncation" if short < 0.6 * long else "genuine_mismatch"


@F.pandas_udf(types.StringType())
def mismatch(truth: pd.Series, predicted: pd.Series) -> pd.Series:
    return pd.Series([mismatch_class(t or "", p or "") for t, p in zip(truth, predicted, strict=True)])
