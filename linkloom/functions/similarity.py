"""Similarity of pairs of strings and sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams of the text without spaces; the whole text if it is shorter; none if it is empty."""
    s = F.replace(c, F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, F.lit(n)))
    return F.when(s == "", F.array().cast("array<string>")).when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(grams))


def acronym_hit(a: Column, b: Column) -> Column:
    """Whether the initials of one (two or more) are the other's initials, or in its letters."""
    first = lambda ts: F.array_join(F.transform(ts, lambda t: F.left(t, F.lit(1))), "")
    compact = lambda ts: F.array_join(ts, "")
    hit = lambda x, y: (F.length(first(x)) >= 2) & ((first(x) == first(y)) | F.contains(compact(y), first(x)))
    return hit(a, b) | hit(b, a)


def edit_distance(a: Column, b: Column, limit: int) -> Column:
    """Levenshtein distance; limit + 1 beyond the limit."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def weighted_overlap(a: Column, b: Column, idf: Column, unknown: Column) -> Column:
    """Sum of idf (a map) over the intersection by that over the union; 0 if the union is empty."""
    total = lambda ts: F.aggregate(ts, F.lit(0.0), lambda s, t: s + F.coalesce(F.element_at(idf, t), unknown))
    both = total(F.array_union(a, b))
    return F.when(both > 0, total(F.array_intersect(a, b)) / both).otherwise(0.0)


def jaro_winkler_of(a: str, b: str, weight: float = 0.1, prefix: int = 4, from_: float = 0.7) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, found = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                found.append(c)
                break
    if not found:
        return 0.0
    m = len(found)
    moved = sum(x != y for x, y in zip(found, (b[j] for j in range(len(b)) if taken[j]))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= from_:
        return jaro
    same = 0
    while same < min(prefix, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * weight * (1 - jaro)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each position of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio_of(a: str, b: str) -> float:
    """100 * twice the longest common subsequence by the lengths' sum."""
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def partial_ratio_of(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length, cut at the longer text's ends."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    return max(ratio_of(a, b[max(0, k) : k + len(a)]) for k in range(1 - len(a), len(b)))


#: Pairs compared at a time; the longest texts that are (the shorter one's letters are bits of a word). Others are compared one by one.
PAIRS, SHORT, LONG = 256, 64, 256


def _letters(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each text, filled up with pad; lengths."""
    n = np.array([len(t) for t in texts], np.int64)
    points = np.full((len(texts), max(1, n.max())), pad, np.uint32)
    points[np.arange(points.shape[1]) < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, n


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each letter of b the letters of a that equal it, as bits."""
    if max(a.max(where=a < 0x110000, initial=0), b.max(where=b < 0x110000, initial=0)) < 254:
        a, b = (np.where(x < 0x110000, x, x - 0x110000 + 254).astype(np.uint8) for x in (a, b))
    same = np.zeros((*b.shape, 64), bool)
    np.equal(a[:, None, :], b[:, :, None], out=same[:, :, : a.shape[1]])
    return np.packbits(same, axis=2, bitorder="little").view("<u8")[:, :, 0].astype(np.uint64)


def _full(n: np.ndarray) -> np.ndarray:
    return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    """ratio_of for texts that aren't empty, those of a at most SHORT letters long."""
    (x, m), (y, n) = _letters(a, 0x110000), _letters(b, 0x110001)
    equal, full = _equal(x, y), _full(m)
    s = full.copy()
    for j in range(y.shape[1]):
        u = s & equal[:, j]
        s = s + u | s - u
    return 200.0 * (m - np.bitwise_count(s & full)) / (m + n)


def _partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """partial_ratio_of for the shorter text first, neither empty: all windows of all pairs go through the recurrence together."""
    (x, m), (y, n) = _letters(a, 0x110000), _letters(b, 0x110001)
    equal, full = _equal(x, y), _full(m)
    most, wide = x.shape[1], y.shape[1]
    equal = np.pad(equal, ((0, 0), (0, most)))
    s = np.repeat(full[:, None], wide, axis=1)  # a window for each start in b
    best = np.zeros(len(a))
    for t in range(most):
        u = np.where((t < m)[:, None], equal[:, t : t + wide], np.uint64(0)) & s
        s = s + u | s - u
        # windows cut at b's start are b's beginnings
        first = 200.0 * (m - np.bitwise_count(s[:, 0] & full)) / (m + np.minimum(t + 1, n))
        best = np.where(t < m, np.maximum(best, first), best)
    size = np.minimum(m[:, None], n[:, None] - np.arange(wide))
    whole = 200.0 * (m[:, None] - np.bitwise_count(s & full[:, None]).astype(np.int64)) / np.maximum(m[:, None] + size, 1)
    return np.maximum(best, np.where(size > 0, whole, 0.0).max(axis=1))


def _jaro_winklers(a: list[str], b: list[str], weight: float = 0.1, prefix: int = 4, from_: float = 0.7) -> np.ndarray:
    """jaro_winkler_of for texts that aren't empty, those of b at most SHORT letters long."""
    (x, m), (y, n) = _letters(a, 0x110000), _letters(b, 0x110001)
    equal, reach = _equal(y, x), np.maximum(m, n) // 2 - 1
    taken, mine = np.zeros(len(a), np.uint64), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        # positions max(0, i - reach) to i + reach
        near = _full(np.clip(i + reach + 1, 0, 64)) & ~_full(np.clip(i - reach, 0, 64))
        free = equal[:, i] & near & ~taken
        low = free & (~free + np.uint64(1))
        taken |= low
        mine[:, i] = low != 0
    theirs = (taken[:, None] >> np.arange(y.shape[1], dtype=np.uint64)) & np.uint64(1) != 0
    found = mine.sum(axis=1)
    row = np.repeat(np.arange(len(a)), found)
    moved = np.bincount(row, x[mine] != y[theirs], minlength=len(a)).astype(np.int64) // 2
    some = np.maximum(found, 1)
    jaro = np.where(found > 0, (found / m + found / n + (found - moved) / some) / 3, 0.0)
    k = min(prefix, x.shape[1], y.shape[1])
    same = np.logical_and.accumulate(x[:, :k] == y[:, :k], axis=1).sum(axis=1)
    return np.where(jaro <= from_, jaro, jaro + same * weight * (1 - jaro))


def _together(one, many, by_length: bool):
    """one(a, b) for lists of texts: those that fit by `many`, PAIRS at a time and of like length. by_length: the shorter is given first."""

    def run(a: list[str], b: list[str]) -> np.ndarray:
        if by_length:
            a, b = (list(t) for t in zip(*((p, q) if len(p) <= len(q) else (q, p) for p, q in zip(a, b)))) if a else ([], [])
        out = np.empty(len(a))
        bits = a if by_length else b
        fit = [0 < len(s) <= SHORT and 0 < len(p) <= LONG and 0 < len(q) <= LONG for s, p, q in zip(bits, a, b)]
        for i in (i for i, f in enumerate(fit) if not f):
            out[i] = one(a[i], b[i])
        rest = sorted((i for i, f in enumerate(fit) if f), key=lambda i: (len(a[i]), len(b[i])))
        for k in range(0, len(rest), PAIRS):
            some = rest[k : k + PAIRS]
            out[some] = many([a[i] for i in some], [b[i] for i in some])
        return out

    return run


jaro_winklers = _together(jaro_winkler_of, _jaro_winklers, False)
ratios = _together(ratio_of, _ratios, True)
partial_ratios = _together(partial_ratio_of, _partial_ratios, True)


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    words = {t: " ".join(sorted(t.split())) for t in {*a, *b}}
    return ratios([words[t] for t in a], [words[t] for t in b])


def _pairwise(f):
    """f for the distinct pairs of a batch."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], int] = {}
        at = [known.setdefault((x or "", y or ""), len(known)) for x, y in zip(a, b)]
        return pd.Series(f([x for x, _ in known], [y for _, y in known])[at], dtype="float64")

    return run


jaro_winkler = _pairwise(jaro_winklers)
ratio = _pairwise(ratios)
token_sort_ratio = _pairwise(token_sort_ratios)
partial_ratio = _pairwise(partial_ratios)
