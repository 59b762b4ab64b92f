"""Similarities and scores on columns.  Only the sequence ratio needs Python, in Arrow batches."""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_count(text_tokens: Column, query_tokens: Column) -> Column:
    """How often the query's tokens stand in the text, each as often as the query has it."""
    return F.aggregate(query_tokens, F.lit(0), lambda acc, q: acc + F.size(F.filter(text_tokens, lambda t: t == q)))


def _common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def geometric_overlap(a: Column, b: Column) -> Column:
    n, m = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((n > 0) & (m > 0), _common(a, b) / F.sqrt(n.cast("double") * m)).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    n, m = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((n > 0) & (m > 0), _common(a, b) / F.least(n, m)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, _common(a, b) / n).otherwise(0.0)


#: Pairs of strings whose ratio a worker remembers, and characters of two strings up to which it does.
REMEMBERED, SHORT = 1 << 15, 4096


#: Characters of the second string from where on difflib leaves out the frequent ones.
FREQUENT_FROM = 200


def _matched(x: str, y: str, least: float = 0.0) -> int:
    """Characters in the matching blocks of difflib, where it leaves out none: the longest common run, of equals the first in x, then in y, and the same again on either side of it.

    A run is sought as a string in the other, only ever longer than the best one so far.  0 as soon as `least` is out of reach."""
    todo, total, room = [(0, len(x), 0, len(y))], 0, min(len(x), len(y))
    while todo:
        if total + room < least:
            return 0
        a, a_end, b, b_end = todo.pop()
        room -= min(a_end - a, b_end - b)
        part, best, at, i = y[b:b_end], 0, a, a
        while i + best < a_end:
            if x[i : i + best + 1] in part:
                best, at = best + 1, i
                while i + best < a_end and x[i : i + best + 1] in part:
                    best += 1
            i += 1
        if best:
            total += best
            found = b + part.index(x[at : at + best])
            if a < at and b < found:
                todo.append((a, at, b, found))
                room += min(at - a, found - b)
            if at + best < a_end and found + best < b_end:
                todo.append((at + best, a_end, found + best, b_end))
                room += min(a_end - at, b_end - found) - best
    return total


def _places(x: str, c: str) -> list[int]:
    out, i = [], x.find(c)
    while i >= 0:
        out.append(i)
        i = x.find(c, i + 1)
    return out


@lru_cache(4096)
def _rare_places(y: str) -> tuple[dict[str, list[int]], dict[str, list[int]]]:
    """Where the characters stand that difflib starts blocks at (in a string of FREQUENT_FROM characters and more those that are not frequent there), and where two of them stand side by side."""
    most = len(y) // 100 + 1
    places, twos = {c: _places(y, c) for c in set(y) if y.count(c) <= most}, {}
    for i in sorted(i for own in places.values() for i in own):
        if y[i + 1 : i + 2] in places:
            twos.setdefault(y[i : i + 2], []).append(i)
    return places, twos


def _forward(x: str, i: int, y: str, j: int, most: int) -> int:
    """How many characters from two places on are equal, up to `most`."""
    n = 0
    for step in (64, 8, 1):
        while n + step <= most and x[i + n : i + n + step] == y[j + n : j + n + step]:
            n += step
    return n


def _backward(x: str, i: int, y: str, j: int, most: int) -> int:
    """How many characters ahead of two places are equal, up to `most`."""
    n = 0
    for step in (64, 8, 1):
        while n + step <= most and x[i - n - step : i - n] == y[j - n - step : j - n]:
            n += step
    return n


def _matched_rare(x: str, y: str, least: float = 0.0) -> int:
    """Characters in the matching blocks of difflib, where it leaves out the frequent characters of y: a block is the longest run of rare ones, of equals the first in x, then in y, with what is equal on either side of it;
    without a rare one it is what is equal at the beginning.  0 as soon as `least` is out of reach."""
    places, twos = _rare_places(y)
    at = sorted(p for c in places for p in _places(x, c))
    pairs = [p for p in at if x[p : p + 2] in twos] if twos else []
    todo, total, room = [(0, len(x), 0, len(y))], 0, min(len(x), len(y))
    while todo:
        if total + room < least:
            return 0
        a, a_end, b, b_end = todo.pop()
        room -= min(a_end - a, b_end - b)
        best, i, j, last, before = 0, a, b, -1, {}
        for p in pairs[bisect_left(pairs, a) : bisect_left(pairs, a_end - 1)]:
            if p != last + 1:
                before = {}
            now = {}
            for q in twos[x[p : p + 2]]:
                if b <= q < b_end - 1:
                    k = now[q] = before.get(q - 1, 1) + 1
                    if k > best:
                        best, i, j = k, p - k + 2, q - k + 2
            last, before = p, now
        if not best:  # no two side by side: the first rare character of both
            for n in range(bisect_left(at, a), len(at)):
                p = at[n]
                if p >= a_end:
                    break
                q = next((q for q in places[x[p]] if b <= q < b_end), -1)
                if q >= 0:
                    best, i, j = 1, p, q
                    break
        back = _backward(x, i, y, j, min(i - a, j - b))
        on = best + _forward(x, i + best, y, j + best, min(a_end - i, b_end - j) - best)
        if back + on:
            total += back + on
            if a < i - back and b < j - back:
                todo.append((a, i - back, b, j - back))
                room += min(i - a, j - b) - back
            if i + on < a_end and j + on < b_end:
                todo.append((i + on, a_end, j + on, b_end))
                room += min(a_end - i, b_end - j) - on
    return total


def matching_ratio(x: str, y: str, least: float = 0.0) -> float:
    """The ratio of difflib's SequenceMatcher(None, x, y); 0 where it is below `least` by more than rounding, as far as that is seen early."""
    both = len(x) + len(y)
    return 2.0 * (_matched if len(y) < FREQUENT_FROM else _matched_rare)(x, y, least * both / 2 - 1e-6) / both if both else 1.0


@lru_cache(REMEMBERED)
def _known(x: str, y: str) -> float:
    return matching_ratio(x, y)


def ratio_of(x: str | None, y: str | None) -> float:
    """The matching-blocks ratio of two strings (difflib); 0 where one is null.  Pairs that come again are compared once a worker."""
    if x is None or y is None:
        return 0.0
    if x == y:
        return 1.0
    return _known(x, y) if len(x) + len(y) <= SHORT else _known.__wrapped__(x, y)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio_of() of two columns."""
    from marginalia.functions.scoring import ratio_of  # the worker's own, which remembers from batch to batch

    return pd.Series([ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def blended_similarity(a: Column, b: Column, tokens_a: Column, tokens_b: Column, weight: float) -> Column:
    """weight * sequence ratio + (1 - weight) * Jaccard; equal strings have 1."""
    return F.when(a == b, 1.0).otherwise(weight * sequence_ratio(a, b) + (1 - weight) * jaccard(tokens_a, tokens_b))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def combined_score(bm25: Column, deep: Column, term: Column, hint: Column, focus: Column, anchor: Column) -> Column:
    return 0.75 * bm25 + 0.25 * (1.6 * F.pow(F.greatest(deep, F.lit(0.0)), F.lit(0.6))) + term + 1.5 * hint + 1.15 * focus + 0.35 * anchor


def calibrated_score(raw: Column, bm25: Column, deep: Column, term: Column, semantic: Column, explicit: Column, anchor: Column, has_section: Column) -> Column:
    """A display score of 0 to 100 from a raw one and the evidence behind it."""
    evidence = 100 * (
        0.34 * clamp((bm25 - 0.5) / 6, 0, 1) + 0.18 * clamp(deep / 4, 0, 1) + 0.16 * clamp((term + 1) / 5, 0, 1) + 0.22 * clamp(semantic / 10, 0, 1) + 0.10 * clamp(explicit / 10, 0, 1)
    )
    score = 0.70 * raw + 0.30 * evidence + F.when(has_section, 2.0).otherwise(-4.0) + F.when(term < 0, F.greatest(F.lit(-12.0), 3 * term)).otherwise(0.0)
    score = F.when(bm25 < 1, F.least(score, F.lit(60.0))).when(bm25 < 2, F.least(score, F.lit(68.0))).otherwise(score)
    score = F.when(anchor > 0, F.greatest(score, F.least(F.lit(98.0), 82 + F.least(F.lit(14.0), 0.8 * anchor)))).otherwise(score)
    return clamp(score, 0, 100)


def fallback_score(bm25: Column, deep: Column, term: Column, semantic: Column) -> Column:
    base = 5.15 + 1.55 * F.tanh((bm25 - 3) / 4) + 1.15 * F.tanh((deep - 8) / 16) + 0.8 * F.tanh(term / 1.6)
    return clamp(F.when(semantic > 0, 0.88 * base + 0.12 * semantic).otherwise(base), 0, 10)


def jitter(key: Column, width: float = 0.04) -> Column:
    """A fixed number within +-width for each key, from the first two bytes of its SHA-1."""
    return (F.conv(F.substring(F.sha1(key), 1, 4), 16, 10).cast("double") / 65535 * 2 - 1) * width


def parse_confidence(raw: Column) -> Column:
    """How likely a raw reference was parsed whole."""
    words = F.regexp_count(raw, F.lit("[A-Za-z]+"))
    marks = (F.regexp_count(raw, F.lit("\\.")) >= 2) | (F.regexp_count(raw, F.lit(",")) >= 3)
    score = (
        F.lit(0.50)
        + F.when(F.length(raw) >= 40, 0.16).otherwise(0.0)
        + F.when(words >= 8, 0.12).otherwise(0.0)
        + F.when(raw.rlike("(19|20)\\d{2}"), 0.08).otherwise(0.0)
        + F.when(raw.rlike("10\\.\\d{4,9}/"), 0.09).otherwise(0.0)
        + F.when(marks, 0.06).otherwise(0.0)
        - F.when(raw.rlike("(\\.\\.\\.|-|,)\\s*$"), 0.28).otherwise(0.0)
        - F.when(F.length(raw) < 18, 0.18).otherwise(0.0)
    )
    return clamp(score, 0.05, 0.99)
