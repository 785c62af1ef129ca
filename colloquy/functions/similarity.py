"""Sequence similarity of text pairs with exact early exits."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of two texts up to which all pairs of their characters are held as the bits of one number.
LONG = 4096


@lru_cache(maxsize=16)
def _places(a: str) -> dict[str, int]:
    """The places of each character of a, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word-parallel step for each character of b. What depends on a alone is kept for the next pairs."""
    masks = _places(a)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        if m := masks.get(c):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def similarity(a: str | None, b: str | None, least: float = 0.0) -> float:
    """0 if either is empty, 1 if equal, else the Ratcliff-Obershelp ratio of a and b; 0 also where it is surely below least.

    Matching blocks form a common subsequence, so its length bounds the ratio.
    """
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    total = len(a) + len(b)
    if least and (2 * min(len(a), len(b)) < least * total or 2 * common_subsequence(a, b) < least * total):
        return 0.0
    return 2 * _matched(a, b) / total


def _matched(a: str, b: str) -> int:
    """Characters in the matching blocks of a and b: the longest common run (the first in a, then in b), then those left and right of it."""
    return _in_bits(a, b) if len(a) * len(b) <= LONG * LONG else _in_runs(a, b)


def _in_bits(a: str, b: str) -> int:
    """_matched of texts whose pairs of characters fit one number: its bit i * width + j says whether runs of some length that begin at a[i] and b[j] are equal.

    Runs of k + n characters are those of k whose place, k further in both texts, begins one of n: so the longest length is
    found by doubling and then by halves, and the lowest bit left is its first place.
    """
    matched, waiting = 0, [(a, b)]
    while waiting:
        a, b = waiting.pop()
        if len(a) == 1 or len(b) == 1:
            matched += a in b or b in a
            continue
        size = len(b) // 8 + 1  # bytes of a row, which ends in a bit that is not set
        none, masks, step = bytes(size), {}, size * 8 + 1
        for j, c in enumerate(b):
            masks[c] = masks.get(c, 0) | 1 << j
        rows = {c: m.to_bytes(size, "little") for c, m in masks.items()}
        runs = int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little")
        if not runs:
            continue
        levels, length = [runs], 1
        while longer := runs & (runs >> length * step):
            levels.append(longer)
            runs, length = longer, length * 2
        for k in range(len(levels) - 2, -1, -1):
            if longer := runs & (levels[k] >> length * step):
                runs, length = longer, length + (1 << k)
        i, j = divmod((runs & -runs).bit_length() - 1, size * 8)
        matched += length
        if i and j:
            waiting.append((a[:i], b[:j]))
        if i + length < len(a) and j + length < len(b):
            waiting.append((a[i + length :], b[j + length :]))
    return matched


def _in_runs(a: str, b: str) -> int:
    """_matched of long texts: the lengths of runs that end at a character of a are kept for all places of b at once, until parts are short enough for _in_bits."""
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    places = {chr(c): np.flatnonzero(codes == c) for c in np.unique(codes)}
    run = np.zeros(len(b) + 1, np.int64)
    matched, waiting = 0, [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        if (a1 - a0) * (b1 - b0) <= LONG * LONG:
            matched += _in_bits(a[a0:a1], b[b0:b1])
            continue
        best, at_a, at_b, last = 0, a0, b0, np.zeros(0, np.int64)
        for i in range(a0, a1):
            here = places.get(a[i])
            if here is None:
                run[last + 1] = 0
                last = last[:0]
                continue
            if b0 or b1 < len(b):
                here = here[np.searchsorted(here, b0) : np.searchsorted(here, b1)]
            size = run[here] + 1
            run[last + 1] = 0
            run[here + 1] = size
            last = here
            if len(size) and (k := int(size.argmax())) >= 0 and size[k] > best:
                best = int(size[k])
                at_a, at_b = i - best + 1, int(here[k]) - best + 1
        run[last + 1] = 0
        if best:
            matched += best
            if a0 < at_a and b0 < at_b:
                waiting.append((a0, at_a, b0, at_b))
            if at_a + best < a1 and at_b + best < b1:
                waiting.append((at_a + best, a1, at_b + best, b1))
    return matched


def similarity_column(a: Column, b: Column, least: Column | float = 0.0) -> Column:
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([similarity(p, q, r) for p, q, r in zip(x, y, z, strict=True)], dtype="float64")

    return score(a, b, least if isinstance(least, Column) else F.lit(float(least)))


#: Characters that a signature counts one by one; all others are counted together.
COUNTED = " abcdefghijklmnopqrstuvwxyz"


def signature(text: Column) -> Column:
    """How often a text holds each counted character, and any other, as an array."""
    counts = F.transform(F.array(*map(F.lit, COUNTED)), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    return F.concat(counts, F.array(F.length(F.regexp_replace(text, f"[{COUNTED[0]}{COUNTED[1]}-{COUNTED[-1]}]", ""))))


def signature_allows(a: Column, b: Column, n: Column, m: Column, least: float) -> Column:
    """Whether texts of lengths n and m with signatures a and b can be as similar as least: matching blocks hold no character more often than both texts do."""
    return 2 * F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y) >= least * (n + m)


def length_allows(a: Column, b: Column, least: float) -> Column:
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))
