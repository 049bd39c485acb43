"""String similarity: restricted Damerau distance and a weighted ratio, with Arrow wrappers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nomenclia.functions.text import plain_phrase


def osa(a: str, b: str, most: int = 1 << 30) -> int:
    """Optimal string alignment: edits and swaps of neighbours, none edited twice; ``most + 1`` if above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most and min(last) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths, in percent."""
    return 100.0 if not a and not b else 200.0 * _common(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ``ratio`` of the shorter string with a stretch of the longer, ends cut short included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best = 0.0
    for k in range(1 - len(a), len(b)):
        best = max(best, ratio(a, b[max(0, k) : k + len(a)]))
    return best


def token_sort_ratio(a: str, b: str, of=ratio) -> float:
    return of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str, of=ratio) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if of is partial_ratio:
        return 100.0 if both else of(only_x, only_y)
    if both and (not only_x or not only_y):
        return 100.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max(of(with_x, with_y), of(both, with_x) if both else 0.0, of(both, with_y) if both else 0.0)


def wratio(a: str, b: str) -> float:
    """The weighted ratio: whole, sorted and set ratios for like lengths, partial ones scaled down for unlike."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer < 8 else 0.6
    best = max(best, scale * partial_ratio(a, b))
    return max(best, 0.95 * scale * max(token_sort_ratio(a, b, partial_ratio), token_set_ratio(a, b, partial_ratio)))


def best_matches(query: str, choices: list[str], limit: int, cutoff: float = 0.0) -> list[tuple[str, float]]:
    """The ``limit`` best choices of at least ``cutoff``, ties by text."""
    q = plain_phrase(query)
    scored = ((c, wratio(q, plain_phrase(c))) for c in choices)
    return sorted((x for x in scored if x[1] >= cutoff), key=lambda x: (-x[1], x[0]))[:limit]


def wratio_column(a: Column, b: Column) -> Column:
    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([wratio(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(scores, "double")(a, b)


def osa_column(a: Column, b: Column, most: int) -> Column:
    def distances(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa(p or "", q or "", most) for p, q in zip(x, y, strict=True)], dtype="int32")

    return F.pandas_udf(distances, "int")(a, b)
