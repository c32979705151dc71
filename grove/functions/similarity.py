"""String similarities: batched Arrow functions where Spark has no built-in one."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@lru_cache(100_000)
def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word row of the table at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_of(a: str, b: str) -> float:
    """Normalised indel similarity, 0 to 100; two empty strings: 100."""
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_of(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of its length in the longer one, cut windows at the ends included."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    n, m = len(s), len(t)
    best = max(ratio_of(s, t[max(0, i) : min(m, i + n)]) for i in range(1 - n, m))
    if n == m:
        best = max(best, max(ratio_of(t, s[max(0, i) : min(n, i + m)]) for i in range(1 - m, n)))
    return best


def token_set_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 100.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    scores = [ratio_of(with_x, with_y)] + ([ratio_of(both, with_x), ratio_of(both, with_y)] if both else [])
    return max(scores)


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def jaro_winkler_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    m, swaps = len(hits), sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _udf(of):
    @pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


ratio, partial_ratio, token_set, token_sort, jaro_winkler = map(_udf, (ratio_of, partial_of, token_set_of, token_sort_of, jaro_winkler_of))
