"""String similarity on a scale of 0 to 100, as Arrow functions over pairs of columns.

Two empty strings are equal (100) to `ratio`, `partial_ratio` and `token_sort_ratio`; the set
ratios are 0 if either side has no tokens, Jaro-Winkler (0 to 1) is 0 if a side is empty and
the other isn't, 1 if both are. Null on a side gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word's worth of columns at a time."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against windows of its length in the longer, cut at the ends."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    m = len(short)
    best = max(ratio(short, long[max(0, k) : k + m]) for k in range(1 - m, len(long)))
    return max(best, max(ratio(long, short[max(0, k) : k + m]) for k in range(1 - m, m))) if len(a) == len(b) else best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _sets(a: str, b: str) -> tuple[str, str, str] | None:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return None
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str) -> float:
    parts = _sets(a, b)
    if parts is None:
        return 0.0
    both, left, right = parts
    if both and (not left or not right):
        return 100.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    scores = [ratio(with_left, with_right)]
    if both:
        scores += [ratio(both, with_left), ratio(both, with_right)]
    return max(scores)


def partial_token_set_ratio(a: str, b: str) -> float:
    parts = _sets(a, b)
    if parts is None:
        return 0.0
    return 100.0 if parts[0] else partial_ratio(parts[1], parts[2])


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(mine, other, strict=True)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


KERNELS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "partial_token_set_ratio": partial_token_set_ratio, "jaro_winkler": jaro_winkler,
}


class Texts:
    """Texts as small codes, one row for each place in a text, and for each text the places of its characters as bits; up to 64 places."""

    def __init__(self, texts: list[str], table: np.ndarray):
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.zeros((len(texts), int(self.size.max(initial=0))), np.int64)
        code[np.arange(code.shape[1]) < self.size[:, None]] = table[chars]
        self.code = np.ascontiguousarray(code.T)

    def places(self, kinds: int) -> np.ndarray:
        """For each text and code, one after the other."""
        out, base = np.zeros(len(self.size) * kinds, np.uint64), np.arange(len(self.size)) * kinds
        for k, code in enumerate(self.code):
            out[base + code] |= np.where(self.size > k, np.uint64(1 << k), np.uint64(0))
        return out


def _together(a: list[str], b: list[str]) -> tuple[Texts, Texts, int]:
    kinds = sorted(map(ord, set("".join(a)) | set("".join(b))))
    table = np.zeros(kinds[-1] + 1 if kinds else 1, np.int64)
    table[kinds] = np.arange(len(kinds))
    return Texts(a, table), Texts(b, table), max(1, len(kinds))


WORD, CHUNK = 64, 2048
#: The lowest n bits, for n from 0 to 64.
LOW = np.array([(1 << n) - 1 for n in range(WORD + 1)], np.uint64)


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """`lcs` of many pairs, a step for each character of the longer texts; those over a machine word one at a time."""
    out = np.zeros(len(a), np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    for i, (x, y) in enumerate(pairs):
        if len(x) > WORD:
            out[i] = lcs(x, y)
    # longest first, so that a step's pairs are the first ones
    short = sorted((i for i, (x, _) in enumerate(pairs) if 0 < len(x) <= WORD), key=lambda i: -len(pairs[i][1]))
    for lo in range(0, len(short), CHUNK):
        at = np.array(short[lo : lo + CHUNK])
        x, y, kinds = _together([pairs[i][0] for i in at], [pairs[i][1] for i in at])
        places, row, base = x.places(kinds), LOW[x.size], np.arange(len(at)) * kinds
        left = len(at) - np.searchsorted(y.size[::-1], np.arange(len(y.code)), side="right")
        for code, n in zip(y.code, left, strict=True):
            now = row[:n]
            hit = now & places.take(base[:n] + code[:n])
            now[:] = (now + hit) | (now - hit)
        out[at] = x.size - np.bitwise_count(row & LOW[x.size])
    return out


def ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    n = np.fromiter(map(len, a), np.int64, len(a)) + np.fromiter(map(len, b), np.int64, len(b))
    return np.where(n > 0, 200.0 * lcs_many(a, b) / np.maximum(n, 1), 100.0)


def token_sort_many(a: list[str], b: list[str]) -> np.ndarray:
    in_order = {t: " ".join(sorted(t.split())) for t in {*a, *b}}
    return ratio_many([in_order[t] for t in a], [in_order[t] for t in b])


def token_set_many(a: list[str], b: list[str]) -> np.ndarray:
    """`token_set_ratio`: of texts that begin alike only what follows has to be compared."""
    words = {t: frozenset(t.split()) for t in {*a, *b}}
    width = lambda found: sum(map(len, found)) + len(found) - 1 if found else 0
    out, which, lefts, rights, sizes = np.zeros(len(a)), [], [], [], []
    for i, (s, t) in enumerate(zip(a, b, strict=True)):
        x, y = words[s], words[t]
        if not x or not y:
            continue
        both, left, right = x & y, x - y, y - x
        if both and (not left or not right):
            out[i] = 100.0
            continue
        which.append(i)
        lefts.append(" ".join(sorted(left)))
        rights.append(" ".join(sorted(right)))
        sizes.append(width(both))
    if which:
        both, (p, q) = np.array(sizes), (np.fromiter(map(len, side), np.int64, len(which)) for side in (lefts, rights))
        begin = np.where(both > 0, both + 1, 0)
        best = 200.0 * (begin + lcs_many(lefts, rights)) / (2 * begin + p + q)
        for side in (p, q):
            best = np.maximum(best, np.where(both > 0, 200.0 * both / (both + begin + side), 0.0))
        out[which] = best
    return out


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    """`jaro_winkler` of many pairs, a step for each character of a; those over a machine word one at a time."""
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(a, b, strict=True)])
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x != y and max(len(x), len(y)) > WORD and x and y:
            out[i] = jaro_winkler(x, y)
    short = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y and x and y and max(len(x), len(y)) <= WORD]
    for lo in range(0, len(short), CHUNK):
        at = np.array(short[lo : lo + CHUNK])
        x, y, kinds = _together([a[i] for i in at], [b[i] for i in at])
        places, reach, base = y.places(kinds), np.maximum(np.maximum(x.size, y.size) // 2 - 1, 0), np.arange(len(at)) * kinds
        taken, mine = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for k, code in enumerate(x.code):
            window = np.where(x.size > k, LOW[np.minimum(y.size, k + reach + 1)] & ~LOW[np.clip(k - reach, 0, WORD)], np.uint64(0))
            free = places.take(base + code) & window & ~taken
            taken |= free & (~free + np.uint64(1))
            mine |= np.where(free > 0, np.uint64(1 << k), np.uint64(0))
        m = np.bitwise_count(mine).astype(np.int64)
        bits = lambda found, width: np.nonzero(found[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1))
        of, there = bits(mine, len(x.code)), bits(taken, len(y.code))
        swaps = np.bincount(of[0], x.code[of[::-1]] != y.code[there[::-1]], minlength=len(at)).astype(np.int64) // 2
        jaro = (m / x.size + m / y.size + (m - swaps) / np.maximum(m, 1)) / 3
        n = min(4, len(x.code), len(y.code))
        alike = (x.code[:n] == y.code[:n]) & (np.arange(n)[:, None] < np.minimum(x.size, y.size))
        jaro = np.where(jaro > 0.7, jaro + 0.1 * np.cumprod(alike, axis=0).sum(0) * (1 - jaro), jaro)
        out[at] = np.where(m > 0, jaro, 0.0)
    return out


#: Kernels of whole batches, equal to the last place to those of a pair.
MANY: dict[str, Callable[[list[str], list[str]], np.ndarray]] = {"ratio": ratio_many, "token_sort_ratio": token_sort_many, "token_set_ratio": token_set_many, "jaro_winkler": jaro_winkler_many}


def scores(name: str, a: pd.Series, b: pd.Series) -> pd.Series:
    """The named similarity of each row, null where a side is; pairs that repeat are scored once."""
    pairs = list(zip(a, b, strict=True))
    each = list({p for p in pairs if p[0] is not None and p[1] is not None})
    found = MANY[name]([x for x, _ in each], [y for _, y in each]) if name in MANY else [KERNELS[name](*p) for p in each]
    known = dict(zip(each, map(float, found), strict=True))
    return pd.Series([known.get(p) for p in pairs], dtype="float64")


def kernel(name: str) -> Callable[[Column | str, Column | str], Column]:
    """The named similarity as a function of two columns; pairs that repeat within a batch are scored once."""

    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return scores(name, a, b)

    scored.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(scored, "double")


def ratio_sql(a: Column, b: Column) -> Column:
    """`ratio` within Catalyst, for plans that must not leave the JVM."""
    chars = F.when(F.length(b) > 0, F.split(b, "")).otherwise(F.array().cast("array<string>"))
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda x: F.lit(0))
    outer = F.when(F.length(a) > 0, F.split(a, "")).otherwise(F.array().cast("array<string>"))

    def row(state, c):
        def cell(new, j):
            return F.concat(new, F.array(F.when(F.get(chars, j) == c, F.get(state, j) + 1).otherwise(F.greatest(F.get(new, j), F.get(state, j + 1)))))

        return F.aggregate(F.when(F.length(b) > 0, F.sequence(F.lit(0), F.length(b) - 1)).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), cell)

    best = F.get(F.aggregate(outer, zero, row), F.length(b))
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 100.0).otherwise(200.0 * best / n)
