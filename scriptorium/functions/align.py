"""Alignment of sequences with a fixed order of preference: diagonal, then deletion, then insertion."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

PAIRS = ArrayType(StructType().add("a", StringType()).add("b", StringType()))


#: Distances of so many pairs of pieces are kept by a task before it begins anew.
KEPT = 200_000


def bits_distance(a: str, b: str) -> int:
    """Levenshtein distance by Myers' bit vectors, a column of the table as two numbers; equal ends don't count."""
    n, low = min(len(a), len(b)), 0
    while low < n and a[low] == b[low]:
        low += 1
    end = 0
    while end < n - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        where.setdefault(c, []).append(i)
    masks = {}
    for c, places in where.items():
        row = bytearray(len(a) // 8 + 1)
        for i in places:
            row[i >> 3] |= 1 << (i & 7)
        masks[c] = int.from_bytes(row, "little")
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh
        score += bool(ph & last) - bool(mh & last)
        ph = ph << 1 | 1
        up, down = (mh << 1 | ~(xv | ph)) & full, ph & xv
    return score


def _added(more: dict[str, int], letters: str, by: int) -> None:
    for c in letters:
        more[c] = more.get(c, 0) + by


def _least(more: dict[str, int], a: str, b: str) -> int:
    """An edit takes away one letter at most and adds one at most, so letters that one side has more often are a lower bound. more: how many more a has of each."""
    lost = sum(k for k in more.values() if k > 0)
    return max(lost, lost + len(b) - len(a))


def _same_places(a: str, b: str) -> int | None:
    """The distance of equally long texts if it is the number of places where they differ; None if the lower bound doesn't show that."""
    if len(a) == len(b):
        differing, more = [p for p in zip(a, b) if p[0] != p[1]], {}
        for x, y in differing:
            more[x] = more.get(x, 0) + 1
            more[y] = more.get(y, 0) - 1
        if len(differing) <= _least(more, a, b):
            return len(differing)
    return None


_PIECE = re.compile(r"[^\s-]+[\s-]*|[\s-]+")


def exact_distance(a: str, b: str, kept: dict) -> int:
    """Levenshtein distance of two texts; kept: distances of the pieces met so far.

    Letters or pieces put one under the other are an alignment, so what differs sums to an upper bound. Where a lower bound meets
    it, that is the distance, found without a table; else bit vectors find it.
    """
    if a == b:
        return 0
    same = _same_places(a, b)
    if same is not None:
        return same
    left, right = a.split(" "), b.split(" ")
    if len(left) != len(right):
        left, right = _PIECE.findall(a), _PIECE.findall(b)
    if 1 < len(left) == len(right):
        upper, more = 0, {}
        for x, y in zip(left, right):
            if x != y:
                one = kept.get((x, y))
                if one is None:
                    one = _same_places(x, y)
                    if len(kept) >= KEPT:
                        kept.clear()
                    one = kept[x, y] = bits_distance(x, y) if one is None else one
                upper += one
                _added(more, x, 1)
                _added(more, y, -1)
        if upper <= _least(more, a, b):
            return upper
    return bits_distance(a, b)


@F.pandas_udf(IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of code points, in time that doesn't grow with the square of texts whose words stand in the same order."""
    kept: dict = {}
    return pd.Series([None if x is None or y is None else exact_distance(x, y, kept) for x, y in zip(a, b, strict=True)], dtype="Int32")


def path(a: list[str], b: list[str]) -> list[tuple[str | None, str | None]]:
    """Least-cost pairs of a and b; None is a gap. Rows of costs are numpy arrays: along a row insertions chain, so a running minimum settles them.

    Equal ends pair up first, as the order of preference has it; what is left and equally long with at most two differences can't be cheaper by gaps.
    """
    tail = 0
    while tail < len(a) and tail < len(b) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if tail:
        return path(a[: len(a) - tail], b[: len(b) - tail]) + list(zip(a[len(a) - tail :], b[len(b) - tail :], strict=True))
    if not a or not b:
        return [(x, None) for x in a] + [(None, y) for y in b]
    if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 2:
        return list(zip(a, b, strict=True))
    cost = _small(a, b) if len(a) * len(b) <= 600 else _costs(a, b)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    return out[::-1]


def _small(a: list[str], b: list[str]) -> list[list[int]]:
    """The table of costs of two words, for which arrays would be slower."""
    cost = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        above, row, left = cost[-1], [i], i
        for j, y in enumerate(b):
            best = above[j] if x == y else above[j] + 1
            over = above[j + 1] + 1
            left = min(best, over, left + 1)
            row.append(left)
        cost.append(row)
    return cost


def _costs(a: list[str], b: list[str]) -> np.ndarray:
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(v, len(codes)) for v in s], np.int64) for s in (a, b))
    column = np.arange(len(y) + 1)
    cost = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    cost[0] = column
    for i in range(1, len(x) + 1):
        best = np.empty(len(y) + 1, np.int64)
        best[0] = i
        best[1:] = np.minimum(cost[i - 1, :-1] + (y != x[i - 1]), cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(best - column) + column
    return cost


@F.pandas_udf(PAIRS)
def align_words(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else [{"a": p, "b": q} for p, q in path(list(x), list(y))] for x, y in zip(a, b, strict=True)])


def align_letters(a: Column, b: Column) -> Column:
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    return align_words(letters(a), letters(b))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def windowed(anchor: pd.Series, candidates: pd.Series) -> pd.Series:
    """For each line of the anchor's words and each candidate: the word aligned to each anchor word, from a window of twice the line that moves on by the line."""
    out = []
    for lines, streams in zip(anchor, candidates, strict=True):
        rows = []
        for words in streams:
            at, row, words = 0, [], list(words)
            for line in lines:
                line = list(line)
                own = [b for a, b in path(line, words[at : at + 2 * len(line)]) if a is not None]
                row += own
                at += len(line)
            rows.append(row)
        out.append(rows)
    return pd.Series(out)
