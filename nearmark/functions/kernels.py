"""Distances that Spark has no function for, computed for whole Arrow batches of pairs.

Every step of the dynamic programme works on one cell of all pairs at once, so
the Python loops run over string positions and not over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def _matrix(texts: list[list[int]], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code lists as a padded matrix, one row per text, and their lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int32)
    out = np.full((len(texts), max(int(lengths.max(initial=0)), 1)), fill, dtype=np.int32)
    for i, codes in enumerate(texts):
        out[i, : len(codes)] = codes
    return out, lengths


def _bytes(texts) -> list[list[int]]:
    return [list(t.encode("utf-8")) for t in texts]


def _chars(texts) -> list[list[int]]:
    return [[ord(c) for c in t] for t in texts]


def _by_length(left: list, right: list, limit: int = 1 << 22) -> Iterator[np.ndarray]:
    """Row groups of similar length, so that one long pair does not pad all others."""
    sizes = np.array([max(len(a), len(b)) + 1 for a, b in zip(left, right)], dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and end - start < 8192 and sizes[order[end]] <= 2 * sizes[order[start]] + 8 \
                and (end - start) * sizes[order[end]] < limit:
            end += 1
        yield order[start:end]
        start = end


def _osa(left: list[list[int]], right: list[list[int]]) -> np.ndarray:
    a, n = _matrix(left, -1)
    b, m = _matrix(right, -2)
    rows, width = len(left), b.shape[1]
    result = np.where(n == 0, m, 0).astype(np.int32)
    before = None
    last = np.tile(np.arange(width + 1, dtype=np.int32), (rows, 1))
    pick = np.arange(rows)
    for i in range(1, a.shape[1] + 1):
        same = a[:, i - 1 : i] == b
        row = np.empty_like(last)
        row[:, 0] = i
        for j in range(1, width + 1):
            best = np.minimum(row[:, j - 1], last[:, j]) + 1
            best = np.minimum(best, last[:, j - 1] + ~same[:, j - 1])
            if i > 1 and j > 1:
                swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swapped, np.minimum(best, before[:, j - 2] + 1), best)
            row[:, j] = best
        done = n == i
        result[done] = row[pick[done], m[done]]
        before, last = last, row
    return result


def osa_distances(left: list[list[int]], right: list[list[int]]) -> np.ndarray:
    """Edit distance with adjacent swaps, where no part is edited twice."""
    out = np.zeros(len(left), dtype=np.int32)
    for rows in _by_length(left, right):
        out[rows] = _osa([left[r] for r in rows], [right[r] for r in rows])
    return out


def _jaro(left: list[list[int]], right: list[list[int]]) -> np.ndarray:
    a, n = _matrix(left, -1)
    b, m = _matrix(right, -2)
    rows, width = len(left), b.shape[1]
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    used = np.zeros((rows, width), dtype=bool)
    hit = np.zeros(a.shape, dtype=bool)
    positions = np.arange(width)
    for i in range(a.shape[1]):
        # the first free equal character of the other string inside the window
        free = (b == a[:, i : i + 1]) & ~used & (np.abs(positions - i) <= reach[:, None])
        found = free.any(axis=1)
        at = free.argmax(axis=1)
        used[found, at[found]] = True
        hit[:, i] = found
    matches = hit.sum(axis=1)
    # matched characters of both sides in order: stable sort puts them first
    first = np.take_along_axis(a, np.argsort(~hit, axis=1, kind="stable"), axis=1)
    second = np.take_along_axis(b, np.argsort(~used, axis=1, kind="stable"), axis=1)
    shared = min(a.shape[1], width)
    inside = np.arange(shared) < matches[:, None]
    swaps = ((first[:, :shared] != second[:, :shared]) & inside).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (matches / n + matches / m + (matches - swaps) / matches) / 3.0
    score = np.where(matches == 0, 0.0, score)
    return np.where((n == 0) & (m == 0), 1.0, score)


def jaro_scores(left: list[list[int]], right: list[list[int]]) -> np.ndarray:
    out = np.zeros(len(left), dtype=np.float64)
    for rows in _by_length(left, right, 1 << 21):
        out[rows] = _jaro([left[r] for r in rows], [right[r] for r in rows])
    return out


@F.pandas_udf(IntegerType())
def osa(left: pd.Series, right: pd.Series) -> pd.Series:
    """Byte-wise edit distance with adjacent swaps."""
    return pd.Series(osa_distances(_bytes(left), _bytes(right)))


@F.pandas_udf(IntegerType())
def osa_bytes(left: pd.Series, right: pd.Series) -> pd.Series:
    """The same for strings that hold one character per byte."""
    return pd.Series(osa_distances(*[[list(t.encode("latin-1")) for t in texts] for texts in (left, right)]))


@F.pandas_udf(DoubleType())
def jaro(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(jaro_scores(_chars(left), _chars(right)))


@F.pandas_udf(DoubleType())
def jaro_winkler(left: pd.Series, right: pd.Series) -> pd.Series:
    """Jaro, raised by a common start of up to four characters once it is above 0.7."""
    score = jaro_scores(_chars(left), _chars(right))
    common = np.zeros(len(score))
    for size in range(1, 5):
        common += [a[:size] == b[:size] and min(len(a), len(b)) >= size for a, b in zip(left, right)]
    return pd.Series(np.where(score > 0.7, score + 0.1 * common * (1.0 - score), score))


SCAN_TYPE = StructType([StructField("distance", IntegerType()), StructField("substring", StringType())])


def scan_windows(texts: list[list[int]], targets: list[list[int]], limits: np.ndarray, every: bool):
    """Slide a window of target length over each text until it is within the limit.

    The step grows with the distance left over; ``every`` visits each window and keeps the closest.
    Returns the distance and start of the last (or closest) window, start -1 when there is none.
    """
    count = len(texts)
    room = np.array([len(t) - len(g) for t, g in zip(texts, targets)])
    start = np.zeros(count, dtype=np.int64)
    best = np.zeros(count, dtype=np.int32)
    best_start = np.full(count, -1)
    active = np.flatnonzero(room > 0)
    while len(active):
        windows = [texts[r][start[r] : start[r] + len(targets[r])] for r in active]
        found = osa_distances(windows, [targets[r] for r in active])
        if every:
            closer = (best_start[active] < 0) | (found < best[active])
            best[active[closer]] = found[closer]
            best_start[active[closer]] = start[active[closer]]
            step = np.where((best[active] > 0) & (start[active] < room[active]), 1, 0)
        else:
            best[active], best_start[active] = found, start[active]
            step = np.minimum((found - limits[active]) // 2, room[active] - start[active] - 1)
        going = step > 0
        active = active[going]
        start[active] += step[going]
    return best, best_start


def _scan(texts: pd.Series, targets: pd.Series, limits: pd.Series, every: bool) -> pd.DataFrame:
    t, g = _bytes(texts), _bytes(targets)
    distance, start = scan_windows(t, g, limits.to_numpy(dtype=np.int64), every)
    cut = [
        bytes(t[i][s : s + len(g[i])]).decode("utf-8", "replace") if s >= 0 else None for i, s in enumerate(start)
    ]
    return pd.DataFrame({"distance": distance, "substring": cut})


@F.pandas_udf(SCAN_TYPE)
def osa_scan(texts: pd.Series, targets: pd.Series, limits: pd.Series) -> pd.DataFrame:
    return _scan(texts, targets, limits, False)


@F.pandas_udf(SCAN_TYPE)
def osa_scan_all(texts: pd.Series, targets: pd.Series, limits: pd.Series) -> pd.DataFrame:
    return _scan(texts, targets, limits, True)
