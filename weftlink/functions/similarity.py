"""Pairwise similarities of normalized values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .normalize import tokens


#: Cells (places of the right text, times pairs) that one step compares.
CELLS = 1 << 17


def _longest(left: np.ndarray, right: np.ndarray, task: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest common block of each task's stretches: where it starts in either text, and its size; the first one on ties.

    left and right hold the pairs' texts as numbers from 1, with 0 after them; a task is pair, start and end left, start and end right.
    """
    pair, a0, a1, b0, b1 = task.T
    wide, high = int((b1 - b0).max()), int((a1 - a0).max())
    stretch = lambda text, start, end, n, rest: np.where((at := start + np.arange(n)[:, None]) < end, text[pair, np.minimum(at, text.shape[1] - 1)], rest)
    a, b = stretch(left, a0, a1, high, np.array(np.iinfo(left.dtype).max, left.dtype)), stretch(right, b0, b1, wide, np.array(0, right.dtype))
    kind = np.uint8 if high < 255 else np.int32
    runs, size = np.zeros((wide + 1, len(task)), kind), np.zeros(len(task), kind)
    x, y = np.zeros(len(task), np.int64), np.zeros(len(task), np.int64)
    for i in range(high):
        runs[1:] = (runs[:-1] + kind(1)) * (b == a[i])
        more = np.flatnonzero(runs.max(0) > size)
        if len(more):
            own = runs[:, more]
            j = own.argmax(0)
            size[more] = n = own[j, np.arange(len(more))]
            x[more], y[more] = a0[more] + i + 1 - n, b0[more] + j - n
    return x, y, size.astype(np.int64)


def matched(left: list[str], right: list[str]) -> np.ndarray:
    """The sum of the matching blocks' lengths of each pair: longest block first, then what is left and right of it."""
    codes = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (left, right)]
    known, number = np.unique(np.concatenate(codes), return_inverse=True)
    kind = np.uint8 if len(known) < 254 else np.uint32
    sizes, texts = [np.array([len(t) for t in x], np.int64) for x in (left, right)], []
    for n, values in zip(sizes, np.split(number + 1, [len(codes[0])]), strict=True):
        table = np.zeros((len(n), int(n.max(initial=0)) + 1), kind)
        table[np.arange(table.shape[1]) < n[:, None]] = values
        texts.append(table)
    out, zero = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    tasks = np.column_stack([np.arange(len(left)), zero, sizes[0], zero, sizes[1]])
    while len(tasks := tasks[(tasks[:, 1] < tasks[:, 2]) & (tasks[:, 3] < tasks[:, 4])]):
        # those of like size together, the longest first
        tasks, further = tasks[np.lexsort((tasks[:, 1] - tasks[:, 2], tasks[:, 3] - tasks[:, 4]))], []
        start = 0
        while start < len(tasks):
            some = tasks[start : start + max(1, CELLS // int(tasks[start, 4] - tasks[start, 3]))]
            start += len(some)
            x, y, n = _longest(*texts, some)
            np.add.at(out, some[:, 0], n)
            some, x, y, n = some[n > 0], x[n > 0], y[n > 0], n[n > 0]
            pair, a0, a1, b0, b1 = some.T
            further += [np.column_stack([pair, a0, x, b0, y]), np.column_stack([pair, x + n, a1, y + n, b1])]
        tasks = np.concatenate(further)
    return out


@F.pandas_udf(DoubleType())
def character_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the matching blocks' length over both lengths (longest block first, then its two sides); 0 if one is empty.

    Not symmetric, as difflib's. Each distinct pair of a batch is compared once, all of them place by place together.
    """
    known = dict.fromkeys((a, b) for a, b in zip(left, right, strict=True) if a and b and a != b)
    if known:
        for (a, b), n in zip(known, matched(*map(list, zip(*known, strict=True))).tolist(), strict=True):
            known[a, b] = round(2.0 * n / (len(a) + len(b)), 6)
    return pd.Series([known.get((a, b), 1.0 if a else 0.0) if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype="float64")


def rounded(x: Column) -> Column:
    """Six places, half to even on the double's own value, as Python rounds; F.round looks at its shortest decimal text.

    Away from a tie the product's error can't matter. Near one the remainder over a half is exact: x splits into a 24-bit
    head and a rest, and each times 2,000,000 is a double. x is read several times, so a dear one should be a column.
    """

    def exact(v: Column) -> Column:
        size = F.abs(v)
        head, whole = size.cast("float").cast("double"), F.floor(size * 1e6).cast("double")
        over = (head * 2e6 - (2 * whole + 1)) + (size - head) * 2e6
        up = (over > 0) | ((over == 0) & (whole % 2 == 1))
        return F.signum(v) * (whole + up.cast("int")) / 1e6

    scaled = x * 1e6
    clear = F.abs(F.abs(scaled - F.rint(scaled)) - 0.5) > 1e-6 + F.abs(scaled) * 1e-15
    return F.when(clear, F.rint(scaled) / 1e6).otherwise(F.transform(F.array(x), exact)[0])  # binds x, which is read eleven times


def bounded(x: Column) -> Column:
    """Within 0 and 1, rounded to six places."""
    return rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def token_sizes(left: Column, right: Column) -> tuple[Column, Column, Column]:
    """How many distinct tokens either value has, and both have."""
    a, b = F.array_distinct(tokens(left)), F.array_distinct(tokens(right))
    return F.size(a), F.size(b), F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, both: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(rounded(both / (a + b - both)))


def overlap(a: Column, b: Column, both: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(rounded(both / F.least(a, b)))


def token_jaccard(left: Column, right: Column) -> Column:
    return jaccard(*token_sizes(left, right))


def token_overlap(left: Column, right: Column) -> Column:
    return overlap(*token_sizes(left, right))
