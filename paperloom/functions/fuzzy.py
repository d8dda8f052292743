"""String ratios that Spark lacks, as Arrow batch functions; small helpers a row."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, one big integer a character."""
    if not a or not b:
        return 0
    places: dict = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


#: Places of strands held at once when texts are compared side by side.
STRANDS = 1 << 15


def _codes(texts: list[str], length: int, fill: int) -> np.ndarray:
    """One column a text: its code points, then ``fill``."""
    out = np.full((length, len(texts)), fill, dtype=np.int32)
    for column, t in enumerate(texts):
        out[: len(t), column] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return out


def _strands(short: list[str], long_: list[str]) -> np.ndarray:
    """For each place of each long text (a column) where the strand that ends there began, less than 0 if beside it.

    Strands start at the places of both texts and cross at most once, and not where the characters agree: the common
    subsequence of all of ``short`` and a window of ``long_`` is as long as the window less the strands that begin and
    end in it (Tiskin's combing, one diagonal of all texts at a time).
    """
    n, m = max(map(len, short)), max(map(len, long_))
    kind, bits = (np.uint16, 15) if n + m < 1 << 15 else (np.uint32, 31)
    one, two = np.ascontiguousarray(_codes(short, n, -1)[::-1]), _codes(long_, m, -2)
    h = np.repeat(np.arange(n, dtype=kind)[:, None], len(short), 1)
    v = np.repeat(np.arange(n, n + m, dtype=kind)[:, None], len(short), 1)
    for d in range(n + m - 1):
        first, last = max(0, d - m + 1), min(n - 1, d)
        x, y = slice(n - 1 - last, n - first), slice(d - last, d - first + 1)
        # the highest bit makes a strand the larger one where the characters agree
        left, top = (one[x] == two[y]).astype(kind), v[y]
        left <<= bits
        left |= h[x]
        np.minimum(left, top, out=h[x])
        np.maximum(left, top, out=top)
        top &= (1 << bits) - 1
    return v.astype(np.int32) - n


def _best_window(began: np.ndarray, n: int) -> float:
    """Best ratio of a text of ``n`` characters against windows of a longer one, from where the strands began."""
    m = len(began)
    ends = np.flatnonzero(began >= 0)
    starts = began[ends].astype(np.int64)
    # whole windows: a strand lies in those that begin after its end less n, up to its start
    inside = np.bincount(np.maximum(ends - n + 1, 0), minlength=m + 1) - np.bincount(np.maximum(starts + 1, np.maximum(ends - n + 1, 0)), minlength=m + 1)
    best = 200.0 * (n - int(np.cumsum(inside)[: m - n + 1].min())) / (2 * n)
    if n > 1:
        width = np.arange(1, n)
        head = width - np.cumsum(np.bincount(ends, minlength=m))[: n - 1]
        tail = width - np.cumsum(np.bincount(m - 1 - starts, minlength=m))[: n - 1]
        best = max(best, float((200.0 * np.maximum(head, tail) / (n + width)).max()))
    return best


def partials(a: Sequence[str], b: Sequence[str]) -> list[float]:
    """Best ratio of the shorter text of each pair against windows of the longer (also those cut off at its ends).

    Pairs of about one length are compared side by side.
    """
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    out = [100.0 if short in long_ and (short or not long_) else 0.0 for short, long_ in pairs]
    left = sorted((i for i, (short, _) in enumerate(pairs) if short and not out[i]), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    while left:
        n, m = map(len, pairs[left[-1]])
        some = [left.pop()]
        while left and (len(some) + 1) * n <= STRANDS and 2 * len(pairs[left[-1]][0]) >= n and m <= 2 * len(pairs[left[-1]][1]) <= 4 * m:
            some.append(left.pop())
        began = _strands([pairs[i][0] for i in some], [pairs[i][1] for i in some])
        for column, i in enumerate(some):
            out[i] = _best_window(began[: len(pairs[i][1]), column], len(pairs[i][0]))
    return out


def partial(a: str, b: str) -> float:
    return partials([a], [b])[0]


def _pairs(score, kind: str):
    """A column function of two text columns from a function of two texts; null if either is null."""

    def apply(a: Column | str, b: Column | str) -> Column:
        def batch(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or q is None else score(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32" if kind == "int" else "float64")

        return F.pandas_udf(batch, kind)(a, b)

    return apply


fuzzy_ratio = _pairs(lambda a, b: round(indel_ratio(a, b)), "int")


def _partial_batch(x: pd.Series, y: pd.Series) -> pd.Series:
    """Rounded partial ratios; null if either is null."""
    both = [i for i, (p, q) in enumerate(zip(x, y, strict=True)) if isinstance(p, str) and isinstance(q, str)]
    found = dict(zip(both, partials([x.iloc[i] for i in both], [y.iloc[i] for i in both]), strict=True))
    return pd.Series([round(found[i]) if i in found else None for i in range(len(x))], dtype="Int32")


def fuzzy_partial_ratio(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_partial_batch, "int")(a, b)


def _close(least: float):
    """The sequence ratio where it is at least ``least``, else 0: bounds that are cheap to get come first."""

    def score(a: str, b: str) -> float:
        m = difflib.SequenceMatcher(None, a.lower(), b.lower())
        return r if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (r := m.ratio()) >= least else 0.0

    return score


def sequence_ratio_from(least: float, a: Column | str, b: Column | str) -> Column:
    return _pairs(_close(least), "double")(a, b)


sequence_ratio = _pairs(lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio(), "double")


NAMES = ("fuzzy_ratio", "fuzzy_partial_ratio", "sequence_ratio")


def register(spark) -> None:
    """Make the ratios usable from SQL."""

    def named(score, kind):
        def batch(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32" if kind == "int" else "float64")

        return F.pandas_udf(batch, kind)

    spark.udf.register("fuzzy_partial_ratio", F.pandas_udf(_partial_batch, "int"))
    scores = (lambda x, y: round(indel_ratio(x, y)), "int"), (lambda x, y: difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio(), "double")
    for name, (score, kind) in zip(("fuzzy_ratio", "sequence_ratio"), scores, strict=True):
        spark.udf.register(name, named(score, kind))
