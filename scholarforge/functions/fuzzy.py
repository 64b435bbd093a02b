"""Similarity of strings: Arrow-batched UDFs over the standard library, for distinct values only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp ratio between 0 and 1."""
    return SequenceMatcher(None, a, b).ratio()


def common_part(a: str, b: str) -> str:
    """The longest common substring, the first in ``a`` if several are as long."""
    m = SequenceMatcher(None, a, b).find_longest_match(0, len(a), 0, len(b))
    return a[m.a : m.a + m.size]


def _percent(a: str, b: str) -> int:
    return round(100 * ratio(a, b)) if a and b else 0


def _partial(a: str, b: str) -> int:
    """Best ratio of the shorter string with a stretch of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    best = 0.0
    for m in SequenceMatcher(None, short, long).get_matching_blocks():
        at = max(0, m.b - m.a)
        r = ratio(short, long[at : at + len(short)])
        if r > 0.995:
            return 100
        best = max(best, r)
    return round(100 * best)


@lru_cache(100_000)
def _plain(text: str) -> str:
    return " ".join(re.sub(r"[^\w]+|_", " ", text.lower()).split())


@lru_cache(100_000)
def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


@lru_cache(1_000)
def _places(text: str) -> dict[str, int]:
    """The places of each character, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, all places of ``a`` at once (Hyyrö)."""
    places, full = _places(a), (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _most(a: str, b: str, part: bool) -> int:
    """What ``_percent``, or with ``part`` ``_partial``, of two texts can be at most: their blocks are a common subsequence."""
    if not a or not b:
        return 0
    same = _subsequence(a, b)
    if not part:
        return round(100 * (2.0 * same / (len(a) + len(b))))
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short not in long:
        same = min(same, len(short) - 1)
    return round(100 * (2.0 * same / (len(short) + same)))


def _weights(long: float) -> tuple[bool, float]:
    """Whether texts whose lengths differ by this factor are compared by parts, and the weight of that."""
    return long >= 1.5, 1.0 if long < 1.5 else 0.6 if long > 8 else 0.9


def _weighted(a: str, b: str, least: float = 0) -> int:
    """Weighted ratio of plain texts; if it is below ``least``, any number below. A comparison is left out only where it cannot change that."""
    if not a or not b:
        return 0
    part, weight = _weights(max(len(a), len(b)) / min(len(a), len(b)))
    s, t = set(a.split()), set(b.split())
    both = " ".join(sorted(s & t))
    x, y = f"{both} {' '.join(sorted(s - t))}".strip(), f"{both} {' '.join(sorted(t - s))}".strip()
    tokens = 0.95 * weight
    best = 0.0
    for w, one, other, p in ((1.0, a, b, False), (weight if part else 0.0, a, b, True), (tokens, _sorted(a), _sorted(b), part), (tokens, both, x, part), (tokens, both, y, part), (tokens, x, y, part)):
        if round(w * 100) < least or w * 100 <= best:
            continue
        most = w * _most(one, other, p)
        if most > best and round(most) >= least:
            best = max(best, w * (_partial if p else _percent)(one, other))
    return round(best)


def weighted_ratio(a: str, b: str) -> int:
    """Weighted ratio between 0 and 100: the best of whole, partial and token comparisons, each with its weight."""
    return _weighted(_plain(a), _plain(b))


class Closest:
    """``value -> entry of a list`` with the highest weighted ratio, the first of several; None below ``least``.

    Gives what comparing with every entry would.  Letters and words in common, counted
    for all entries at once, limit each ratio from above; entries are compared from the
    highest limit down, and those that cannot beat the best so far are not compared.
    """

    def __init__(self, choices: list[str], least: float) -> None:
        self.choices, self.least = choices, least
        self.plain = [_plain(c) for c in choices]
        self.column = {c: k for k, c in enumerate(sorted(set("".join(self.plain))))}
        self.letters = np.zeros((len(choices), len(self.column)), np.int32)
        holds: dict[str, list[int]] = {}
        for i, text in enumerate(self.plain):
            for c in text:
                self.letters[i, self.column[c]] += 1
            for w in set(text.split()):
                holds.setdefault(w, []).append(i)
        self.holds = {w: np.array(at) for w, at in holds.items()}
        self.length = np.array([len(t) for t in self.plain], np.int64)
        self.distinct = np.array([len(" ".join(set(t.split()))) for t in self.plain], np.int64)

    def limits(self, a: str) -> np.ndarray:
        """What the weighted ratio of a plain text with each entry can be at most."""
        if not a:
            return np.zeros(len(self.plain))
        mine = np.zeros(len(self.column), np.int32)
        for c in a:
            if c in self.column:
                mine[self.column[c]] += 1
        same = np.minimum(self.letters, mine).sum(axis=1)
        words = set(a.split())
        both = np.zeros(len(self.plain), np.int64)
        for w in words & self.holds.keys():
            both[self.holds[w]] += len(w) + 1
        both = np.maximum(both - 1, 0)
        la, lx, ly = len(a), len(" ".join(words)), self.distinct

        def percent(same, total):
            return np.rint(100 * (2.0 * same / np.maximum(total, 1)))

        def partial(same, one, other):
            short = np.minimum(one, other)
            k = np.minimum(same, short)
            return percent(k, short + k)

        whole = percent(same, la + self.length)
        sets = np.minimum(same, np.minimum(lx, ly))
        near = np.maximum(whole, 0.95 * np.maximum(percent(sets, lx + ly), np.maximum(percent(both, both + lx), percent(both, both + ly))))
        long = np.maximum(la, self.length) / np.maximum(np.minimum(la, self.length), 1)
        weight = np.where(long > 8, 0.6, 0.9)
        tokens = 0.95 * weight * np.maximum(partial(sets, lx, ly), np.where(both > 0, 100, 0))
        far = np.maximum(whole, np.maximum(weight * partial(same, la, self.length), tokens))
        return np.where(self.length == 0, 0, np.rint(np.where(long < 1.5, near, far)))

    def __call__(self, value: str) -> str | None:
        a = _plain(value)
        limits = self.limits(a)
        could = np.flatnonzero(limits >= self.least)
        best, found = -1, -1
        for i in could[np.argsort(-limits[could], kind="stable")].tolist():
            if limits[i] < best:
                break
            need = best if i < found else best + 1
            if limits[i] < need:
                continue
            score = _weighted(a, self.plain[i], max(need, self.least))
            if score >= need and score >= self.least:
                best, found = score, i
        return self.choices[found] if found >= 0 else None


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """X9."""
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """X10."""
    return pd.Series([common_part(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(T.IntegerType())
def weighted(a: pd.Series, b: pd.Series) -> pd.Series:
    """Weighted ratio of two columns."""
    return pd.Series([weighted_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")


def choices(listed: DataFrame, name: str, most: int = 5_000) -> list[str]:
    """The names of a reference list, in order; raises if it has more than ``most`` entries."""
    rows = listed.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the list has more than {most} entries")
    return [r[0] for r in rows]


def best_of(choices: list[str], least: float, score: str = "weighted"):
    """``value -> best choice`` of a bounded list, null below ``least`` (J3: weighted, 90; J4: sequence, 0.6)."""

    def closest(v: str) -> str | None:
        best = max(choices, key=lambda c: ratio(v, c), default=None)
        return best if best is not None and ratio(v, best) >= least else None

    @F.pandas_udf(T.StringType())
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = Closest(choices, least) if score == "weighted" else closest
        for values in batches:
            yield pd.Series([found(v) if v is not None else None for v in values], dtype=object)

    return pick
