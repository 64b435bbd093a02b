"""Per-document text quality statistics, and a verdict: prose, list, table or junk (p7).

Every line of a document is described by a few coarse statistics (length, ending,
share of common words, digits, symbols, separators, start, word length, mixed
words).  A hidden Markov model over them, with a few states per kind, labels the
lines; its start is estimated from documents whose kind a reader has given and
refined by expectation-maximisation in which a labelled document favours its kind
but may hold lines of others.  The shares of the labels, by characters, are
aggregated per document; the verdict is the kind with the most characters, where
prose has to reach a share learnt from the same labelled documents.

The model is fitted on at most ``max_labelled`` documents (5,000; chosen by a hash
of the key); statistics and labels cover every line of every document.

Defined results: null and blank documents have zero counts and no verdict; lines of
any length are read whole; repeated rows have equal results; an empty table, or one
without labelled documents, uses the built-in start of the model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("prose", "list", "table", "junk")

# Common words of four languages.
COMMON = """
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when
who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made
after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good world make very year still see own work
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son aux ont cette mais comme on tout nous sa fait été aussi leur bien peut ces y deux même
el los las y en por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante
"""
_COMMON = frozenset(COMMON.split())

_SEPARATED = re.compile(r"\t|\s\|\s|;|,|\s{2,}")
_BULLET = re.compile(r"[•·▪‣◦*–»›-]\s")
_NUMBERED = re.compile(r"\(?\d{1,3}[.)]\s")
_CODED = re.compile(r"[A-Z]{1,4}[ -]?\d{2,5}\b")
_USUAL = ".,;:()!?'’‘“”\"–—-/%•*"
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
#: Signs other than those of ordinary text.
_ODD = re.compile(r"[^\w .,;:!?'’‘“”\"()\-–—/\t%°\n]|_")

#: Number of values of each feature of a line.
SIZES = (35, 3, 4, 5, 4, 5, 6, 6, 4, 4)


@lru_cache(maxsize=1 << 16)
def _of_word(word: str) -> tuple[int, int, int]:
    """Letters, common words and mixed words in a word that is not of letters only."""
    w = word.strip(_USUAL)
    if w and not (w[0].isalnum() and w[-1].isalnum()):
        w = _EDGE.sub("", w)
    if w.lower() in _COMMON:
        return len(w), 1, 0
    if not w:
        return 0, 0, 1
    mixed = not w.isalpha() and not w.isdigit() and not w.replace("-", "").replace("’", "").replace("'", "").isalpha() and not w.replace(".", "").replace(",", "").isdigit()
    return len(w), 0, int(mixed)


def line_features(line: str) -> tuple[tuple[int, ...], int, int, int, int]:
    """Coarse features of a line; its words, letters in words, common words and symbols."""
    words = line.split()
    n = len(words)
    plain = list(filter(str.isalpha, words))
    letters = len("".join(plain))
    common = sum(map(_COMMON.__contains__, " ".join(plain).lower().split(" "))) if plain else 0
    mixed = 0
    rest = list(filterfalse(str.isalpha, words)) if len(plain) < n else []
    for w in rest:
        own, usual, odd = _of_word(w) if len(w) < 40 else _of_word.__wrapped__(w)
        letters, common, mixed = letters + own, common + usual, mixed + odd
    size = max(1, len(line))
    blanks = line.count(" ") == n - 1 == len(line) - sum(map(len, words))  # every space is a single blank
    signs = "".join(rest)  # digits and signs stand in these words only
    digits = sum(map(signs.count, "0123456789")) / size if signs else 0
    symbols = len(_ODD.findall(signs if blanks else line)) if signs or not blanks else 0
    semis = signs.count(";")
    seps = semis + signs.count(",") if blanks and "|" not in signs else len(_SEPARATED.findall(line))
    end = line[-1:]
    start = 0 if _BULLET.match(line) else 1 if _NUMBERED.match(line) else 2 if _CODED.match(line) else 3 if line[:1].isupper() else 4 if line[:1].islower() else 5
    mean = letters / max(1, n)
    distinct = len(set(words)) / n if n >= 10 else 1.0
    long = 0 if n <= 1 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 9 else 4 if n <= 14 else 5 if n <= 25 else 6
    usual = 0 if not common else 1 if common < 0.08 * n else 2 if common < 0.16 * n else 3 if common < 0.28 * n else 4
    features = (
        long * 5 + usual,
        0 if end in ".!?" else 1 if end in ",;:" else 2,
        0 if n < 10 else 1 if distinct >= 0.8 else 2 if distinct >= 0.55 else 3,
        0 if not digits else 1 if digits < 0.04 else 2 if digits < 0.12 else 3 if digits < 0.35 else 4,
        0 if not symbols else 1 if symbols < 0.02 * size else 2 if symbols < 0.08 * size else 3,
        0 if not seps else 1 if seps == 1 else 2 if seps < 0.12 * n + 1 else 3 if seps < 0.4 * n + 1 else 4,
        start,
        0 if mean < 1.8 else 1 if mean < 3.2 else 2 if mean < 4.6 else 3 if mean < 6.2 else 4 if mean < 8.2 else 5,
        0 if not mixed else 1 if mixed < 0.12 * n else 2 if mixed < 0.4 * n else 3,
        0 if not semis else 1 if semis < 3 else 2 if n < 9 * (semis + 1) else 3,
    )
    return features, n, letters, common, symbols


#: States per kind: kinds such as junk hold several quite different sorts of lines.
SUBSTATES = 8
_STATES = len(KINDS) * SUBSTATES
_KIND_OF = np.repeat(np.arange(len(KINDS)), SUBSTATES)


def _sorts(codes: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Sorts of lines of one kind: k-means over the one-hot features, seeded by the farthest line."""
    hot = np.concatenate([np.eye(n)[codes[:, f]] for f, n in enumerate(SIZES)], axis=1)
    points, back, weight = np.unique(hot, axis=0, return_inverse=True, return_counts=True)
    centres = [np.average(points, axis=0, weights=weight)]
    for _ in range(k - 1):
        away = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(points[np.argmax(away * np.sqrt(weight))])
    for _ in range(rounds):
        near = np.argmin([((points - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres = [np.average(points[near == i], axis=0, weights=weight[near == i]) if (near == i).any() else c for i, c in enumerate(centres)]
    return near[back.ravel()]


class LineModel:
    """Hidden Markov model: a few states per kind, independent categorical features."""

    def __init__(self) -> None:
        self.emit = [np.full((_STATES, k), 1.0 / k) for k in SIZES]
        self.move = (np.full((_STATES, _STATES), 0.05) + np.eye(_STATES) * 0.8) / (0.05 * _STATES + 0.8)
        self.start = np.full(_STATES, 1.0 / _STATES)
        self.least_prose = 0.5

    def log_likelihood(self, codes: np.ndarray) -> np.ndarray:
        """Lines x features -> lines x states."""
        out = np.zeros((len(codes), _STATES))
        for f, table in enumerate(self.emit):
            out += np.ascontiguousarray(np.log(table).T)[codes[:, f]]
        return out

    def states(self, codes: list[np.ndarray], favour: np.ndarray | None = None, chunk: int = 60_000) -> list[np.ndarray]:
        """Posterior of every state of every line, by forward-backward over many documents at once.

        Documents of about equal length go together, as many as keep documents x longest
        within ``chunk`` lines (one at least), so that memory follows the longest document only.
        """
        out: list[np.ndarray] = [np.zeros((0, _STATES))] * len(codes)
        # the longest first, so that fewer documents are left at every further line
        order = [i for i in sorted(range(len(codes)), key=lambda i: -len(codes[i])) if len(codes[i])]
        at = 0
        while at < len(order):
            part = order[at : at + max(1, chunk // len(codes[order[at]]))]
            at += len(part)
            sizes = np.array([len(codes[i]) for i in part])
            flat = self.log_likelihood(np.concatenate([codes[i] for i in part]))
            if favour is not None:
                flat = flat + np.repeat(favour[part], sizes, axis=0)
            # the features are not independent of each other: part of their weight
            flat = np.exp((flat - flat.max(axis=1, keepdims=True)) * 0.7) + 1e-30
            offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            longest = int(sizes[0])
            alpha = np.zeros((len(part), longest, _STATES))
            beta = np.ones((len(part), longest, _STATES))
            for t in range(longest):
                live = int((sizes > t).sum())
                a = flat[offsets[:live] + t] * (self.start if t == 0 else alpha[:live, t - 1] @ self.move)
                alpha[:live, t] = a / a.sum(axis=1, keepdims=True)
            for t in range(longest - 2, -1, -1):
                live = int((sizes > t + 1).sum())
                b = (flat[offsets[:live] + t + 1] * beta[:live, t + 1]) @ self.move.T
                beta[:live, t] = b / b.sum(axis=1, keepdims=True)
            for r, i in enumerate(part):
                gamma = alpha[r, : sizes[r]] * beta[r, : sizes[r]]
                out[i] = gamma / gamma.sum(axis=1, keepdims=True)
        return out

    def posteriors(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Lines x kinds for every document."""
        return [p.reshape(len(p), len(KINDS), SUBSTATES).sum(axis=2) for p in self.states(codes)]

    def fit(self, codes: list[np.ndarray], sizes: list[np.ndarray], kinds: list[int], rounds: int = 6, smooth: float = 0.3) -> LineModel:
        """Start from the readers' labels, then EM with a labelled document favouring its own kind."""
        if not codes:
            return self
        held = [np.zeros((len(c), _STATES)) for c in codes]
        for k in range(len(KINDS)):
            own = [i for i, x in enumerate(kinds) if x == k]
            if own:
                near = _sorts(np.concatenate([codes[i] for i in own]), SUBSTATES)
                for i, part in zip(own, np.split(near, np.cumsum([len(codes[i]) for i in own])[:-1])):
                    held[i][np.arange(len(part)), k * SUBSTATES + part] = 1
        # Lists, tables and junk seldom hold other lines; prose has headings, references and lists in it.
        own_kind = (_KIND_OF[None, :] == np.array(kinds)[:, None]) * 0.9 + 0.1
        favour = np.log(own_kind) * np.where(np.array(kinds) == 0, 2.0, 12.0)[:, None]
        for r in range(rounds):
            all_codes, all_held = np.concatenate(codes), np.concatenate(held)
            for f, k in enumerate(SIZES):
                table = np.stack([np.bincount(all_codes[:, f], weights=all_held[:, s], minlength=k) for s in range(_STATES)]) + smooth
                self.emit[f] = table / table.sum(axis=1, keepdims=True)
            move, start = np.eye(_STATES) + 0.2, np.full(_STATES, 0.2)
            for h in held:
                start += h[0]
                move += h[:-1].T @ h[1:]
            self.move, self.start = move / move.sum(axis=1, keepdims=True), start / start.sum()
            if r < rounds - 1:
                held = self.states(codes, favour)
        shares = np.array([self.shares(h, s) for h, s in zip(self.posteriors(codes), sizes)])
        truth = np.array(kinds) == 0
        grid = np.linspace(0.1, 0.9, 33)
        right = np.array([((shares[:, 0] >= g) == truth).mean() for g in grid])
        self.least_prose = float(np.median(grid[right >= right.max()]))
        return self

    @staticmethod
    def shares(posterior: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (posterior * sizes[:, None]).sum(axis=0) / sizes.sum() if len(posterior) and sizes.sum() else np.zeros(len(KINDS))


def _coded(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Features of the non-blank lines, their lengths, and the document's statistics."""
    lines = [x for x in (y.strip() for y in (text or "").split("\n")) if x]
    rows = []
    sizes = np.array([len(x) for x in lines], dtype=np.float64)
    words = letters = common = symbols = ends = 0
    for line in lines:
        row, n, l, c, s = line_features(line)
        rows += row
        words, letters, common, symbols = words + n, letters + l, common + c, symbols + s
        ends += line[-1] in ".!?:;"
    codes = np.array(rows, dtype=np.int64).reshape(-1, len(SIZES))
    size = max(1.0, float(sizes.sum()))
    return codes, sizes, [len(lines), words, letters / max(1, words), symbols / size, ends / max(1, len(lines)), common / max(1, words)]


_CODES = T.StructType([T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_CODES)
def _line_codes(text: pd.Series) -> pd.DataFrame:
    out = [_coded(t)[:2] for t in text]
    return pd.DataFrame({"codes": [c.ravel().tolist() for c, _ in out], "sizes": [s.tolist() for _, s in out]})


def fit(labelled: DataFrame, text: str, kind: str, max_labelled: int = 5_000) -> LineModel:
    """The model fitted on at most ``max_labelled`` rows of ``labelled``; their line features only come to the driver."""
    rows = labelled.where(F.col(kind).isin(*KINDS)).limit(max_labelled).select(_line_codes(text).alias("c"), kind).collect()
    codes = [np.array(r["c"]["codes"], dtype=np.int64).reshape(-1, len(SIZES)) for r in rows]
    sizes = [np.array(r["c"]["sizes"]) for r in rows]
    kinds = [KINDS.index(r[kind]) for r in rows]
    use = [i for i in range(len(rows)) if len(codes[i])]
    return LineModel().fit([codes[i] for i in use], [sizes[i] for i in use], [kinds[i] for i in use])


_STATS = ("lines", "words", "mean_word_length", "symbol_ratio", "ending_share", "common_share")
SCHEMA = T.StructType([T.StructField(s, T.LongType() if s in ("lines", "words") else T.DoubleType()) for s in _STATS] + [T.StructField(f"{k}_share", T.DoubleType()) for k in KINDS] + [T.StructField("verdict", T.StringType())])


def describe(df: DataFrame, text: str, model: LineModel, into: str = "quality", prepare: Callable[[str], str] | None = None) -> DataFrame:
    """``df`` with a struct ``into``: statistics, shares of the line labels and the verdict; of ``prepare(text)`` if given."""

    @F.pandas_udf(SCHEMA)
    def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            coded = [_coded(prepare(t) if prepare and t else t) for t in texts]
            posteriors = model.posteriors([c[0] for c in coded])
            shares = np.array([model.shares(p, c[1]) for p, c in zip(posteriors, coded)]).reshape(-1, len(KINDS))
            frame = pd.DataFrame([c[2] for c in coded], columns=list(_STATS))
            frame = frame.astype({"lines": "int64", "words": "int64"})
            for i, k in enumerate(KINDS):
                frame[f"{k}_share"] = shares[:, i]
            other = 1 + shares[:, 1:].argmax(axis=1) if len(shares) else np.zeros(0, dtype=int)
            frame["verdict"] = [None if not c[2][0] else "prose" if s[0] >= model.least_prose else KINDS[o] for c, s, o in zip(coded, shares, other)]
            yield frame

    return df.withColumn(into, statistics(F.col(text)))
