"""Visually identical text with different characters (p6).

Look-alike *classes* are the components of a union-find over strings: code points,
combining sequences, and the strings they are drawn like.  Edges come from Unicode
itself (width and font variants, canonical composition, kinds of space, invisible
characters) and from a short list of letters of other scripts that are drawn like
Latin ones; they are transitive.  The representative of a class is the member most
frequent in the collection (of the members in ASCII, where there are any), and a
multi-pattern automaton rewrites every other member to it, longest match first, until
nothing changes.

A word in another script is left alone: letters are only rewritten inside words
that mix scripts, or in words that consist of look-alikes and stand among Latin
words without a genuine word of that script beside them.

Defined results: null stays null, empty stays empty; a value of any length is read
whole; ties between members of a class go to the lower code point; equal values
have equal results; empty tables give empty results; other columns stay.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts (and Latin variants) drawn like the Latin letter after them.
LOOKALIKES = """
А A В B Е E Ѕ S І I Ј J К K М M Н H О O Р P С C Т T У Y Х X Ү Y Ԁ D Ԍ G Ԛ Q Ԝ W
а a е e о o р p с c у y х x ѕ s і i ј j һ h ԁ d ԛ q ԝ w ѵ v г r к k т t м m п n в b ԍ g
Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X Ϲ C Ϳ J
α a ι i κ k ν v ο o ρ p τ t υ u χ x ϲ c ϳ j γ y η n ω w ε e
Ա U Օ O օ o ո n ս u հ h ց g զ q
ɑ a ɡ g ɩ i ɪ i ʏ y ᴄ c ᴏ o ᴠ v ᴡ w ᴢ z
"""
# Signs drawn like an ordinary one.
SIGNS = {"\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2212": "-", "\ufe63": "-", "\u02b9": "'", "\u02bc": "\u2019", "\u2024": ".", "\u2215": "/", "\u2044": "/", "\ua78f": "\u00b7"}
_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)]
_SCRIPTS = (("latin", r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff"), ("greek", r"\u0370-\u03ff\u1f00-\u1fff"), ("cyrillic", r"\u0400-\u052f"), ("armenian", r"\u0530-\u058f"))


class UnionFind:
    """Disjoint sets over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


@lru_cache(1)
def _letters() -> dict[str, str]:
    parts = LOOKALIKES.split()
    return dict(zip(parts[::2], parts[1::2]))


@lru_cache(1)
def edges() -> list[tuple[str, str]]:
    """Pairs of strings that look alike; an invisible character is paired with the empty string."""
    out = [*_letters().items(), *SIGNS.items()] + [(chr(c), "") for c in _INVISIBLE]
    for cp in range(0xA0, 0x20000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Zs":
            out.append((c, " "))
            continue
        split = unicodedata.decomposition(c)
        if not split:
            continue
        if split.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>")) or 0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F:
            out.append((c, unicodedata.normalize("NFKC", c)))
        elif split[0] != "<" and cp < 0x2000 and unicodedata.normalize("NFC", c) == c:
            out.append((c, unicodedata.normalize("NFD", c)))
    return out


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Member -> representative, for every member that is not its own.

    The most frequent member stands for its class; where a class has members in ASCII, the
    most frequent of these, so that ordinary letters and signs are never rewritten.
    """
    sets = UnionFind()
    for a, b in edges():
        if b:
            sets.union(a, b)
    out = {chr(c): "" for c in _INVISIBLE}
    for members in sets.classes().values():
        best = min(members, key=lambda m: (not m.isascii(), -counts.get(m, 0), len(m) > 1 and unicodedata.normalize("NFC", m) != m, m))
        out.update({m: best for m in members if m != best and not m.isascii()})
    return out


def character_counts(df: DataFrame, fields: list[str]) -> dict[str, int]:
    """How often each member of a look-alike class occurs in ``fields``: at most as many rows as there are members."""
    members = {m for e in edges() for m in e if m}
    rows = None
    for f in fields:
        one = df.select(F.explode(F.split(F.col(f).cast("string"), "")).alias("c"))
        rows = one if rows is None else rows.unionByName(one)
    got = rows.where("c != ''").groupBy("c").count().collect()  # one row per character of the alphabet
    return {r["c"]: r["count"] for r in got if r["c"] in members}


_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f\u00ad\u200b-\u200d\u2060\ufeff])*")
_RANGES = [(name, re.compile(f"[{r}]")) for name, r in _SCRIPTS]


def _script(c: str) -> str:
    for name, regex in _RANGES:
        if regex.match(c):
            return name
    return "" if not c.isalpha() else "other"


def _alien_words(text: str) -> list[tuple[int, int]]:
    """Spans of words with letters of other scripts that stand for Latin ones."""
    letters = _letters()
    found, genuine, latin = [], set(), False
    for m in _WORD.finditer(text):
        scripts = {s for s in map(_script, m.group()) if s}
        foreign = scripts & {"greek", "cyrillic", "armenian"}
        latin |= "latin" in scripts
        if not foreign:
            continue
        if "latin" in scripts:
            found.append((m.span(), None))
        elif all(c in letters for c in m.group() if c.isalpha()):
            found.append((m.span(), foreign))
        else:
            genuine |= foreign
    return [span for span, scripts in found if scripts is None or (latin and not scripts & genuine)]


class Rewriter:
    """Greedy rewriting with one automaton over all members of the classes."""

    def __init__(self, reps: dict[str, str]) -> None:
        self.reps = reps
        self.automaton = ahocorasick.Automaton()
        for member in reps:
            self.automaton.add_word(member, member)
        self.automaton.make_automaton()
        self.alien = frozenset(_letters())

    def __call__(self, text: str) -> str:
        seen = set()
        while not text.isascii() and text not in seen:  # what one pass makes ordinary may show the next that a word mixes scripts
            seen.add(text)
            text = self._once(text)
        return text

    def _once(self, text: str) -> str:
        spans = _alien_words(text) if any(c in self.alien for c in text) else []
        hits = []
        for end, member in self.automaton.iter(text):
            start = end - len(member) + 1
            if len(member) == 1 and member in self.alien and not any(a <= start < b for a, b in spans):
                continue
            hits.append((start, -len(member), member))
        hits.sort()
        out, at = [], 0
        for start, minus, member in hits:
            if start >= at:
                out += [text[at:start], self.reps[member]]
                at = start - minus
        out.append(text[at:])
        return unicodedata.normalize("NFC", "".join(out))


def one_form(df: DataFrame, fields: list[str], suffix: str = "_plain", counts: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``<field><suffix>``: equal-looking values are equal there."""
    reps = representatives(character_counts(df, fields) if counts is None else counts)

    @F.pandas_udf(T.StringType())
    def rewrite(values: pd.Series) -> pd.Series:
        put = Rewriter(reps)
        return values.map(lambda v: None if v is None else put(v))

    def plain(c: Column) -> Column:
        return F.when(c.rlike(r"[^\x00-\x7f]"), rewrite(c)).otherwise(c)

    return df.withColumns({f + suffix: plain(F.col(f).cast("string")) for f in fields})


def variant_cells(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field`` of each cell that is not written in the one form."""
    odd = None
    for f in fields:
        one = df.select(key, F.lit(f).alias("field"), F.col(f).cast("string").alias("value")).where(F.col("value").rlike(r"[^\x00-\x7f]"))
        odd = one if odd is None else odd.unionByName(one)
    counts = character_counts(df, fields)
    return one_form(odd, ["value"], counts=counts).where("value != value_plain").select(key, "field")
