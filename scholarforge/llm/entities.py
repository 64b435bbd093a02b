"""Freely entered values mapped to a reference list (p4).

Three passes over the *distinct* values: (1) acronyms; (2) one multi-pattern
automaton over canonical names and their aliases finds embedded mentions, the
longest non-overlapping match wins; (3) what remains goes to token-set similarity: the
same words in any order, two edits in all; where edits have run words together, the
closest alias as one string.  A mention counts only if the rest of the value names no other kind
of institution, so that a school of nursing in the same town is no university.

The list is broadcast; it must not exceed ``max_entries`` (checked).  Defined
results: cells without a value give no row; a value that means no entry has id 0;
equal values have equal results; of two entries that fit equally well the lower id
is taken only if their names are equal, else the value is reported as 0; an empty
list maps everything to 0; values are read whole; other columns are not needed.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarforge.functions.missing import has_value
from scholarforge.runtime import stage

# Spellings of the words that name a kind of institution.
SPELLINGS = """
university: university univ uni universitat universite universita universidad universidade universiteit uniwersytet
institute: institute inst institut instituto istituto
technical: technical tech technische technique tecnica tecnologica
technology: technology technologie tecnologia
medical: medical med medizinische medicale medica
state: state st
"""
# Words that name another kind of institution, or a part of one.
OTHER_KINDS = """
academy academia akademie board campus center centre clinic college conservatory conservatoire council fachhochschule foundation gymnasium hochschule hospital instytut laboratory library
ministry museum music nursing office polytechnic polytechnique school seminary society studies teachers veterinary maritime defence defense general advanced sciences
"""
# Parts of an institution and other additions that may stand beside its name.
ADDITIONS = r"(?:(?:department|dept|faculty|school|division) of [^,/|()-]+|main campus|campus|ph ?d|d ?phil|dr|prof(?:essor)?|msc|ma)"
_DROP = {"the", "of", "de", "du", "di", "da", "der", "die", "das", "la", "le", "el", "at", "in", "for", "fur", "d"}


def _kinds() -> dict[str, str]:
    out = {}
    for line in SPELLINGS.strip().splitlines():
        kind, words = line.split(":")
        out.update({w: kind for w in words.split()})
    return out


_KIND = _kinds()
_OTHER = frozenset(OTHER_KINDS.split())


def normalise(value: str) -> str:
    """Lower case ASCII words, separators between them kept as ``|``."""
    text = unicodedata.normalize("NFKD", value).lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l")
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    text = re.sub(r"\s*[,;/|()\[\]]\s*|\s+[-–—]\s+", " | ", text)
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9|]+", " ", text)).strip(" |")


def _words(text: str) -> list[str]:
    return [_KIND.get(w, w) for w in text.replace("|", " ").split() if w not in _DROP]


def _expand(text: str) -> str:
    """Words of a part in one spelling, without articles and prepositions, ``tu`` and a lone ``u`` spelt out."""
    out = []
    for w in text.split():
        if w == "tu":
            out += ["technical", "university"]
        elif w == "u":
            out.append("university")
        elif w not in _DROP:
            kind = _KIND.get(w, w)
            out.append("technology" if kind == "technical" and out and "institute" in out else kind)
    return " ".join(out)


def _distance(a: str, b: str, most: int) -> int:
    """Edits, exchanges of neighbours included, or ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last, now = [], list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        now = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            now[j] = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], before[j - 2] + 1)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return last[-1]


# How the kinds are written in short or in other languages, before and after the name (run together).
SHORT = {
    ("university",): ("univ univof uni unof u uof universityof university universitat universite universitede universidadde universidad", "univ uni u university universitat"),
    ("technical", "university"): ("techuniv techunivof technicalunivof techuniversityof techuniversity technicaluniversity tu technischeuniversitat", "technicaluniv techuniv tu"),
    ("institute", "technology"): ("instituteoftechnology insttechnol insttechnology instoftechnology insttech instoftech", "instoftech insttech instoftechnology institutetech instituteoftech institutetechnology"),
    ("medical", "university"): ("meduniv medunivof medicaluniv medicaluniversityof medicaluniversity meduni medizinischeuniversitat", "meduniv medicaluniv meduni medicaluniversity"),
    ("state", "university"): ("stateuniv stateuniversityof", "state stateuniv stuniv stateu stu stuniversity stateuni"),
}


def _spelt(core: str, kinds: list[str]) -> set[str]:
    before, after = SHORT.get(tuple(kinds), ("", ""))
    name = core.replace(" ", "")
    return {b + name for b in before.split()} | {name + a for a in after.split()} if name else set()


class Mapper:
    """The three passes over one reference list of ``(id, name, acronym)``."""

    def __init__(self, entries: list[tuple[int, str, str | None]], edits: int = 2) -> None:
        self.edits = edits
        acronyms: dict[str, dict[str, int]] = defaultdict(dict)
        self.exact: dict[str, int] = {}
        by_core: dict[str, list[tuple[int, frozenset]]] = defaultdict(list)
        self.core: dict[int, str] = {}
        self.kinds: dict[int, list[str]] = {}
        aliases: dict[str, set[int]] = defaultdict(set)
        for eid, name, acronym in sorted(entries):
            if acronym and acronym.strip():
                acronyms[re.sub(r"[^a-z0-9]", "", acronym.lower())].setdefault(name, eid)
            words = _words(normalise(name))
            kinds = [w for w in words if w in set(_KIND.values())]
            core = " ".join(w for w in words if w not in set(_KIND.values()))
            self.core[eid] = core
            self.kinds[eid] = kinds
            by_core[core].append((eid, frozenset(kinds)))
            full = " ".join(words)
            if kinds == ["state", "university"]:
                aliases[f"{core} state"].add(eid)
            for form in {full, " ".join([*kinds, core]), " ".join([core, *kinds]), " ".join([*(k for k in kinds if k != "university"), core, *(k for k in kinds if k == "university")])}:
                if kinds or form == full:
                    aliases[form].add(eid)
        #: An acronym that entries of different names share means none of them.
        self.acronyms = {a: next(iter(ids.values())) if len(ids) == 1 else 0 for a, ids in acronyms.items() if a}
        for core, found in by_core.items():
            if core and len(found) == 1:
                self.exact[core] = found[0][0]
        self.aliases = {form: min(ids) for form, ids in aliases.items() if len(ids) == 1 and form}
        self.automaton = ahocorasick.Automaton()
        for form, eid in self.aliases.items():
            self.automaton.add_word(f" {form} ", (form, eid))
        if len(self.automaton):
            self.automaton.make_automaton()
        squeezed: dict[str, set[int]] = defaultdict(set)
        for form, eid in self.aliases.items():
            squeezed[form.replace(" ", "")].add(eid)
        for core, eid in self.exact.items():
            squeezed[core.replace(" ", "")].add(eid)
        for eid, name, _ in entries:  # as written, with articles and prepositions, which edits may have run together
            squeezed[normalise(name).replace("|", "").replace(" ", "")].add(eid)
            squeezed[re.sub("^the ", "", normalise(name)).replace("|", "").replace(" ", "")].add(eid)
            for form in _spelt(self.core[eid], self.kinds[eid]):
                squeezed[form].add(eid)
        self.forms = [(f, min(ids)) for f, ids in squeezed.items() if len(ids) == 1]
        self.index = PairIndex([f for f, _ in self.forms], self.edits)
        # token sets: the words of every entry, kinds in one spelling
        tokens: dict[frozenset[str], set[int]] = defaultdict(set)
        for eid in self.core:
            tokens[frozenset(self.core[eid].split()) | frozenset(self.kinds[eid])].add(eid)
        self.sets = [(t, min(ids)) for t, ids in tokens.items() if len(ids) == 1 and t]
        by_word: dict[str, list[int]] = defaultdict(list)
        for i, (t, _) in enumerate(self.sets):
            for w in t:
                by_word[w].append(i)
        self.by_word = dict(by_word)
        words = PairIndex(sorted(by_word), self.edits)
        #: The words of entries near a word, with the edits between them; values share most of their words.
        self.near_words = lru_cache(100_000)(lambda w: {words.forms[r]: d for r, d in words.near(w)})

    def _rest_allows(self, rest: str) -> bool:
        return not any(w in _OTHER or w in set(_KIND.values()) for w in rest.split())

    def _mention(self, parts: list[str]) -> int | None:
        if not len(self.automaton):
            return None
        text = " " + " | ".join(parts) + " "
        hits = []
        for end, (form, eid) in self.automaton.iter(text):
            hits.append((-len(form), end - len(form) - 1, form, eid))
        taken: list[tuple[int, int]] = []
        found: list[int] = []
        for minus, start, form, eid in sorted(hits):
            stop = start - minus + 2
            if all(stop - 1 <= a or start + 1 >= b for a, b in taken):
                taken.append((start, stop))
                found.append(eid)
        if not found:
            return None
        rest = list(text)
        for a, b in taken:
            rest[a + 1 : b - 1] = " " * (b - a - 2)
        # A kind named in the mention's own part belongs to the name; in another part it is an addition.
        for a, b in taken[:1]:
            left = text.rfind("|", 0, a + 1) + 1
            right = text.find("|", b - 1)
            if not self._rest_allows("".join(rest[left : right if right >= 0 else None])):
                return None
        return found[0]

    def __call__(self, value: str) -> int:
        norm = normalise(value)
        squeezed = re.sub(r"[^a-z0-9]", "", norm)
        if squeezed in self.acronyms:
            return self.acronyms[squeezed]
        parts = [p for p in (re.sub(rf"^(?:{ADDITIONS})(?= |$)\s*", "", q.strip()) for q in norm.split("|")) if p]
        parts = [_expand(p) for p in parts]
        parts = [p for p in parts if p]
        if not parts:
            return 0
        if (eid := self._mention(parts)) is not None:
            return eid
        if (eid := self._mention([" ".join(parts)])) is not None:
            return eid
        for p in parts:
            if p in self.exact:
                return self.exact[p]
        whole = re.sub(r"\|", " ", norm)
        return self._similar([*parts, *([whole] if not any(w in _OTHER for w in whole.split()) else [])])

    def _similar(self, parts: list[str]) -> int:
        usable = [t for t in dict.fromkeys([*parts, " ".join(parts)]) if not any(w in _OTHER for w in t.split())]
        found = self._token_sets(usable)
        return self._run_together(usable) if found is None else found

    def _token_sets(self, texts: list[str]) -> int | None:
        """The entry whose words are the text's, in any order, within the edits in all; 0 if two fit as well; None if none does."""
        best: list[tuple[int, int, int]] = []
        for text in texts:
            own = {_KIND.get(w, w) for w in text.split() if w not in _DROP}
            near = {w: self.near_words(w) for w in own}
            if not own or not all(near.values()):
                continue
            # every word must be met, so the entries that meet the rarest one are all that can
            rarest = min(own, key=lambda w: (sum(len(self.by_word[x]) for x in near[w]), w))
            tried = {i for x in near[rarest] for i in self.by_word[x] if len(self.sets[i][0]) == len(own)}
            for i in tried:
                left, spent = set(self.sets[i][0]), 0
                for w in sorted(own, key=lambda w: (w not in left, w)):
                    fits = [(d, x) for x, d in near[w].items() if x in left]
                    if not fits:
                        spent = self.edits + 1
                        break
                    d, x = min(fits)
                    left.discard(x)
                    spent += d
                if spent <= self.edits:
                    best.append((spent, -len(own), self.sets[i][1]))
        if not best:
            return None
        ids = {eid for d, n, eid in best if (d, n) == min(best)[:2]}
        return ids.pop() if len(ids) == 1 else 0

    def _run_together(self, texts: list[str]) -> int:
        """For words that edits have run together or torn: the form closest as one string."""
        best: list[tuple[float, int]] = []  # fewest edits, then the longest form
        for text in texts:
            t = text.replace(" ", "")
            if len(t) >= 5:  # shorter ones are within two edits of half the list
                best += [(d - len(self.forms[r][0]) / 1000, self.forms[r][1]) for r, d in self.index.near(t)]
        if not best:
            return 0
        ids = {eid for d, eid in best if d == min(best)[0]}
        return ids.pop() if len(ids) == 1 else 0


class PairIndex:
    """Strings by their letter pairs, to find all within some edits of a text (one edit below eight letters)."""

    def __init__(self, forms: list[str], edits: int) -> None:
        self.forms = forms
        lists: dict[str, list[int]] = defaultdict(list)
        for r, f in enumerate(forms):
            for p in {f[i : i + 2] for i in range(len(f) - 1)}:
                lists[p].append(r)
        self.lists = {p: np.array(rows, dtype=np.int32) for p, rows in lists.items()}
        self.length = np.array([len(f) for f in forms], dtype=np.int32)
        self.most = np.minimum(edits, np.where(self.length < 8, 1, 2))
        # An edit undoes at most three pairs of a form (an exchange of neighbours): what must be left of its pairs.
        self.least = np.array([len({f[i : i + 2] for i in range(len(f) - 1)}) for f in forms], dtype=np.int32) - 3 * self.most

    def near(self, text: str) -> list[tuple[int, int]]:
        """``(row, edits)`` of every form within its edits of ``text``."""
        if not self.forms:
            return []
        hits = [self.lists[p] for p in {text[i : i + 2] for i in range(len(text) - 1)} if p in self.lists]
        shared = np.bincount(np.concatenate(hits), minlength=len(self.forms)) if hits else np.zeros(len(self.forms), dtype=np.int64)
        out = []
        for r in np.flatnonzero((shared >= self.least) & (np.abs(self.length - len(text)) <= self.most)):
            d = _distance(text, self.forms[r], int(self.most[r]))
            if d <= self.most[r]:
                out.append((int(r), d))
        return out


def map_values(df: DataFrame, key: str, fields: list[str], reference: DataFrame, entry_id: str, entry_name: str, acronym: str | None = None, max_entries: int = 100_000) -> DataFrame:
    """``key, field, value, <entry_id>`` of every cell of ``fields`` that holds a value; id 0: means no entry.

    The distinct values are mapped, not the rows; a value that is an entry letter by letter maps to it.
    """
    listed = reference.select(F.col(entry_id).cast("long").alias("id"), F.col(entry_name).alias("name"), (F.col(acronym) if acronym else F.lit(None)).cast("string").alias("acronym")).where("name is not null")
    entries = [tuple(r) for r in listed.limit(max_entries + 1).collect()]
    if len(entries) > max_entries:
        raise ValueError(f"the reference list has more than max_entries = {max_entries} entries")
    names: dict[str, int] = {}
    for eid, name, _ in sorted(entries):
        names.setdefault(name, eid)
    cells = None
    for f in fields:
        one = df.select(F.col(key).alias(key), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")).where(has_value(F.col(f)))
        cells = one if cells is None else cells.unionByName(one)

    @F.pandas_udf(T.LongType())
    def meant(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mapper = Mapper(entries)
        for values in batches:
            yield values.map(lambda v: names.get(v) or mapper(v)).astype("int64")

    # the values are few bytes but much work: they are spread over tasks by number, not by size
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = cells.select("value").distinct().repartition(tasks, F.xxhash64("value")).withColumn(entry_id, meant("value"))
    return cells.join(stage(distinct, "mapped"), "value").select(key, "field", "value", entry_id)
