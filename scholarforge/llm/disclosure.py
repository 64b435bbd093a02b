"""Personal information inside free text (p10): information-theoretic sanitisation.

How strongly a term reveals a protected entity is estimated from the whole
collection.  For words with a capital: the pointwise mutual information between the
word and person contexts, first those that a title opens, then those beside words
already known to be strong.  For numbers, mail addresses, telephone numbers and
street addresses, which are met once each, the term is what stands for them: the
words that label a number, the shape of a telephone number, the word for a way, the
sign of a mail address; it counts how much more often a person is named on their
lines than on any line.  An item is replaced if its terms exceed the disclosure
threshold; the lists of labels and the forms weigh two and a half bits at the start, no more.

Found items become typed placeholders such as ``[NAME]``; all else stays as it is.

Defined results: null and empty texts hold nothing; whole texts are read; repeated
ids are reported once for each line and kind; empty tables give empty results;
line numbers count from 1, split at the newline character only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarforge.runtime import stage

# Titles that open a person's name, without their full stop, in lower case.
TITLES = frozenset("dr prof professor mr mrs ms miss mx sir dame herr herrn frau fräulein mme mlle monsieur madame sr sra srta dra don doña señor señora".split())
# Labels of numbers that belong to persons; a start for what the collection says itself.
PERSON_LABELS = frozenset("staff no|staff number|staff id|personnel number|personnel no|employee number|employee no|student number|student no|student id|matriculation|matriculation number|passport|passport no|passport number|ssn|social security|security number|national id|card no|card number|identity no|identity number|id no|id number|insurance number|insurance no|tax number|tax id|licence no|dni|nif|nie|matrikelnummer|personalnummer|ausweis|reisepass|pasaporte|passeport|patient no|patient number".split("|"))
# Labels of numbers that belong to things.
THING_LABELS = frozenset("budget line|serial|serial number|serial no|accession|accession number|isbn|issn|doi|reference|grant reference|grant|firmware|module|room|catalogue no|order no|invoice no|invoice number|order number|version|volume|account|station|line|lot|batch|item|part number|pp|page|pages|hours|tel|phone|telephone|fax".split("|"))
#: Bits by which a listed label, or a form made for reaching a person, is believed before the collection has spoken.
PRIOR_BITS = 2.5
_WAY = re.compile(r"street|st\b|avenue|ave\b|avenida|avda|road|rd\b|lane|drive|dr\b|blvd|boulevard|close|crescent|terrace|way\b|place|square|court|gardens|grove|row\b|hill|rue|chemin|allée|impasse|quai|straße|strasse|weg|gasse|allee|platz|damm|ufer|calle|plaza|paseo|camino|c/")
_GENERIC = frozenset("no number id nr num nº n° # nummer número numéro".split())

_AT = re.compile(r" ?(?:@|[\[({] ?at ?[\])}]) ?| at (?=[\w-]+(?:\.[\w-]+)* dot [\w-])", re.IGNORECASE)
_AT_HINTS = ("@", "(at)", "[at]", "{at}", "( at )", "[ at ]", " dot ", " DOT ", "(AT)", "[AT]")
_LOCAL = re.compile(r"[\w.+'’%-]{1,64}$")
_DOMAIN = re.compile(r"[\w-]+(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[\w-]+)+", re.IGNORECASE)
_NUMBER = re.compile(r"[+(]?\(?\d[\d ()/.–-]{3,26}\d(?:,? ?(?:ext|x|extension)\.? ?\d{1,6})?")
_PHONE = re.compile(
    r"(?:\+\d{1,3}[ .-]?(?:\(0?\d{0,4}\)[ .-]?)?\d{1,4}(?:[ .-]\d{2,4}){1,5}|\+\d{1,3} ?\(\d{2,4}\) ?\d{3}[ .-]\d{4}|00\d{2,3}[ .-]\d{1,4}[ .-]\d{4,9}|\(0?\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}"
    r"|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4} ?/ ?\d{2,4}(?:[ -]\d{2,4}){0,4}|0\d{2,4} \d{3,4} \d{3,4}|\d{3}-\d{4})(?:,? ?(?:ext|x|extension)\.? ?\d{1,6})?$"
)
_STREET = re.compile(
    r"\b\d{1,4}[a-zA-Z]? (?:[A-ZÀ-ÖØ-ÞĀ-Ž][\w’'-]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Dr|Blvd|Boulevard|Close|Crescent|Terrace|Way|Place|Square|Court|Gardens|Grove|Row|Hill)\b"
    r"|\b\d{1,4},? (?:bis |ter )?(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai) (?:de la |de l’|de |du |des |d’)?[A-ZÀ-ÖØ-Þ]\w+"
)
_WAYS = ("straße ", "strasse ", "weg ", "gasse ", "allee ", "platz ", "damm ", "ufer ")
_STREET_DE = re.compile(r"(?:straße|strasse|weg|gasse|allee|platz|damm|ufer) \d{1,4}[a-z]?\b")
_WORD_END = re.compile(r"[^\W\d_]+$")
_VIAS = ("Calle", "Avenida", "Avda", "Plaza", "Paseo", "Camino", "C/")
_STREET_ES = re.compile(r"\b(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|C/) ?(?:de la |de los |del |de )?[A-ZÀ-ÖØ-Þ][\w’'-]+(?: [A-ZÀ-ÖØ-Þ][\w’'-]+)*,? (?:n\.?º ?)?\d{1,4}\b")
_FLAT = re.compile(r"(?:Flat|Apt|Apartment|Unit|Suite) \d{1,4}[a-zA-Z]?, ?$")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞĀ-Ž](?:[^\W\d_]|[\u0300-\u036f])*(?:[-’'](?:[^\W\d_])+)*\.?")
_WORDS_BEFORE = re.compile(r"([^\W\d_]+)\.?[ :#]*$")


def _proper(word: str) -> str:
    """A word as it is counted: without final stop, possessive and capitals but the first; the first of joined words."""
    word = word.rstrip(".")
    for end in ("’s", "'s", "’S", "'S"):
        word = word.removesuffix(end)
    return "-".join(p[:1].upper() + p[1:].lower() for p in word.split("-"))


def _label(text: str, at: int) -> str:
    """The label before a number: its last word, or two if the last one is general."""
    before = text[max(0, at - 40) : at].split("\n")[-1]
    m = _WORDS_BEFORE.search(before)
    if not m:
        return ""
    last = m.group(1).lower()
    n = _WORDS_BEFORE.search(before[: m.start()]) if last in _GENERIC else None
    return f"{n.group(1).lower()} {last}" if n else last


def fixed_forms(text: str) -> list[tuple[str, int, int]]:
    """Mail addresses, telephone numbers and street addresses with their places; the rest of long numbers as ``number``."""
    out = []
    if any(h in text for h in _AT_HINTS):
        for m in _AT.finditer(text):
            local, domain = _LOCAL.search(text, max(0, m.start() - 64), m.start()), _DOMAIN.match(text, m.end())
            if local and domain and (m.group()[:1] != " " or m.group() == " @ " or "@" not in m.group()):
                out.append(("email", local.start(), domain.end()))
    for m in _STREET.finditer(text):
        flat = _FLAT.search(text, max(0, m.start() - 16), m.start())
        out.append(("address", flat.start() if flat else m.start(), m.end()))
    if any(w in text for w in _WAYS):
        for m in _STREET_DE.finditer(text):
            head = _WORD_END.search(text, max(0, m.start() - 60), m.start())
            if head and head.group()[0].isupper():
                out.append(("address", head.start(), m.end()))
    if any(w in text for w in _VIAS):
        out += [("address", m.start(), m.end()) for m in _STREET_ES.finditer(text)]
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        number = m.group()
        while number[0] == "(" and number.count("(") > number.count(")"):
            number, start = number[1:], start + 1
        if _PHONE.match(number) and not text[max(0, start - 1) : start].isalnum():
            out.append(("phone", start, end))
            continue
        head = re.search(r"[A-Z]{1,3}$", text[max(0, start - 3) : start])
        start -= len(head.group()) if head else 0
        tail = re.match(r"-?[A-Z]{1,2}\b", text[end : end + 4])
        end += len(tail.group()) if tail else 0
        if sum(c.isdigit() for c in number) >= 6:
            out.append(("number", start, end))
    return out


def term_of(kind: str, said: str) -> str:
    """What stands for an item of a fixed form in the collection."""
    if kind == "email":
        return "@" if "@" in said else "at"
    if kind == "phone":
        return re.sub(r"\d+", "0", said)
    way = _WAY.search(said.lower())
    return way.group() if way else ""


def _capitals(text: str) -> list[tuple[int, int, str]]:
    """Words with a capital; parts of addresses and codes are none."""
    out = []
    for m in _CAPITAL.finditer(text):
        before, after = text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
        if not (before and (before.isalnum() or before in "@_+./") or after and (after.isdigit() or after in "@_+")):
            out.append((m.start(), m.end(), m.group()))
    return out


def name_candidates(text: str, tokens: list[tuple[int, int, str]] | None = None) -> list[tuple[str, str, str, int, int]]:
    """Word sequences that may name a person: ``form, first, second, start, end``.

    Forms: T title and name, G given name and surname, I initial and surname,
    C surname, comma, given name or initial, S surname and initial.
    """
    tokens = _capitals(text) if tokens is None else tokens
    out = []
    n = len(tokens)

    def kind(i: int) -> str:
        t = tokens[i][2]
        if t.rstrip(".").lower() in TITLES:
            return "title"
        return "initial" if len(t) <= 2 and (len(t) == 2 and t[1] == ".") else "name" if len(t.rstrip(".")) > 1 and not (t.endswith(".") and len(t) < 4) else "other"

    kinds = [kind(i) for i in range(n)]
    for i in range(n):
        k = kinds[i]
        if k == "other":
            continue
        j = i + 1
        ended = tokens[i][2].endswith(".") and k == "name"
        gap = text[tokens[i][1] : tokens[j][0]] if j < n and not ended else "\0"
        if k == "title":
            names, last = [], i
            while j < n and text[tokens[last][1] : tokens[j][0]] == " " and kinds[j] in ("initial", "name") and len(names) < 3:
                if kinds[j] == "name":
                    names.append(j)
                last, j = j, j + 1
                if kinds[last] == "name" and tokens[last][2].endswith("."):
                    break
            if names:
                out.append(("T", _proper(tokens[names[0]][2]), _proper(tokens[names[-1]][2]), tokens[i][0], tokens[last][1]))
        elif k == "initial":
            while j < n and kinds[j] == "initial" and text[tokens[j - 1][1] : tokens[j][0]] in (" ", ""):
                j += 1
            if j < n and kinds[j] == "name" and text[tokens[j - 1][1] : tokens[j][0]] == " ":
                out.append(("I", tokens[i][2][0], _proper(tokens[j][2]), tokens[i][0], tokens[j][1]))
        elif gap == " ":
            m = j
            while m < n and kinds[m] == "initial" and text[tokens[m - 1][1] : tokens[m][0]] == " ":
                m += 1
            if m < n and kinds[m] == "name" and text[tokens[m - 1][1] : tokens[m][0]] == " ":
                out.append(("G", _proper(tokens[i][2]), _proper(tokens[m][2]), tokens[i][0], tokens[m][1]))
            elif kinds[j] == "initial":
                out.append(("S", _proper(tokens[i][2]), tokens[j][2][0], tokens[i][0], tokens[j][1]))
        elif gap == ", " and kinds[j] in ("name", "initial"):
            out.append(("C", _proper(tokens[i][2]), _proper(tokens[j][2]), tokens[i][0], tokens[j][1]))
    return out


ITEM = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("form", T.StringType()),
    T.StructField("first", T.StringType()), T.StructField("second", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("n", T.LongType()),
])


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items and candidates of every text; once a batch, how often each candidate's words occur with a capital."""
    names = [f.name for f in ITEM]
    for batch in batches:
        rows = []
        seen: Counter = Counter()
        lines = 0
        for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
            if not text:
                continue
            breaks = [i for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
            lines += len(breaks) + 1
            tokens = _capitals(text)
            seen.update(t[2] for t in tokens)
            for kind, a, b in fixed_forms(text):
                label = _label(text, a) if kind == "number" else term_of(kind, text[a:b])
                rows.append((key, bisect_right(breaks, a) + 1, kind, "", label, "", a, b, 1))
            for form, first, second, a, b in name_candidates(text, tokens):
                rows.append((key, bisect_right(breaks, a) + 1, "candidate", form, first, second, a, b, 1))
        words: Counter = Counter()
        for w, n in seen.items():
            words[_proper(w)] += n
        rows += [(None, 0, "word", "", w, "", 0, 0, n) for w, n in words.items() if len(w) > 1]
        rows.append((None, 0, "lines", "", "", "", 0, 0, lines))
        yield pd.DataFrame(rows, columns=names)


def extract(df: DataFrame, key: str, text: str) -> DataFrame:
    """All items and candidates, staged; ``first`` of a number is its label, of another form its term."""
    return stage(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInPandas(_items, ITEM), "items")


def _word_scores(items: DataFrame, rounds: int = 3) -> DataFrame:
    """``w, given, surname``: mutual information, in bits, of a word with either place in a person's name."""
    total = items.where("kind = 'word'").groupBy(F.col("first").alias("w")).agg(F.sum("n").alias("n"))
    pairs = stage(items.where("kind = 'candidate'").groupBy("form", "first", "second").agg(F.sum("n").alias("n")), "pairs")
    # Title contexts: the last word is a surname; the word before it, if any, a given name.
    titled = pairs.where("form = 'T'")
    counts = titled.select(F.explode(F.array(F.struct(F.col("second").alias("w"), F.lit(0).alias("g"), F.lit(1).alias("s")), F.struct(F.when(F.col("first") != F.col("second"), F.col("first")).alias("w"), F.lit(1).alias("g"), F.lit(0).alias("s")))).alias("x"), "n")
    counts = counts.where("x.w is not null").groupBy("x.w").agg(F.sum(F.col("x.g") * F.col("n")).alias("g"), F.sum(F.col("x.s") * F.col("n")).alias("s"))
    scores = None
    for r in range(rounds):
        scores = stage(_information(total, counts), "scores")
        if r == rounds - 1:
            break
        # A strong given name before a word is a person context for that word, and so is a strong surname after it.
        known_g, known_s = scores.where("given > 3").select(F.col("w").alias("first"), F.lit(1).alias("kg")), scores.where("surname > 3").select(F.col("w").alias("second"), F.lit(1).alias("ks"))
        near = pairs.where("form in ('G', 'C')").select(F.when(F.col("form") == "G", F.col("first")).otherwise(F.col("second")).alias("first"), F.when(F.col("form") == "G", F.col("second")).otherwise(F.col("first")).alias("second"), "n")
        near = near.join(known_g, "first", "left").join(known_s, "second", "left").where("kg = 1 or ks = 1")
        more = near.select(F.explode(F.array(F.struct(F.when(F.col("kg") == 1, F.col("second")).alias("w"), F.lit(0).alias("g"), F.lit(1).alias("s")), F.struct(F.when(F.col("ks") == 1, F.col("first")).alias("w"), F.lit(1).alias("g"), F.lit(0).alias("s")))).alias("x"), "n")
        more = more.where("x.w is not null").groupBy("x.w").agg(F.sum(F.col("x.g") * F.col("n")).alias("g"), F.sum(F.col("x.s") * F.col("n")).alias("s"))
        counts = counts.unionByName(more).groupBy("w").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    return scores


def _information(total: DataFrame, counts: DataFrame, smooth: float = 0.5) -> DataFrame:
    both = total.join(counts, "w", "left").fillna(0, ["g", "s"])
    sums = both.agg(F.sum("n").alias("all"), F.sum("g").alias("all_g"), F.sum("s").alias("all_s"))
    scored = both.crossJoin(F.broadcast(sums))  # one row
    bits = lambda c, a: F.log2(((F.col(c) + smooth * (F.col(a) + 1.0) / (F.col("all") + 1.0)) / (F.col("n") + smooth)) / ((F.col(a) + 1.0) / (F.col("all") + 1.0)))
    return scored.select("w", "n", bits("g", "all_g").alias("given"), bits("s", "all_s").alias("surname"))


def found_items(df: DataFrame, key: str, text: str, bits: float = 2.0) -> DataFrame:
    """``key, line_no, kind, start, stop`` of every item whose terms exceed the disclosure threshold of ``bits``."""
    items = extract(df, key, text)
    scores = _word_scores(items)
    pairs = items.where("kind = 'candidate'").select("form", "first", "second").distinct()
    first, second = scores.select(F.col("w").alias("first"), *[F.col(c).alias("f_" + c) for c in ("given", "surname", "n")]), scores.select(F.col("w").alias("second"), *[F.col(c).alias("s_" + c) for c in ("given", "surname", "n")])
    # a joined surname that is rare itself counts as its first part does
    part = scores.select(F.col("w").alias("__part"), F.col("surname").alias("p_surname"))
    judged = pairs.withColumn("__part", F.when(F.col("second").contains("-"), F.substring_index("second", "-", 1)))
    judged = judged.join(first, "first", "left").join(second, "second", "left").join(part, "__part", "left").withColumn("s_surname", F.greatest("s_surname", "p_surname"))
    v = lambda c: F.coalesce(F.col(c), F.lit(-9.0))
    # a word met once after an initial is told by the form itself: by most words after initials that are met more often
    initials = judged.where("form = 'I' and s_n > 1").agg(F.coalesce(F.avg((v("s_surname") > bits).cast("double")), F.lit(1.0)).alias("__share"))
    judged = judged.crossJoin(F.broadcast(initials.select((F.col("__share") > 0.5).alias("__initials"))))  # one row
    rare = -2.0  # a word met once or twice tells nothing against a person
    strong = (
        F.when(F.col("form") == "T", (v("s_surname") > bits))
        .when(F.col("form") == "G", ((v("f_given") > bits) & (v("s_surname") > rare)) | ((v("s_surname") > bits) & (v("f_given") > rare)))
        .when(F.col("form") == "C", ((v("f_surname") > bits) & ((v("s_given") > bits) | (F.length("second") == 1))))
        .when(F.col("form") == "I", (v("s_surname") > bits) | ((F.col("s_n") == 1) & F.col("__initials")))
        .otherwise(v("f_surname") > bits)
    )
    named = judged.where(strong).select("form", "first", "second")
    names = items.where("kind = 'candidate'").join(named, ["form", "first", "second"], "left_semi").select("key", "line_no", F.lit("name").alias("kind"), "start", "stop")
    names = stage(names, "names")
    fixed = items.where("kind = 'number' and first != '' or kind in ('email', 'phone', 'address')")
    strong_terms = _term_scores(items, fixed, names).where(F.col("told") > bits).select("kind", "first")
    rest = fixed.join(strong_terms, ["kind", "first"], "left_semi").select("key", "line_no", F.when(F.col("kind") == "number", "id_number").otherwise(F.col("kind")).alias("kind"), "start", "stop")
    return names.unionByName(rest)


def _term_scores(items: DataFrame, fixed: DataFrame, names: DataFrame, few: float = 5.0) -> DataFrame:
    """``kind, first, told``: bits by which a person is likelier on a line with the term than on any line.

    A term met ``few`` times or less leans on its kind as a whole; a label of numbers met
    less often than that has its prior only.  Shapes of numbers and labels are many, but each is one row; none is collected.
    """
    people = names.select("key", "line_no").distinct().withColumn("p", F.lit(1))
    lines = items.where("kind = 'lines'").agg(F.sum("n").alias("lines"))
    base = people.agg(F.count("*").alias("named")).crossJoin(lines).select(((F.col("named") + 1.0) / (F.coalesce("lines", F.lit(0)) + 50.0)).alias("base"))
    terms = fixed.join(people, ["key", "line_no"], "left").groupBy("kind", "first").agg(F.count("*").alias("n"), F.sum(F.coalesce("p", F.lit(0))).alias("p"))
    kinds = terms.groupBy("kind").agg(F.sum("n").alias("kn"), F.sum("p").alias("kp"))
    both = terms.join(F.broadcast(kinds), "kind").crossJoin(F.broadcast(base))  # four rows, one row
    lean = F.when(F.col("kind") == "number", F.col("base")).otherwise((F.col("kp") + F.col("base")) / (F.col("kn") + 1.0))
    prior = F.when(F.col("kind") != "number", PRIOR_BITS).when(F.col("first").isin(*PERSON_LABELS), PRIOR_BITS).when(F.col("first").isin(*THING_LABELS), -PRIOR_BITS).otherwise(0.0)
    told = F.log2((F.col("p") + few * lean) / (F.col("n") + few) / F.col("base"))
    told = F.when((F.col("kind") == "number") & (F.col("n") < few), 0.0).otherwise(told)  # so few lines tell nothing of a label
    return both.select("kind", "first", (told + prior).alias("told"))


def sanitised(df: DataFrame, key: str, text: str, into: str = "sanitised", bits: float = 2.0) -> DataFrame:
    """``df`` with ``into``: the text with items replaced by ``[NAME]``, ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]``."""
    spans = found_items(df, key, text, bits).groupBy("key").agg(F.collect_set(F.struct("start", "stop", "kind")).alias("__spans"))  # bounded by a text's length

    @F.pandas_udf(T.StringType())
    def put(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            if t and s is not None and len(s):
                parts, at = [], 0
                for x in sorted(s, key=lambda x: (x["start"], -x["stop"])):
                    if x["start"] >= at:
                        parts += [t[at : x["start"]], f"[{x['kind'].upper()}]"]
                        at = x["stop"]
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    joined = df.join(spans.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left")
    return joined.withColumn(into, put(F.col(text), F.col("__spans"))).drop("__key", "__spans")
