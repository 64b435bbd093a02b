"""Page boilerplate mixed with main content (p3).

A page is rendered through a tree: a builder reads the page line by line (or tag by
tag, see :mod:`scholarforge.functions.html` for marked-up pages), gives every line
the element it implies - menu entry, breadcrumb, page tool, notice, heading of a
sidebar, entry of a sidebar, footer, heading, list entry, table row, paragraph -
and opens and closes the containers ``nav``, ``aside``, ``footer``, ``banner`` and
``main`` as the implied elements demand.  Visibility rules then hide every
container but ``main``; what stays keeps its order, blank lines, lists and table
cells as they were.

The element a line implies comes from three sides: the collection itself - a wording
that stands on a large share of the pages of one site and on few pages of all others is
part of that site's structure (:func:`site_wording`), and is then known on every page -,
a list of the usual wording of such furniture in four languages, and the shape of the
line.  Words that head sections of a profile as well as menus, and wording learnt from
sites, are settled by their neighbours in the tree.

Defined results: a null page gives null, an empty page an empty one; blank lines
are never furniture; whole pages are read, however long; repeated rows give the
same result each; empty tables give empty results; other columns stay.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarforge.runtime import stage

# Entries of site menus.
MENU = """
home|people|our staff|about us|news|events|research|study|seminars|contact|library|graduate school|a–z index|vacancies|outreach|giving|alumni|facilities
intranet|undergraduate|undergraduate courses|postgraduate|publications|equality and diversity|visitors|how to apply|staff|faculty|students|admissions|media|jobs|search
accueil|présentation|équipe|recherche|formations|actualités|agenda|bibliothèque|offres d’emploi|nous contacter|partenaires|annuaire
startseite|über uns|personen|forschung|studium|aktuelles|termine|bibliothek|stellenangebote|kontakt|presse|lehre
inicio|quiénes somos|personal|investigación|estudios|noticias|agenda|biblioteca|empleo|contacto|docencia|eventos
"""
# Of these, the ones that also head a section of a profile.
SHARED = "contact|publications|research|news|events|seminars|facilities|kontakt|contacto|recherche|forschung|investigación|publikationen|publicaciones"
# Page tools and controls.
TOOLS = """
menu|close|english|deutsch|français|español|log in|login|search this site|search|skip to main content|skip to content|skip to navigation|toggle navigation|jump to navigation
print this page|share by mail|send to a friend|tweet this|back to top|subscribe to our feed|text size a a a|report a problem with this page|bookmark this page|email this page
"""
# Headings of sidebars.
ASIDES = "quick links|in this section|share this page|follow us|most read|latest news|related pages|upcoming events|downloads|popular searches|see also|useful links|contact us"
# Lines of footers.
FOOTERS = """
site map|sitemap|accessibility statement|accessibility|webmaster|freedom of information|privacy policy|cookie policy|terms of use|legal notice|staff login|disclaimer
impressum|datenschutz|mentions légales|plan du site|aviso legal|mapa del sitio
"""
# Headings of sections of a profile.
HEADINGS = """
biography|background|about|about me|education|awards|honours|teaching|supervision|contact|publications|selected publications|recent papers|key outputs|full list of outputs|articles
research|research interests|current projects|projects|keywords|interests|profile|experience|employment|qualifications|memberships|service|funding|grants|office hours
"""

_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
_DATE = rf"(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[/.]\d{{1,2}}[/.]\d{{2,4}}|\d{{1,2}} (?:{_MONTHS}) \d{{4}})"
_NOTICE = re.compile(
    r"(?:we|this (?:web)?site|our (?:web)?site|cookies help|we and selected|by using|diese (?:web)?seite|wir (?:nutzen|verwenden|setzen)|ce site|nous (?:utilisons|d[é�]posons)"
    r"|este sitio|usamos|utilizamos|cookies)\b.*(?:\bcookies?\b|stores? small files)|cookies help us\b|our website stores small files\b"
)
_CRUMB = re.compile(r"(?:you are here ?[:;.]? ?)?(?:home|startseite|accueil|inicio) ?(?:[»›>/]|�) ?\S")
_FOOT = re.compile(
    rf"(?:last updated|updated|page last modified on|last modified|zuletzt geändert|dernière mise à jour|última actualización)[ :;]+(?:on )?{_DATE}[ .]*$"
    r"|(?:©|�|\(c\)) ?\d{4} .{2,90}$|copyright (?:©|�)? ?.{2,90} ?\d{4}[ .]*$"
    r"|charity registered in \w+[ .]*$|registered charity\b.{0,40}$|switchboard ?[:;] ?[\d +()/.-]{5,30}$|privacy policy ?\| ?.*"
    r"|\d{1,4} [^\W\d]+ (?:road|street|avenue|lane|terrace|close|square)[,;] [^\W\d]+[,;] [^\W\d]+[ .]*$"
)
_UNIT = re.compile(r".{2,90} [–�-] (?:department|faculty|school|institute|college) of .{2,60} [–�-] \d{4}[ .]*$")
_SEPARATORS = re.compile(r"[\t|/·•»›>�]|  ")


def _is_footer(text: str) -> bool:
    if _FOOT.match(text) or "all rights reserved" in text or " estate is a smoke-free area" in text:
        return True
    return text.rstrip(" .")[-4:].isdigit() and _UNIT.match(text) is not None


_PROMO = re.compile(r"join us at the .{2,40} open day\b|(?:the|our) \w+ has launched an appeal\b|applications for the .{2,40} (?:summer|winter) school close\b|register (?:now|your interest)\b|sign up (?:now|to|for) ")
_SPLIT = re.compile(r"\s*\t\s*|\s+[|/·•»›>�]+\s+|\s{2,}")
_BULLET = re.compile(r"(?:[•·▪‣◦*–»›-]|�+)\s+")
_PROSE_END = re.compile(r"[.!?;:,]$|[.;:,!?] ")
_ENTRY_NO = re.compile(r"\d|[()=_{}<>|;\t]")
_LINKS = {"in", "the", "and", "for", "of", "near", "at", "to", "on", "with", "a", "an", "by", "from"}
_VERBS = {"is", "are", "was", "were", "has", "have", "had", "can", "may", "might", "lets", "asks", "uses", "keeps", "ask", "use", "keep", "that", "which", "who", "this", "these", "she", "he", "her", "his", "we", "our", "it", "its", "how", "why", "whether", "under", "over", "since", "between", "where"}
_TITLE = re.compile(r"(?:prof(?:essor)?|dr|mr|ms|mrs)\b|ph ?d\b|d\. ?phil|office ?[:;]")


def _set(text: str) -> frozenset[str]:
    return frozenset(x.strip() for x in text.replace("\n", "|").split("|") if x.strip())


_MENU, _SHARED, _TOOLS, _ASIDES, _FOOTERS, _HEADINGS = map(_set, (MENU, SHARED, TOOLS, ASIDES, FOOTERS, HEADINGS))


def _skeleton(text: str) -> str:
    return re.sub(r"[^\x00-\x7f]+", "�", text)


_LOST = {name: frozenset(map(_skeleton, values)) for name, values in (("menu", _MENU), ("tools", _TOOLS), ("asides", _ASIDES), ("footers", _FOOTERS))}
_KINDS = {"menu": _MENU, "tools": _TOOLS, "asides": _ASIDES, "footers": _FOOTERS}


def _is(kind: str, text: str) -> bool:
    return text in _KINDS[kind] or ("�" in text and _skeleton(text) in _LOST[kind])


def _named(words: list[str]) -> bool:
    """Whether every word has a capital, as in a person's name."""
    return len(words) > 1 and all(w[:1].isupper() for w in words)


def _bar(text: str) -> str:
    """``bar`` for a line of menu entries between separators."""
    parts = [x for x in _SPLIT.split(text) if x]
    return "bar" if len(parts) > 1 and sum(_is("menu", x) for x in parts) >= max(2, 0.6 * len(parts)) else ""


def _implied(line: str) -> str:
    """The element a line implies by its wording and shape."""
    text = line.strip().lower()
    if not text:
        return ""
    if "�" in text:
        text = re.sub("�+", "�", text)
    bullet = _BULLET.match(text)
    bare = text[bullet.end() :].strip() if bullet else text
    if bullet and text[0] == "�" and not _is("menu", bare):
        bullet, bare = None, text  # a lost character may be any sign
    mark = "*" if bullet else ""
    if _is("menu", bare):
        return ("shared" if bare in _SHARED else "menu") + mark
    if not bullet:
        if _is("tools", text):
            return "tool"
        if _is("asides", text):
            return "aside"
        if _is("footers", text):
            return "foot"
        if text in _HEADINGS:
            return "h"
        first = text[0]
        if _CRUMB.match(text):
            return "crumb"
        if _NOTICE.match(text) or ("cookies" in text and ("accept all" in text or "en savoir plus" in text or "más información" in text)):
            return "notice"
        if _PROMO.match(text):
            return "promo"
        if _is_footer(text):
            return "foot"
        if first in "-–|" and len(text) < 2 or len(text) > 220:  # no list of links is that long without a separator
            return "p" if len(text) < 2 or not _SEPARATORS.search(text) else _bar(text) or "p"
    if bar := _SEPARATORS.search(text) and _bar(text):
        return bar
    if bullet:
        return "li"
    words = text.split(" ")
    if len(text) <= 75 and len(words) <= 9 and not _PROSE_END.search(text) and not _ENTRY_NO.search(text) and line.strip()[0].isupper() and not _TITLE.match(text) and words[-1] not in _LINKS and not any(w in _VERBS for w in words) and not _named(line.strip().split(" ")):
        return "entry"
    return "p"


_short = lru_cache(maxsize=1 << 15)(_implied)


#: Signs that open an entry of a list.
_MARKS = "•·▪‣◦*–»›- "


def wording(line: str) -> int:
    """Hash of a line as it is compared between pages: lower case, without a leading mark, digits as 0; the JVM's twin is in :func:`site_wording`."""
    text = re.sub("[0-9]+", "0", line.strip(" ").lower().lstrip(_MARKS))
    return xxhash.xxh64_intdigest(text.encode(), 42)


def _tag(line: str, learnt: dict[int, bool]) -> str:
    """The element of a line; where its own wording says nothing, what the collection says of it."""
    tag = _short(line) if len(line) < 90 else _implied(line)
    if learnt and tag in ("p", "entry", "li", "h") and len(line) < _LONGEST and (firm := learnt.get(wording(line))) is not None and (firm or tag != "h"):
        if len(line.split()) > 6:
            return "foot" if firm else tag
        return ("menu" if firm else "shared") + ("*" if tag == "li" else "")
    return tag


#: Lines of site furniture that are learnt have fewer characters.
_LONGEST = 120


def site_wording(df: DataFrame, site: Column, page: str, text: str, share: float = 0.0005, rate: float = 0.25, lift: float = 2.0, nats: float = 20.0, sites: int = 2) -> dict[int, bool]:
    """Wording of lines (by hash) that belongs to the structure of sites, and whether it belongs to nothing else.

    A line counts if, on ``sites`` sites, it stands on the share ``rate`` of their different
    pages at least (one site alone may hold many versions of one page; lines of more than
    six words need ``2 * sites + 1``), ``lift`` times as often as on the pages of all other
    sites, and if this is no chance (log-likelihood ratio over ``nats``).  It belongs to
    nothing else if a quarter of the pages are on sites that never use it: what heads
    sections of pages is met on every site now and then.  Only lines on the share ``share``
    of all pages are looked at, so at most (lines a page / ``share``) come to the driver,
    whatever the size of the collection; all pages are counted, as hashes combined before
    the shuffle.
    """
    pages = df.where(F.length(text) > 0).select(F.xxhash64(F.coalesce(site.cast("string"), F.lit(""))).alias("site"), F.xxhash64(page).alias("page"), F.col(text).alias("t"))
    bare = F.ltrim(F.lower(F.trim("l")), F.lit(_MARKS))
    said = F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, "[0-9]+", "0")).otherwise(bare)
    lines = pages.select("site", "page", F.explode(F.split("t", "\n")).alias("l")).where((F.length("l") > 1) & (F.length("l") < _LONGEST) & F.col("l").rlike("[a-zA-Z]{2}"))
    lines = lines.select("site", "page", said.alias("l")).select("site", "page", F.xxhash64("l").alias("h"), (F.size(F.split("l", " ")) > 6).alias("long"))
    all_pages = stage(pages.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("n")), "sites")
    sums = all_pages.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") >= 20, F.col("n"))).alias("large")).first()
    each = stage(lines.distinct().groupBy("h", "long", "site").agg(F.count("*").alias("c")), "site-lines")
    totals = each.groupBy("h").agg(F.sum("c").alias("all_c")).where(F.col("all_c") >= max(8.0, share * (sums["n"] or 0)))
    each = each.join(totals, "h").join(all_pages, "site")
    own = F.least(F.col("c") / F.col("n"), F.lit(0.999999))
    other = F.greatest((F.col("all_c") - F.col("c") + 0.5) / (F.lit(float(sums["n"] or 0)) - F.col("n") + 1.0), F.lit(1e-9))
    ratio = F.col("c") * F.log(own / other) + (F.col("n") - F.col("c")) * F.log((1 - own) / F.greatest(1 - other, F.lit(1e-9)))
    hit = (F.col("n") < (sums["n"] or 0)) & (own >= rate) & (own >= lift * other) & (ratio >= nats)
    found = each.groupBy("h", "long").agg(F.count_if(hit).alias("sites"), F.coalesce(F.sum(F.when(F.col("n") >= 20, F.col("n"))), F.lit(0)).alias("used"))
    found = found.where(F.col("sites") >= F.when(F.col("long"), 2 * sites + 1).otherwise(sites))
    return {r["h"] & 0xFFFFFFFFFFFFFFFF: r["used"] <= 0.75 * (sums["large"] or 0) for r in found.collect()}


HIDDEN = frozenset(("nav", "aside", "footer", "banner"))
_HOLDER = {"tool": "nav", "crumb": "nav", "bar": "nav", "menu": "nav", "menu*": "nav", "notice": "banner", "promo": "aside", "aside": "aside", "foot": "footer"}


def build(lines: list[str], learnt: dict[int, bool] | None = None) -> list[str]:
    """The container of every line: ``nav``, ``aside``, ``footer``, ``banner``, ``main`` or '' for a blank line.

    The builder keeps one open container below ``body``.  An implied element opens
    its container and closes any other; a blank line closes ``nav`` and ``aside``.
    """
    tags = [_tag(x, learnt or {}) for x in lines]
    n = len(tags)
    out = [""] * n
    i = 0
    while i < n:
        tag = tags[i]
        if tag == "":
            i += 1
            continue
        if tag[:4] in ("menu", "shar"):
            mark = tag[-1] == "*"
            j = i
            while j < n and tags[j][:4] in ("menu", "shar") and (tags[j][-1] == "*") == mark:
                j += 1
            run = tags[i:j]
            firm = sum(t[:4] == "menu" for t in run)
            if mark or firm >= 1 and len(run) >= 2 or firm and len(run) == 1:
                hold = "nav"
            elif len(run) >= 3:
                hold = "nav"
            else:
                hold = "main"
            for k in range(i, j):
                out[k] = hold
            i = j
            continue
        out[i] = _HOLDER.get(tag, "main")
        i += 1
        if tag == "aside":
            before = next((lines[k].rstrip() for k in range(i - 2, -1, -1) if out[k] == "main"), "")
            broken = bool(before) and before[-1] not in ".!?:" and len(before) > 30
            while i < n and tags[i] == "entry" and not _looks_wrapped(lines, tags, i, broken):
                out[i] = "aside"
                i += 1
    return out


def _looks_wrapped(lines: list[str], tags: list[str], i: int, broken: bool) -> bool:
    """Whether line ``i`` begins a sentence that the next line goes on with in lower case.

    Where the sidebar itself broke a sentence (``broken``), the lower-case line goes on with that one.
    """
    nxt = lines[i + 1].strip() if i + 1 < len(lines) else ""
    return not broken and len(lines[i]) > 30 and nxt[:1].islower() and tags[i + 1] == "p"


def furniture(text: str | None, learnt: dict[int, bool] | None = None) -> list[int]:
    """Numbers, from 1, of the non-empty lines of ``text`` that belong to the site."""
    if not text:
        return []
    return [k for k, hold in enumerate(build(text.split("\n"), learnt), 1) if hold in HIDDEN]


def main_lines(text: str, learnt: dict[int, bool] | None = None) -> list[str]:
    """The lines of ``text`` that belong to the page's own content, blank ones included."""
    lines = text.split("\n")
    return [x for x, hold in zip(lines, build(lines, learnt)) if hold not in HIDDEN]


def own_text(text: str, learnt: dict[int, bool] | None = None) -> str:
    """The page's own content as one text."""
    return "\n".join(main_lines(text, learnt))


def site_lines(df: DataFrame, key: str, text: str, learnt: dict[int, bool] | None = None) -> DataFrame:
    """``key, line_no`` of every line that belongs to the site; ``learnt`` as :func:`site_wording` gives it."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(text: pd.Series) -> pd.Series:
        return text.map(lambda t: furniture(t, learnt))

    return df.where(F.length(text) > 0).select(key, F.explode(numbers(text)).alias("line_no"))


def main_text(df: DataFrame, text: str, into: str | None = None, learnt: dict[int, bool] | None = None) -> DataFrame:
    """``df`` with ``into`` (default: ``text`` itself) reduced to the page's own content."""

    @F.pandas_udf(T.StringType())
    def own(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else own_text(t, learnt) for t in text], dtype=object)

    return df.withColumn(into or text, own(F.col(text)))
