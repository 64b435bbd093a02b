"""Fields of a profile from the lines of its page: rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarforge.functions.text import YEAR, contains_any

# Patterns of the rules.
PHD = r"(ph\.?[ ]?d\.?[ ]?)|(d\.?[ ]?phil\.?[ ]?)"
ASSOCIATE = r"(associate|(assoc\.?)) prof[\.]?[ ]?"
ASSISTANT = r"(assistant|(asst\.?)) prof[\.]?[ ]?"
PROFESSOR = r"prof\.|professor"
INSTITUTION = r"[A-Za-z ]*(?:University|Institute|College)[A-Za-z ]*|[A-Z][A-Z]{2,4}"
INSTITUTION_NAME = r"(?:[ ]?([A-Za-z ]*(?:University|Institute|College)[A-Za-z ]*)[ ]?|[A-Z][A-Z]{2,4})"
YEAR_IN_LINK = r"/(?:19|20)[0-9]{2}/"
REFERENCE = r"[A-Z][a-z]+(?:, |,| )[A-Z](?:\. |\.| ).*(?:19|20)[0-9]{2}"


def _short(x: Column, n: int) -> Column:
    return F.size(F.split(x, " ")) <= n


def position(title: Column, lines: Column, longest: int = 10) -> Column:
    """Professor, Associate or Assistant Professor, or Non-Professor, from a title and short lines."""
    t = F.lower(F.coalesce(title, F.lit("")))
    has = lambda p: F.exists(lines, lambda x: F.lower(x).rlike(p) & _short(x, longest))
    one_word = F.exists(lines, lambda x: F.lower(x).contains("professor") & _short(x, 1))
    plain = F.exists(lines, lambda x: F.lower(x).rlike(PROFESSOR) & ~F.lower(x).rlike(ASSOCIATE) & ~F.lower(x).rlike(ASSISTANT) & _short(x, longest))
    return (
        F.when(t.startswith("prof"), "Professor")
        .when(t.startswith("assistant") | t.startswith("asst"), "Assistant Professor")
        .when(t.startswith("associate") | t.startswith("asso"), "Associate Professor")
        .when(one_word | plain, "Professor")
        .when(has(ASSISTANT), "Assistant Professor")
        .when(has(ASSOCIATE), "Associate Professor")
        .otherwise("Non-Professor")
    )


def key_line(lines: Column, facet: str) -> Column:
    """The first line of at most 20 words with the facet, an institution and a year."""
    return F.get(F.filter(lines, lambda x: _short(x, 20) & F.lower(x).rlike(facet) & x.rlike(INSTITUTION) & x.rlike(YEAR)), 0)


def latest_year(line: Column) -> Column:
    """The highest year of a line."""
    return F.array_max(F.transform(F.regexp_extract_all(line, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int")))


def phd_year(lines: Column) -> Column:
    return latest_year(key_line(lines, PHD))


def phd_school(lines: Column) -> Column:
    """The institution of the PhD line; ``Unknown`` for an acronym or none."""
    found = F.trim(F.regexp_extract(key_line(lines, PHD), r"([A-Za-z ]*(?:University|Institute|College)[A-Za-z ]*)", 1))
    return F.when(F.coalesce(found, F.lit("")) == "", "Unknown").otherwise(found)


def promotion_year(lines: Column) -> Column:
    kept = F.filter(lines, lambda x: ~x.rlike(YEAR_IN_LINK))
    return latest_year(key_line(kept, "professor"))


def blocks(text: Column) -> Column:
    """Groups of lines that stand together, between blank lines; blank ones left out."""
    groups = F.transform(F.split(text, r"\n[ \t]*\n"), lambda g: F.filter(F.split(g, "\n"), lambda x: F.trim(x) != ""))
    return F.filter(groups, lambda g: F.size(g) > 0)


def _first_with(groups: list[Column], facet: str) -> Column:
    """The first piece with the facet, an institution and a year: of single lines first, then of whole groups joined by commas."""
    has = lambda x: F.lower(x).rlike(facet) & x.rlike(INSTITUTION) & x.rlike(YEAR)
    lines = F.concat(*[F.flatten(g) for g in groups])
    joined = F.concat(*[F.transform(g, lambda x: F.array_join(x, ", ")) for g in groups])
    return F.coalesce(F.get(F.filter(lines, has), 0), F.get(F.filter(joined, has), 0))


def _dated(groups: Column) -> Column:
    """Groups with a year that is no part of a link."""
    return F.filter(groups, lambda g: F.exists(g, lambda x: x.rlike(YEAR)) & ~F.exists(g, lambda x: x.rlike(YEAR_IN_LINK)))


def key_info(text: Column) -> tuple[Column, Column, Column]:
    """PhD year, PhD school and promotion year by the cascade over lines, then over groups of lines.

    Groups about a PhD that name an institution come before groups about a PhD with a year;
    without a group of the first kind nothing is said of the PhD.  School: ``Unknown`` for an acronym.
    """
    groups = blocks(text)
    phd = F.filter(groups, lambda g: F.exists(g, lambda x: F.lower(x).rlike(PHD)))
    placed = F.filter(phd, lambda g: F.exists(g, lambda x: F.lower(x).rlike("university|institute|college") | x.rlike("(?i)[A-Z][A-Z]{2,4}")))
    told = F.when(F.size(placed) > 0, _first_with([placed, _dated(phd)], PHD))
    professor = _dated(F.filter(groups, lambda g: F.exists(g, lambda x: F.lower(x).contains("professor"))))
    promoted = _first_with([professor], "professor")
    school = F.trim(F.regexp_extract(told, INSTITUTION_NAME, 1))
    return latest_year(told), F.when(F.coalesce(school, F.lit("")) == "", "Unknown").otherwise(school), latest_year(promoted)


def main_lines(lines: Column) -> Column:
    """Lines of at least 20 words that are neither references nor about a PhD."""
    return F.array_distinct(F.filter(lines, lambda x: (F.size(F.split(x, " ")) >= 20) & ~x.rlike(REFERENCE) & ~F.lower(x).rlike(PHD)))


def sensible(phd: Column, promotion: Column, this_year: int) -> tuple[Column, Column]:
    """Years in the future, and PhD years after the promotion, become null."""
    promoted = F.when(promotion <= this_year, promotion)
    return F.when((phd <= this_year) & ~F.coalesce(phd > promoted, F.lit(False)), phd), promoted


def neighbours(lines: Column, facet: str, longest: int = 10) -> Column:
    """Lines with a facet together with the lines before and after them."""
    near = F.transform(lines, lambda x, i: F.when((F.lower(x).rlike(facet) & ~F.lower(x).contains("student") & _short(x, longest)), F.slice(lines, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3))).otherwise(F.slice(lines, 1, 0)))
    return F.array_distinct(F.flatten(near))


def first_year(lines: Column) -> Column:
    """The first year of lines that speak of no student."""
    kept = F.filter(lines, lambda x: ~F.lower(x).contains("student"))
    return F.get(F.flatten(F.transform(kept, lambda x: F.regexp_extract_all(x, F.lit(YEAR), F.lit(0)))), 0).cast("int")


def resume_year(lines: Column, facet: str, longest: int = 10) -> Column:
    """Year from short lines with the facet, else from their neighbours."""
    own = F.filter(lines, lambda x: F.lower(x).rlike(facet) & ~F.lower(x).contains("student") & _short(x, longest))
    return F.coalesce(first_year(own), first_year(neighbours(lines, facet, longest)))


def unknown_count(*values: Column) -> Column:
    """How many of the values are ``Unknown``."""
    return F.size(F.filter(F.array(*values), lambda x: x == "Unknown"))


def is_personal(lines: Column, depth: Column, name_in_title: Column) -> Column:
    """Whether a page below the first level is a person's (C4)."""
    heading = F.exists(lines, lambda x: (F.lower(x).contains("publicati") | F.lower(x).contains("interest") | F.lower(x).contains("biograp")) & _short(x, 5))
    return (depth > 1) & (name_in_title | heading)


# Words that no name of a person or an organisation holds.
NO_ENTITY = ["library", "university", "department", "faculty", "menu", "copyright", "college", "staff", "student", "lab", "footer", "impact", "header", "view", "profile", "human", "resources", "hub", "scholar"]
# Words that tell an organisation from a person.
ORGANISATION = r"(?i)univ|insti|college|school|academy|hospital|laborator|centre|center|society|council"
_RUN = r"(?U)\p{Lu}[\p{L}.’'-]*(?: (?:(?:of|for|and|the|de|du|von) )*\p{Lu}[\p{L}.’'-]*)+"


def named_entities(c: Column, organisations: bool = True, only_organisations: bool = False) -> Column:
    """Runs of words with a capital, by rule where no model is given (M11); those with a filter word left out."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_RUN), F.lit(0))
    if only_organisations:  # names of schools hold filter words themselves, so these are not applied here
        return F.filter(runs, lambda x: x.rlike(ORGANISATION))
    kept = F.filter(runs, lambda x: ~contains_any(x, NO_ENTITY))
    return kept if organisations else F.filter(kept, lambda x: ~x.rlike(ORGANISATION))


def resolved_name(link_title: Column, page_title: Column, headings: Column) -> Column:
    """Name of a page's person: the link's title or the page's, if an entity is in it, else the first one in a heading."""
    found = F.get(F.flatten(F.transform(headings, lambda h: named_entities(h))), 0)
    return F.when(F.size(named_entities(link_title)) > 0, link_title).when(F.size(named_entities(page_title)) > 0, page_title).otherwise(F.coalesce(found, F.lit("Unknown")))
