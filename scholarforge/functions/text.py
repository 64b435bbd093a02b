"""String expressions on columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = r"(?:19|20)[0-9]{2}"


def collapse(c: Column) -> Column:
    """White space, also Unicode's, as single blanks; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def without_space(c: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first and the rest lower case, as Python's ``str.title``."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.replace(F.upper(F.substring(x, 1, 1)), F.lit("SS"), F.lit("Ss")), F.lower(F.substr(x, F.lit(2))))), "")


def capitalised(c: Column) -> Column:
    """First letter upper, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def calm_capitals(c: Column) -> Column:
    """Words with two capitals in a row capitalised, words that are only punctuation dropped."""
    words = F.filter(F.split(collapse(c), " "), lambda w: (w != "") & ~w.rlike(r"^[!-/:-@\[-`{-~]+$"))
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("[A-Z][A-Z]+"), capitalised(w)).otherwise(w)), " ")


def truncated(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut at a word's end and marked with three dots."""
    head = F.regexp_extract(F.substring(c, 1, n - 3), r"(?s)^(.*)\s", 1)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.when(head == "", F.substring(c, 1, n - 3)).otherwise(head), F.lit("...")))


def cut(c: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(c, 1, n)


def word_count(c: Column) -> Column:
    """Pieces between blanks, empty ones included."""
    return F.size(F.split(c, " "))


def without_number(c: Column, any_number: bool = True) -> Column:
    """The suffix of a repeated label, ``(3)``, removed; of one digit 1 to 9 only if not ``any_number``."""
    return F.regexp_replace(c, r"\(\d+\)" if any_number else r"\([1-9]+\)", "")


def person_name(c: Column) -> Column:
    """Leading title dropped and two further words kept, else three words; blank becomes ``Unknown``."""
    words = F.split(without_number(c), " ")
    titled = F.lower(words[0]).isin("prof.", "dr.", "prof", "dr", "professor")
    kept = F.when(titled, F.slice(words, 2, 2)).otherwise(F.slice(words, 1, 3))
    return F.when(F.trim(c) == "", F.lit("Unknown")).otherwise(F.array_join(kept, " "))


def without_acronym(c: Column) -> Column:
    """Acronyms in brackets replaced by a blank."""
    return F.regexp_replace(c, r"\([A-Z][A-Z]+\)", " ")


def without_brackets(c: Column) -> Column:
    """Whatever stands in brackets replaced by a blank."""
    return F.regexp_replace(c, r"\(.+\)", " ")


def years(c: Column) -> Column:
    """All years from 1900 to 2099, as numbers."""
    return F.transform(F.regexp_extract_all(c, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int"))


def year(c: Column) -> Column:
    """The first year in a text, null if there is none."""
    return F.get(years(c), 0)


def rank_number(c: Column) -> Column:
    """``=10`` as 10."""
    return F.element_at(F.split(c, "="), -1).try_cast("int")


def cleaned_for_topics(c: Column, stop_words: list[str]) -> Column:
    """Lower-case words of letters, without stop words."""
    words = F.split(collapse(F.regexp_replace(F.lower(collapse(c)), r"[^a-zA-Z\s]+", "")), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*stop_words))


def list_items_joined(c: Column) -> Column:
    """Lines without leading brackets, digits, dots and dashes, joined by full stops."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^[()0-9.\-]+", "")), ". ")


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether the text holds any of the words as a substring, in lower case."""
    return F.coalesce(F.lower(c).rlike("|".join(_escape(w) for w in words)), F.lit(False)) if words else F.lit(False)


def _escape(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in word)
