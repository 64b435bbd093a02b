"""Expressions on links."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that, as a whole word of a link, mark it as no page of a person.
WORDS = ["publication", "publications", "paper", "search", "news", "event", "events", "calendar", "map", "student", "lab", "lib", "library"]
# Strings that do so anywhere in a link.
STRINGS = ["login", "logout", "publication", "news", "wiki", "lab", "resource", "event", "calendar", "map", "article", "blog", "student", "library"]
# The same for navigation.
NAVIGATION_WORDS = ["publication", "publications", "paper", "search", "news", "event", "events", "calendar", "map", "student"]
NAVIGATION_STRINGS = ["login", "logout", "publication", "news", "wiki", "event", "calendar", "map", "article", "blog", "student"]
# Extensions of files that are no pages.
EXTENSIONS = "7z avi bmp bz2 css csv doc docx eps exe flv gif gz ico iso jpeg jpg js m4a mov mp3 mp4 mpeg mpg ods odt ogg pdf png pps ppt pptx ps rar rss svg swf tar tif tiff txt wav webm wma wmv xls xlsx zip".split()
# Suffixes of two labels under which domains are registered.
SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "org.uk", "edu.au", "com.au", "edu.sg", "com.sg", "edu.hk", "ac.jp", "co.jp", "ac.nz", "co.nz", "edu.cn", "com.cn", "ac.in", "co.in", "com.br", "edu.br"]


def netloc(link: Column) -> Column:
    """Host with port, as written (X11)."""
    return F.regexp_extract(link, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def host(link: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(link), r"^.*@", ""), r":\d*$", ""))


def path(link: Column) -> Column:
    return F.regexp_extract(link, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_parts(link: Column) -> Column:
    """Non-empty parts of the path (X11)."""
    return F.filter(F.split(path(link), "/"), lambda x: x != "")


def level(link: Column) -> Column:
    return F.size(path_parts(link))


def parent_path(link: Column) -> Column:
    """The path without its last part, joined by slashes."""
    parts = path_parts(link)
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")).otherwise("")


def registered_domain(link: Column) -> Column:
    """The last two labels of the host, three below a suffix of two."""
    labels = F.split(host(link), r"\.")
    n = F.size(labels)
    suffix = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    keep = F.when(suffix.isin(*SUFFIXES), 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), keep), ".")


def has_keyword(link: Column, words: list[str] = WORDS, strings: list[str] = STRINGS) -> Column:
    """Whether a word of the link is one of ``words`` or the link holds one of ``strings``."""
    tokens = F.regexp_extract_all(F.lower(link), F.lit("[a-z]+"), F.lit(0))
    return F.arrays_overlap(tokens, F.lit(words)) | F.lower(link).rlike("|".join(strings))


def is_file(link: Column) -> Column:
    """Whether the path ends like a file that is no page."""
    return F.lower(path(link)).rlike(r"\.(" + "|".join(EXTENSIONS) + ")$")


def has_fragment(link: Column) -> Column:
    return link.contains("#")


def is_resume(link: Column) -> Column:
    """A PDF whose link speaks of a curriculum vitae."""
    return link.contains(".pdf") & (link.contains("cv") | link.contains("resum") | link.contains("vitam"))


def without_slash(link: Column) -> Column:
    """The link without one trailing slash."""
    return F.regexp_replace(link, "/$", "")


def leads_elsewhere(current: Column, previous: Column) -> Column:
    """Whether the paths differ in a part that both have."""
    pairs = F.arrays_zip(path_parts(current).alias("c"), path_parts(previous).alias("p"))
    return F.exists(pairs, lambda x: x["c"].isNotNull() & x["p"].isNotNull() & (x["c"] != x["p"]))


def link_label(link: Column) -> Column:
    """A label made from a link: words of path and query, extensions dropped, first occurrences kept."""
    rest = F.regexp_replace(F.regexp_replace(link, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    tokens = F.filter(F.split(F.regexp_replace(rest, r"[!-/:-@\[-`{-~]+", " "), " "), lambda t: (t != "") & ~t.isin(*EXTENSIONS, "htm", "html"))
    return F.array_join(F.array_distinct(tokens), " ")


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    """Relative links made absolute."""
    return pd.Series([urljoin(b, x) if b is not None and x is not None else None for b, x in zip(base, link)], dtype=object)
