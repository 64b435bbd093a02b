"""Steps of the crawl over saved pages: answers, menus, departments, people, accepted profiles.

Every step is a function from the rows that arrive to the rows that go on; a crawl is
these steps joined to a table of saved pages, level by level.  Defined results: null links
go nowhere, null texts are empty; repeated rows stay repeated unless a step says otherwise;
empty tables give empty results; other columns stay where a step returns its input rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarforge.functions import extract, fuzzy, urls
from scholarforge.functions import text as X
from scholarforge.operators import crawl
from scholarforge.runtime import stage


def answered(requests: DataFrame, pages: DataFrame, link: str = "link", status: str = "status", url: str = "url") -> DataFrame:
    """Requests with the page that answered and ``redirected``; missing pages and redirects to filtered links are dropped.

    ``pages`` has ``link`` (as asked for), ``status`` and ``url`` (where the answer came from).
    """
    got = requests.join(pages.select(F.col(link).alias("__asked"), F.col(status).alias("__status"), F.col(url).alias("url")), F.col(link) == F.col("__asked"))
    got = got.where("__status != 404").withColumn("redirected", F.col("url") != F.col(link)).drop("__asked", "__status")
    return got.where(~(F.col("redirected") & urls.has_keyword(F.col("url"))))


def target_scores(menu: DataFrame, text: str, people_only: bool = False) -> DataFrame:
    """``text, kind, target, score``: every distinct text against every target (J11); the number of targets is fixed."""
    targets = [("PEOPLE", t) for t in crawl.PEOPLE_TARGETS] + ([] if people_only else [("DEPARTMENT", t) for t in crawl.DEPARTMENT_TARGETS])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [crawl.target_score(x, [t]) for _, t in targets])

    known = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("target")) for k, t in targets])
    distinct = menu.where(F.col(text).isNotNull()).select(text).distinct().select(text, score(F.col(text)).alias("s"))
    each = distinct.select(text, F.explode(F.arrays_zip(known.alias("t"), F.col("s"))).alias("x"))
    return each.select(text, F.col("x.t.kind").alias("kind"), F.col("x.t.target").alias("target"), F.col("x.s").alias("score"))


def menu_links(menu: DataFrame, scores: DataFrame, page: str, link: str, text: str, least: float = crawl.GENERAL, top: int = 3) -> DataFrame:
    """``page, link, text, kind, score`` of the links a page's menu leads to.

    Of a page's entries the ``top`` best for every target are taken, the best of them for
    every link, those of ``least`` and more, without links that hold a keyword.  A page has
    no more entries than a page can hold, so its window is small; pages are spread by key.
    """
    entries = menu.where(F.col(link).isNotNull() & F.col(text).isNotNull()).select(page, link, text).distinct()
    rated = entries.join(scores, text)
    first = Window.partitionBy(page, "target").orderBy(F.desc("score"), link, text)
    best = Window.partitionBy(page, link).orderBy(F.desc("score"), F.desc("kind"), "target", text)
    taken = rated.withColumn("__i", F.row_number().over(first)).where(F.col("__i") <= top)
    taken = taken.withColumn("__j", F.row_number().over(best)).where("__j = 1").where(F.col("score") >= least)
    return taken.where(~urls.has_keyword(F.col(link), urls.NAVIGATION_WORDS, urls.NAVIGATION_STRINGS)).select(page, link, text, "kind", "score")


def menu_step(menu: DataFrame, anchors: DataFrame, page: str, link: str, text: str, people_only: bool = False) -> DataFrame:
    """:func:`menu_links` of the menu, or of all of a page's anchors where its menu leads nowhere."""
    least = crawl.PEOPLE_ONLY if people_only else crawl.GENERAL
    all_texts = menu.select(text).unionByName(anchors.select(text))
    scores = stage(target_scores(all_texts, text, people_only), "target-scores")
    own = stage(menu_links(menu, scores, page, link, text, least), "menu-links")
    rest = anchors.join(own.select(page).distinct(), page, "left_anti")
    return own.unionByName(menu_links(rest, scores, page, link, text, least))


def department_step(found: DataFrame, page: str, link: str, depth: str) -> DataFrame:
    """Unique links of a department's page with ``step`` and ``next_depth``.

    A link on another host, or on a lower level of the path, starts a menu anew (depth -1);
    any other is a page of the department, at the same depth.  Files and keywords go nowhere.
    """
    here, there = F.col(page), F.col(link)
    back = (urls.netloc(here) != urls.netloc(there)) | (urls.level(there) < urls.level(here))
    kept = found.where(there.isNotNull() & here.isNotNull() & ~urls.is_file(there) & ~urls.has_keyword(there))
    return kept.withColumn("step", F.when(back, "menu").otherwise("department")).withColumn("next_depth", F.when(back, F.lit(-1)).otherwise(F.col(depth)).cast("int"))


def unlike_before(title: Column, before: Column) -> Column:
    """A page's title without what it has in common with the title of the page before; only letters, dots and dashes."""
    shared = fuzzy.longest_common(title, before)
    return F.regexp_replace(F.when(shared != "", F.replace(title, shared, F.lit(""))).otherwise(title), r"[^ .A-Za-z\-]", " ")


def is_person_page(link_title: Column, page_title: Column, title_before: Column, lines: Column, depth: Column) -> Column:
    """Whether a page is a person's (C4): deeper than 1, and a name in the link's title or in the
    page's own part of its title, or a heading of publications, interests or biography."""
    own = unlike_before(F.coalesce(page_title, F.lit("")), F.coalesce(title_before, F.lit("")))
    named = (F.size(extract.named_entities(link_title, organisations=False)) > 0) | (F.size(extract.named_entities(own, organisations=False)) > 0)
    return extract.is_personal(lines, depth, named)


def falls_back(current: Column, previous: Column, fell_back: Column) -> Column:
    """Whether a shallow page on another path returns to the menu, once."""
    return urls.leads_elsewhere(current, previous) & ~F.coalesce(fell_back, F.lit(False))


def accepted(hits: DataFrame, start: str, order: str, link: str, threshold: int = 10) -> DataFrame:
    """Profile pages that are taken (A14, C5): the first ``threshold`` - 1 of a start, then those that fit the pattern of these."""
    numbered = stage(crawl.counted(hits, start, order, threshold), "hits")
    learnt = crawl.patterns(numbered.where(~F.col("needs_match")), start, link).select(F.col(start).alias("__s"), "netlocs", "paths")
    both = numbered.join(learnt, numbered[start].eqNullSafe(F.col("__s")), "left")
    fits = F.coalesce(crawl.matches(F.col(link), F.col("netlocs"), F.col("paths")), F.lit(False))
    return both.where(~F.col("needs_match") | fits).drop("__s", "netlocs", "paths")


def without_menu(anchors: DataFrame, menu: DataFrame, page: str, link: str, text: str) -> DataFrame:
    """Anchors whose text or link the page's menu lacks (J14), by two equi-joins in place of one join with an OR."""
    texts = menu.select(F.col(page).alias("__p"), F.col(text).alias("__t")).distinct().withColumn("__in_text", F.lit(1))
    links = menu.select(F.col(page).alias("__q"), F.col(link).alias("__l")).distinct().withColumn("__in_link", F.lit(1))
    both = anchors.join(texts, (F.col(page) == F.col("__p")) & (F.col(text) == F.col("__t")), "left").join(links, (F.col(page) == F.col("__q")) & (F.col(link) == F.col("__l")), "left")
    return both.where("__in_text is null or __in_link is null").select(*anchors.columns)


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both with one row a key; those of ``right`` win (U4). Of rows repeated within a side the least one is taken."""
    rest = [c for c in left.columns if c != key]
    sides = left.select(key, *rest, F.lit(1).alias("__side")).unionByName(right.select(key, *rest, F.lit(0).alias("__side")))
    return sides.groupBy(key).agg(F.min(F.struct("__side", *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def anchor_names(anchors: DataFrame, link: str, text: str, first_texts: DataFrame) -> DataFrame:
    """``name`` of every anchor (H3, J13, X20): its text, else the first text known for its link, else a label made of the link.

    ``first_texts`` has ``link`` and ``first_text``.
    """
    known = first_texts.select(F.col(link).alias("__l"), "first_text")
    both = anchors.join(known, F.col(link) == F.col("__l"), "left").drop("__l")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return both.withColumn("name", F.when(~blank(F.col(text)), X.collapse(F.col(text))).when(~blank(X.without_number(F.col("first_text"), any_number=False)), F.col("first_text")).otherwise(urls.link_label(F.col(link))))


def known_words(titles: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """``normalised``: a title that is a word of the vocabulary as it is, else without acronyms and pieces without letters."""
    words = vocabulary.select(F.lower("word").alias("__w")).distinct().withColumn("__known", F.lit(True))
    pieces = F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(text, "[A-Z][A-Z]+", ""), r"\s+", " ")), " "), lambda w: w.rlike("[A-Za-z]"))
    both = titles.join(words, F.lower(text) == F.col("__w"), "left")
    return both.withColumn("normalised", F.when(F.col("__known"), F.col(text)).otherwise(F.array_join(pieces, " "))).drop("__w", "__known")


def professors(profiles: DataFrame, position: str = "position") -> DataFrame:
    """Pages of professors of any kind."""
    return profiles.where(F.coalesce(F.col(position), F.lit("Non-Professor")) != "Non-Professor")


def cv_schools(pages: DataFrame, key: str, lines: str, colleges: list[str], longest: int = 10) -> DataFrame:
    """``key, phd_school`` by the rules for resumes (C9): organisations in short lines about a PhD, those that look like
    a school (J5), the most frequent, first on ties (A10), by the list's spelling where it is close (J4).

    Lines before and after are looked at where the lines themselves name none.  Distinct
    names are compared with the list, not rows; the list is the caller's and bounded.
    """
    own = F.filter(F.col(lines), lambda x: F.lower(x).rlike(extract.PHD) & ~F.lower(x).contains("student") & (F.size(F.split(x, " ")) <= longest))
    names = lambda ls, clean: F.flatten(F.transform(ls, lambda x: extract.named_entities(clean(x), only_organisations=True)))
    first = pages.select(key, names(own, X.without_acronym).alias("__a"), names(extract.neighbours(F.col(lines), extract.PHD, longest), X.without_brackets).alias("__b"))
    each = first.select(key, F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("__a").alias("n")), F.struct(F.lit(1).alias("level"), F.col("__b").alias("n")))).alias("x"))
    each = stage(each.select(key, "x.level", F.posexplode("x.n").alias("at", "name")), "schools")

    @F.pandas_udf(T.BooleanType())
    def looks_like_school(found: pd.Series) -> pd.Series:
        lower = [c.lower() for c in colleges]
        return found.map(lambda n: "univ" in n or "insti" in n or any(fuzzy.ratio(c, n.lower()) >= 0.5 for c in lower))

    kept = stage(each.select("name").distinct().where(looks_like_school("name")).select("name", fuzzy.best_of(colleges, 0.6, "sequence")(F.col("name")).alias("listed")), "kept")
    counts = each.join(kept, "name").groupBy(key, "level", "name", "listed").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = counts.groupBy(key).agg(F.min(F.struct("level", (-F.col("n")).alias("n"), "at", F.coalesce("listed", "name").alias("school"))).alias("b"))
    return pages.select(key).join(best.select(key, F.col("b.school").alias("phd_school")), key, "left").fillna("Unknown", ["phd_school"])
