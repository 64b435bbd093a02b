"""The crawl as bounded dataflow over saved pages: frontier, routing, patterns, counters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarforge.functions import urls
from scholarforge.functions.fuzzy import ratio
from scholarforge.runtime import stage

# Phrases that links to departments and to people are compared with.
DEPARTMENT_TARGETS = ["area of study", "department", "department of", "school", "school of", "academic unit", "school & department", "major and minor", "major", "faculty & department", "academics", "departments and programs"]
PEOPLE_TARGETS = ["academic staff", "faculty", "faculty staff", "faculty people", "faculty directory", "our people", "people", "teaching faculty", "courtesy faculty", "adjunct faculty", "professors", "staff list", "staff directory", "teaching staff", "emeritus", "faculty profiles", "faculty list", "staff"]
# Thresholds of similarity, in general and where only people are wanted.
GENERAL, PEOPLE_ONLY = 0.7, 0.85
MODES = ("TEST", "PRIORITIZED", "SELECTED", "GENERIC", "PARTICULAR")
PAGE_CAP = 50


def start_rows(departments: DataFrame, mode: str, universities: list[str] | None = None, department: str | None = None, link: str | None = None, seed: int = 1) -> DataFrame:
    """Rows of the first frontier: link, title, university_name, tag, depth 0.

    ``SELECTED`` keeps the given universities and department, and raises if one of
    them is unknown (J2); ``GENERIC`` shuffles; ``PARTICULAR`` starts at one link.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rows = departments.select(F.col("url").alias("link"), "title", F.col("school_name").alias("university_name"), F.coalesce("tag", F.lit("None")).alias("tag"))
    if mode == "SELECTED":
        spark = departments.sparkSession
        asked = spark.createDataFrame([(u,) for u in universities or []], "university_name string")
        missing = asked.join(rows.select("university_name").distinct(), "university_name", "left_anti").collect()  # of the names asked for
        if missing or not rows.where(F.col("title") == department).limit(1).count():
            raise ValueError(f"unknown: {[r[0] for r in missing] or department}")
        rows = rows.join(F.broadcast(asked), "university_name", "left_semi").where(F.col("title") == department).select("link", "title", "university_name", "tag")
    elif mode == "PARTICULAR":
        rows = rows.where(urls.registered_domain(F.col("link")) == urls.registered_domain(F.lit(link))).select(F.lit(link).alias("link"), "title", "university_name", "tag").limit(1)
    elif mode == "TEST":
        rows = rows.orderBy("link").limit(1)
    elif mode == "GENERIC":
        rows = rows.orderBy(F.rand(seed))
    return rows.withColumn("depth", F.lit(0))


def followable(links: DataFrame, link: str = "link") -> DataFrame:
    """Links that are pages, hold no keyword and no fragment."""
    c = F.col(link)
    return links.where(c.isNotNull() & ~urls.has_keyword(c) & ~urls.is_file(c) & ~urls.has_fragment(c))


def same_site(links: DataFrame, allowed: DataFrame, link: str = "link", site: str = "url") -> DataFrame:
    """Links under a registered domain of ``allowed``."""
    domains = allowed.select(urls.registered_domain(F.col(site)).alias("__d")).distinct()
    return links.withColumn("__d", urls.registered_domain(F.col(link))).join(domains, "__d", "left_semi").drop("__d")


def first_requests(frontier: DataFrame, key: str = "frontier_id") -> DataFrame:
    """The first row of every link, trailing slash apart."""
    rest = [c for c in frontier.columns if c != key]
    once = frontier.withColumn("__l", urls.without_slash(F.col("link"))).groupBy("__l").agg(F.min_by(F.struct(key, *rest), key).alias("r"))
    return once.select("r.*").select(*frontier.columns)


def reach(starts: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """``link, depth`` of all links within ``depth`` steps of the starts: one join a level, every level staged.

    Only the new links of a level travel; those seen before are removed by an anti join.
    """
    level = stage(starts.select("link").distinct().withColumn("depth", F.lit(0)), "level0")
    seen = level
    for d in range(1, depth + 1):
        nxt = edges.select(F.col("previous_link").alias("link"), F.col("link").alias("__next")).join(level.select("link"), "link").select(F.col("__next").alias("link")).distinct()
        level = stage(nxt.join(seen.select("link"), "link", "left_anti").withColumn("depth", F.lit(d)), f"level{d}")
        seen = seen.unionByName(level)
    return seen


def numbered(links: DataFrame, page: list[str], text: str, order: str, into: str = "label") -> DataFrame:
    """Repeated texts of a page as ``t(1)``, ``t(2)``; others as they are."""
    group = Window.partitionBy(*page, text)
    n, i = F.count("*").over(group), F.row_number().over(group.orderBy(order))
    return links.withColumn(into, F.when(n > 1, F.concat(F.col(text), F.lit("("), i, F.lit(")"))).otherwise(F.col(text)))


def new_on_page(current: DataFrame, ancestors: DataFrame, page: str = "page") -> DataFrame:
    """Anchors whose link (trailing slash apart) and text occur on no ancestor page.

    ``current`` has page, link, text; ``ancestors`` the same for the pages above it.
    A page that has nothing new keeps all its anchors.
    """
    here = current.withColumn("__l", urls.without_slash(F.col("link")))
    links = ancestors.select(page, urls.without_slash(F.col("link")).alias("__l")).distinct()
    texts = ancestors.select(page, "text").distinct()
    fresh = here.join(links, [page, "__l"], "left_anti").join(texts, [page, "text"], "left_anti").select(page, "link", "text")
    bare = current.select(page).distinct().join(fresh.select(page).distinct(), page, "left_anti")
    return fresh.unionByName(current.join(bare, page, "left_semi").select(page, "link", "text"))


def patterns(pages: DataFrame, start: str, link: str = "link", n: int = 2) -> DataFrame:
    """``start, netlocs, paths``: the ``n`` most frequent hosts and all parent paths of a start's profile links."""
    parts = pages.select(F.col(start), urls.netloc(F.col(link)).alias("netloc"), urls.parent_path(F.col(link)).alias("path"))
    counts = parts.groupBy(start, "netloc").count()
    place = Window.partitionBy(start).orderBy(F.desc("count"), "netloc")
    hosts = counts.withColumn("i", F.row_number().over(place)).where(F.col("i") <= n).groupBy(start).agg(F.array_sort(F.collect_list(F.struct("i", "netloc"))).alias("h"))
    paths = parts.where("path != ''").groupBy(start).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return hosts.join(paths, start, "left").select(start, F.col("h.netloc").alias("netlocs"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def matches(link: Column, netlocs: Column, paths: Column) -> Column:
    """Whether a link fits a pattern: its host, and a path that is part of its parent path."""
    parent = urls.parent_path(link)
    return F.array_contains(netlocs, urls.netloc(link)) & F.exists(paths, lambda p: parent.contains(p))


def counted(hits: DataFrame, start: str, order: str, threshold: int = 10) -> DataFrame:
    """``hit_no`` of every profile page of a start, and whether the start's pattern is in force for it."""
    no = F.row_number().over(Window.partitionBy(start).orderBy(order))
    return hits.withColumn("hit_no", no).withColumn("needs_match", F.col("hit_no") >= threshold)


def _words(text: str) -> str:
    return " ".join(re.sub(r"[^a-z&]+", " ", re.sub(r"\([1-9]+\)", "", (text or "").lower())).split())


def _semantic(a: str, b: str) -> float:
    """Default similarity of meaning: overlap of words, stems of four letters counting as equal."""
    x, y = {w[:4] for w in a.split()}, {w[:4] for w in b.split()}
    return len(x & y) / len(x | y) if x | y else 0.0


def target_score(text: str, targets: list[str], semantic=_semantic, weight: float = 0.8) -> float:
    """Best similarity of a menu text with any target: sequence ratio if 0.8 or more, else blended with meaning."""
    plain = _words(text)
    best = 0.0
    for t in targets:
        seq = ratio(plain, t)
        best = max(best, seq if seq >= 0.8 else weight * semantic(plain, t) + (1 - weight) * seq)
    return best


def routed(menu: DataFrame, text: str = "title", people_only: bool = False) -> DataFrame:
    """``menu`` with ``people_score``, ``department_score`` and ``route``.

    Distinct texts are scored, not rows.
    """
    schema = T.StructType([T.StructField("people_score", T.DoubleType()), T.StructField("department_score", T.DoubleType())])

    @F.pandas_udf(schema)
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"people_score": [target_score(t, PEOPLE_TARGETS) for t in texts], "department_score": [target_score(t, DEPARTMENT_TARGETS) for t in texts]})

    distinct = menu.where(F.col(text).isNotNull()).groupBy(text).count().select(text, score(F.col(text)).alias("s")).select(text, "s.*")
    least = PEOPLE_ONLY if people_only else GENERAL
    out = menu.join(stage(distinct, "scores"), text, "left")
    people = F.col("people_score") >= least
    department = F.lit(False) if people_only else F.col("department_score") >= least
    return out.withColumn("route", F.when(people & (F.col("people_score") >= F.col("department_score")), "PEOPLE").when(department, "DEPARTMENT").when(people, "PEOPLE"))


def best_links(scores: DataFrame, page: str, link: str, score: str) -> DataFrame:
    """The best-scored row of every link of a page."""
    place = Window.partitionBy(page, link).orderBy(F.desc(score), "title")
    return scores.withColumn("__i", F.row_number().over(place)).where("__i = 1").drop("__i")


def expanded_rows(listing: DataFrame) -> DataFrame:
    """Rows of a department list: where ``XPATH`` is ``-``, one per remark (C11); rows without XPATH are dropped."""
    kept = listing.na.drop(subset=["XPATH"])
    direct = kept.where("XPATH = '-'").select("Name", F.explode(F.split("Remark", "; ")).alias("link"))
    return direct.unionByName(kept.where("XPATH != '-'").select("Name", F.col("URL").alias("link")))


def letter_pages(link: str) -> DataFrame:
    """Expression of a listing's pages A to Z (C11)."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.concat(F.lit(link), F.chr(i + 65))))


def with_fallback(requests: DataFrame, pages: DataFrame, link_count: str = "n_links") -> DataFrame:
    """Pages of the requests; where a page has no links, the page at the same address with ``xml`` for ``html``."""
    found = requests.join(pages.select(F.col("link"), F.col(link_count).alias("__n")), "link", "left")
    other = pages.select(F.col("link").alias("__alt"), F.col(link_count).alias("__m"))
    both = found.withColumn("__alt", F.regexp_replace("link", "html", "xml")).join(other, "__alt", "left")
    return both.withColumn("source", F.when(F.coalesce("__n", F.lit(0)) > 0, F.col("link")).otherwise(F.when(F.col("__m") > 0, F.col("__alt")))).drop("__n", "__m", "__alt")
