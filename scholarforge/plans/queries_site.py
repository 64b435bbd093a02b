"""Queries of the crawl's steps, of menus, of recognising and reading pages, over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarforge.functions import extract, fuzzy, urls
from scholarforge.operators import crawl, navigation
from scholarforge.plans.queries_crawl import _FIRST_SEEN, _L, _NAV_KEY, _NETLOC, _PARENT, _PARTS, _PATH, _PEOPLE_KEY, _departments, _documents, _frontier, _position, _profiles, _RUNS, _universities
from scholarforge.plans.queries_store import _benchmarks
from scholarforge.runtime import stage

_START = "original_start.url"


def c_arrived(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that a saved page answers, redirected where the address has another form."""
    f = _frontier(spark, sf)
    saved = f.where("previous_link is not null").select(F.col("previous_link").alias("link")).distinct().withColumn("saved", F.lit(True))
    asked = f.where("link is not null").select("link").distinct()
    pages = asked.join(saved, "link", "left").select("link", F.when(F.col("saved"), 200).otherwise(404).alias("status"), urls.without_slash(F.col("link")).alias("url"))
    return navigation.answered(f.where("link is not null").select("frontier_id", "link"), pages).select("frontier_id", "url", "redirected")


def c_menu_routes(spark, sf):
    """Where the menus of the start pages lead, all anchors where a menu leads nowhere."""
    f = _frontier(spark, sf).select(F.col(_START).alias("page"), "link", F.col("title").alias("text"), "is_department")
    return navigation.menu_step(f.where("is_department").select("page", "link", "text"), f.select("page", "link", "text"), "page", "link", "text").select("page", "link", "text", "kind", F.round("score", 6).alias("score"))


def c_menu_overlap(spark, sf):
    """The same choice of links by the words that a title shares with a target."""
    f = _frontier(spark, sf).select(F.col(_START).alias("page"), "link", F.col("title").alias("text"))
    known = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("target")) for k, ts in (("PEOPLE", crawl.PEOPLE_TARGETS), ("DEPARTMENT", crawl.DEPARTMENT_TARGETS)) for t in ts])
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    each = f.where("text is not null").select("text").distinct().select("text", F.explode(known).alias("x")).select("text", "x.kind", "x.target")
    scores = each.withColumn("score", F.size(F.array_intersect(words(F.col("text")), words(F.col("target")))) / F.size(F.array_union(words(F.col("text")), words(F.col("target")))))
    return navigation.menu_links(f, scores, "page", "link", "text", least=0.3).select("page", "link", "text", "kind", F.round("score", 6).alias("score"))


def c_department_step(spark, sf):
    """Links of a page: back to a menu, or on in the department."""
    f = _frontier(spark, sf).select("frontier_id", "previous_link", "link", "depth")
    return navigation.department_step(f, "previous_link", "link", "depth").select("frontier_id", "step", "next_depth")


def c_envelope(spark, sf):
    """What goes along with a request: tag, start, previous page, depth + 1."""
    return _frontier(spark, sf).where("depth < 4").select("frontier_id", F.col("link").alias("previous_link"), "university_name", F.col(_START).alias("start"), F.coalesce("tag", F.lit("None")).alias("tag"), (F.col("depth") + 1).alias("depth"))


def c_accepted(spark, sf):
    """Profile pages that are taken: nine a start, then those that fit their pattern."""
    hits = _frontier(spark, sf).where(F.col("link").rlike("/(people|staff|faculty)/")).select("frontier_id", F.col(_START).alias("start"), "link")
    return navigation.accepted(hits, "start", "frontier_id", "link").select("frontier_id", "hit_no")


def c_fall_back(spark, sf):
    """Shallow pages on another path that return to the menu, once (C4)."""
    f = _frontier(spark, sf).where("depth <= 1 and link is not null and previous_link is not null")
    return f.where(navigation.falls_back(F.col("link"), F.col("previous_link"), F.col("fall_back"))).select("frontier_id")


def c_menu_names(spark, sf):
    """Names of anchors with empty texts: another text of the link, else a label made of it."""
    f = _frontier(spark, sf).where("link is not null").select("frontier_id", "link", "title")
    first = f.where("trim(title) != ''").groupBy("link").agg(F.min_by("title", "frontier_id").alias("first_text"))
    return navigation.anchor_names(f, "link", "title", first).select("frontier_id", "name")


def j_without_menu(spark, sf):
    """Anchors below the first level that the first level lacks."""
    f = _frontier(spark, sf).select("frontier_id", F.col(_START).alias("page"), "link", F.col("title").alias("text"), "depth")
    return navigation.without_menu(f.where("depth > 1").drop("depth"), f.where("depth = 1"), "page", "link", "text").select("frontier_id")


def u_merged(spark, sf):
    """Titles by link of two levels, the deeper one's first (U4)."""
    f = _frontier(spark, sf).where("link is not null").select("link", "title", "depth")
    return navigation.merged(f.where("depth = 1").drop("depth"), f.where("depth = 2").drop("depth"), "link")


def u_concat(spark, sf):
    """Aspirants and then peers, in one list."""
    d = _departments(spark, sf).select("school_name", "title", "tag")
    return d.where("tag = 'aspirant'").select(F.lit(1).alias("part"), "school_name", "title").unionAll(d.where("tag = 'peer'").select(F.lit(2).alias("part"), "school_name", "title"))


def r_first_metric(spark, sf):
    """The first of a request's metrics."""
    return _benchmarks(spark, sf).select("benchmark_id", F.get(F.split("metrics", ", "), 0).alias("metric"))


def f_topics(spark, sf):
    """Documents with more than a character."""
    return _documents(spark, sf).where(F.length("text") > 1).select("doc_id")


def f_professors(spark, sf):
    """Pages of professors, by the position read off them."""
    lines = _profiles(spark, sf).where("text_raw is not null").select("profile_id", F.split("text_raw", "\n").alias("lines"))
    return navigation.professors(lines.select("profile_id", extract.position(F.lit(""), F.col("lines")).alias("position")))


def e_key_info(spark, sf):
    """PhD year, PhD school and promotion year by the whole cascade."""
    year, school, promoted = extract.key_info(F.col("text_raw"))
    return _profiles(spark, sf).where("text_raw is not null").select("profile_id", year.alias("phd_year"), school.alias("phd_school"), promoted.alias("promotion_year"))


def e_cv_schools(spark, sf):
    """PhD schools by the rules for resumes."""
    names = fuzzy.choices(_universities(spark, sf), "university")
    pages = _profiles(spark, sf).where("text_raw is not null").select("profile_id", F.split("text_raw", "\n").alias("lines"))
    return navigation.cv_schools(pages, "profile_id", "lines", names)


def e_person_pages(spark, sf):
    """Pages that are persons', by the link's title, the page's, the one before and the lines."""
    title = F.concat_ws(" - ", "university", "name")
    personal = navigation.is_person_page(F.coalesce("department", F.lit("")), title, F.coalesce("university", F.lit("")), F.split(F.coalesce("text_raw", F.lit("")), "\n"), urls.level(F.col("profile_link")))
    return _profiles(spark, sf).select("profile_id", personal.alias("personal"))


def x_normalised(spark, sf):
    """Titles as they are compared: known words as they are, else without acronyms."""
    words = _documents(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    titles = _frontier(spark, sf).where("title is not null").select("frontier_id", "title")
    return navigation.known_words(titles, "frontier_id", "title", stage(words, "vocabulary")).select("frontier_id", "normalised")


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and k[:2] in ("c_", "j_", "u_", "r_", "f_", "e_", "x_")}

_S = "original_start.url"
_TARGETS = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, ts in (("PEOPLE", crawl.PEOPLE_TARGETS), ("DEPARTMENT", crawl.DEPARTMENT_TARGETS)) for t in ts) + ") t(kind, target)"
_TOKENS = "list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '#.*$', ''), '[!-/:-@\\[-`{-~]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN (" + ", ".join(f"'{e}'" for e in [*urls.EXTENSIONS, "htm", "html"]) + "))"
_HITS = f"n AS (SELECT frontier_id, {_S} AS start, link, row_number() OVER (PARTITION BY {_S} ORDER BY frontier_id) AS i FROM frontier WHERE regexp_matches(link, '/(people|staff|faculty)/'))"


def _has(facet):
    return f"lambda x: regexp_matches(lower(x), '{facet}') AND regexp_matches(x, '{extract.INSTITUTION}') AND regexp_matches(x, '(?:19|20)[0-9]{{2}}')"


def _told(groups, facet):
    lines = " || ".join(f"flatten({g})" for g in groups)
    joined = " || ".join(f"list_transform({g}, lambda g: array_to_string(g, ', '))" for g in groups)
    return f"coalesce(list_filter({lines}, {_has(facet)})[1], list_filter({joined}, {_has(facet)})[1])"


def _where(groups, some):
    return f"list_filter({groups}, lambda g: len(list_filter(g, lambda x: {some})) > 0)"


_DATED = "list_filter({g}, lambda g: len(list_filter(g, lambda x: regexp_matches(x, '(?:19|20)[0-9]{{2}}'))) > 0 AND len(list_filter(g, lambda x: regexp_matches(x, '" + extract.YEAR_IN_LINK.replace("{", "{{").replace("}", "}}") + "'))) = 0)"
_LATEST = "list_max(list_transform(regexp_extract_all({c}, '(?:19|20)[0-9]{{2}}'), lambda y: CAST(y AS INTEGER)))"
ORACLE = {
    "c_arrived": f"SELECT frontier_id, regexp_replace(link, '/$', '') AS url, regexp_replace(link, '/$', '') <> link AS redirected FROM frontier WHERE link IN (SELECT previous_link FROM frontier WHERE previous_link IS NOT NULL) AND NOT (regexp_replace(link, '/$', '') <> link AND {_PEOPLE_KEY.replace('link', 'regexp_replace(link, chr(47) || chr(36), chr(32))')})",
    "c_menu_overlap": f"""WITH e AS (SELECT DISTINCT {_S} AS page, link, title AS text FROM frontier WHERE link IS NOT NULL AND title IS NOT NULL), t AS ({_TARGETS}),
w AS (SELECT e.*, t.*, list_distinct(string_split(lower(text), ' ')) AS a, list_distinct(string_split(lower(target), ' ')) AS b FROM e, t),
s AS (SELECT page, link, text, kind, target, CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(a || b)) AS score FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY page, target ORDER BY score DESC, link, text) AS i FROM s),
m AS (SELECT *, row_number() OVER (PARTITION BY page, link ORDER BY score DESC, kind DESC, target, text) AS j FROM k WHERE i <= 3)
SELECT page, link, text, kind, round(score, 6) AS score FROM m WHERE j = 1 AND score >= 0.3 AND NOT {_NAV_KEY}""",
    "c_department_step": f"""SELECT frontier_id, CASE WHEN back THEN 'menu' ELSE 'department' END AS step, CAST(CASE WHEN back THEN -1 ELSE depth END AS INTEGER) AS next_depth
FROM (SELECT *, {_NETLOC.format(c='previous_link')} <> {_NETLOC.format(c='link')} OR len({_PARTS.format(c='link')}) < len({_PARTS.format(c='previous_link')}) AS back FROM frontier
WHERE link IS NOT NULL AND previous_link IS NOT NULL AND NOT {_PEOPLE_KEY} AND NOT regexp_matches(lower({_PATH.format(c='link')}), '\\.({'|'.join(urls.EXTENSIONS)})$'))""",
    "c_envelope": f"SELECT frontier_id, link AS previous_link, university_name, {_S} AS start, coalesce(tag, 'None') AS tag, CAST(depth + 1 AS INTEGER) AS depth FROM frontier WHERE depth < 4",
    "c_accepted": f"""WITH {_HITS}, h AS (SELECT start, list(netloc) AS netlocs FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY c DESC, netloc) AS r FROM (SELECT start, {_NETLOC.format(c='link')} AS netloc, count(*) AS c FROM n WHERE i < 10 GROUP BY 1, 2)) WHERE r <= 2 GROUP BY start),
q AS (SELECT start, list(DISTINCT p) AS paths FROM (SELECT start, {_PARENT.format(c='link')} AS p FROM n WHERE i < 10) WHERE p <> '' GROUP BY start)
SELECT frontier_id, CAST(i AS INTEGER) AS hit_no FROM n LEFT JOIN h ON h.start IS NOT DISTINCT FROM n.start LEFT JOIN q ON q.start IS NOT DISTINCT FROM n.start
WHERE i < 10 OR (list_contains(netlocs, {_NETLOC.format(c='link')}) AND len(list_filter(paths, lambda x: contains({_PARENT.format(c='link')}, x))) > 0)""",
    "c_fall_back": f"SELECT frontier_id FROM frontier WHERE depth <= 1 AND link IS NOT NULL AND previous_link IS NOT NULL AND NOT coalesce(fall_back, false) AND len(list_filter(list_zip({_PARTS.format(c='link')}, {_PARTS.format(c='previous_link')}), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL AND z[1] <> z[2])) > 0",
    "c_menu_names": f"""WITH f AS (SELECT frontier_id, link, title, {_TOKENS} AS t FROM frontier WHERE link IS NOT NULL), k AS (SELECT link, arg_min(title, frontier_id) AS first_text FROM f WHERE trim(title) <> '' GROUP BY link)
SELECT frontier_id, CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(regexp_replace(title, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g')) WHEN trim(regexp_replace(coalesce(first_text, ''), '\\([1-9]+\\)', '', 'g')) <> '' THEN first_text
ELSE array_to_string({_FIRST_SEEN.format(l='t')}, ' ') END AS name FROM f LEFT JOIN k USING (link)""",
    "j_without_menu": f"""WITH m AS (SELECT {_S} AS page, link, title AS text FROM frontier WHERE depth = 1), a AS (SELECT frontier_id, {_S} AS page, link, title AS text FROM frontier WHERE depth > 1)
SELECT frontier_id FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page = a.page AND m.text = a.text) OR NOT EXISTS (SELECT 1 FROM m WHERE m.page = a.page AND m.link = a.link)""",
    "u_merged": "WITH f AS (SELECT link, title, CASE depth WHEN 2 THEN 0 ELSE 1 END AS side FROM frontier WHERE link IS NOT NULL AND depth IN (1, 2)) SELECT link, title FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY side, title NULLS FIRST) AS i FROM f) WHERE i = 1",
    "u_concat": "SELECT CAST(1 AS INTEGER) AS part, school_name, title FROM departments WHERE tag = 'aspirant' UNION ALL SELECT 2, school_name, title FROM departments WHERE tag = 'peer'",
    "r_first_metric": "SELECT benchmark_id, string_split(metrics, ', ')[1] AS metric FROM benchmarks",
    "f_topics": "SELECT doc_id FROM documents WHERE length(text) > 1",
    "f_professors": f"WITH {_L} SELECT * FROM (SELECT profile_id, {_position('lines')} AS position FROM L) WHERE position <> 'Non-Professor'",
    "e_key_info": f"""WITH g AS (SELECT profile_id, list_filter(list_transform(string_split_regex(text_raw, '\\n[ \\t]*\\n'), lambda g: list_filter(string_split(g, chr(10)), lambda x: trim(x) <> '')), lambda g: len(g) > 0) AS gs FROM profiles WHERE text_raw IS NOT NULL),
p AS (SELECT *, {_where('gs', f"regexp_matches(lower(x), '{extract.PHD}')")} AS phd, {_where('gs', "contains(lower(x), 'professor')")} AS prof FROM g),
q AS (SELECT *, {_where('phd', "regexp_matches(lower(x), 'university|institute|college') OR regexp_matches(x, '(?i)[A-Z][A-Z]{2,4}')")} AS placed, {_DATED.format(g='phd')} AS dated, {_DATED.format(g='prof')} AS promo FROM p),
t AS (SELECT profile_id, CASE WHEN len(placed) > 0 THEN {_told(['placed', 'dated'], extract.PHD)} END AS told, {_told(['promo'], 'professor')} AS promoted FROM q)
SELECT profile_id, {_LATEST.format(c='told')} AS phd_year, coalesce(nullif(trim(regexp_extract(told, '{extract.INSTITUTION_NAME}', 1)), ''), 'Unknown') AS phd_school, {_LATEST.format(c='promoted')} AS promotion_year FROM t""",
    "x_normalised": "WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents) SELECT frontier_id, CASE WHEN w IS NOT NULL THEN title ELSE array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(title, '[A-Z][A-Z]+', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: regexp_matches(x, '[A-Za-z]')), ' ') END AS normalised FROM frontier LEFT JOIN v ON lower(title) = w WHERE title IS NOT NULL",
}
