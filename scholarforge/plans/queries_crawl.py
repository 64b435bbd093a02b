"""Queries of the crawl, of links, of page lines, of field extraction and of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarforge.functions import extract, fuzzy, html, urls, vectors
from scholarforge.functions import text as X
from scholarforge.operators import crawl, research
from scholarforge.runtime import read_table


def _t(name):
    return lambda spark, sf: read_table(spark, sf, name)


_frontier, _profiles, _departments, _universities, _documents, _embeddings, _activities = map(_t, ("frontier", "profiles", "departments", "universities", "documents", "embeddings", "activities"))


def c_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Start rows of all prioritised departments."""
    return crawl.start_rows(_departments(spark, sf), "PRIORITIZED")


def c_starts_selected(spark, sf):
    """Start rows of the universities that have a geography department."""
    rows = _departments(spark, sf)
    asked = [r[0] for r in rows.where("title = 'Geography'").select("school_name").distinct().collect()]  # the request's list
    return crawl.start_rows(rows, "SELECTED", asked, "Geography")


def c_requests(spark, sf):
    """The first request of every link."""
    return crawl.first_requests(_frontier(spark, sf).select("frontier_id", "link", "depth"))


def c_followable(spark, sf):
    """Links that may be followed."""
    return crawl.followable(_frontier(spark, sf)).select("frontier_id", "link")


def c_keyword_links(spark, sf):
    """Links with a keyword, for people and for navigation."""
    c = F.col("link")
    return _frontier(spark, sf).where("link is not null").select("frontier_id", urls.has_keyword(c).alias("people"), urls.has_keyword(c, urls.NAVIGATION_WORDS, urls.NAVIGATION_STRINGS).alias("navigation"))


def c_depth_limit(spark, sf):
    """Requests within the depth limit, with the next depth."""
    return _frontier(spark, sf).where("depth < 4").select("frontier_id", (F.col("depth") + 1).alias("next_depth"))


def c_page_cap(spark, sf):
    """The first 50 requests."""
    return _frontier(spark, sf).orderBy("frontier_id").limit(crawl.PAGE_CAP).select("frontier_id")


def c_same_site(spark, sf):
    """Links of the departments' own domains."""
    return crawl.same_site(_frontier(spark, sf), _departments(spark, sf).select("url")).select("frontier_id")


def c_reach(spark, sf):
    """Links within four steps of the start pages."""
    f = _frontier(spark, sf)
    starts = f.select(F.col("original_start.url").alias("link")).distinct()
    return crawl.reach(starts, f.select("previous_link", "link").where("link is not null and previous_link is not null")).groupBy("depth").agg(F.count("*").alias("links"))


def c_patterns(spark, sf):
    """Hosts and parent paths of every start's people pages."""
    pages = _frontier(spark, sf).where("link is not null").select(F.col("original_start.url").alias("start"), "link")
    return crawl.patterns(pages.where(F.col("link").rlike("/(people|staff|faculty)/")), "start").select("start", F.array_join("netlocs", "|").alias("netlocs"), F.array_join("paths", "|").alias("paths"))


def c_pattern_matches(spark, sf):
    """Links that fit their start's pattern."""
    pages = _frontier(spark, sf).where("link is not null").select("frontier_id", F.col("original_start.url").alias("start"), "link")
    found = crawl.patterns(pages.where(F.col("link").rlike("/(people|staff|faculty)/")), "start")
    return pages.join(found, "start").where(crawl.matches(F.col("link"), F.col("netlocs"), F.col("paths"))).select("frontier_id")


def c_counter(spark, sf):
    """Running number of every start's hits, and from the tenth on a match is needed."""
    hits = _frontier(spark, sf).select("frontier_id", F.col("original_start.url").alias("start"))
    return crawl.counted(hits, "start", "frontier_id").select("frontier_id", "hit_no", "needs_match")


def c_routes(spark, sf):
    """Where the frontier's titles lead."""
    return crawl.routed(_frontier(spark, sf).select("frontier_id", "title")).select("frontier_id", "route", F.round("people_score", 6).alias("people_score"))


def c_best_links(spark, sf):
    """The best title of every link of a start."""
    scored = crawl.routed(_frontier(spark, sf).select(F.col("original_start.url").alias("start"), "link", "title"))
    return crawl.best_links(scored.where("link is not null"), "start", "link", "people_score").select("start", "link", "title")


def c_labels(spark, sf):
    """Titles of a start numbered where they repeat."""
    f = _frontier(spark, sf).where("title is not null").select("frontier_id", F.col("original_start.url").alias("start"), "title")
    return crawl.numbered(f, ["start"], "title", "frontier_id").select("frontier_id", "label")


def c_new_anchors(spark, sf):
    """Anchors of a page at depth 2 that its ancestors lack."""
    f = _frontier(spark, sf).where("link is not null and title is not null").select(F.col("original_start.url").alias("page"), "link", F.col("title").alias("text"), "depth").distinct()
    return crawl.new_on_page(f.where("depth = 2").select("page", "link", "text").distinct(), f.where("depth = 1").select("page", "link", "text"))


def c_xml_fallback(spark, sf):
    """Pages without links looked up at their XML address."""
    pages = _frontier(spark, sf).where("link is not null").groupBy(F.col("previous_link").alias("link")).agg(F.count("*").alias("n_links")).where("link is not null")
    asked = _frontier(spark, sf).where("link is not null").select("link").distinct()
    return crawl.with_fallback(asked, pages).select("link", "source")


def c_letters(spark, sf):
    """Pages A to Z of a listing (C11)."""
    return spark.range(1).select(crawl.letter_pages("https://www.example.org/people?letter=").alias("link"))


def c_start_schools(spark, sf):
    """Frontier rows with the university of their domain."""
    sites = _universities(spark, sf).select(urls.registered_domain(F.col("homepage")).alias("d"), "university")
    return _frontier(spark, sf).select("frontier_id", urls.registered_domain(F.col("link")).alias("d")).join(sites, "d").select("frontier_id", "university")


def l_parts(spark, sf):
    """Host, level and parent path of links (X11)."""
    c = F.col("link")
    return _frontier(spark, sf).where("link is not null").select("frontier_id", urls.netloc(c).alias("netloc"), urls.level(c).alias("level"), urls.parent_path(c).alias("parent"))


def l_domains(spark, sf):
    """Registered domains."""
    return _profiles(spark, sf).select("profile_id", urls.registered_domain(F.col("profile_link")).alias("domain"))


def l_labels(spark, sf):
    """Labels made from links."""
    return _frontier(spark, sf).where("link is not null").select("frontier_id", urls.link_label(F.col("link")).alias("label"))


def l_elsewhere(spark, sf):
    """Links to another path than the page they stand on."""
    f = _frontier(spark, sf).where("link is not null and previous_link is not null")
    return f.select("frontier_id", urls.leads_elsewhere(F.col("link"), F.col("previous_link")).alias("elsewhere"))


def l_absolute(spark, sf):
    """Relative links made absolute."""
    return _frontier(spark, sf).where("link is not null").select("frontier_id", urls.absolute(F.col("previous_link"), F.lit("../people/list.html")).alias("link"))


def l_resumes(spark, sf):
    """Links to PDFs, and to resumes among them."""
    return _frontier(spark, sf).where(F.col("link").contains(".pdf")).select("frontier_id", urls.is_resume(F.col("link")).alias("resume"))


def _lines(spark, sf):
    return _profiles(spark, sf).where("text_raw is not null").select("profile_id", "position", "name", F.split("text_raw", "\n").alias("lines"))


def e_positions(spark, sf):
    """Position read off a page."""
    return _lines(spark, sf).select("profile_id", extract.position(F.lit(""), F.col("lines")).alias("position"))


def e_positions_titled(spark, sf):
    """Position read off a title."""
    return _profiles(spark, sf).where("position is not null").select("profile_id", extract.position(F.col("position"), F.array().cast("array<string>")).alias("found"))


def e_phd_years(spark, sf):
    """PhD year of the key line."""
    return _lines(spark, sf).select("profile_id", extract.phd_year(F.col("lines")).alias("phd_year"))


def e_phd_schools(spark, sf):
    """PhD school of the key line."""
    return _lines(spark, sf).select("profile_id", extract.phd_school(F.col("lines")).alias("phd_school"))


def e_promotions(spark, sf):
    """Promotion year of the key line."""
    return _lines(spark, sf).select("profile_id", extract.promotion_year(F.col("lines")).alias("promotion_year"))


def e_main_lines(spark, sf):
    """Lines of the main text."""
    return _lines(spark, sf).select("profile_id", F.array_join(extract.main_lines(F.col("lines")), "\n").alias("main"))


def e_resume_years(spark, sf):
    """Years by the rules for resumes, with neighbours."""
    return _lines(spark, sf).select("profile_id", extract.resume_year(F.col("lines"), extract.PHD).alias("phd_year"), extract.resume_year(F.col("lines"), extract.PROFESSOR).alias("promotion_year"))


def e_sensible(spark, sf):
    """Years in order and not in the future."""
    p, q = extract.sensible(X.year(F.col("phd_year")), X.year(F.col("promotion_year")), 2020)
    return _profiles(spark, sf).select("profile_id", p.alias("phd_year"), q.alias("promotion_year"))


def e_unknowns(spark, sf):
    """Unknown fields counted."""
    c = [F.coalesce(F.col(x), F.lit("")) for x in ("phd_year", "phd_school", "promotion_year")]
    return _profiles(spark, sf).select("profile_id", extract.unknown_count(*c).alias("n"))


def e_personal(spark, sf):
    """Pages with a heading of a personal page."""
    return _lines(spark, sf).select("profile_id", extract.is_personal(F.col("lines"), F.lit(2), F.lit(False)).alias("personal"))


def e_long_lines(spark, sf):
    """Lines of three characters and more, and those with a filter word."""
    words = ["calendar", "curriculum", "event", "news", "resource", "student", "log"]
    kept = F.filter("lines", lambda x: F.length(x) >= 3)
    return _lines(spark, sf).select("profile_id", F.size(kept).alias("kept"), F.size(F.filter(kept, lambda x: X.contains_any(x, words))).alias("filtered"), F.size(F.filter(kept, lambda x: X.word_count(x) <= 5)).alias("short"))


def e_unique_lines(spark, sf):
    """Lines of a page that the crawl of the same link before it lacks."""
    df = _profiles(spark, sf).where("text_raw is not null").select("profile_id", "profile_link", F.split("text_raw", "\n").alias("lines"))
    before = F.lag("lines").over(Window.partitionBy("profile_link").orderBy("profile_id"))
    return df.withColumn("b", F.coalesce(before, F.array().cast("array<string>"))).select("profile_id", F.array_join(F.array_except("lines", "b"), "\n").alias("own"))


def e_neither(spark, sf):
    """Lines that are neither about assistants nor associates."""
    a = F.filter("lines", lambda x: ~F.lower(x).rlike(extract.ASSISTANT))
    b = F.filter("lines", lambda x: ~F.lower(x).rlike(extract.ASSOCIATE))
    return _lines(spark, sf).select("profile_id", F.array_join(F.array_intersect(a, b), "\n").alias("neither"))


def e_topic_words(spark, sf):
    """Words of the documents as topic models take them."""
    return _documents(spark, sf).select("doc_id", F.array_join(X.cleaned_for_topics(F.col("text"), research.STOP_WORDS), " ").alias("words"))


def e_list_items(spark, sf):
    """Lists joined to running text."""
    return _documents(spark, sf).select("doc_id", X.list_items_joined(F.col("text")).alias("text"))


def e_bag(spark, sf):
    """Words of all documents by frequency."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    return _documents(spark, sf).select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def e_bigrams(spark, sf):
    """Pairs of words that belong together (M5)."""
    df = _documents(spark, sf).select(F.array(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("sentences"))
    return research.bigram_scores(df).select("a", "b", F.round("score", 6).alias("score"))


def e_noun_phrases(spark, sf):
    """Noun phrases of the documents (M1, M2)."""
    return _documents(spark, sf).select("doc_id", F.size(research.phrases_udf()(F.col("text"))).alias("n"))


def e_sentence_tokens(spark, sf):
    """Words of sentences (M4)."""
    return research.sentence_tokens(_documents(spark, sf), "text").select("doc_id", F.size("sentences").alias("sentences"), F.size(F.flatten("sentences")).alias("words"))


def e_rendered(spark, sf):
    """Profile lines marked up as a page, rendered and read (H1 to H7)."""
    marked = F.concat(F.lit("<html><head><title>"), F.coalesce("name", F.lit("")), F.lit("</title></head><body><nav class=menu><a href='/people'>People</a><a href='/news'>News</a></nav><h1>"), F.coalesce("name", F.lit("")), F.lit("</h1><ul><li>"), F.coalesce("position", F.lit("")), F.lit("<li>"), F.coalesce("phd_school", F.lit("")), F.lit("</ul></body></html>"))
    got = _profiles(spark, sf).select("profile_id", html.page(F.col("profile_link"), marked).alias("p"))
    return got.select("profile_id", F.size("p.anchors").alias("anchors"), F.get("p.anchors", 0)["href"].alias("href"), F.get("p.title", 0).alias("title"), F.size("p.blocks").alias("blocks"))


def e_school_ratio(spark, sf):
    """Distinct schools with the closest university by sequence ratio."""
    names = fuzzy.choices(_universities(spark, sf), "university")
    schools = _profiles(spark, sf).where("phd_school is not null").select("phd_school").distinct()
    return schools.select("phd_school", fuzzy.best_of(names, 0.6, "sequence")(F.col("phd_school")).alias("university"))


def e_common_part(spark, sf):
    """What university and school of a profile have in common."""
    df = _profiles(spark, sf).where("phd_school is not null and university is not null").select("university", "phd_school").distinct()
    return df.select("university", "phd_school", fuzzy.longest_common(F.col("university"), F.col("phd_school")).alias("common"), F.round(fuzzy.sequence_ratio(F.col("university"), F.col("phd_school")), 6).alias("ratio"))


def e_entities(spark, sf):
    """Entities in the names of schools, all and organisations only."""
    c = F.col("phd_school")
    df = _profiles(spark, sf).where("phd_school is not null").select("phd_school").distinct()
    return df.select("phd_school", F.size(extract.named_entities(c)).alias("entities"), F.size(extract.named_entities(c, only_organisations=True)).alias("organisations"))


def e_names(spark, sf):
    """Names resolved from titles, else from the short lines of a page."""
    rows = _profiles(spark, sf).where("text_raw is not null").select("profile_id", F.coalesce("name", F.lit("")).alias("t"), F.filter(F.split("text_raw", "\n"), lambda x: F.size(F.split(x, " ")) <= 6).alias("h"))
    return rows.select("profile_id", extract.resolved_name(F.col("t"), F.lit(""), F.col("h")).alias("name"))


def v_closest_words(spark, sf):
    """Words closest to a sum of words."""
    told = research.sentence_tokens(_documents(spark, sf).select("doc_id", "text"), "text", "phrases")
    return research.closest_words(research.word_vectors(told, size=16), ["fusion", "membrane"], ["yeast"])


def v_cosines(spark, sf):
    """Cosine of every vector with the first one."""
    e = _embeddings(spark, sf)
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))


def v_pair_max(spark, sf):
    """The closest of ten query vectors, 0 at least."""
    e = _embeddings(spark, sf)
    asked = e.orderBy("vec_id").limit(10).agg(F.collect_list("embedding").alias("q"))
    best = F.aggregate(F.transform("q", lambda q: vectors.cosine(F.col("embedding"), q)), F.lit(0.0), lambda a, x: F.greatest(a, x))
    return e.crossJoin(F.broadcast(asked)).select("vec_id", F.round(best, 5).alias("best"))


def _three(spark, sf):
    """Similarity of every vector with the first three."""
    e = _embeddings(spark, sf)
    asked = e.orderBy("vec_id").limit(3).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("q"))
    return e.crossJoin(F.broadcast(asked)).select("vec_id", *[F.round(vectors.cosine(F.col("embedding"), F.get("q", i)), 5).alias(f"s{i + 1}") for i in range(3)])


def v_combined(spark, sf):
    """Three similarities combined: lowest two, highest two, all, and the mean of two."""
    s = [F.col(c) for c in ("s1", "s2", "s3")]
    three = F.array(*s)
    return _three(spark, sf).select("vec_id", F.round(vectors.lowest_mean(three, 2), 6).alias("two_lowest"), F.round(vectors.highest_mean(three, 2), 6).alias("two_highest"), F.round(vectors.lowest_mean(three, 3), 6).alias("all_three"), F.round((s[0] + s[1]) / 2, 6).alias("two"))


def v_blended(spark, sf):
    """Scores blended unless the sequence decides."""
    return _three(spark, sf).select("vec_id", F.round(vectors.blended(F.col("s1"), F.col("s2")), 6).alias("score"))


def v_mean_nonzero(spark, sf):
    """Mean of scores that are not zero."""
    s = F.array(*[F.greatest(F.col(c), F.lit(0.0)) for c in ("s1", "s2", "s3")])
    return _three(spark, sf).select("vec_id", F.round(vectors.mean_nonzero(s), 6).alias("score"))


def v_topics(spark, sf):
    """Topic similarity of all documents with the first of them (M8, M9)."""
    df = _documents(spark, sf).where("length(text) > 0").select("doc_id", "text")
    first = df.agg(F.min("doc_id")).first()[0]
    told = research.sentence_tokens(df, "text", "phrases")
    return research.topic_similarity(told, "doc_id", first or 0)


def v_words(spark, sf):
    """Embedding similarity of all documents with the first of them (M6, M7)."""
    df = _documents(spark, sf).where("length(text) > 0").select("doc_id", "text")
    first = df.agg(F.min("doc_id")).first()[0]
    told = research.sentence_tokens(df, "text", "phrases")
    return research.embedding_similarity(told, "doc_id", first or 0, size=16, least=5)


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and k[:2] in ("c_", "l_", "e_", "v_")}


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_KEY = "(list_has_any(regexp_extract_all(lower(link), '[a-z]+'), {w}) OR regexp_matches(lower(link), '{s}'))"
_PEOPLE_KEY = _KEY.format(w=_list(urls.WORDS), s="|".join(urls.STRINGS))
_NAV_KEY = _KEY.format(w=_list(urls.NAVIGATION_WORDS), s="|".join(urls.NAVIGATION_STRINGS))
_NETLOC = "regexp_extract({c}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_PATH = "regexp_extract({c}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_PARTS = "list_filter(string_split(" + _PATH + ", '/'), lambda x: x <> '')"
_PARENT = "array_to_string((" + _PARTS + ")[1:-2], '/')"
_DOMAIN = "array_to_string((string_split(lower(regexp_replace(" + _NETLOC + ", ':\\d*$', '')), '.'))[-2:], '.')"
_L = "L AS (SELECT profile_id, string_split(text_raw, chr(10)) AS lines FROM profiles WHERE text_raw IS NOT NULL)"
_W = "len(string_split(x, ' '))"


_FIRST_SEEN = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_RUNS = "regexp_extract_all({c}, '" + extract._RUN.replace("(?U)", "").replace("'", "''").replace("{", "{{").replace("}", "}}") + "')"
_KEPT = f"lambda x: NOT regexp_matches(lower(x), '{'|'.join(extract.NO_ENTITY)}')"


def _keyline(facet, more=""):
    return f"list_filter(lines, lambda x: {_W} <= 20 AND regexp_matches(lower(x), '{facet}') AND regexp_matches(x, '{extract.INSTITUTION}') AND regexp_matches(x, '(?:19|20)[0-9]{{2}}'){more})[1]"


_FIRST = "list_filter({l}, lambda x: NOT contains(lower(x), 'student'))"
_YEARS = "regexp_extract_all({c}, '(?:19|20)[0-9]{{2}}')"
_START = "original_start.url"
_PAT = f"""p AS (SELECT {_START} AS start, link, {_NETLOC.format(c='link')} AS netloc, {_PARENT.format(c='link')} AS path FROM frontier WHERE link IS NOT NULL AND regexp_matches(link, '/(people|staff|faculty)/')),
h AS (SELECT start, list(netloc ORDER BY i) AS netlocs FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, netloc) AS i FROM (SELECT start, netloc, count(*) AS n FROM p GROUP BY 1, 2)) WHERE i <= 2 GROUP BY 1),
q AS (SELECT start, list(DISTINCT path ORDER BY path) AS paths FROM p WHERE path <> '' GROUP BY 1)"""


def _resume(facet):
    own = f"list_filter(list_zip(lines, range(1, len(lines) + 1)), lambda z: regexp_matches(lower(z[1]), '{facet}') AND NOT contains(lower(z[1]), 'student') AND len(string_split(z[1], ' ')) <= 10)"
    mine = f"list_transform({own}, lambda z: z[1])"
    near = f"flatten(list_transform({own}, lambda z: lines[greatest(z[2] - 1, 1):z[2] + 1]))"
    year = lambda l: f"TRY_CAST(flatten(list_transform(list_filter({l}, lambda x: NOT contains(lower(x), 'student')), lambda x: {_YEARS.format(c='x')}))[1] AS INTEGER)"
    return f"coalesce({year(mine)}, {year(near)})"


def _position(lines):
    has = lambda p: f"len(list_filter({lines}, lambda x: regexp_matches(lower(x), '{p}') AND {_W} <= 10)) > 0"
    return f"""CASE WHEN len(list_filter({lines}, lambda x: contains(lower(x), 'professor') AND {_W} <= 1)) > 0
 OR len(list_filter({lines}, lambda x: regexp_matches(lower(x), '{extract.PROFESSOR}') AND NOT regexp_matches(lower(x), '{extract.ASSOCIATE}') AND NOT regexp_matches(lower(x), '{extract.ASSISTANT}') AND {_W} <= 10)) > 0 THEN 'Professor'
 WHEN {has(extract.ASSISTANT)} THEN 'Assistant Professor' WHEN {has(extract.ASSOCIATE)} THEN 'Associate Professor' ELSE 'Non-Professor' END"""


_COS = "round(CAST(list_sum(list_transform(list_zip(embedding, {q}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform({q}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS DOUBLE), 5)"
_S3 = "[" + ", ".join(_COS.format(q=f"q[{i}]") for i in (1, 2, 3)) + "]"
_THREE = f"(SELECT vec_id, {_S3} AS t FROM embeddings, (SELECT list(embedding ORDER BY vec_id) AS q FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 3)))"
ORACLE = {
    "c_starts": "SELECT url AS link, title, school_name AS university_name, coalesce(tag, 'None') AS tag, CAST(0 AS INTEGER) AS depth FROM departments",
    "c_starts_selected": "SELECT url AS link, title, school_name AS university_name, coalesce(tag, 'None') AS tag, CAST(0 AS INTEGER) AS depth FROM departments WHERE title = 'Geography'",
    "c_requests": "SELECT frontier_id, link, depth FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(link, '/$', '') ORDER BY frontier_id) AS i FROM frontier) WHERE i = 1",
    "c_followable": f"SELECT frontier_id, link FROM frontier WHERE link IS NOT NULL AND NOT {_PEOPLE_KEY} AND NOT regexp_matches(lower({_PATH.format(c='link')}), '\\.({'|'.join(urls.EXTENSIONS)})$') AND NOT contains(link, '#')",
    "c_keyword_links": f"SELECT frontier_id, {_PEOPLE_KEY} AS people, {_NAV_KEY} AS navigation FROM frontier WHERE link IS NOT NULL",
    "c_depth_limit": "SELECT frontier_id, CAST(depth + 1 AS INTEGER) AS next_depth FROM frontier WHERE depth < 4",
    "c_page_cap": "SELECT frontier_id FROM frontier ORDER BY frontier_id LIMIT 50",
    "c_same_site": f"SELECT frontier_id FROM frontier WHERE {_DOMAIN.format(c='link')} IN (SELECT {_DOMAIN.format(c='url')} FROM departments)",
    "c_reach": f"""WITH RECURSIVE e AS (SELECT DISTINCT previous_link, link FROM frontier WHERE link IS NOT NULL AND previous_link IS NOT NULL),
r AS (SELECT DISTINCT {_START} AS link, 0 AS depth FROM frontier UNION SELECT e.link, r.depth + 1 FROM r JOIN e ON e.previous_link = r.link WHERE r.depth < 4)
SELECT CAST(depth AS INTEGER) AS depth, count(*) AS links FROM (SELECT link, min(depth) AS depth FROM r WHERE link IS NOT NULL GROUP BY link) GROUP BY depth""",
    "c_patterns": f"WITH {_PAT} SELECT start, array_to_string(netlocs, '|') AS netlocs, coalesce(array_to_string(paths, '|'), '') AS paths FROM h LEFT JOIN q USING (start)",
    "c_pattern_matches": f"WITH {_PAT} SELECT frontier_id FROM frontier f JOIN h ON h.start = f.{_START} JOIN q ON q.start = h.start WHERE link IS NOT NULL AND list_contains(netlocs, {_NETLOC.format(c='link')}) AND len(list_filter(paths, lambda x: contains({_PARENT.format(c='link')}, x))) > 0",
    "c_counter": f"SELECT frontier_id, CAST(i AS INTEGER) AS hit_no, i >= 10 AS needs_match FROM (SELECT frontier_id, row_number() OVER (PARTITION BY {_START} ORDER BY frontier_id) AS i FROM frontier)",
    "c_labels": f"SELECT frontier_id, CASE WHEN n > 1 THEN title || '(' || i || ')' ELSE title END AS label FROM (SELECT frontier_id, title, count(*) OVER (PARTITION BY {_START}, title) AS n, row_number() OVER (PARTITION BY {_START}, title ORDER BY frontier_id) AS i FROM frontier WHERE title IS NOT NULL)",
    "c_new_anchors": f"""WITH f AS (SELECT DISTINCT {_START} AS page, link, title AS text, depth, regexp_replace(link, '/$', '') AS l FROM frontier WHERE link IS NOT NULL AND title IS NOT NULL), c AS (SELECT DISTINCT page, link, text, l FROM f WHERE depth = 2), a AS (SELECT * FROM f WHERE depth = 1),
n AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page IS NOT DISTINCT FROM c.page AND a.l = c.l) AND NOT EXISTS (SELECT 1 FROM a WHERE a.page IS NOT DISTINCT FROM c.page AND a.text = c.text))
SELECT page, link, text FROM n UNION ALL SELECT page, link, text FROM c WHERE page NOT IN (SELECT page FROM n)""",
    "c_xml_fallback": "WITH p AS (SELECT DISTINCT previous_link AS link FROM frontier WHERE link IS NOT NULL AND previous_link IS NOT NULL) SELECT DISTINCT f.link, CASE WHEN p.link IS NOT NULL THEN f.link ELSE x.link END AS source FROM (SELECT DISTINCT link FROM frontier WHERE link IS NOT NULL) f LEFT JOIN p ON p.link = f.link LEFT JOIN p x ON x.link = regexp_replace(f.link, 'html', 'xml', 'g')",
    "c_letters": "SELECT 'https://www.example.org/people?letter=' || chr(CAST(65 + i AS INTEGER)) AS link FROM range(26) t(i)",
    "c_start_schools": f"SELECT frontier_id, university FROM frontier f JOIN universities u ON {_DOMAIN.format(c='f.link')} = {_DOMAIN.format(c='u.homepage')}",
    "l_parts": f"SELECT frontier_id, {_NETLOC.format(c='link')} AS netloc, CAST(len({_PARTS.format(c='link')}) AS INTEGER) AS level, {_PARENT.format(c='link')} AS parent FROM frontier WHERE link IS NOT NULL",
    "l_domains": f"SELECT profile_id, {_DOMAIN.format(c='profile_link')} AS domain FROM profiles",
    "l_elsewhere": f"SELECT frontier_id, len(list_filter(list_zip({_PARTS.format(c='link')}, {_PARTS.format(c='previous_link')}), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL AND z[1] <> z[2])) > 0 AS elsewhere FROM frontier WHERE link IS NOT NULL AND previous_link IS NOT NULL",
    "l_resumes": "SELECT frontier_id, contains(link, 'cv') OR contains(link, 'resum') OR contains(link, 'vitam') AS resume FROM frontier WHERE contains(link, '.pdf')",
    "e_positions": f"WITH {_L} SELECT profile_id, {_position('lines')} AS position FROM L",
    "e_positions_titled": "SELECT profile_id, CASE WHEN starts_with(t, 'prof') THEN 'Professor' WHEN starts_with(t, 'assistant') OR starts_with(t, 'asst') THEN 'Assistant Professor' WHEN starts_with(t, 'associate') OR starts_with(t, 'asso') THEN 'Associate Professor' ELSE 'Non-Professor' END AS found FROM (SELECT profile_id, lower(position) AS t FROM profiles WHERE position IS NOT NULL)",
    "e_phd_years": f"WITH {_L} SELECT profile_id, list_max(list_transform({_YEARS.format(c=_keyline(extract.PHD))}, lambda y: CAST(y AS INTEGER))) AS phd_year FROM L",
    "e_phd_schools": f"WITH {_L} SELECT profile_id, coalesce(nullif(trim(regexp_extract({_keyline(extract.PHD)}, '([A-Za-z ]*(?:University|Institute|College)[A-Za-z ]*)', 1)), ''), 'Unknown') AS phd_school FROM L",
    "e_promotions": f"WITH {_L} SELECT profile_id, list_max(list_transform({_YEARS.format(c=_keyline('professor', " AND NOT regexp_matches(x, '" + extract.YEAR_IN_LINK + "')"))}, lambda y: CAST(y AS INTEGER))) AS promotion_year FROM L",
    "e_main_lines": f"WITH {_L} SELECT profile_id, array_to_string({_FIRST_SEEN.format(l='m')}, chr(10)) AS main FROM (SELECT profile_id, list_filter(lines, lambda x: {_W} >= 20 AND NOT regexp_matches(x, '{extract.REFERENCE}') AND NOT regexp_matches(lower(x), '{extract.PHD}')) AS m FROM L)",
    "e_resume_years": f"WITH {_L} SELECT profile_id, {_resume(extract.PHD)} AS phd_year, {_resume(extract.PROFESSOR)} AS promotion_year FROM L",
    "e_sensible": "SELECT profile_id, CASE WHEN p <= 2020 AND NOT coalesce(p > (CASE WHEN q <= 2020 THEN q END), false) THEN p END AS phd_year, CASE WHEN q <= 2020 THEN q END AS promotion_year FROM (SELECT profile_id, TRY_CAST(nullif(regexp_extract(phd_year, '(?:19|20)[0-9]{2}', 0), '') AS INTEGER) AS p, TRY_CAST(nullif(regexp_extract(promotion_year, '(?:19|20)[0-9]{2}', 0), '') AS INTEGER) AS q FROM profiles)",
    "e_unknowns": "SELECT profile_id, CAST((coalesce(phd_year, '') = 'Unknown')::INT + (coalesce(phd_school, '') = 'Unknown')::INT + (coalesce(promotion_year, '') = 'Unknown')::INT AS INTEGER) AS n FROM profiles",
    "e_personal": f"WITH {_L} SELECT profile_id, len(list_filter(lines, lambda x: regexp_matches(lower(x), 'publicati|interest|biograp') AND {_W} <= 5)) > 0 AS personal FROM L",
    "e_long_lines": f"WITH {_L} SELECT profile_id, CAST(len(k) AS INTEGER) AS kept, CAST(len(list_filter(k, lambda x: regexp_matches(lower(x), 'calendar|curriculum|event|news|resource|student|log'))) AS INTEGER) AS filtered, CAST(len(list_filter(k, lambda x: {_W} <= 5)) AS INTEGER) AS short FROM (SELECT profile_id, list_filter(lines, lambda x: length(x) >= 3) AS k FROM L)",
    "e_unique_lines": f"SELECT profile_id, array_to_string(list_filter({_FIRST_SEEN.format(l='lines')}, lambda x: NOT list_contains(b, x)), chr(10)) AS own FROM (SELECT profile_id, lines, coalesce(lag(lines) OVER (PARTITION BY profile_link ORDER BY profile_id), []) AS b FROM (SELECT profile_id, profile_link, string_split(text_raw, chr(10)) AS lines FROM profiles WHERE text_raw IS NOT NULL))",
    "e_neither": f"WITH {_L} SELECT profile_id, array_to_string({_FIRST_SEEN.format(l='m')}, chr(10)) AS neither FROM (SELECT profile_id, list_filter(lines, lambda x: NOT regexp_matches(lower(x), '{extract.ASSISTANT}') AND NOT regexp_matches(lower(x), '{extract.ASSOCIATE}')) AS m FROM L)",
    "e_topic_words": "SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g'))), '[^a-zA-Z\\s]+', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('', " + ", ".join(f"'{w}'" for w in research.STOP_WORDS) + ")), ' ') AS words FROM documents",
    "e_list_items": "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[()0-9.\\-]+', '')), '. ') AS text FROM documents",
    "e_bag": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) GROUP BY word",
    "e_bigrams": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents), u AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w), v AS (SELECT count(*) AS v FROM u),
p AS (SELECT z[1] AS a, z[2] AS b, count(*) AS n FROM (SELECT unnest(list_zip(w[1:-2], w[2:])) AS z FROM d WHERE len(w) > 1) GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT a, b, round((p.n - 5) * v / CAST(x.n * y.n AS DOUBLE), 6) AS score FROM p JOIN u x ON x.w = a JOIN u y ON y.w = b, v WHERE (p.n - 5) * v / CAST(x.n * y.n AS DOUBLE) > 10""",
    "v_cosines": f"SELECT vec_id, {_COS.format(q='q')} AS cosine FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)",
    "v_pair_max": f"SELECT vec_id, greatest(max(c), 0) AS best FROM (SELECT vec_id, {_COS.format(q='q')} AS c FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 10)) GROUP BY vec_id",
    "v_combined": f"SELECT vec_id, round((s[1] + s[2]) / 2, 6) AS two_lowest, round((s[2] + s[3]) / 2, 6) AS two_highest, round((s[1] + s[2] + s[3]) / 3, 6) AS all_three, round((t[1] + t[2]) / 2, 6) AS two FROM (SELECT *, list_sort(t) AS s FROM {_THREE})",
    "v_blended": f"SELECT vec_id, round(CASE WHEN t[2] >= 0.8 THEN t[2] ELSE 0.8 * t[1] + (1 - 0.8) * t[2] END, 6) AS score FROM {_THREE}",
    "v_mean_nonzero": f"SELECT vec_id, round(coalesce(list_avg(list_filter(t, lambda x: x > 0)), 0.0), 6) AS score FROM {_THREE}",
    "l_labels": "SELECT frontier_id, array_to_string(" + _FIRST_SEEN.format(l="t") + ", ' ') AS label FROM (SELECT frontier_id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '#.*$', ''), '[!-/:-@\\[-`{-~]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN (" + ", ".join(f"'{e}'" for e in [*urls.EXTENSIONS, "htm", "html"]) + ")) AS t FROM frontier WHERE link IS NOT NULL)",
    "l_absolute": f"SELECT frontier_id, regexp_extract(previous_link, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', 0) || array_to_string(string_split({_PATH.format(c='previous_link')}, '/')[1:-3], '/') || '/people/list.html' AS link FROM frontier WHERE link IS NOT NULL",
    "e_entities": f"SELECT phd_school, CAST(len(list_filter(r, lambda x: NOT regexp_matches(lower(x), '{'|'.join(extract.NO_ENTITY)}'))) AS INTEGER) AS entities, CAST(len(list_filter(r, lambda x: regexp_matches(x, '{extract.ORGANISATION}'))) AS INTEGER) AS organisations FROM (SELECT DISTINCT phd_school, {_RUNS.format(c='phd_school')} AS r FROM profiles WHERE phd_school IS NOT NULL)",
    "e_names": f"SELECT profile_id, CASE WHEN len(list_filter({_RUNS.format(c='t')}, {_KEPT})) > 0 THEN t ELSE coalesce(list_filter(flatten(list_transform(h, lambda y: {_RUNS.format(c='y')})), {_KEPT})[1], 'Unknown') END AS name FROM (SELECT profile_id, coalesce(name, '') AS t, list_filter(string_split(text_raw, chr(10)), lambda x: {_W} <= 6) AS h FROM profiles WHERE text_raw IS NOT NULL)",
}
