"""Queries of the profile store, the ranking and the history, over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarforge.functions import text as X
from scholarforge.operators import ranking, research, store
from scholarforge.operators.ranking import Person
from scholarforge.runtime import read_table

PERSON = Person("Biochemistry", "Professor", 1995, 2023, "University of Wexaloburg", "protein folding and membrane fusion in cultured neurons")
DEPARTMENT = "Geography"


def _t(name):
    return lambda spark, sf: read_table(spark, sf, name)


_profiles, _activities, _benchmarks, _users, _universities = map(_t, ("profiles", "activities", "benchmarks", "users", "universities"))
_KEYS = ["profile_id", "profile_link"]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Quota preview of the benchmark ranking (P1: F1, A1, A2, W1, W2)."""
    scores = ranking.scored(_profiles(spark, sf).drop("text_raw"), PERSON, ["PHD YEAR", "PROMO YEAR"])
    return ranking.preview(scores).select("profile_id", "tag", "place", F.round("final_score", 6).alias("final_score"))


def b_full_export(spark, sf):
    """Ranked export with three metrics, both lists in full."""
    scores = ranking.scored(_profiles(spark, sf).drop("text_raw"), PERSON, ["PHD YEAR", "PROMO YEAR", "PHD UNIVERSITY"], _universities(spark, sf), fuzzy=False)
    return ranking.ranked(scores).select("profile_id", "tag", "place", F.round("final_score", 6).alias("final_score"))


def b_year_scores(spark, sf):
    """Scores by year."""
    scores = ranking.scored(_profiles(spark, sf).drop("text_raw"), PERSON, ["PHD YEAR", "PROMO YEAR"])
    return scores.select("profile_id", F.round("phd_year_score", 6).alias("phd_year_score"), F.round("promotion_year_score", 6).alias("promotion_year_score"))


def b_rank_fuzzy(spark, sf):
    """Ranking with schools matched by weighted ratio."""
    scores = ranking.scored(_profiles(spark, sf).drop("text_raw"), PERSON, ["PHD UNIVERSITY", "PHD YEAR"], _universities(spark, sf), fuzzy=True)
    return ranking.ranked(scores).select("profile_id", "tag", "place", F.round("final_score", 6).alias("final_score"))


def b_research(spark, sf):
    """Research scores of a department's aspirants against the first of them."""
    df = _profiles(spark, sf).where("department = 'Geography' and position = 'Professor' and tag = 'aspirant'").select("profile_id", "text_raw")
    first = df.where("length(text_raw) > 0").agg(F.min("profile_id")).first()[0]
    return research.research_scores(df, "profile_id", first or 0, topics=10)


def s_profiles(spark, sf):
    """Full table."""
    return _profiles(spark, sf).select("profile_id", "profile_link", "name", "department", "university", "tag", "position", "phd_year", "phd_school", "promotion_year", "user_updated")


def s_parameters(spark, sf):
    """Query with parameters."""
    _profiles(spark, sf).createOrReplaceTempView("sf_profiles")
    return spark.sql("SELECT profile_id, university FROM sf_profiles WHERE department = ? AND tag = ?", args=["Geography", "peer"])


def s_literal_row(spark, sf):
    """The query person as a row."""
    return spark.createDataFrame([(PERSON.department, PERSON.position, PERSON.phd_year)], "department string, position string, phd_year int")


def u_append_person(spark, sf):
    """The query person appended, missing columns null."""
    person = spark.createDataFrame([("Query Person", "Biochemistry")], "name string, department string")
    return _profiles(spark, sf).select("name", "department", "tag").unionByName(person, allowMissingColumns=True)


def f_person_split(spark, sf):
    """Rows without a tag, as the query row is told from the rest."""
    return _profiles(spark, sf).where("tag is null").select("profile_id")


def f_candidates(spark, sf):
    """Candidates of a person (F1)."""
    return ranking.candidates(_profiles(spark, sf), PERSON).select("profile_id", "name")


def f_known_by_tag(spark, sf):
    """Known names by tag (F2)."""
    return _profiles(spark, sf).where((F.col("name") != "Unknown") & F.col("tag").isin("peer", "aspirant")).groupBy("tag").agg(F.count("*").alias("n"))


def f_isin(spark, sf):
    """Membership in a list."""
    return _profiles(spark, sf).where(F.col("position").isin("Professor", "Associate Professor")).select("profile_id", "position")


def f_incomplete(spark, sf):
    """Incomplete profiles."""
    return store.incomplete(_profiles(spark, sf)).select("profile_id")


def u_incomplete_union(spark, sf):
    """Incomplete profiles as the union of five queries."""
    df = _profiles(spark, sf)
    parts = [df.where(F.col(f) == v).select("profile_id") for f, v in (("name", "Unknown"), ("phd_year", "Unknown"), ("phd_school", "Unknown"), ("promotion_year", "Unknown"), ("text_raw", ""))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def k_latest(spark, sf):
    """The store after all crawls: edited rows kept, else the last crawl (K6)."""
    return store.latest(_profiles(spark, sf).select("profile_link", "profile_id", "name", "user_updated", "stored_at")).select("profile_link", "profile_id", "name")


def k_upsert(spark, sf):
    """Crawls of 2022 on, upserted into the store of the crawls before (K6)."""
    df = _profiles(spark, sf).select("profile_link", "profile_id", "name", "position", "user_updated", "crawled_at", "stored_at")
    old = store.latest(df.where("crawled_at < timestamp'2022-06-01'"))
    new = store.latest(df.where("crawled_at >= timestamp'2022-06-01'"))
    return store.protected_upsert(old, new).select("profile_link", "profile_id", "name", "user_updated")


def k_edits(spark, sf):
    """Edits named in the audit log, as changed cells marked by hand (K7)."""
    remark = F.col("remark")
    edits = (
        _activities(spark, sf).where("activity_name = 'Edit profile' and remark is not null")
        .select(F.regexp_extract(remark, r" of (\S+)$", 1).alias("profile_link"), F.regexp_extract(remark, r"^(\w+) of ", 1).alias("field"), F.concat(F.lit("edited "), F.col("activity_id").cast("string")).alias("value"), F.col("activity_id").alias("edit_no"))
    )
    stored = store.latest(_profiles(spark, sf).select("profile_link", "profile_id", "name", "position", "phd_year", "phd_school", "promotion_year", "user_updated", "stored_at")).drop("stored_at")
    return store.edited(stored, edits.where("profile_link != ''")).where("user_updated = 1").select("profile_link", "name", "position", "phd_year", "user_updated")


def k_export(spark, sf):
    """Export of a department."""
    return store.export(_profiles(spark, sf), DEPARTMENT)


def k_audit(spark, sf):
    """Audit log without repeated deliveries (K4)."""
    return _activities(spark, sf).groupBy("activity_id").agg(F.min("activity_timestamp").alias("activity_timestamp"), F.min("user_id").alias("user_id"), F.min("activity_name").alias("activity_name"))


def k_history(spark, sf):
    """Requests with their metrics as a list and joined again."""
    parts = F.split("metrics", ", ")
    return _benchmarks(spark, sf).select("benchmark_id", F.size(parts).alias("n_metrics"), F.array_join(parts, ", ").alias("metrics"))


def o_preview(spark, sf):
    """First page of a department."""
    return store.page_of(_profiles(spark, sf).select("profile_id", "name", "university", "department"), DEPARTMENT, 18).select("profile_id", "university", "name")


def o_recent_activity(spark, sf):
    """Last five activities of every user (O2)."""
    return store.recent(k_audit(spark, sf), "user_id", "activity_timestamp", "activity_id").select("user_id", "activity_id")


def o_recent_benchmarks(spark, sf):
    """Last five requests of every user (O2)."""
    return store.recent(_benchmarks(spark, sf), "user_id", "benchmark_timestamp", "benchmark_id").select("user_id", "benchmark_id")


def o_scores_sorted(spark, sf):
    """Places by score, missing scores last."""
    scores = ranking.scored(_profiles(spark, sf).drop("text_raw"), PERSON, ["PHD YEAR"])
    return ranking.ranked(scores).where("place <= 25").select("profile_id", "tag", "place")


def a_universities(spark, sf):
    """Distinct universities of a department and tag (A4)."""
    return store.universities_of(_profiles(spark, sf), DEPARTMENT, "peer")


def a_departments_by_count(spark, sf):
    """Values by frequency (A3)."""
    return _profiles(spark, sf).where("department is not null").groupBy("department").agg(F.count("*").alias("n"))


def a_is_empty(spark, sf):
    """Whether any profile is stored (A5)."""
    return _profiles(spark, sf).select("profile_id").limit(1).agg((F.count("*") > 0).alias("any_profile"))


def a_mode_school(spark, sf):
    """The most frequent school of every university's profiles, first on ties (A10)."""
    df = _profiles(spark, sf).where("phd_school is not null and university is not null")
    n = df.groupBy("university", "phd_school").agg(F.count("*").alias("n"))
    return n.groupBy("university").agg(F.min_by("phd_school", F.struct(-F.col("n"), F.col("phd_school"))).alias("phd_school"), F.max("n").alias("n"))


def r_badges(spark, sf):
    """Badges by position and tag."""
    return _profiles(spark, sf).select(
        "profile_id",
        F.when(F.col("position") == "Professor", "primary").when(F.col("position") == "Associate Professor", "info").when(F.col("position") == "Assistant Professor", "secondary").otherwise("light").alias("position_badge"),
        F.when(F.col("tag") == "peer", "success").when(F.col("tag") == "aspirant", "warning").otherwise("light").alias("tag_badge"),
    )


CODES = {"bme": "Biomedical Engineering", "biochem": "Biochemistry", "geo": "Geography"}


def r_codes(spark, sf):
    """Department codes decoded."""
    codes = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    code = F.regexp_extract("profile_link", r"//(bme|biochem|geo)\.", 1)
    return _profiles(spark, sf).where(code != "").select("profile_id", codes[code].alias("department"))


def r_catalogue(spark, sf):
    """Peer and aspirant universities by department."""
    return read_table(spark, sf, "departments").where("tag in ('peer', 'aspirant')").select(F.col("title").alias("department"), "tag", F.col("school_name").alias("university")).distinct()


def r_title_case(spark, sf):
    """Names in title case."""
    return _profiles(spark, sf).where("name is not null").select("profile_id", X.title_case(F.col("name")).alias("name"))


def r_sentinel(spark, sf):
    """Unknown texts as empty ones."""
    t = F.when(F.col("text_raw") == "Unknown", "").otherwise(F.col("text_raw"))
    return _profiles(spark, sf).select("profile_id", t.alias("text_raw"))


def r_cut(spark, sf):
    """Texts cut to 100 characters."""
    return _profiles(spark, sf).where("text_raw is not null").select("profile_id", X.cut(F.col("text_raw"), 100).alias("head"))


def r_truncated(spark, sf):
    """Texts truncated at a word's end."""
    return _profiles(spark, sf).where("text_raw is not null").select("profile_id", X.truncated(F.col("text_raw"), 100).alias("head"))


def r_capitalised(spark, sf):
    """Departments capitalised."""
    return _profiles(spark, sf).where("department is not null").select("profile_id", X.capitalised(F.col("department")).alias("department"))


def x_rank(spark, sf):
    """Ranks with ties as numbers."""
    return _universities(spark, sf).select("university_id", X.rank_number(F.col("rank_raw")).alias("rank"))


def x_years(spark, sf):
    """The first year in a field."""
    return _profiles(spark, sf).select("profile_id", X.year(F.col("phd_year")).alias("phd_year"), X.year(F.col("promotion_year")).alias("promotion_year"))


def x_dates(spark, sf):
    """Dates formatted."""
    return k_audit(spark, sf).select("activity_id", F.date_format("activity_timestamp", "yyyy-MM-dd HH:mm").alias("moment"), F.year("activity_timestamp").alias("year"))


def x_collapsed(spark, sf):
    """White space of names collapsed and removed."""
    n = F.col("phd_school")
    return _profiles(spark, sf).where("phd_school is not null").select("profile_id", X.collapse(n).alias("collapsed"), X.without_space(n).alias("removed"))


def x_person_name(spark, sf):
    """Names without titles, at most three words."""
    return _profiles(spark, sf).select("profile_id", X.person_name(F.col("name")).alias("name"))


def w_duplicates(spark, sf):
    """Repeated deliveries told by link, time and text."""
    df = _profiles(spark, sf).select("profile_id", "profile_link", "crawled_at", F.md5("text_raw").alias("h"))
    place = Window.partitionBy("profile_link", "crawled_at", "h").orderBy("profile_id")
    return df.withColumn("i", F.row_number().over(place)).where("i > 1").select("profile_id", "i")


def j_users_of_requests(spark, sf):
    """Requests with their users' institutions."""
    users = _users(spark, sf).select("user_id", "institution")
    return _benchmarks(spark, sf).select("benchmark_id", "user_id").join(users, "user_id", "left")


def j_edited_profiles(spark, sf):
    """Profiles that an edit names."""
    links = _activities(spark, sf).where("activity_name = 'Edit profile'").select(F.regexp_extract("remark", r" of (\S+)$", 1).alias("profile_link")).where("profile_link != ''")
    return _profiles(spark, sf).select("profile_id", "profile_link").join(links, "profile_link", "left_semi").select("profile_id")


def j_unknown_schools(spark, sf):
    """Departments' schools that the list lacks: must be none."""
    return read_table(spark, sf, "departments").select(F.col("school_name").alias("university")).join(_universities(spark, sf).select("university"), "university", "left_anti").distinct()


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and k[:2] in ("b_", "s_", "u_", "f_", "k_", "o_", "a_", "r_", "x_", "w_", "j_")}
QUERIES["flagship"] = flagship

_Y = "TRY_CAST(nullif(regexp_extract({c}, '(?:19|20)[0-9]{{2}}', 0), '') AS INTEGER)"
_CAND = f"""c AS (SELECT *, abs({_Y.format(c='phd_year')} - 1995) AS dp, abs({_Y.format(c='promotion_year')} - 2023) AS dq FROM profiles WHERE department = 'Biochemistry' AND position = 'Professor'),
y AS (SELECT *, 1 - dp / nullif(CAST((SELECT max(dp) FROM c) AS DOUBLE), 0) AS sp, 1 - dq / nullif(CAST((SELECT max(dq) FROM c) AS DOUBLE), 0) AS sq FROM c)"""
_TWO = f"WITH {_CAND}, s AS (SELECT *, list_avg(list_filter([sp, sq], lambda x: x IS NOT NULL)) AS final_score FROM y)"
_LAST = "row_number() OVER (PARTITION BY tag ORDER BY final_score DESC NULLS LAST, profile_id)"
_AUDIT = "(SELECT activity_id, min(activity_timestamp) AS activity_timestamp, min(user_id) AS user_id, min(activity_name) AS activity_name FROM activities GROUP BY activity_id)"
_STORE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_link ORDER BY coalesce(user_updated, 0) DESC, stored_at DESC NULLS LAST, profile_id DESC) AS i FROM {t}) WHERE i = 1)"
ORACLE = {
    "flagship": f"""{_TWO}, k AS (SELECT *, {_LAST} AS place, count(*) FILTER (WHERE tag = 'peer') OVER () AS p, count(*) FILTER (WHERE tag = 'aspirant') OVER () AS a FROM s WHERE name <> 'Unknown' AND tag IN ('peer', 'aspirant'))
SELECT profile_id, tag, CAST(place AS INTEGER) AS place, round(final_score, 6) AS final_score FROM k
WHERE place <= CASE WHEN tag = 'peer' THEN CASE WHEN p < 6 THEN p WHEN a >= 4 THEN 6 ELSE 10 - a END ELSE CASE WHEN p < 6 THEN 10 - p WHEN a >= 4 THEN 4 ELSE a END END""",
    "b_full_export": f"""WITH {_CAND}, r AS (SELECT lower(university) AS u, min(CAST(split_part(rank_raw, '=', -1) AS INTEGER)) AS rk FROM universities GROUP BY 1),
d AS (SELECT y.*, abs(r.rk - (SELECT rk FROM r WHERE u = 'university of wexaloburg')) AS dr FROM y LEFT JOIN r ON lower(trim(y.phd_school)) = r.u),
s AS (SELECT *, list_avg(list_filter([sp, sq, 1 - dr / nullif(CAST((SELECT max(dr) FROM d) AS DOUBLE), 0)], lambda x: x IS NOT NULL)) AS final_score FROM d)
SELECT profile_id, tag, CAST({_LAST} AS INTEGER) AS place, round(final_score, 6) AS final_score FROM s WHERE tag IN ('peer', 'aspirant')""",
    "b_year_scores": f"WITH {_CAND} SELECT profile_id, round(sp, 6) AS phd_year_score, round(sq, 6) AS promotion_year_score FROM y",
    "s_profiles": "SELECT profile_id, profile_link, name, department, university, tag, position, phd_year, phd_school, promotion_year, user_updated FROM profiles",
    "s_parameters": "SELECT profile_id, university FROM profiles WHERE department = 'Geography' AND tag = 'peer'",
    "s_literal_row": "SELECT 'Biochemistry' AS department, 'Professor' AS position, CAST(1995 AS INTEGER) AS phd_year",
    "u_append_person": "SELECT name, department, tag FROM profiles UNION ALL SELECT 'Query Person', 'Biochemistry', NULL",
    "f_person_split": "SELECT profile_id FROM profiles WHERE tag IS NULL",
    "f_candidates": "SELECT profile_id, name FROM profiles WHERE department = 'Biochemistry' AND position = 'Professor'",
    "f_known_by_tag": "SELECT tag, count(*) AS n FROM profiles WHERE name <> 'Unknown' AND tag IN ('peer', 'aspirant') GROUP BY tag",
    "f_isin": "SELECT profile_id, position FROM profiles WHERE position IN ('Professor', 'Associate Professor')",
    "f_incomplete": "SELECT profile_id FROM profiles WHERE name = 'Unknown' OR phd_year = 'Unknown' OR phd_school = 'Unknown' OR promotion_year = 'Unknown' OR text_raw = ''",
    "u_incomplete_union": "SELECT profile_id FROM profiles WHERE name = 'Unknown' UNION SELECT profile_id FROM profiles WHERE phd_year = 'Unknown' UNION SELECT profile_id FROM profiles WHERE phd_school = 'Unknown' UNION SELECT profile_id FROM profiles WHERE promotion_year = 'Unknown' UNION SELECT profile_id FROM profiles WHERE text_raw = ''",
    "k_latest": f"SELECT profile_link, profile_id, name FROM {_STORE.format(t='profiles')}",
    "k_upsert": f"""WITH o AS {_STORE.format(t="(SELECT * FROM profiles WHERE crawled_at < TIMESTAMP '2022-06-01')")}, n AS {_STORE.format(t="(SELECT * FROM profiles WHERE crawled_at >= TIMESTAMP '2022-06-01')")}
SELECT profile_link, o.profile_id, o.name, o.user_updated FROM o LEFT JOIN n USING (profile_link) WHERE n.profile_id IS NULL OR o.user_updated = 1
UNION ALL SELECT profile_link, n.profile_id, n.name, CAST(0 AS INTEGER) FROM n LEFT JOIN o USING (profile_link) WHERE o.profile_id IS NULL OR o.user_updated IS NULL OR o.user_updated <> 1""",
    "k_edits": f"""WITH e AS (SELECT regexp_extract(remark, ' of (\\S+)$', 1) AS profile_link, regexp_extract(remark, '^(\\w+) of ', 1) AS field, max(activity_id) AS id FROM activities WHERE activity_name = 'Edit profile' AND remark IS NOT NULL GROUP BY 1, 2),
w AS (SELECT profile_link, {', '.join(f"max(CASE WHEN field = '{f}' THEN id END) AS {f}" for f in store.EDITABLE)} FROM e WHERE field IN {store.EDITABLE} GROUP BY 1),
s AS {_STORE.format(t='profiles')}
SELECT profile_link, coalesce('edited ' || w.name, s.name) AS name, coalesce('edited ' || w.position, s.position) AS position, coalesce('edited ' || w.phd_year, s.phd_year) AS phd_year, CAST(1 AS INTEGER) AS user_updated
FROM s LEFT JOIN w USING (profile_link) WHERE s.user_updated = 1 OR w.profile_link IS NOT NULL""",
    "k_export": "SELECT name, department, university, tag, position, phd_year, phd_school, promotion_year, text_raw AS research_area FROM profiles WHERE department = 'Geography'",
    "k_audit": f"SELECT * FROM {_AUDIT}",
    "k_history": "SELECT benchmark_id, CAST(len(string_split(metrics, ', ')) AS INTEGER) AS n_metrics, metrics FROM benchmarks",
    "o_preview": "SELECT profile_id, university, name FROM profiles WHERE department = 'Geography' ORDER BY university NULLS FIRST, name NULLS FIRST, profile_id LIMIT 18",
    "o_recent_activity": f"SELECT user_id, activity_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY activity_timestamp DESC NULLS LAST, activity_id DESC) AS i FROM {_AUDIT} WHERE user_id IS NOT NULL) WHERE i <= 5",
    "o_recent_benchmarks": "SELECT user_id, benchmark_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY benchmark_timestamp DESC NULLS LAST, benchmark_id DESC) AS i FROM benchmarks WHERE user_id IS NOT NULL) WHERE i <= 5",
    "o_scores_sorted": f"WITH {_CAND}, s AS (SELECT *, sp AS final_score FROM y), k AS (SELECT profile_id, tag, CAST({_LAST} AS INTEGER) AS place FROM s WHERE tag IN ('peer', 'aspirant')) SELECT * FROM k WHERE place <= 25",
    "a_universities": "SELECT DISTINCT university FROM profiles WHERE department = 'Geography' AND tag = 'peer'",
    "a_departments_by_count": "SELECT department, count(*) AS n FROM profiles WHERE department IS NOT NULL GROUP BY department",
    "a_is_empty": "SELECT count(*) > 0 AS any_profile FROM profiles",
    "a_mode_school": "SELECT university, phd_school, n FROM (SELECT *, row_number() OVER (PARTITION BY university ORDER BY n DESC, phd_school) AS i FROM (SELECT university, phd_school, count(*) AS n FROM profiles WHERE phd_school IS NOT NULL AND university IS NOT NULL GROUP BY 1, 2)) WHERE i = 1",
    "r_badges": "SELECT profile_id, CASE position WHEN 'Professor' THEN 'primary' WHEN 'Associate Professor' THEN 'info' WHEN 'Assistant Professor' THEN 'secondary' ELSE 'light' END AS position_badge, CASE tag WHEN 'peer' THEN 'success' WHEN 'aspirant' THEN 'warning' ELSE 'light' END AS tag_badge FROM profiles",
    "r_codes": "SELECT profile_id, CASE regexp_extract(profile_link, '//(bme|biochem|geo)\\.', 1) WHEN 'bme' THEN 'Biomedical Engineering' WHEN 'biochem' THEN 'Biochemistry' WHEN 'geo' THEN 'Geography' END AS department FROM profiles WHERE regexp_matches(profile_link, '//(bme|biochem|geo)\\.')",
    "r_catalogue": "SELECT DISTINCT title AS department, tag, school_name AS university FROM departments WHERE tag IN ('peer', 'aspirant')",
    "r_sentinel": "SELECT profile_id, CASE WHEN text_raw = 'Unknown' THEN '' ELSE text_raw END AS text_raw FROM profiles",
    "r_cut": "SELECT profile_id, substring(text_raw, 1, 100) AS head FROM profiles WHERE text_raw IS NOT NULL",
    "r_truncated": "SELECT profile_id, CASE WHEN length(text_raw) <= 100 THEN text_raw ELSE CASE WHEN h = '' THEN substring(text_raw, 1, 97) ELSE h END || '...' END AS head FROM (SELECT *, regexp_extract(substring(text_raw, 1, 97), '(?s)^(.*)\\s', 1) AS h FROM profiles WHERE text_raw IS NOT NULL)",
    "r_capitalised": "SELECT profile_id, upper(department[1]) || lower(department[2:]) AS department FROM profiles WHERE department IS NOT NULL",
    "x_rank": "SELECT university_id, TRY_CAST(split_part(rank_raw, '=', -1) AS INTEGER) AS rank FROM universities",
    "x_years": f"SELECT profile_id, {_Y.format(c='phd_year')} AS phd_year, {_Y.format(c='promotion_year')} AS promotion_year FROM profiles",
    "x_dates": f"SELECT activity_id, strftime(activity_timestamp, '%Y-%m-%d %H:%M') AS moment, CAST(year(activity_timestamp) AS INTEGER) AS year FROM {_AUDIT}",
    "x_collapsed": "SELECT profile_id, trim(regexp_replace(phd_school, '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g')) AS collapsed, regexp_replace(phd_school, '[\\s\\x0b\\x{85}\\p{Z}]+', '', 'g') AS removed FROM profiles WHERE phd_school IS NOT NULL",
    "r_title_case": "SELECT profile_id, array_to_string(list_transform(regexp_extract_all(name, '\\p{L}+|\\P{L}+'), lambda x: CASE x[1] WHEN 'ß' THEN 'Ss' ELSE upper(x[1]) END || lower(x[2:])), '') AS name FROM profiles WHERE name IS NOT NULL",
    "x_person_name": "SELECT profile_id, CASE WHEN trim(name) = '' THEN 'Unknown' WHEN lower(w[1]) IN ('prof.', 'dr.', 'prof', 'dr', 'professor') THEN array_to_string(w[2:3], ' ') ELSE array_to_string(w[1:3], ' ') END AS name FROM (SELECT *, string_split(regexp_replace(name, '\\(\\d+\\)', '', 'g'), ' ') AS w FROM profiles)",
    "w_duplicates": "SELECT profile_id, CAST(i AS INTEGER) AS i FROM (SELECT profile_id, row_number() OVER (PARTITION BY profile_link, crawled_at, md5(text_raw) ORDER BY profile_id) AS i FROM profiles) WHERE i > 1",
    "j_users_of_requests": "SELECT benchmark_id, b.user_id, institution FROM benchmarks b LEFT JOIN users u ON b.user_id = u.user_id",
    "j_edited_profiles": "SELECT profile_id FROM profiles WHERE profile_link IN (SELECT regexp_extract(remark, ' of (\\S+)$', 1) FROM activities WHERE activity_name = 'Edit profile' AND remark IS NOT NULL)",
    "j_unknown_schools": "SELECT DISTINCT school_name AS university FROM departments WHERE school_name NOT IN (SELECT university FROM universities)",
}
