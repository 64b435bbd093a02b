import datetime as dt

import pytest
from pyspark.sql import functions as F

from scholarforge.operators import crawl, ranking, research, store
from scholarforge.operators.ranking import Person
from scholarforge.sources import readers, sinks
from scholarforge.streaming import ingest

P = "profile_id long, name string, department string, position string, tag string, phd_year string, promotion_year string, phd_school string"
WHO = Person("D", "P", 2000, 2020, "University of A")


def _people(spark, peers, asps, year=lambda i: str(1990 + i)):
    rows = [(i, f"N{i}", "D", "P", "peer", year(i), "2001", None) for i in range(peers)] + [(100 + i, f"M{i}", "D", "P", "aspirant", year(i), "2001", None) for i in range(asps)]
    return spark.createDataFrame(rows, P)


@pytest.mark.parametrize("p, a, want", [(6, 4, (6, 4)), (7, 9, (6, 4)), (5, 9, (5, 5)), (5, 2, (5, 2)), (9, 3, (7, 3)), (0, 0, (0, 0)), (0, 12, (0, 10))])
def test_quota(spark, p, a, want):
    got = ranking.preview(ranking.scored(_people(spark, p, a), WHO, ["PHD YEAR"])).groupBy("tag").count().collect()
    n = {r["tag"]: r["count"] for r in got}
    assert (n.get("peer", 0), n.get("aspirant", 0)) == want


def test_scores(spark):
    flat = ranking.scored(_people(spark, 3, 0, lambda i: "1995"), WHO, ["PHD YEAR"]).collect()
    assert {r["final_score"] for r in flat} == {0.0}  # all as far away: 1 - 5 / 5
    same = ranking.scored(_people(spark, 3, 0, lambda i: "2000"), WHO, ["PHD YEAR"]).collect()
    assert {r["final_score"] for r in same} == {None}  # largest difference 0
    unknown = ranking.scored(_people(spark, 3, 0, lambda i: "Unknown"), WHO, ["PHD YEAR", "PROMO YEAR"]).collect()
    assert all(r["phd_year_score"] is None for r in unknown)
    with pytest.raises(ValueError):
        ranking.scored(_people(spark, 1, 1), WHO, ["AGE"])


def test_school_ranks(spark):
    unis = spark.createDataFrame([("University of A", "1"), ("B Institute", "=10")], "university string, rank_raw string")
    rows = spark.createDataFrame([("University of A",), ("A, University of",), ("B Institut",), ("Zzz",), ("Unknown",), (None,)], "phd_school string")
    fuzzy = {r[0]: r[1] for r in ranking.school_ranks(rows, unis, True).collect()}
    assert fuzzy["University of A"] == 1 and fuzzy["A, University of"] == 1 and fuzzy["B Institut"] == 10 and fuzzy["Zzz"] == -1 and len(fuzzy) == 4


def test_school_names_are_spread_over_tasks(spark):
    unis = spark.createDataFrame([("University of A", "1")], "university string, rank_raw string")
    rows = spark.range(400).select(F.concat(F.lit("School "), F.col("id").cast("string")).alias("phd_school"))
    ranks = ranking.school_ranks(rows, unis, True).withColumn("task", F.spark_partition_id())
    assert ranks.groupBy("task").count().where("count > 50").count() == 4  # few bytes, which adaptive execution would put into one task


S = "profile_link string, name string, position string, user_updated int"


def test_upsert(spark):
    old = spark.createDataFrame([("a", "A", "x", 0), ("b", "B", "x", 1), ("c", "C", "x", 0)], S)
    new = spark.createDataFrame([("a", "A2", "y", 1), ("b", "B2", "y", 0), ("d", "D", "y", 1)], S)
    once = store.protected_upsert(old, new)
    want = {("a", "A2", "y", 0), ("b", "B", "x", 1), ("c", "C", "x", 0), ("d", "D", "y", 0)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in store.protected_upsert(once, new).collect()} == want
    assert store.protected_upsert(old.limit(0), new.limit(0)).count() == 0


def test_edits_and_recent(spark):
    old = spark.createDataFrame([("a", "A", "x", 0), ("b", "B", "x", 0)], S)
    edits = spark.createDataFrame([("a", "name", "N1", 1), ("a", "name", None, 2), ("b", "user_updated", "9", 3)], "profile_link string, field string, value string, edit_no int")
    assert {tuple(r) for r in store.edited(old, edits).collect()} == {("a", None, "x", 1), ("b", "B", "x", 0)}
    log = spark.createDataFrame([(1, i, i % 3) for i in range(9)] + [(None, 9, 9)], "user int, id int, t int")
    assert [r["id"] for r in store.recent(log, "user", "t", "id", 2).orderBy("id").collect()] == [5, 8]


def test_incomplete_ignores_null(spark):
    rows = [(1, "Unknown", "1", "s", "1", "t"), (2, None, None, None, None, None), (3, "a", "1", "s", "1", "")]
    df = spark.createDataFrame(rows, "profile_id int, name string, phd_year string, phd_school string, promotion_year string, text_raw string")
    assert {r[0] for r in store.incomplete(df).select("profile_id").collect()} == {1, 3}


def test_numbering_and_counter(spark):
    df = spark.createDataFrame([("p", "a", 1), ("p", "a", 2), ("p", "b", 3), ("p", "a", 4)], "page string, t string, pos int")
    assert [r["label"] for r in crawl.numbered(df, ["page"], "t", "pos").orderBy("pos").collect()] == ["a(1)", "a(2)", "b", "a(3)"]
    hits = crawl.counted(spark.range(12).withColumn("s", F.lit("x")), "s", "id")
    assert hits.where("needs_match").count() == 3


def test_new_on_page_falls_back(spark):
    cur = spark.createDataFrame([("p", "u/", "A"), ("p", "v", "B"), ("q", "w", "C")], "page string, link string, text string")
    anc = spark.createDataFrame([("p", "u", "Z"), ("q", "w", "C")], "page string, link string, text string")
    assert {tuple(r) for r in crawl.new_on_page(cur, anc).collect()} == {("p", "v", "B"), ("q", "w", "C")}


def test_reach_and_patterns(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f")], "previous_link string, link string")
    got = {r["link"]: r["depth"] for r in crawl.reach(spark.createDataFrame([("a",)], "link string"), edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    pages = spark.createDataFrame([("s", f"http://{h}.org/people/x{i}") for i, h in enumerate("aabbc")], "start string, link string")
    p = crawl.patterns(pages, "start").first()
    assert p["netlocs"] == ["a.org", "b.org"] and p["paths"] == ["people"]
    with pytest.raises(ValueError):
        crawl.start_rows(spark.createDataFrame([("u", "t", "s", "peer")], "url string, title string, school_name string, tag string"), "SELECTED", ["none"], "t")


def test_navigation_scores():
    assert crawl.target_score("Our Staff", crawl.PEOPLE_TARGETS) > crawl.target_score("Library", crawl.PEOPLE_TARGETS)
    assert crawl.target_score("People(2)", crawl.PEOPLE_TARGETS) == 1.0


@pytest.mark.parametrize("tags, want", [("NOUN NOUN", ["w1"]), ("ADJ NOUN", ["w0 w1"]), ("PROPN PROPN", ["w0 w1"]), ("ADJ ADJ NOUN VERB NOUN", ["w4", "w0 w1 w2"])])
def test_noun_phrases(tags, want):
    assert research.noun_phrases([(f"w{i}", t) for i, t in enumerate(tags.split())]) == want


def test_research_scores(spark):
    texts = ["Membrane fusion in cultured neurons. Protein folding in yeast.", "Membrane fusion in yeast. Protein folding.", "Urban heat in river deltas.", "", None, "Unknown"]
    df = spark.createDataFrame(list(enumerate(texts)), "profile_id long, text_raw string")
    got = {r["profile_id"]: r for r in research.research_scores(df, "profile_id", 0, topics=3).collect()}
    assert len(got) == 6 and got[1]["keyword_score"] > got[2]["keyword_score"] and got[3]["keyword_score"] == 0


def test_bigrams(spark):
    sent = [["new", "york", "is", "big"], ["new", "york", "city"]] * 6 + [["a", "b"]]
    df = spark.createDataFrame([(1, sent)], "id int, sentences array<array<string>>")
    scores = research.bigram_scores(df, threshold=0.01)
    assert ("new", "york") in {(r["a"], r["b"]) for r in scores.collect()}
    assert research.joined_bigrams(df, "id", scores).first()["phrases"][0][0] == "new_york"


def test_closest_words(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "word string, vector array<double>")
    assert [r["word"] for r in research.closest_words(v, ["a"]).collect()] == ["b", "c"]
    assert research.closest_words(v, ["none"]).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"A": {"Homepage": "h", "Rank": "=2"}, "B": {"Homepage": "g", "Rank": "1"}}')
    got = readers.json_by_key(spark, str(tmp_path / "u.json"), "Homepage string, Rank string", "university").orderBy("university").collect()
    assert [tuple(r) for r in got] == [("A", "h", "=2"), ("B", "g", "1")]
    (tmp_path / "d.csv").write_bytes('Name,URL,XPATH,Remark,"Department or Faculty"\n"Zo\xeb, X",u,-,l1; l2,D\n\nY,v,//a,,D\nZ,w,,,D\n'.encode("latin-1"))
    rows = readers.csv_table(spark, str(tmp_path / "d.csv"), readers.LISTING, "ISO-8859-1")
    assert {tuple(r) for r in crawl.expanded_rows(rows).collect()} == {("Zoë, X", "l1"), ("Zoë, X", "l2"), ("Y", "v")}
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.json_records(spark, str(tmp_path / "r.json"), "a int").count() == 2
    (tmp_path / "x.pdf").write_bytes(b"one two")
    assert readers.binary_texts(spark, str(tmp_path / "x.pdf"), lambda b: b.decode()).first()["tokens"] == ["one", "two"]
    pages = spark.createDataFrame([(1, ["A", "B"], ["1", "=2"], ["u"])], "page_no int, titles array<string>, ranks array<string>, links array<string>")
    assert readers.ranking_batches(pages).count() == 1
    assert readers.newest_ranking(spark.createDataFrame([("a-2015",), ("b-2018",), ("c",)], "link string")).first()["year"] == 2018
    sinks.append_audit(spark, str(tmp_path / "audit"), 1, "Login", None, "2022-01-01 10:00:00")
    sinks.append_audit(spark, str(tmp_path / "audit"), 2, "Export", "x", "2022-01-01 10:00:00")
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    df = spark.createDataFrame([("a", "A", "x", 0)], S)
    for _ in range(2):
        sinks.upsert_folder(spark, str(tmp_path / "store"), df)
    assert sinks.read_store(spark, str(tmp_path / "store")).count() == 1 and sinks.read_store(spark, str(tmp_path / "none")) is None
    sinks.set_process(spark, str(tmp_path / "process"), "core", True)
    sinks.export_csv(df, str(tmp_path / "csv"))
    sinks.ranking_json(df, str(tmp_path / "json"))
    assert readers.csv_table(spark, str(tmp_path / "csv"), S).count() == 1


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "profile_id long, profile_link string, name string, user_updated int, stored_at timestamp"
    rows = [(i, f"l{i % 3}", f"n{i}", 0, dt.datetime(2022, 1, 1) + dt.timedelta(days=i)) for i in range(9)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(src)
    ingest.into_store(ingest.page_stream(spark, src, schema, 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sinks.read_store(spark, str(tmp_path / "out")).count() == 3
    q = ingest.counted_stream(ingest.page_stream(spark, src, schema), "profile_link", "name", 3).writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select max(hit_no), sum(int(needs_match)) from counted").first()[:] == (3, 3)


def test_store_rewrites_only_what_is_touched(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.upsert_folder(spark, path, spark.createDataFrame([(f"l{i}", "A", "x", int(i == 1)) for i in range(40)], S), buckets=8)
    before = sinks._current(spark, path)[1]
    sinks.upsert_folder(spark, path, spark.createDataFrame([("l1", "B", "y", 0), ("l2", "B", "y", 0), ("new", "C", "z", 1)], S), buckets=8)
    got = {r["profile_link"]: r for r in sinks.read_store(spark, path).collect()}
    assert len(got) == 41 and got["l1"][1] == "B" and got["l2"][1] == "B" and got["new"]["user_updated"] == 0 and got["l3"][1] == "A"
    after = sinks._current(spark, path)[1]
    assert 5 <= sum(after[b] == v for b, v in before.items()) < 8
    # a crash before the switch leaves the store as it was
    spark.createDataFrame([("l9", "Z", "z", 0)], S).write.parquet(f"{path}/data/version=3/bucket=0")
    assert sinks.read_store(spark, path).count() == 41
    sinks.upsert_folder(spark, path, spark.createDataFrame([("l9", "D", "z", 0)], S), buckets=8)
    assert sinks.read_store(spark, path).where("profile_link = 'l9'").count() == 1 and sinks.read_store(spark, path).count() == 41


def test_ranges_are_numbered_like_one_list(spark):
    rows = [(i, "peer" if i % 3 else "aspirant", None if i % 7 == 0 else (i * 37 % 50) / 50.0, "n") for i in range(200)] + [(500, None, 0.5, "n")]
    scores = spark.createDataFrame(rows, "profile_id long, tag string, final_score double, name string")
    got = {tuple(r) for r in ranking.ranked(scores).select("profile_id", "place").collect()}
    assert got == {tuple(r) for r in ranking._placed(scores, "profile_id").select("profile_id", "place").collect()} and len(got) == 200
    assert ranking.ranked(scores.limit(0)).count() == 0
