"""Steps of the crawl and the reading of pages, on small tables with edge cases."""

import pytest
from pyspark.sql import functions as F

from scholarforge.functions import extract
from scholarforge.operators import crawl, navigation


def test_answered(spark):
    asked = spark.createDataFrame([(1, "http://a.x/p"), (2, "http://a.x/q"), (3, "http://a.x/r"), (4, None), (5, "http://a.x/s")], "id int, link string")
    pages = spark.createDataFrame([("http://a.x/p", 200, "http://a.x/p"), ("http://a.x/q", 404, "http://a.x/q"), ("http://a.x/r", 200, "http://a.x/news/1"), ("http://a.x/s", 200, "http://a.x/t")], "link string, status int, url string")
    got = {(r["id"], r["redirected"]) for r in navigation.answered(asked, pages).collect()}
    assert got == {(1, False), (5, True)}


def test_menu_step_takes_three_a_target_and_falls_back(spark):
    menu = [("p", f"http://a.x/{i}", t) for i, t in enumerate(("People", "People(2)", "People(3)", "People(4)", "Library"))] + [("q", "http://b.x/1", "Cafeteria"), ("q", None, "People"), ("q", "http://b.x/news/2", "Staff")]
    anchors = [("q", "http://b.x/3", "Our people"), ("p", "http://a.x/9", "Staff")]
    make = lambda rows: spark.createDataFrame(rows, "page string, link string, text string")
    got = sorted((r["page"], r["link"], r["kind"]) for r in navigation.menu_step(make(menu), make(anchors), "page", "link", "text").collect())
    assert got == [("p", "http://a.x/0", "PEOPLE"), ("p", "http://a.x/1", "PEOPLE"), ("p", "http://a.x/2", "PEOPLE"), ("q", "http://b.x/3", "PEOPLE")]
    assert navigation.menu_step(make([]), make([]), "page", "link", "text").count() == 0


def test_department_step(spark):
    rows = [(1, "http://a.x/d/geo/staff", "http://a.x/d", 2), (2, "http://a.x/d", "http://a.x/d/geo", 2), (3, "http://a.x/d", "http://b.x/d/geo", 2), (4, "http://a.x/d", "http://a.x/d/y.pdf", 2), (5, "http://a.x/d", None, 2)]
    got = {r["id"]: (r["step"], r["next_depth"]) for r in navigation.department_step(spark.createDataFrame(rows, "id int, page string, link string, depth int"), "page", "link", "depth").collect()}
    assert got == {1: ("menu", -1), 2: ("department", 2), 3: ("menu", -1)}


def test_accepted_needs_the_pattern_from_the_tenth_on(spark):
    rows = [(i, "s", f"http://a.x/people/p{i}") for i in range(12)] + [(12, "s", "http://a.x/other/p"), (13, "s", "http://b.x/people/p"), (14, None, "http://c.x/people/p")]
    got = {r["id"] for r in navigation.accepted(spark.createDataFrame(rows, "id int, start string, link string"), "start", "id", "link").collect()}
    assert got == {*range(12), 14}


def test_person_pages(spark):
    rows = [(1, "Ann Lee", "x", "x", ["a"], 2), (2, "More", "Geo - Ann Lee", "Geo - Staff", ["a"], 2), (3, "More", "Geo", "Geo", ["Research interests"], 2), (4, "Ann Lee", "x", "x", ["a"], 1), (5, "More", None, None, ["a"], 3)]
    df = spark.createDataFrame(rows, "id int, link_title string, title string, before string, lines array<string>, depth int")
    got = {r["id"]: r["p"] for r in df.select("id", navigation.is_person_page(F.col("link_title"), F.col("title"), F.col("before"), F.col("lines"), F.col("depth")).alias("p")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_without_menu_and_merged(spark):
    make = lambda rows, s: spark.createDataFrame(rows, s)
    menu = make([("p", "l1", "A"), ("p", "l2", "B")], "page string, link string, text string")
    anchors = make([("p", "l1", "A"), ("p", "l1", "C"), ("p", "l3", "B"), ("p", "l1", "B"), ("q", "l1", "A")], "page string, link string, text string")
    assert sorted((r["page"], r["link"], r["text"]) for r in navigation.without_menu(anchors, menu, "page", "link", "text").collect()) == [("p", "l1", "C"), ("p", "l3", "B"), ("q", "l1", "A")]
    left, right = make([("a", 1), ("b", 2), ("b", 3)], "k string, v int"), make([("b", 9), ("c", None)], "k string, v int")
    assert {tuple(r) for r in navigation.merged(left, right, "k").collect()} == {("a", 1), ("b", 9), ("c", None)}


def test_names_of_anchors_and_known_words(spark):
    anchors = spark.createDataFrame([(1, "http://a.x/x", " Staff  list "), (2, "http://a.x/y", ""), (3, "http://a.x/our-people/list.html?x=1", None)], "id int, link string, text string")
    first = spark.createDataFrame([("http://a.x/y", "About us"), ("http://a.x/our-people/list.html?x=1", "(2)")], "link string, first_text string")
    assert {r["id"]: r["name"] for r in navigation.anchor_names(anchors, "link", "text", first).collect()} == {1: "Staff list", 2: "About us", 3: "our people list x 1"}
    words = spark.createDataFrame([("people",), ("people",)], "word string")
    titles = spark.createDataFrame([(1, "People"), (2, "BME Staff 12 x"), (3, "")], "id int, t string")
    assert {r["id"]: r["normalised"] for r in navigation.known_words(titles, "id", "t", words).collect()} == {1: "People", 2: "Staff x", 3: ""}


def test_schools_of_resumes(spark):
    colleges = ["University of Abrin", "Velk Institute of Technology"]
    pages = [(1, ["Ph.D., Univeristy of Abrin, 1999", "Lecturer at Oster School"]), (2, ["Education", "PhD 1998", "Velk Institute of Technology"]), (3, ["PhD student, University of Abrin"]), (4, []), (5, None), (6, ["PhD, University of Nowhereland Xyz"])]
    got = {r["id"]: r["phd_school"] for r in navigation.cv_schools(spark.createDataFrame(pages, "id int, lines array<string>"), "id", "lines", colleges).collect()}
    assert got[2] == "Velk Institute of Technology" and got[3] == got[4] == got[5] == "Unknown" and len(got) == 6


@pytest.mark.parametrize("text, want", [
    ("PhD, University of Abrin, 1999\n\nProfessor at Velk Institute since 2010", (1999, "University of Abrin", 2010)),
    ("Ph.D.\nUniversity of Abrin\n1999", (1999, "University of Abrin", None)),
    ("PhD, MIT, 1999", (1999, "Unknown", None)),
    ("PhD 1999", (None, "Unknown", None)),
    ("", (None, "Unknown", None)),
])
def test_key_info(spark, text, want):
    y, s, p = extract.key_info(F.col("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(y, s, p).first()) == want
