from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholarforge.functions import extract, fuzzy, html, urls, vectors
from scholarforge.functions import text as X


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize("name", ["leader-williams", "o'brien", "3rd", "ÉLVIRA ñu", "", "a b  c"])
def test_title_case_as_python(spark, name):
    assert one(spark, name, X.title_case) == name.title()


@pytest.mark.parametrize("value, want", [("Prof Jane Q Doe", "Jane Q"), ("Dr. X", "X"), ("  ", "Unknown"), ("Name(2)", "Name"), ("A B C D", "A B C")])
def test_person_name(spark, value, want):
    assert one(spark, value, X.person_name) == want


def test_text_rules(spark):
    assert one(spark, " a  \n b ", X.collapse) == "a b"
    assert one(spark, "a b\tc", X.without_space) == "abc"
    assert one(spark, "t(10)", lambda c: X.without_number(c, False)) == "t(10)" and one(spark, "t(10)", X.without_number) == "t"
    assert one(spark, "The NUS (UK) page !", X.calm_capitals) == "The Nus (uk) page"
    assert one(spark, "word " * 40, lambda c: X.truncated(c, 20)) == "word word word..."
    assert one(spark, "=10", X.rank_number) == 10 and one(spark, None, X.rank_number) is None
    assert one(spark, "1. a\n- b", X.list_items_joined) == " a.  b"


def test_links(spark):
    link = "https://www.bme.x.ac.uk:8080/a/Lab-x/p.html?q=1#f"
    assert one(spark, link, urls.netloc) == "www.bme.x.ac.uk:8080"
    assert one(spark, link, urls.path_parts) == ["a", "Lab-x", "p.html"] and one(spark, link, urls.parent_path) == "a/Lab-x"
    assert one(spark, link, urls.registered_domain) == "x.ac.uk"
    assert one(spark, link, urls.has_keyword) and one(spark, link, urls.has_fragment)
    assert not one(spark, "https://x.org/people/ann", urls.has_keyword) and one(spark, "https://x.org/news/1", urls.has_keyword)
    assert one(spark, "https://x.org/a/CV.PDF", urls.is_file) and one(spark, "https://x.org/my-cv.pdf", urls.is_resume)
    assert one(spark, "https://x.org/a-b/c.html?x=b", urls.link_label) == "a b c x"
    assert spark.createDataFrame([("https://x.org/a/b", "../c"), (None, "x")], "b string, l string").select(urls.absolute("b", "l")).collect()[0][0] == "https://x.org/c"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20), st.text(max_size=20))
def test_ratio_is_difflibs(a, b):
    assert fuzzy.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    part = fuzzy.common_part(a, b)
    assert part in a and part in b
    assert 0 <= fuzzy.weighted_ratio(a, b) <= 100


def test_weighted_ratio():
    assert fuzzy.weighted_ratio("University of X", "university of x") == 100
    assert fuzzy.weighted_ratio("X, University of", "University of X") >= 90
    assert fuzzy.weighted_ratio("University of Abcde", "Zzz Polytechnic") < 60


def _weighted(a, b):
    """The weighted ratio with every comparison made."""
    a, b = fuzzy._plain(a), fuzzy._plain(b)
    if not a or not b:
        return 0
    s, t = set(a.split()), set(b.split())
    join = lambda words: " ".join(sorted(words))
    both = join(s & t)
    x, y = f"{both} {join(s - t)}".strip(), f"{both} {join(t - s)}".strip()
    long = max(len(a), len(b)) / min(len(a), len(b))
    score = fuzzy._percent if long < 1.5 else fuzzy._partial
    weight = 1 if long < 1.5 else 0.6 if long > 8 else 0.9
    tokens = 0.95 * weight * max(score(join(a.split()), join(b.split())), score(both, x), score(both, y), score(x, y))
    return round(max(fuzzy._percent(a, b), weight * score(a, b), tokens))


_NAME = st.lists(st.sampled_from("university of the oska oskar by st uni é".split()), max_size=6).map(" ".join) | st.text("ab cÉ-", max_size=14) | st.text("abcdefghij ", min_size=198, max_size=204)


@settings(max_examples=100, deadline=None)
@given(_NAME, st.lists(_NAME, max_size=5), st.sampled_from([0, 60, 85, 90, 95, 100]))
def test_closest_is_that_of_all_comparisons(value, choices, least):
    scores = [_weighted(value, c) for c in choices]
    assert [fuzzy.weighted_ratio(value, c) for c in choices] == scores
    want = choices[scores.index(max(scores))] if choices and max(scores) >= least else None
    assert fuzzy.Closest(choices, least)(value) == want


def test_closest_compares_few(monkeypatch):
    made = []
    monkeypatch.setattr(fuzzy, "SequenceMatcher", lambda *a: made.append(a) or SequenceMatcher(*a))
    towns = [f"{a}{b}" for a in ("Osk", "Marn", "Vel", "Quen", "Tharn", "Yarne", "Lumb", "Drunn", "Cor", "Zel") for b in ("reby", "holt", "stad", "dior", "mere", "burg", "haven")]
    listed = [f"University of {t}" for t in towns] + [f"{t} State University" for t in towns]
    closest = fuzzy.Closest(listed, 90)
    assert [closest(n.replace("University", "Univeristy")) for n in listed] == listed
    assert closest("Nowhere Polytechnic") is None
    assert len(made) < 10 * len(listed)  # of 140 entries for each name, by up to five comparisons


def test_vectors(spark):
    df = spark.createDataFrame([([0.9, 0.5, 0.1],)], "s array<double>")
    low, high, none = df.select(F.round(vectors.lowest_mean(F.col("s"), 2), 6), F.round(vectors.highest_mean(F.col("s"), 2), 6), vectors.mean_known(F.lit(None).cast("double"))).first()
    assert (low, high, none) == (0.3, 0.7, None)
    assert df.select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] is None
    assert df.select(vectors.closeness(F.lit(0), F.lit(0))).first()[0] is None
    assert df.select(F.round(vectors.blended(F.lit(0.5), F.lit(0.6)), 6)).first()[0] == 0.52


@pytest.mark.parametrize("title, lines, want", [
    ("Asst Prof X", [], "Assistant Professor"), ("Assoc Prof X", [], "Associate Professor"), ("X", ["Associate Professor", "Assistant Professor"], "Assistant Professor"),
    ("X", ["Associate Professor of Y"], "Associate Professor"), ("X", ["Professor"], "Professor"), ("X", ["Reader"], "Non-Professor"), (None, ["Associate Prof. of Y", "Prof. Smith"], "Professor"),
])
def test_positions(spark, title, lines, want):
    df = spark.createDataFrame([(title, lines)], "t string, l array<string>")
    assert df.select(extract.position(F.col("t"), F.col("l"))).first()[0] == want


def test_key_information(spark):
    df = spark.createDataFrame([(["PhD, University of X, 1994 and 1996", "Professor at Y University since 2001", "other"],), (["PhD MIT 1990"],), ([],)], "l array<string>")
    got = [tuple(r) for r in df.select(extract.phd_year("l"), extract.phd_school("l"), extract.promotion_year("l")).collect()]
    assert got == [(1996, "University of X", 2001), (1990, "Unknown", None), (None, "Unknown", None)]
    split = spark.createDataFrame([(["1989", "Ph.D.", "1990 student"],)], "l array<string>")
    assert split.select(extract.resume_year(F.col("l"), extract.PHD)).first()[0] == 1989


PAGE = """<html><head><title>Ann Lee</title><style>x</style></head><body><div class="mainmenu"><ul><li><a href="/p">People</a><li><a href="#top">Top</a></ul></div>
<h1>Ann <b>Lee</b></h1><p>First<p>Second<br>line<ol><li>one<li>two</ol><table><tr><td>a<td>bbbb<tr><td>cccc<td>d</table><span hidden>no</span><iframe src="f.html"></iframe></body></html>"""


def test_page():
    got = html.read_page("https://x.org/a/", PAGE)
    anchors, frames, title, h1 = got[:4]
    assert [(a[1], a[2]) for a in anchors] == [("People", "https://x.org/p")] and "menu" in anchors[0][3]
    assert frames == ["https://x.org/a/f.html"] and title == ["Ann Lee"] and h1 == ["Ann Lee"]
    assert got[9].split("\n")[-2:] == ["a     bbbb", "cccc  d"] and "1. one\n2. two" in got[9] and "no" not in got[9].split()
    assert html.read_page(None, None)[0] == [] and html.read_page("", "<p>a<b>c")[9] == "ac"


def test_entities_and_names(spark):
    df = spark.createDataFrame([("People", "Staff page", ["Welcome", "Dr Ann Lee of Xby"]), ("Ann Lee", "", []), (None, None, [])], "t string, p string, h array<string>")
    assert [r[0] for r in df.select(extract.resolved_name(F.col("t"), F.col("p"), F.col("h"))).collect()] == ["Dr Ann Lee of Xby", "Ann Lee", "Unknown"]
    assert one(spark, "PhD from Xby Institute of Art, with Ann Lee", lambda c: extract.named_entities(c, only_organisations=True)) == ["Xby Institute of Art"]
    assert one(spark, "Department Library and Ann Lee", lambda c: extract.named_entities(c, organisations=False)) == []
