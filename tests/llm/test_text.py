"""Encoding, boilerplate, look-alikes and quality, on small hand-made tables."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholarforge.llm import boilerplate, confusables, encoding, quality

WORDS = "École près forêts Müller Übung Peñalvar señal l’équipe 5–10 µm “so” København Straße".split()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=8), st.sampled_from(sorted(encoding.CHAINS)))
def test_every_chain_is_undone(words, chain):
    text = " ".join(words)
    assert encoding.repair_text(encoding.mangle(text, chain), chain) == text


@pytest.mark.parametrize("text", [None, "", "plain", "ÂMBAR E MÃO", "CHÂLET-DES-MÂTS"])
def test_sound_texts_stay(text):
    assert encoding.repair_text(text, "cp1252") == text


def _cells(spark):
    names = ["Peñalvar Jiménez", "Grünhart Örn", "Élodie Lefèvre", "SÃO MÃO", "Віолетта Іваненко", "áñé"] * 12
    rows = [(i, f"s{i % 2}", n) for i, n in enumerate(names)]
    rows += [(1000 + i, "s0", encoding.mangle(n, "cp1252")) for i, n in enumerate(names[:3])]
    rows += [(1100 + i, "s1", encoding.mangle(n, "mac")) for i, n in enumerate(names[:3])]
    rows += [(1200, "s1", "Gr��nhart �rn"), (1201, "s0", None), (1202, "s0", ""), (1203, None, encoding.mangle("Lefèvre", "cp1252x2"))]
    return spark.createDataFrame(rows, "id long, source string, name string").withColumn("field", F.lit(0)).withColumn("chain", F.lit("x"))


def test_damaged_cells_are_found_and_restored(spark):
    df = _cells(spark)
    found = encoding.damaged_cells(df, "id", ["name"], F.col("source"))
    got = {r["id"]: r["chain"] for r in found.collect()}
    assert set(got) == {1000, 1001, 1002, 1100, 1101, 1102, 1200, 1203}
    fixed = encoding.repaired(df, "id", "name", F.col("source"))
    assert fixed.count() == df.count() and {"field", "chain"} <= set(fixed.columns)
    names = {r["id"]: r["name"] for r in fixed.collect()}
    assert names[1000] == "Peñalvar Jiménez" and names[1101] == "Grünhart Örn" and names[1203] == "Lefèvre" and names[1200] == "Grünhart Örn"
    assert names[3] == "SÃO MÃO" and names[4] == "Віолетта Іваненко" and names[1201] is None


def test_encoding_of_empty_tables(spark):
    df = _cells(spark).limit(0)
    assert encoding.damaged_cells(df, "id", ["name"], F.col("source")).count() == 0
    assert encoding.repaired(df, "id", "name", F.col("source")).count() == 0


PAGE = """We use cookies so that pages load as they should.
Skip to main content
• News
• Contact
Home » Geography » Staff » Ann Lee

Dr Ann Lee
Contact
She studies how visitors read cookie notices, and the river had moved by
Latest news
Carbon budgets
Residual nuclear pores
the winter of 1999 before the flood came.
Contact
Research interests
water security
Office: Block 1, Room 2.3
Join us at the Xby open day and find out how our graduates work on x.
Print this page
© 2015 University of X. All rights reserved.
12 Ravo Road, Xby, Westland
Site map"""


def test_page_lines():
    gone = boilerplate.furniture(PAGE)
    assert gone == [1, 2, 3, 4, 5, 10, 11, 12, 18, 19, 20, 21, 22]
    assert boilerplate.furniture(None) == [] and boilerplate.furniture("\n \n") == []
    assert boilerplate.furniture("News | Library | People\nText about rivers and so on.") == [1]
    assert boilerplate.furniture("x " * 200_000 + "\nSite map") == [2]


def test_site_lines_of_a_table(spark):
    df = spark.createDataFrame([(1, PAGE, "a"), (1, PAGE, "a"), (2, None, "a"), (3, "", "a")], "id long, text string, line_no string")
    assert boilerplate.site_lines(df.drop("line_no"), "id", "text").count() == 26
    main = boilerplate.main_text(df, "text").where("id = 1").first()["text"]
    assert "cookie notices" in main and "Site map" not in main and "line_no" in boilerplate.main_text(df, "text").columns
    assert boilerplate.site_lines(df.limit(0), "id", "text").count() == 0


def test_long_notices_are_notices():
    notice = "We use cookies " + "and similar small files " * 12 + "to remember your settings."
    assert len(notice) > 220 and boilerplate.furniture(f"A text about rivers, floods and other things.\n{notice}") == [2]


def test_wording_of_sites_is_learnt(spark):
    menu = ["Campus shop", "Give to us", "Parents"]
    rows = []
    for site in range(6):
        for page in range(40):
            own = [f"Page {'abcdefghij'[page % 10]}{page} of site {site} tells of things.", "Biography", f"It goes on with word{site}x{page} and ends."]
            rows.append((site, f"https://s{site}.example/{page}", "\n".join([*(menu if site < 2 else []), *own])))
    df = spark.createDataFrame(rows, "site int, link string, text string")
    learnt = boilerplate.site_wording(df, F.col("site"), "link", "text")
    assert learnt == {boilerplate.wording(x): True for x in ("Campus shop", "• give to us", "parents")}
    assert boilerplate.furniture(rows[0][2]) == [] and boilerplate.furniture(rows[0][2], learnt) == [1, 2, 3]
    assert boilerplate.site_lines(df, "link", "text", learnt).count() == 2 * 3 * 40
    assert boilerplate.site_wording(df.limit(0), F.col("site"), "link", "text") == {}
    assert boilerplate.site_wording(df.where("site = 0"), F.col("site"), "link", "text") == {}


def _plain(text, counts=None):
    reps = {m: r for m, r in confusables.representatives(counts or {"e": 9, "o": 9, "P": 9, " ": 9}).items() if not m.isascii()}
    return confusables.Rewriter(reps)(text)


@pytest.mark.parametrize("text, want", [
    ("Ｐｒｏｆ．　Ｌｅｅ", "Prof. Lee"), ("Prоfеssor", "Professor"), ("Zöe", "Zöe"), ("A​nn­Lee", "AnnLee"), ("Ann Lee", "Ann Lee"), ("Р. Lee", "P. Lee"),
    ("Élvira Ñu", "Élvira Ñu"), ("Ann (Мирева Весенко)", "Ann (Мирева Весенко)"), ("Ann (Ειρήνη)", "Ann (Ειρήνη)"), ("Ann (霧沢 葉)", "Ann (霧沢 葉)"), ("", ""),
])
def test_one_form(text, want):
    assert _plain(text) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcÉñ Рrо​еａＢ́ ", max_size=15))
def test_one_form_is_stable(text):
    assert _plain(_plain(text)) == _plain(text)


def test_classes_are_transitive():
    sets = confusables.UnionFind()
    for a, b in (("a", "b"), ("b", "c"), ("x", "y")):
        sets.union(a, b)
    assert sets.find("a") == sets.find("c") != sets.find("x")
    # an ordinary letter or sign is never rewritten, however frequent its look-alikes are
    for counts in ({"a": 1, "а": 90}, {"a": 5, "а": 1}, {"\u2010": 900, "-": 1}):
        reps = confusables.representatives(counts)
        assert reps["а"] == "a" and reps["\u2010"] == reps["\u2011"] == "-" and not {"a", "-"} & set(reps)
    put = confusables.Rewriter(confusables.representatives({"\u2010": 900}))
    assert {put(x) for x in ("Bio-chem", "Bio\u2010chem", "Bio\u2011chem", "Вio-сhеm")} == {"Bio-chem"}


def test_variant_cells(spark):
    df = spark.createDataFrame([(1, "Ann Lee", "Bio"), (2, "Ann Lee", None), (3, None, "Віо"), (4, "", "Bіo")], "id long, name string, value string").withColumn("dept", F.col("value"))
    got = {tuple(r) for r in confusables.variant_cells(df, "id", ["name", "dept"]).collect()}
    assert got == {(2, "name"), (4, "dept")}  # a word of look-alikes alone, among no Latin words, is its own script's
    assert confusables.variant_cells(df.limit(0), "id", ["name"]).count() == 0
    assert {"value", "name_plain"} <= set(confusables.one_form(df, ["name"]).columns)


PROSE = "The group has described how the river moved since the flood, and it asks why the soil may fail in wet years.\nWith the help of a fund, she compares the old towns with the new ones."
KINDS = {
    "prose": [PROSE, PROSE.replace("river", "sea"), PROSE.replace("group", "team") + "\nAwards\n" + PROSE],
    "list": ["• carbon budgets\n• urban heat\n• pollen cores\n• oral histories", "street audits; urban heat; oral histories; soil carbon; border trade\nsea level; rent reform; dam building; tree rings"],
    "table": ["1.2\t3.4\t5.6\n7.8\t9.1\t2.3\n4.5\t6.7\t8.9", "Year;Code;Site\n1999;A12;X\n2001;B13;Y\n2005;C14;Z"],
    "junk": ["#q$ %w^ &e* (r)\n~t= y+u {i}\no|p [a] s~d", "var x = document.getElementById('y12');\nif(a.b){ c.push(3); }\n.z-w { margin: 9px 0; float: left }", "zoxin maren zoxin zoxin lurate maren zoxin maren zoxin lurate maren maren zoxin lurate zoxin maren"],
}


def test_quality(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in KINDS.items() for t in ts for _ in range(6))]
    df = spark.createDataFrame([*rows, (900, None, None), (901, " \n ", None), (902, "the river " * 30_000, None)], "id long, text string, kind string").withColumn("verdict", F.lit(1))
    model = quality.fit(df, "text", "kind")
    got = {r["id"]: r for r in quality.describe(df, "text", model).collect()}
    assert all(got[i]["quality"]["verdict"] == k for i, _, k in rows)
    assert got[900]["quality"]["verdict"] is None and got[901]["quality"]["words"] == 0 and got[902]["quality"]["words"] == 60_000
    assert quality.describe(df.limit(0), "text", quality.LineModel()).count() == 0
    assert quality.fit(df.limit(0), "text", "kind").least_prose == 0.5
    assert quality.line_features("Two words.")[1:] == (2, 8, 1, 0)  # words, letters, common words, symbols


def test_signs_between_and_inside_words_are_counted():
    lines = ["plain words only", "a\u2009b c", "a @b, c_d", "a\u3000b #1", "a # b"]
    assert [quality.line_features(x)[4] for x in lines] == [0, 1, 2, 2, 1]
    assert quality.line_features("the 12, of Paris; x-y")[1:4] == (5, 15, 2)
