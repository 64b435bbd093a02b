"""Entities, near-duplicates, packing, leakage and personal information, against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholarforge.llm import disclosure, entities, leakage, neardup, packing

LIST = [(1, "University of Abrin", "UABR"), (2, "Abrin State University", None), (3, "Technical University of Velk", "TUVE"), (4, "Corvan Institute of Technology", None), (5, "The University of Solvmere", None), (6, "Tarnh Medical University", None)]


@pytest.mark.parametrize("value, want", [
    ("university of abrin ", 1), ("Univ. of Abrin", 1), ("Abrin, University of", 1), ("Universität Abrin", 1), ("Université d’Abrin", 1), ("UABR", 1), ("uabr", 1), ("Unversity of Abirn", 1), ("Universityof Abrin", 1),
    ("PhD, University of Abrin", 1), ("Department of Geography, University of Abrin", 1), ("University of Abrin - Main Campus", 1), ("University of Abrin (Westland)", 1), ("Abrin State U.", 2), ("Abrin State", 2),
    ("TU Velk", 3), ("Velk", 3), ("Institute of Technology, Corvan", 4), ("Corvan Inst. of Tech.", 4), ("Solvmere", 5), ("Medizinische Universität Tarnh", 6), ("Tarnh Med. Univ.", 6),
    ("Abrin Seminary", 0), ("Abrin School of Nursing", 0), ("Velk Maritime Academy", 0), ("University of Ostig", 0), ("Polytechnic of Ostig", 0), ("?", 0), ("Medical University of Abrin", 0),
])
def test_meanings(value, want):
    assert entities.Mapper(LIST)(value) == want


def test_mapping_of_cells(spark):
    ref = spark.createDataFrame(LIST, "university_id long, university string, acronym string")
    df = spark.createDataFrame([(1, "Velk", "Unknown"), (2, None, "University of Abrin"), (3, "Zzz", " "), (3, "Zzz", " ")], "id long, a string, b string").withColumn("value", F.lit(1))
    got = sorted((r["id"], r["field"], r["value"], r["university_id"]) for r in entities.map_values(df, "id", ["a", "b"], ref, "university_id", "university", "acronym").collect())
    assert got == [(1, "a", "Velk", 3), (2, "b", "University of Abrin", 1), (3, "a", "Zzz", 0), (3, "a", "Zzz", 0)]
    assert entities.map_values(df, "id", ["a"], ref.limit(0), "university_id", "university").where("university_id != 0").count() == 0
    assert entities.map_values(df.limit(0), "id", ["a"], ref, "university_id", "university").count() == 0
    with pytest.raises(ValueError):
        entities.map_values(df, "id", ["a"], ref, "university_id", "university", max_entries=2)


def _texts(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    out = []
    for i in range(n):
        if i % 3 and out:
            words = list(rng.choice(out).split())
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=60)
        out.append(" ".join(words))
    return out


def _brute(texts, n, threshold):
    sets = [frozenset(zip(*(t.split()[k:] for k in range(n)))) if t and len(t.split()) >= 20 else None for t in texts]
    return {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


def test_pairs_against_brute_force(spark):
    texts = [*_texts(), None, "", "too short", "too short"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("a", F.lit(1))
    sk = neardup.sketched(df, "id", "text", n=3)
    got = {tuple(r) for r in neardup.row_pairs(sk, 3, 9, 0.5).collect()}
    want = _brute(texts, 3, 0.5)
    assert got <= want and len(got) >= 0.9 * len(want)
    found = {r["id"]: r["class_id"] for r in neardup.classes(sk, 3, 9, 0.5).collect()}
    assert len(found) == len(texts) and all(found[a] == found[b] for a, b in got) and found[122] != found[123]
    assert neardup.row_pairs(neardup.sketched(df.limit(0), "id", "text"), 5, 9, 0.8).count() == 0


def test_hot_buckets_lose_no_pair(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base, f"x{rng.random()}"]) for _ in range(60)]
    sk = neardup.sketched(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3), "id", "text", n=3)
    for block in (4, 16, 256):
        pairs = neardup.candidates(sk.select("id", "keys"), 9, block=block)
        assert {tuple(r) for r in pairs.collect()} == set(itertools.combinations(range(60), 2))


def test_hot_sub_keys_lose_no_pair(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base, f"x{rng.random()}"]) for _ in range(70)] + _texts()
    sk = neardup.sketched(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5), "id", "text", n=3)
    plain = {tuple(r) for r in neardup.candidates(sk.select("id", "keys"), 9).collect()}
    assert {tuple(r) for r in neardup.candidates(sk.select("id", "keys"), 9, block=8, hot=16).collect()} >= plain >= set(itertools.combinations(range(70), 2))


def test_repeated_ids_are_documents_of_their_own_text(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    sk = neardup.sketched(spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (3, b)], "id long, text string"), "id", "text", n=3)
    assert {tuple(r) for r in neardup.row_pairs(sk, 3, 9, 0.5).collect()} == {(1, 2), (1, 3)}


def test_copies(spark):
    text = " ".join(f"w{i}" for i in range(30))
    sk = neardup.sketched(spark.createDataFrame([(i, text) for i in range(5)], "id long, text string"), "id", "text", n=3)
    assert neardup.row_pairs(sk, 3, 9, 0.5).count() == 10
    assert {r["class_id"] for r in neardup.classes(sk, 3, 9, 0.5).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.integers(50, 80))
def test_packing_places_everything_once(sizes, capacity):
    bins = packing.pack(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(bins) <= 1 + 2 * sum(sizes) / capacity


def test_filling_is_as_close_as_can_be():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randint(1, 30) for _ in range(9)]
        room = rng.randint(5, 60)
        left = {n: sizes.count(n) for n in sizes}
        best = max(sum(c) for k in range(10) for c in itertools.combinations(sizes, k) if sum(c) <= room)
        got = packing.fill(room, sorted(set(sizes), reverse=True), left, 64)
        assert sum(got) == best and all(got.count(n) <= left[n] for n in got)


def test_packed_table(spark):
    df = spark.createDataFrame([(1, 0), (2, 25), (3, 10), (4, 4), (4, 4), (5, None)], "id long, n long").fillna(0)
    got = packing.packed(df, "id", "n", [(1, 10), (2, 100)]).collect()
    for limit, capacity in ((1, 10), (2, 100)):
        own = [r for r in got if r["limit_id"] == limit]
        assert sum(r["tokens"] for r in own) == 43 and {r["key"] for r in own} == {1, 2, 3, 4, 5}
        used = {}
        for r in own:
            used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
        assert max(used.values()) <= capacity
    assert sorted(r["piece"] for r in got if r["key"] == 2 and r["limit_id"] == 1) == [0, 1, 2]
    assert len([r for r in got if r["key"] == 2 and r["limit_id"] == 2]) == 1
    assert packing.packed(df.limit(0), "id", "n", [(1, 10)]).count() == 0


def _leaks(docs, items, least):
    out = set()
    for (i, d), (j, e) in itertools.product(docs, items):
        w, v = leakage.words(d), leakage.words(e)
        if any(w[a : a + least] == v[b : b + least] for a in range(len(w) - least + 1) for b in range(len(v) - least + 1)):
            out.add((i, j))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "river", "x_1", "Éa", "flood", "b2"])
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 30)))) for i in range(12)]
    docs = [(100 + i, " ".join(word() for _ in range(40))) for i in range(40)]
    docs += [(200 + i, "Before, " + re.sub(" ", ",\n", t).upper() + " after") for i, (_, t) in enumerate(items)] + [(300, None), (301, ""), (200, "again")]
    index = leakage.build_index(spark.createDataFrame(docs, "id long, text string").repartition(3), "id", "text")
    asked = spark.createDataFrame([*items, (90, None), (91, "")], "k long, t string")
    for least in (3, 6):
        for block in (25, 10_000):
            got = {(r["key"], r["item"]) for r in leakage.find(index, asked, "k", "t", least=least, block_words=block).collect()}
            assert got == _leaks(docs, items, least)
    assert leakage.find(index, asked.limit(0), "k", "t").count() == 0


def test_near_leaks(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, item.replace("w7 ", "")), (2, " ".join(f"w{i}" for i in range(12))), (3, "nothing here")]
    index = leakage.build_index(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    got = leakage.find(index, spark.createDataFrame([(9, item)], "k long, t string"), "k", "t", least=16, window=20, slack=2).collect()
    assert [(r["key"], r["matched"]) for r in got] == [(1, 19)]


@pytest.mark.parametrize("text, kinds", [
    ("Write to a.b+lab@x-y.example, not", {"email"}), ("A.B@X.EXAMPLE", {"email"}), ("ab [at] x.example", {"email"}), ("ab (at) x (dot) example", {"email"}), ("ab AT x DOT example", {"email"}), ("ab @ x.example", {"email"}),
    ("under @zoxlab. Then", set()), ("for dialysis at home. The dot", set()),
    ("call +44 (0)20 7946 0355 now", {"phone"}), ("+1 (761) 555-0193", {"phone"}), ("((422) 555 0186)", {"phone"}), ("0821 / 555 01 82", {"phone"}), ("00999-27-7755722", {"phone"}), ("555-0106 ext. 552", {"phone"}), ("876.555.0182.", {"phone"}), ("+999 88 248 66 96", {"phone"}),
    ("from 1998-2004 and 2011-2015", set()), ("pp. 294-347", set()), ("hours 09.00-17.30", set()), ("Firmware 2.10.454", set()), ("lies at 11.4684, -5.4684", set()),
    ("lives at Flat 5, 44 Graerin Crescent, X", {"address"}), ("213 Ursgrad Avenue, G", {"address"}), ("Home: Jutosovaweg 206, 18446 V", {"address"}), ("29, rue de Ellargrad, 1", {"address"}), ("Calle Tormund 194, 6.º B", {"address"}),
    ("Street audits, 12 samples per street", set()), ("Room 6.71, Graovith Building", set()),
])
def test_fixed_forms(text, kinds):
    assert {k for k, _, _ in disclosure.fixed_forms(text) if k != "number"} == kinds


def test_disclosure(spark):
    people = [("Ann", "Lee"), ("Bo", "Grun"), ("Cy", "Dahl-Lee"), ("Di", "Moss")]
    docs = [(i, f"Minutes were taken by Dr {g} {s} here.\nThe river at Xby moved.\nWe thank {g} {s} for staff no. S12345{i:02d}.\nThe Xby Prize and the Oster Hall.\nBudget line 356 365 356.") for i, (g, s) in enumerate(people * 12)]
    docs += [(900, "Asked by B. Grun and by Lee, Ann.\nPassport X12345678 was found."), (901, None), (902, ""), (900, "Asked by B. Grun")]
    df = spark.createDataFrame(docs, "id long, text string").withColumn("kind", F.lit(1))
    got = {(r["key"], r["line_no"], r["kind"]) for r in disclosure.found_items(df, "id", "text").collect()}
    assert {(i, n, "name") for i in range(48) for n in (1, 3)} | {(i, 3, "id_number") for i in range(48)} | {(900, 1, "name"), (900, 2, "id_number")} == got
    clean = {r["id"]: r["sanitised"] for r in disclosure.sanitised(df.where("id < 900"), "id", "text").collect()}
    assert clean[0].split("\n")[0] == "Minutes were taken by [NAME] here." and "Budget line 356 365 356." in clean[0] and "[ID_NUMBER]" in clean[0]
    assert disclosure.found_items(df.limit(0), "id", "text").count() == 0


def test_sub_keys_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64)) for _ in range(9)]
    seeds = neardup._seeds(36)
    assert (neardup.minhashes(sets, seeds) == np.concatenate([neardup.minhashes([s], seeds, chunk=7) for s in sets])).all()
