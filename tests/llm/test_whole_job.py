"""Whole jobs: what earlier versions left out."""

import random

import numpy as np
from pyspark.sql import functions as F

from scholarforge.llm import encoding, entities, neardup, queries


def _profiles(spark, folder, rows):
    spark.createDataFrame([(i, f"https://a.example/{i}", name, text) for i, name, text in rows], "profile_id long, profile_link string, name string, text_raw string").write.parquet(f"{folder}/profiles.parquet")
    return str(folder)


def test_pairs_of_pages_with_lost_letters(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{rng.choice('äöüéè')}{b}" for a in ("grab", "wel", "tron", "spal", "kirm") for b in ("nis", "dor", "lak", "mut")]
    plain = [f"word{i}" for i in range(200)]
    page = [w for i in range(30) for w in (rng.choice(words), plain[2 * i], plain[2 * i + 1])]
    broken = [w if w.isascii() or i % 2 else "".join(c if c.isascii() else "\ufffd" for c in w) for i, w in enumerate(page)]
    sf = _profiles(spark, tmp_path, [(1, "A", " ".join(page)), (2, "B", " ".join(broken)), (3, "C", " ".join(rng.sample(plain, 60)))])
    assert [tuple(r) for r in queries.p5_found(spark, sf).collect()] == [(1, 2)]


def test_pairs_at_the_threshold(spark):
    rows = []
    for i in range(200):  # 60 of 120 sequences are shared: a similarity of 0.5
        common = [f"c{i}_{k}" for k in range(62)]
        rows += [(2 * i + j, " ".join([*common, *(f"t{i}_{j}_{k}" for k in range(30))])) for j in (0, 1)]
    sk = neardup.sketched(spark.createDataFrame(rows, "id long, text string"), "id", "text", n=3, m=queries.TABLES)
    got = {tuple(r) for r in neardup.row_pairs(sk, 3, queries.TABLES, 0.5).collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(200)} and len(got) >= 186


def test_a_long_chain_is_one_class(spark, monkeypatch):
    ids = list(range(150))
    random.Random(6).shuffle(ids)
    chain = [(min(a, b), max(a, b), 0.9) for a, b in zip(ids, ids[1:])] + [(200, 201, 0.9), (201, 202, 0.9)]
    monkeypatch.setattr(neardup, "similar_pairs", lambda *_: spark.createDataFrame(chain, "a long, b long, similarity double").coalesce(1))
    sk = spark.range(203).withColumn("set_hash", F.when(F.col("id") != 150, F.col("id"))).coalesce(1)
    got = {r["id"]: (r["class_id"], r["links"]) for r in neardup.classes(sk, 3, 9, 0.5).collect()}
    assert len(got) == 203 and {got[i][0] for i in ids} == {0} and got[200] == (200, 1)
    assert got[201] == (200, 2) and got[202] == (200, 1) and got[150] == (150, 0) and got[160] == (160, 0)


def test_names_and_page_texts_are_given_back(spark, tmp_path):
    texts = ["Die Universität für Bodenkultur und Geschichte", "Les élèves et la géographie générale", "Größe und Höhe der Flüsse"]
    rows = [(i, "José Núñez", texts[i % 3]) for i in range(60)]
    rows += [(100 + i, encoding.mangle("José Núñez", "cp1252"), encoding.mangle(texts[i % 3], "cp1252")) for i in range(6)]
    rows += [(200, "José Núñez", "Gr\ufffd\ufffde und H\ufffdhe der Fl\ufffdsse"), (201, None, None)]
    sf = _profiles(spark, tmp_path, rows)
    got = {(r["profile_id"], r["field"]): (r["repaired"], r["chain"]) for r in queries.p1_repaired(spark, sf).collect()}
    assert set(got) == {tuple(r) for r in queries.p1_found(spark, sf).collect()} and len(got) == 13
    assert got[100, "name"][0] == "José Núñez" and all(got[100 + i, "text_raw"][0] == texts[i % 3] for i in range(6))
    assert got[200, "text_raw"][1] == "lost" and "Höhe der Flüsse" in got[200, "text_raw"][0]


def test_every_form_within_the_edits_is_tried():
    rng = random.Random(8)
    places = ["".join(rng.choice(("ka", "ze", "lm", "ru", "fa", "hi", "tu", "po", "xi", "ne")) for _ in range(3)) for _ in range(140)]
    mapper = entities.Mapper([(i + 1, f"University of {p.title()}", None) for i, p in enumerate(dict.fromkeys(places))])
    for _ in range(100):
        form, _ = rng.choice(mapper.forms)
        t = list(form)
        for _ in range(2):
            i = rng.randrange(len(t) - 1)
            t[i], t[i + 1] = t[i + 1], t[i]
        t = "".join(t)
        if len(t) < 5:
            continue
        near = [(entities._distance(t, f, m) - len(f) / 1000, e) for f, e in mapper.forms for m in [1 if len(f) < 8 else 2] if entities._distance(t, f, m) <= m]
        ids = {e for d, e in near if d == min(near)[0]}
        assert mapper._similar([t]) == (ids.pop() if len(ids) == 1 else 0)


def test_short_documents_are_grouped(spark, tmp_path):
    texts = ["call for papers on river floods", "call for papers on river floods", "Call for papers", "call, for papers", "call for", "***", "***", "", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in queries.p5_document_classes(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}


def test_other_scripts_read_as_western_are_found(spark, tmp_path):
    names = ["Иван Петров", "Мария Соколова", "Γιώργος Παπάς", "Ελένη Δήμου"]
    rows = [(i, names[i % 4] if i % 3 else "Ann Lee", "A page about rivers and floods.") for i in range(80)]
    rows += [(100 + i, encoding.mangle(names[i % 4], ("cp1252", "latin1")[i % 2]), None) for i in range(8)]
    sf = _profiles(spark, tmp_path, rows)
    got = {r["profile_id"]: r["repaired"] for r in queries.p1_repaired(spark, sf).collect()}
    assert got == {100 + i: names[i % 4] for i in range(8)}


def test_shared_acronyms_and_words_in_any_order():
    mapper = entities.Mapper([(1, "University of Abrin", "UA"), (2, "University of Arkan", "UA"), (3, "Velk Institute of Technology", "VIT"), (4, "Royal Corvan Medical University", None)])
    assert mapper("UA") == 0 and mapper("vit") == 3
    assert mapper("Corvan University, Royal Medcal") == 4 and mapper("Medical Royal Univeristy Corvan") == 4
    assert mapper("Royal Corvan Polytechnic") == 0 and mapper("") == 0


def test_pairs_at_the_threshold_are_candidates():
    rng = np.random.default_rng(5)
    m, width = queries.TABLES, 2
    seeds = neardup._seeds((1 + neardup.SECOND) * m * width)
    found = 0
    for _ in range(400):  # 60 of 120 sequences are shared
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (60, 30, 30))
        least = neardup.minhashes([np.unique(np.concatenate([common, x])) for x in (a, b)], seeds)
        x = neardup.sub_keys(least[:, : m * width], width)
        y = neardup._mix(least[:, m * width :]).astype(np.uint8).reshape(2, -1, width)
        same = y[0] == y[1]
        hashes = same.size
        found += (x[0] == x[1]).any() and same.all(axis=1).sum() >= neardup.LEAST_TABLES and same.sum() >= hashes / 2 - 1.5 * hashes**0.5
    assert found >= 0.96 * 400


def test_hot_sub_keys_give_the_candidates_of_all_others(spark):
    rng = random.Random(9)
    common = [f"c{k}" for k in range(40)]
    rows = [(i, " ".join([*common, *(f"u{i}_{k}" for k in range(rng.choice((50, 60, 140))))])) for i in range(120)]
    rows += [(200 + i, rows[i][1] + f" more{i} words{i}") for i in range(0, 120, 3)]
    sk = neardup.sketched(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", "text", n=3, m=queries.TABLES)
    plain = {tuple(r) for r in neardup.candidates(sk, queries.TABLES, hot=10**9).collect()}
    assert plain >= {(i, 200 + i) for i in range(0, 120, 3)} and len(plain) < 2_000
    for block in (7, 40, 1_000):  # several blocks of a sub-key, a few, one
        assert {tuple(r) for r in neardup.candidates(sk, queries.TABLES, block=block, hot=8).collect()} == plain
