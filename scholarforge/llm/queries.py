"""Queries of the operators in this folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarforge.llm import boilerplate, confusables, encoding, entities, neardup, quality, queries_documents
from scholarforge.runtime import read_table, stage


def _site():
    """The host of a profile's link; also for links that are no proper URL."""
    return F.coalesce(F.regexp_extract("profile_link", r"^[a-zA-Z]+://([^/:?#]+)", 1), F.lit(""))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "profiles")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with characters that come from decoding with a wrong encoding."""
    return encoding.damaged_cells(_profiles(spark, sf_dir), "profile_id", ["name", "text_raw"], _site()).select("profile_id", "field")


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged name and page text with its original, and what was undone."""
    df = _profiles(spark, sf_dir)
    fields = ["name", "text_raw"]
    cells = stage(encoding.damaged_cells(df, "profile_id", fields, _site()), "cells")
    out = None
    for f in fields:
        one = encoding.repaired(df.select("profile_id", "profile_link", f), "profile_id", f, _site(), cells=cells)
        one = one.where(F.col(f"{f}_chain").isNotNull()).select("profile_id", F.lit(f).alias("field"), F.col(f).alias("repaired"), F.col(f"{f}_chain").alias("chain"))
        out = one if out is None else out.unionByName(one)
    return out


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``profile_id, text_raw`` as it was before any damage, words with lost bytes included."""
    df = _profiles(spark, sf_dir).select("profile_id", "profile_link", "text_raw").where(F.length("text_raw") > 0)
    return encoding.repaired(df, "profile_id", "text_raw", _site()).select("profile_id", "text_raw")


def _learnt(spark: SparkSession, sf_dir: str) -> dict[int, bool]:
    """Wording of site furniture, learnt from all pages."""
    return boilerplate.site_wording(_profiles(spark, sf_dir).select("profile_link", "text_raw"), _site(), "profile_link", "text_raw")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the page that belong to the site."""
    return boilerplate.site_lines(_page_texts(spark, sf_dir), "profile_id", "text_raw", _learnt(spark, sf_dir))


def p3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's own content."""
    return boilerplate.main_text(_page_texts(spark, sf_dir), "text_raw", "main_text", _learnt(spark, sf_dir)).select("profile_id", "main_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are not an entry letter by letter, with the entry they mean, or 0."""
    listed = read_table(spark, sf_dir, "universities")
    cells = entities.map_values(_profiles(spark, sf_dir), "profile_id", ["phd_school", "university"], listed, "university_id", "university", "acronym")
    names = listed.select(F.col("university").alias("value")).distinct()
    return cells.join(F.broadcast(names), "value", "left_anti").select("profile_id", "field", F.col("university_id").cast("int").alias("university_id"))


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no entry of the list, with the number of cells that hold them."""
    listed = read_table(spark, sf_dir, "universities")
    cells = entities.map_values(_profiles(spark, sf_dir), "profile_id", ["phd_school", "university"], listed, "university_id", "university", "acronym")
    return cells.where("university_id = 0").groupBy("field", "value").agg(F.count("*").alias("cells"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with variants or look-alikes of ordinary characters; wrongly decoded names are no cases."""
    df = _profiles(spark, sf_dir)
    cells = confusables.variant_cells(df, "profile_id", ["name", "department", "position"])
    damaged = encoding.damaged_cells(df, "profile_id", ["name"], _site()).select("profile_id", "field")
    return cells.join(damaged, ["profile_id", "field"], "left_anti")


def p6_one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, department and position of every profile in one form."""
    fields = ["name", "department", "position"]
    return confusables.one_form(_profiles(spark, sf_dir).select("profile_id", *fields), fields).select("profile_id", *[f"{f}_plain" for f in fields])


#: Sub-keys in either collection: TABLES squared tables. A pair at similarity 0.5 is found with a probability of 0.977.
TABLES = 16


def _page_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of three-word sequences of the main texts, as p5_found asks for."""
    return neardup.sketched(_page_texts(spark, sf_dir), "profile_id", "text_raw", n=3, m=TABLES, width=2, least_words=20, prepare=partial(boilerplate.own_text, learnt=_learnt(spark, sf_dir)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose main texts share at least half of their three-word sequences."""
    pairs = neardup.row_pairs(_page_sketches(spark, sf_dir), 3, TABLES, 0.5)
    return pairs.select(F.col("a").alias("profile_id_a"), F.col("b").alias("profile_id_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile with the class of its main text and the number of its links."""
    found = neardup.classes(_page_sketches(spark, sf_dir), 3, TABLES, 0.5)
    return found.select(F.col("id").alias("profile_id"), "class_id", "links")


def p5_document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class at five-word sequences and a similarity of 0.8; shorter ones by their whole text."""
    found = neardup.classes(neardup.sketched(read_table(spark, sf_dir, "documents"), "doc_id", "text", m=TABLES, least_words=5, whole=True), 5, TABLES, 0.8)
    return found.select(F.col("id").alias("doc_id"), "class_id", "links")


MAX_LABELLED = 5_000


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, learnt = stage(_page_texts(spark, sf_dir), "pages"), _learnt(spark, sf_dir)
    labels = read_table(spark, sf_dir, "text_labels").where(F.col("text_kind").isin(*quality.KINDS))
    sample = labels.groupBy("profile_id").agg(F.min("text_kind").alias("text_kind")).orderBy(F.hash("profile_id"), "profile_id").limit(MAX_LABELLED)
    labelled = pages.join(F.broadcast(sample), "profile_id")  # at most MAX_LABELLED rows
    model = quality.fit(boilerplate.main_text(labelled, "text_raw", learnt=learnt), "text_raw", "text_kind", MAX_LABELLED)
    return quality.describe(pages, "text_raw", model, prepare=partial(boilerplate.own_text, learnt=learnt))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles whose main text is a list, a table or junk."""
    return _quality(spark, sf_dir).where("quality.verdict != 'prose'").select("profile_id")


def p7_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, label shares and verdict of every main text."""
    return _quality(spark, sf_dir).select("profile_id", "quality.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p3_found": p3_found,
    "p3_main_text": p3_main_text,
    "p4_found": p4_found,
    "p4_unmatched": p4_unmatched,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p5_document_classes": p5_document_classes,
    "p6_found": p6_found,
    "p6_one_form": p6_one_form,
    "p7_found": p7_found,
    "p7_statistics": p7_statistics,
    **queries_documents.QUERIES,
}
ORACLE: dict[str, str] = {**queries_documents.ORACLE}
