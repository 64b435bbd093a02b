"""Queries over the documents: packing, leakage of evaluation texts, personal information."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarforge.llm import disclosure, leakage, packing
from scholarforge.runtime import read_table, stage

#: Vocabulary by which sizes are counted; any byte-level BPE ranks file will do.
VOCABULARY = os.environ.get("SCHOLARFORGE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, for every capacity of ``pack_limits``."""
    sized = stage(_documents(spark, sf_dir).select("doc_id", packing.token_counts(VOCABULARY)(F.col("text")).alias("tokens")), "tokens")
    limits = [(r["limit_id"], r["capacity_tokens"]) for r in read_table(spark, sf_dir, "pack_limits").collect()]  # a list of container sizes
    return packing.packed(sized, "doc_id", "tokens", limits).withColumnRenamed("key", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of space filled, for every capacity."""
    capacity = read_table(spark, sf_dir, "pack_limits").select("limit_id", "capacity_tokens")
    used = p8_packed(spark, sf_dir).groupBy("limit_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(capacity), "limit_id").select("limit_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


def _matches(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    index = leakage.build_index(_documents(spark, sf_dir), "doc_id", "text")
    return leakage.find(index, read_table(spark, sf_dir, "eval_items"), "item_id", "text", **how)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item."""
    return _matches(spark, sf_dir).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 16 of 20 successive words of an item, each within two words of its place."""
    near = _matches(spark, sf_dir, least=16, window=20, slack=2)
    return near.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "matched")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which personal information begins, by kind."""
    items = disclosure.found_items(_documents(spark, sf_dir), "doc_id", "text")
    return items.select(F.col("key").alias("doc_id"), F.col("line_no").cast("int").alias("line_no"), "kind").distinct()


def p10_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders for personal information."""
    return disclosure.sanitised(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text").select("doc_id", "sanitised")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_near": p9_near,
    "p10_found": p10_found,
    "p10_sanitised": p10_sanitised,
}

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_RUNS = "SELECT {k}, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT {k}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {k}, " + _WORDS.replace("{", "{{").replace("}", "}}") + " AS w FROM {t}) WHERE len(w) >= 12)"
ORACLE = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_RUNS.format(k='doc_id', t='documents')}) JOIN (SELECT DISTINCT * FROM ({_RUNS.format(k='item_id', t='eval_items')})) USING (run)",
}
