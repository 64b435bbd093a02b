"""Readers with declared schemas."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE = T.StructType([T.StructField("profile_link", T.StringType(), False), *[T.StructField(c, T.StringType()) for c in ("name", "department", "university", "tag", "position", "phd_year", "phd_school", "promotion_year", "text_raw")], T.StructField("user_updated", T.IntegerType())])
DEPARTMENTS = T.StructType([T.StructField(c, T.StringType()) for c in ("department_or_faculty", "school_name", "title", "url", "tag")])
LISTING = T.StructType([T.StructField(c, T.StringType()) for c in ("Name", "URL", "XPATH", "Remark", "Department or Faculty")])


def json_by_key(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """An object of objects as one row per key (S3); ``value`` is the DDL of an inner object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias(key, "v")).select(key, "v.*")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A list of records, or one record a line."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header (S5, S7), in another encoding where asked for (S6); quoted fields may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages ``url, html`` in place of the network (S8); Parquet."""
    return spark.read.schema("page_id long, url string, html string").parquet(path)


def binary_texts(spark: SparkSession, path: str, to_text: Callable[[bytes], str]) -> DataFrame:
    """Files such as PDFs as ``path, tokens`` by a pluggable extractor."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(content: pd.Series) -> pd.Series:
        return content.map(lambda b: to_text(b).split())

    return spark.read.format("binaryFile").load(path).select("path", tokens("content").alias("tokens"))


def ranking_batches(pages: DataFrame, least: int = 100) -> DataFrame:
    """``university, rank_raw, url`` from saved pages of a ranking with parallel lists (S9, J15); the first ``least`` titles by page and place."""
    zipped = F.posexplode(F.arrays_zip(F.col("titles").alias("t"), F.col("ranks").alias("r"), F.col("links").alias("u")))
    rows = pages.select("page_no", zipped.alias("pos", "x")).where("x.t is not null and x.r is not null and x.u is not null")
    return rows.select("page_no", "pos", F.col("x.t").alias("university"), F.col("x.r").alias("rank_raw"), F.col("x.u").alias("url")).orderBy("page_no", "pos").limit(least).select("university", "rank_raw", "url")


def newest_ranking(links: DataFrame) -> DataFrame:
    """The ranking link with the latest year."""
    return links.withColumn("year", F.regexp_extract("link", "(?:19|20)[0-9]{2}", 0).try_cast("int")).where("year is not null").orderBy(F.desc("year"), "link").limit(1)
