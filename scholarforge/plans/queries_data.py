"""Queries of the engine's operators over the project's tables (data problems)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholarforge.operators import impute
from scholarforge.runtime import read_table

FIELDS = ["phd_year", "phd_school", "promotion_year", "position"]


HOW = ("profile_id", "profile_link", ["phd_year", "promotion_year"], ["phd_school", "position"], ["department", "university", "tag"], "crawled_at")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "profiles").select("profile_id", "profile_link", "crawled_at", *FIELDS, "department", "university", "tag")


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.impute(_profiles(spark, sf_dir), *HOW)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without a value that another crawl of the same link can fill."""
    return impute.filled_cells(_filled(spark, sf_dir), "profile_id", FIELDS, "group")


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile with its fields completed and where each value comes from."""
    return _filled(spark, sf_dir).select("profile_id", *[x for f in FIELDS for x in (f + "_filled", f + "_from")])


def p2_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the fillings by field and source, on a tenth of the known cells taken out before."""
    return impute.measured(_profiles(spark, sf_dir), *HOW)


QUERIES = {"p2_found": p2_found, "p2_filled": p2_filled, "p2_measured": p2_measured}

_STAND_INS = "('unknown','n/a','na','n.a.','n.a','n. a.','not stated','not known','not available','not applicable','none','null','nil','nan','tbc','tba','tbd','?','-','--','0','0000','9999','')"
_HAS = "lower(trim(coalesce({c}, ''))) NOT IN " + _STAND_INS
ORACLE = {
    "p2_found": "WITH k AS (SELECT profile_link, "
    + ", ".join(f"max(CASE WHEN {_HAS.format(c=f)} THEN 1 ELSE 0 END) AS has_{f}" for f in FIELDS)
    + " FROM profiles GROUP BY profile_link) "
    + " UNION ALL ".join(f"SELECT profile_id, '{f}' AS field FROM profiles p JOIN k USING (profile_link) WHERE NOT ({_HAS.format(c='p.' + f)}) AND has_{f} = 1" for f in FIELDS)
}
