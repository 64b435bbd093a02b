"""The profile store: protected upsert, edits, previews, completeness, export, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDITABLE = ("name", "position", "phd_year", "phd_school", "promotion_year", "text_raw")


def latest(crawls: DataFrame, link: str = "profile_link", order: tuple[str, ...] = ("stored_at", "profile_id")) -> DataFrame:
    """One row per link: the last crawl, but a manually edited row is not overwritten (K6 over a whole history).

    Aggregated before the exchange, so a hot link costs one row per task.
    """
    rest = [c for c in crawls.columns if c != link]
    best = crawls.groupBy(link).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col("user_updated"), F.lit(0)), *order)).alias("__best"))
    return best.select(link, *[F.col(f"__best.{c}").alias(c) for c in rest])


def protected_upsert(stored: DataFrame, new: DataFrame, link: str = "profile_link") -> DataFrame:
    """The store after ``new`` came in: inserted with ``user_updated`` 0, replaced where not edited by hand (K6).

    ``new`` has one row per link (see :func:`latest`).
    """
    columns = [c for c in stored.columns if c != link]
    old = stored.select(link, F.struct(*columns).alias("__old"))
    incoming = new.select(link, F.struct(*[F.lit(0).alias(c) if c == "user_updated" else F.col(c).cast(stored.schema[c].dataType).alias(c) for c in columns]).alias("__new"))
    both = old.join(incoming, link, "full_outer")
    keep = F.col("__old").isNotNull() & (F.col("__new").isNull() | (F.col("__old.user_updated") == 1))
    # an update leaves the mark as it is: 0 by this condition
    return both.select(link, F.when(keep, F.col("__old")).otherwise(F.col("__new")).alias("__row")).select(link, *[F.col(f"__row.{c}").alias(c) for c in columns])


def edited(stored: DataFrame, edits: DataFrame, link: str = "profile_link") -> DataFrame:
    """Single cells changed and marked as edited (K7); ``edits`` has link, field, value and edit_no, the last one wins."""
    known = edits.where(F.col("field").isin(*EDITABLE))
    last = known.groupBy(link, "field").agg(F.max_by("value", "edit_no").alias("value"))
    wide = last.groupBy(link).agg(*[F.max(F.when(F.col("field") == f, F.struct(F.col("value").alias("v")))).alias(f"__{f}") for f in EDITABLE])
    out = stored.join(wide, link, "left")
    touched = F.greatest(*[F.col(f"__{f}").isNotNull() for f in EDITABLE])
    for f in EDITABLE:
        if f in stored.columns:
            out = out.withColumn(f, F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.v")).otherwise(F.col(f)))
    return out.withColumn("user_updated", F.when(touched, F.lit(1)).otherwise(F.col("user_updated")).cast("int")).select(*stored.columns)


def incomplete(profiles: DataFrame) -> DataFrame:
    """Profiles with an unknown name, year or school, or an empty text; nulls do not count."""
    unknown = F.lit(False)
    for f in ("name", "phd_year", "phd_school", "promotion_year"):
        unknown = unknown | F.coalesce(F.col(f) == "Unknown", F.lit(False))
    return profiles.where(unknown | F.coalesce(F.col("text_raw") == "", F.lit(False)))


def page_of(profiles: DataFrame, department: str, length: int = 9, key: str = "profile_id") -> DataFrame:
    """The first ``length`` profiles of a department by university and name."""
    return profiles.where(F.col("department") == department).orderBy(F.asc_nulls_first("university"), F.asc_nulls_first("name"), key).limit(length)


def universities_of(profiles: DataFrame, department: str, tag: str) -> DataFrame:
    """Distinct universities of a department with a tag (A4)."""
    return profiles.where((F.col("department") == department) & (F.col("tag") == tag)).select("university").distinct()


def export(profiles: DataFrame, department: str) -> DataFrame:
    """The columns of a department's export (K1)."""
    return profiles.where(F.col("department") == department).select("name", "department", "university", "tag", "position", "phd_year", "phd_school", "promotion_year", F.col("text_raw").alias("research_area"))


def recent(history: DataFrame, user: str, when: str, key: str, n: int = 5) -> DataFrame:
    """The last ``n`` rows of every user (O2); ties by key."""
    place = Window.partitionBy(user).orderBy(F.col(when).desc(), F.col(key).desc())
    return history.where(F.col(user).isNotNull()).withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= n).drop("__place")
