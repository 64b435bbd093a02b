"""Benchmark ranking of profiles against a query person."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarforge.functions.fuzzy import best_of
from scholarforge.functions.text import rank_number, year
from scholarforge.functions.vectors import closeness, mean_known
from scholarforge.runtime import stage

METRICS = ("PHD YEAR", "PHD UNIVERSITY", "PROMO YEAR", "RESEARCH AREA SIMILARITY")
SCORES = {"PHD YEAR": "phd_year_score", "PHD UNIVERSITY": "phd_school_score", "PROMO YEAR": "promotion_year_score", "RESEARCH AREA SIMILARITY": "research_area_score"}


@dataclass(frozen=True)
class Person:
    """The person to compare with; ``promotion_year`` is the year of the request."""

    department: str
    position: str
    phd_year: int | None
    promotion_year: int | None
    phd_school: str | None = None
    text_raw: str = ""


def check_metrics(metrics: list[str]) -> None:
    wrong = [m for m in metrics if m not in METRICS]
    if wrong or not metrics:
        raise ValueError(f"metrics must be some of {METRICS}, not {wrong or 'none'}")


def candidates(profiles: DataFrame, person: Person) -> DataFrame:
    """Profiles of the person's department and position (F1); the filter reaches the scan."""
    return profiles.where((F.col("department") == person.department) & (F.col("position") == person.position))


def _scaled(df: DataFrame, away: dict[str, Column]) -> DataFrame:
    """Every score = 1 - difference / largest difference; all largest ones are one aggregate joined back, no global window."""
    df = df.withColumns({f"__d_{s}": d for s, d in away.items()})
    largest = df.agg(*[F.max(f"__d_{s}").alias(f"__max_{s}") for s in away])
    df = df.crossJoin(F.broadcast(largest)).withColumns({s: closeness(F.col(f"__d_{s}"), F.col(f"__max_{s}")) for s in away})
    return df.drop(*[f"__{x}_{s}" for x in ("d", "max") for s in away])


def school_ranks(profiles: DataFrame, universities: DataFrame, fuzzy: bool, most: int = 5_000, tasks: int | None = None) -> DataFrame:
    """``phd_school, school_rank``: rank of the listed university that a school name means; -1: none.

    ``fuzzy`` compares distinct names with the list by weighted ratio, 90 at least;
    else names must be equal but for case. The list is broadcast, ``most`` entries at most.
    ``tasks`` is the number of tasks that compare, by default that of a shuffle.
    """
    listed = universities.select("university", rank_number(F.col("rank_raw")).alias("school_rank")).where("university is not null")
    names = profiles.select("phd_school").where("phd_school is not null and phd_school != 'Unknown'").distinct()
    if not fuzzy:
        ranks = listed.groupBy(F.lower("university").alias("__u")).agg(F.min("school_rank").alias("school_rank"))
        return names.join(F.broadcast(ranks), F.lower(F.trim("phd_school")) == F.col("__u"), "left").select("phd_school", F.coalesce("school_rank", F.lit(-1)).alias("school_rank"))
    rows = listed.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} universities")
    # the names are few bytes but much work: they are spread over tasks by number, not by size
    tasks = tasks or int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picked = names.repartition(tasks, F.xxhash64("phd_school")).withColumn("university", best_of([r["university"] for r in rows], 90)(F.col("phd_school")))
    return picked.join(F.broadcast(listed), "university", "left").select("phd_school", F.coalesce("school_rank", F.lit(-1)).alias("school_rank"))


def scored(profiles: DataFrame, person: Person, metrics: list[str], universities: DataFrame | None = None, fuzzy: bool = True, research: DataFrame | None = None, key: str = "profile_id") -> DataFrame:
    """Candidates with a score for each requested metric and ``final_score``, their null-skipping mean.

    ``research`` holds ``key, research_area_score`` where that metric is requested.
    """
    check_metrics(metrics)
    df = candidates(profiles, person)
    away: dict[str, Column] = {}
    if "PHD YEAR" in metrics:
        away["phd_year_score"] = F.abs(year(F.col("phd_year")) - F.lit(person.phd_year).cast("int"))
    if "PROMO YEAR" in metrics:
        away["promotion_year_score"] = F.abs(year(F.col("promotion_year")) - F.lit(person.promotion_year).cast("int"))
    if "PHD UNIVERSITY" in metrics:
        spark = profiles.sparkSession
        asked = school_ranks(spark.createDataFrame([(person.phd_school,)], "phd_school string"), universities, fuzzy, tasks=1).first() if person.phd_school else None
        if asked is None or asked["school_rank"] < 0:
            df = df.withColumn("phd_school_score", F.lit(None).cast("double"))
        else:
            ranks = stage(school_ranks(df, universities, fuzzy), "ranks")
            df = df.join(ranks, "phd_school", "left")
            away["phd_school_score"] = F.when(F.col("school_rank") != -1, F.abs(F.col("school_rank") - asked["school_rank"]))
    if away:
        df = _scaled(df, away).drop("school_rank")
    if "RESEARCH AREA SIMILARITY" in metrics:
        df = df.join(research.select(key, "research_area_score"), key, "left")
    return df.withColumn("final_score", mean_known(*[F.col(SCORES[m]) for m in metrics]))


def _placed(scores: DataFrame, key: str) -> DataFrame:
    """Places within the lists by one window: for heads of lists, which are short."""
    place = Window.partitionBy("tag").orderBy(F.desc_nulls_last("final_score"), F.col(key))
    return scores.where(F.col("tag").isin("peer", "aspirant")).withColumn("place", F.row_number().over(place))


def ranked(scores: DataFrame, key: str = "profile_id") -> DataFrame:
    """Peers and aspirants with their place in their list (W1, K3); missing scores last, ties by key.

    Ranges of scores are numbered each by itself and moved by the number of rows in the
    ranges before, so that no task sorts a whole list.
    """
    order = [F.col("tag"), F.desc_nulls_last("final_score"), F.col(key)]
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scores.where(F.col("tag").isin("peer", "aspirant")).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    rows = stage(rows, "ranges")
    sizes = rows.groupBy("tag", "__part").agg(F.count("*").alias("__n"))
    before = sizes.select("tag", "__part", (F.sum("__n").over(Window.partitionBy("tag").orderBy("__part")) - F.col("__n")).alias("__before"))  # at most two rows a range
    own = F.row_number().over(Window.partitionBy("tag", "__part").orderBy(F.desc_nulls_last("final_score"), F.col(key)))
    return rows.join(F.broadcast(before), ["tag", "__part"]).withColumn("place", (F.col("__before") + own).cast("int")).select(*scores.columns, "place")


def preview(scores: DataFrame, key: str = "profile_id", total: int = 10, peers: int = 6) -> DataFrame:
    """Quota list of ``total`` (W2): six peers and four aspirants, each list making up for the other.

    Only the first ``total`` of either list can appear, so each is cut by a top-k
    before the quota is taken; no window runs over a whole list.
    """
    known = stage(scores.where(F.col("name") != "Unknown").select(key, "tag", "final_score", *[c for c in scores.columns if c not in (key, "tag", "final_score")]), "scores")
    counts = known.groupBy("tag").agg(F.count("*").alias("n"))
    counts = counts.agg(F.coalesce(F.max(F.when(F.col("tag") == "peer", F.col("n"))), F.lit(0)).alias("p"), F.coalesce(F.max(F.when(F.col("tag") == "aspirant", F.col("n"))), F.lit(0)).alias("a"))
    order = [F.desc_nulls_last("final_score"), F.col(key)]
    heads = [known.where(F.col("tag") == t).orderBy(*order).limit(total) for t in ("peer", "aspirant")]
    top = _placed(heads[0].unionByName(heads[1]), key).crossJoin(F.broadcast(counts))
    rest = total - peers
    most_peers = F.when(F.col("p") < peers, F.col("p")).when(F.col("a") >= rest, peers).otherwise(total - F.col("a"))
    most_asp = F.when(F.col("p") < peers, total - F.col("p")).when(F.col("a") >= rest, rest).otherwise(F.col("a"))
    return top.where(F.when(F.col("tag") == "peer", F.col("place") <= most_peers).otherwise(F.col("place") <= most_asp)).drop("p", "a")
