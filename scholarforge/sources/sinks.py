"""Writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarforge.operators.store import protected_upsert


def export_csv(df: DataFrame, path: str) -> None:
    """A department's export (K1, K2)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_ranked(ranked: DataFrame, path: str) -> None:
    """Peers and aspirants in full, a folder for each list (K3)."""
    ranked.write.mode("overwrite").partitionBy("tag").parquet(path)


def append_audit(spark: SparkSession, path: str, user_id: int, activity: str, remark: str | None, at: str) -> None:
    """One row of the audit log (K4, K5)."""
    row = spark.createDataFrame([(user_id, activity, remark, at)], "user_id long, activity_name string, remark string, at string")
    row.select(F.to_timestamp("at", "yyyy-MM-dd HH:mm:ss").alias("activity_timestamp"), "user_id", "activity_name", "remark").write.mode("append").parquet(path)


def ranking_json(df: DataFrame, path: str) -> None:
    """Ranking as JSON lines (K9)."""
    df.write.mode("overwrite").json(path)


def init_tables(spark: SparkSession, database: str) -> None:
    """Empty tables of the store."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, ddl in {
        "profiles": "profile_link STRING, name STRING, department STRING, university STRING, tag STRING, position STRING, phd_year STRING, phd_school STRING, promotion_year STRING, text_raw STRING, user_updated INT",
        "activities": "activity_id BIGINT, activity_timestamp TIMESTAMP, user_id BIGINT, activity_name STRING, remark STRING",
        "benchmarks": "benchmark_id BIGINT, benchmark_timestamp TIMESTAMP, user_id BIGINT, name STRING, department STRING, position STRING, metrics STRING",
        "process": "crawler_name STRING, processing INT",
    }.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")


def set_process(spark: SparkSession, path: str, crawler: str, running: bool) -> None:
    """The status flag of a crawler."""
    spark.createDataFrame([(crawler, int(running))], "crawler_name string, processing int").write.mode("overwrite").parquet(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a folder and its class of paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _current(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The store's last version, and for every bucket the version that holds it."""
    fs, hadoop = _files(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(hadoop(path))] if fs.exists(hadoop(path)) else []
    last = max((int(n.split("-")[1]) for n in names if n.startswith("current-")), default=0)
    if not last:
        return 0, {}
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(hadoop(f"{path}/current-{last}")), "UTF-8")
    return last, {int(k): int(v) for k, v in json.loads(text).items()}


def read_store(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of a store (of some of its buckets); null before anything was written."""
    _, where = _current(spark, path)
    paths = [f"{path}/data/version={v}/bucket={k}" for k, v in where.items() if buckets is None or k in buckets]
    return spark.read.parquet(*paths) if paths else None


def upsert_folder(spark: SparkSession, path: str, new: DataFrame, buckets: int = 64, link: str = "profile_link") -> None:
    """Protected upsert into a store of Parquet files (K6); :func:`read_store` reads it.

    Rows lie in ``buckets`` by a hash of the link.  Only the buckets that ``new`` touches are
    read and written, as a new version beside the old one; one small file, renamed into
    place at the end, names the version of every bucket.  A crash before that leaves the
    store as it was; versions no longer named are removed after it.
    """
    fs, hadoop = _files(spark, path)
    last, where = _current(spark, path)
    bucket = F.pmod(F.xxhash64(link), F.lit(buckets)).cast("int")
    touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    stored = read_store(spark, path, touched)
    rows = protected_upsert(spark.createDataFrame([], new.schema) if stored is None else stored, new)
    rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={last + 1}")
    where.update({b: last + 1 for b in touched})
    out = fs.create(hadoop(f"{path}/_next"), True)
    out.write(bytearray(json.dumps(where).encode()))
    out.close()
    if not fs.rename(hadoop(f"{path}/_next"), hadoop(f"{path}/current-{last + 1}")):
        raise OSError(f"could not switch {path} to version {last + 1}")
    kept = set(where.values()) | {last + 1}
    for folder in fs.listStatus(hadoop(f"{path}/data")):
        if int(folder.getPath().getName().split("=")[1]) not in kept:
            fs.delete(folder.getPath(), True)
    fs.delete(hadoop(f"{path}/current-{last - 1}"), False)  # readers of the last version still find its file
