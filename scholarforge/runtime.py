"""Session helpers: staging of intermediate results in the cluster's shared folder.

Stages are written as Parquet below ``spark.checkpoint.dir`` (read from the
session), so that a lost executor never loses a stage and later jobs read only
the columns they need.  Only where that setting is absent - in tests and other
local runs - a folder is made here and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share; made and set only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()  # set by setCheckpointDir alone
        found = given.get() if given.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scholarforge-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Stages written inside hand Python at most so many rows at a time; the session's own setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before) if int(before) > 0 else rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@atexit.register
def _drop_stages() -> None:
    for spark, path in _STAGED:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session has ended already
            return


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test-data folder, as a file or a folder of Parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
