"""Streams: pages as they are saved, profiles into the store, running counters with a threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholarforge.operators.store import latest
from scholarforge.sources.sinks import upsert_folder


def page_stream(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def once_per_link(stream: DataFrame, link: str, when: str, late: str = "30 days") -> DataFrame:
    """Repeated deliveries of a link dropped while the watermark holds them."""
    return stream.withWatermark(when, late).dropDuplicatesWithinWatermark([link])


def into_store(stream: DataFrame, folder: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Every batch upserted into the store, edits protected; returns the started query."""

    def put(batch: DataFrame, _: int) -> None:
        rows = latest(prepare(batch) if prepare else batch)
        upsert_folder(batch.sparkSession, folder, rows)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_activity(stream: DataFrame, when: str = "activity_timestamp", late: str = "7 days") -> DataFrame:
    """Activities per hour and name, late rows within the watermark counted."""
    return stream.withWatermark(when, late).groupBy(F.window(when, "1 hour"), "activity_name").count()


COUNTED = "start string, link string, hit_no long, needs_match boolean"


def counted_stream(stream: DataFrame, start: str, link: str, threshold: int = 10) -> DataFrame:
    """Running number of every hit of a start; from ``threshold`` on a pattern must match (A14), with state per start."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for batch in batches:
            no = range(seen + 1, seen + len(batch) + 1)
            seen += len(batch)
            yield pd.DataFrame({"start": key[0], "link": batch[link].tolist(), "hit_no": list(no), "needs_match": [n >= threshold for n in no]})
        state.update((seen,))

    return stream.groupBy(F.col(start)).applyInPandasWithState(count, COUNTED, "seen long", "append", GroupStateTimeout.NoTimeout)
