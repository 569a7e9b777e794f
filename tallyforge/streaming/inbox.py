"""Streams: new statement files as they come, idempotent batches, and the state of deliveries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.identity import TRANSITIONS
from ..sources.statement import read_statements

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_records(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Records of files as they appear, so many files a batch; run with an available-now trigger it is a batch that knows where it was."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(path)
    return read_statements(stream)


def appended_once(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that adds rows by key once, also when a batch is tried again: each batch has a folder of its own, which a second try
    replaces, and holds only keys that no other batch has."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        try:
            stored = spark.read.parquet(path).where(F.col("batch") != number).select(*keys)
            fresh = fresh.join(stored, keys, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def delivery_states(events: DataFrame, key: str = "delivery_id") -> DataFrame:
    """``delivery_id, state, token, stale``: the state of each delivery after each batch of its events (seq, event, token). A worker whose token
    is older than one seen has lost its lease, and changes nothing."""

    def step(delivery: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, token, stale = state.get if state.exists else ("received", 0, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for event, t in zip(rows["event"], rows["token"], strict=True):
            if t < token:
                stale += 1
                continue
            token = int(t)
            now = TRANSITIONS.get((now, event), now)
        state.update((now, token, stale))
        yield pd.DataFrame({key: [delivery[0]], "state": [now], "token": [token], "stale": [stale]})

    out = f"`{key}` {events.schema[key].dataType.simpleString()}, state string, token long, stale long"
    return events.groupBy(key).applyInPandasWithState(step, out, "state string, token long, stale long", "update", GroupStateTimeout.NoTimeout)


def windowed_totals(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Totals by event time with a watermark. Beyond the reference, which knows calendar lateness only."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
