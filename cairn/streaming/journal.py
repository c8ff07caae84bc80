"""Streams over the event log: run stages, revisions, sessions, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, folder: str, *, files_a_batch: int = 1, like: T.StructType = EVENTS) -> DataFrame:
    """Event files of a folder, as they come, with the columns of like."""
    return spark.readStream.schema(like).option("maxFilesPerTrigger", files_a_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind and window; late ones are dropped once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def sessions(events: DataFrame, *, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "n")


def revisions(events: DataFrame) -> DataFrame:
    """user_id, event_id, revision: events numbered per user as they come, in the order of ts and id within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        state.update((n + len(rows),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "revision": range(n, n + len(rows))})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, revision long", "n long", "append", GroupStateTimeout.NoTimeout)


def stages(events: DataFrame, *, idle: str = "5 minutes", late: str = "10 minutes", last: str = "error") -> DataFrame:
    """user_id, stage, finished: the stage of a run after each batch; marks after the last one are ignored.

    A run that has been idle so long, in the events' own time, is forgotten once the watermark has passed that.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stage, done = state.get if state.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        for kind in rows["event_type"]:
            if not done:
                stage, done = kind, kind == last
        state.update((stage, done))
        seen = int(rows["ts"].iloc[-1].value // 1_000_000)
        state.setTimeoutTimestamp(max(seen + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "stage": [stage], "finished": [done]})

    kept = events.withWatermark("ts", late)
    return kept.groupBy("user_id").applyInPandasWithState(step, "user_id long, stage string, finished boolean", "stage string, finished boolean", "update", GroupStateTimeout.EventTimeTimeout)
