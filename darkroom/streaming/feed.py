"""Structured Streaming around the engine: a feed of asset metadata, and pacing by device states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from darkroom.operators import fusion
from darkroom.operators.scheduler import SchedulerState
from darkroom.plans.engine import Engine
from darkroom.sources.schema import ASSETS


def changes(spark: SparkSession, path: str, files_per_trigger: int = 32) -> DataFrame:
    """Asset rows as their files arrive."""
    return spark.readStream.schema(T._parse_datatype_string(ASSETS)).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(feed: DataFrame, engine: Engine, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Fuses each micro-batch and saves it. A batch that runs again writes the same rows, so a restart loses nothing."""

    def save(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), F.struct("analyzed_at", "tier_completed")).alias("r")).select("r.*")
        done = fusion.fused(last, engine.weights).drop("should_queue")
        engine.store.save(done)

    writer = feed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def paced(log: DataFrame) -> DataFrame:
    """(device_id, thermal, batch_size, paused) after each device state of a stream (device_id, seq, thermal).

    The scheduler's state of each device is kept between batches; rows of a batch are taken by seq.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, paused, reason = state.get if state.exists else (32, False, "")
        now = SchedulerState(batch_size=int(size), paused=bool(paused), pause_reason=reason)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for thermal in rows["thermal"]:
            now = now.observed(thermal)
            out.append((key[0], thermal, now.batch_size, now.paused))
        state.update((now.batch_size, now.paused, now.pause_reason))
        yield pd.DataFrame(out, columns=["device_id", "thermal", "batch_size", "paused"])

    return log.groupBy("device_id").applyInPandasWithState(
        fold, "device_id long, thermal string, batch_size int, paused boolean", "batch_size int, paused boolean, reason string", "append", GroupStateTimeout.NoTimeout
    )
