"""The cascade of analysis as a stream: assets go through the tiers as their metadata arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from darkroom.operators import scheduler
from darkroom.plans.engine import Engine
from darkroom.sources.staging import staged

FAILED = "id string, tier int"


class Cascade:
    """Tiers over a feed of metadata. analyze(rows, tier) gives rows with their features; live (id), where given, is what
    the library still holds.

    What analyze leaves out is kept in a table of failures and not tried again; what live lacks is hidden. Every step of a
    batch looks at the tier that its rows have completed, so a batch that runs again after a crash goes on
    where it stopped, and no asset goes through a tier twice.
    """

    def __init__(self, engine: Engine, analyze: Callable[[DataFrame, int], DataFrame], live: DataFrame | None = None, vlm: bool = True):
        self.engine, self.analyze, self.live, self.vlm = engine, analyze, live, vlm
        self.path = f"{engine.store.path}/cascade/failed"

    def failed(self) -> DataFrame:
        """(id, tier) of what could not be analysed."""
        p, fs = self.engine.store._fs(self.path)
        spark = self.engine.spark
        return spark.read.schema(FAILED).parquet(f"{self.path}/*") if fs.exists(p) else spark.createDataFrame([], FAILED)

    def pending(self, rows: DataFrame, tier: int) -> DataFrame:
        """Rows that are due for a tier, without those that failed before."""
        due = scheduler.ambiguous(rows) if tier == 3 else rows.where(F.col("tier_completed") == tier - 1)
        due = due.where(~F.col("is_favorite") & ~F.col("is_hidden"))
        return due.join(self.failed().select("id").distinct(), "id", "left_anti")

    def step(self, ids: DataFrame, tier: int, number: int) -> None:
        engine = self.engine
        rows = staged(self.pending(engine.lookup(ids), tier), "due")
        if not rows.limit(1).count():
            return
        found = staged(self.analyze(rows, tier), "analysed")
        if found.limit(1).count():
            engine.save_fused(found, tier)
        left = rows.join(found.select("id"), "id", "left_anti").select("id", F.lit(tier).alias("tier"))
        left.write.mode("overwrite").parquet(f"{self.path}/{number}-{tier}")

    def batch(self, rows: DataFrame, number: int) -> None:
        last = staged(rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), F.struct("analyzed_at", "tier_completed")).alias("r")).select("r.*"), "arrived")
        self.engine.upsert_meta(last)
        if self.live is not None:  # also when a batch runs again, as its metadata says nothing of this
            self.engine.without_missing(self.engine.lookup(last.select("id")), self.live)
        for tier in (1, 2, 3) if self.vlm else (1, 2):
            self.step(last.select("id"), tier, number)

    def start(self, feed: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = feed.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
