"""Decisions as a stream: the undo stack of each queue is kept as state, and what it does comes out as changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "queue_id long, seq long, asset_id string, decision string, change int"
#: State of several kinds is held by this provider only.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: the size of a page of the queue, beyond which decisions fall on an empty queue.
PAGE = 1000


class UndoStack(StatefulProcessor):
    """One queue: decisions are pushed while the page has assets, an undo takes the last one back."""

    def __init__(self, length: int = PAGE):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stack = handle.getListState("stack", "seq long, asset_id string, decision string")
        self.made = handle.getValueState("made", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("seq")
        stack = [tuple(x) for x in self.stack.get()]
        made = self.made.get()[0] if self.made.exists() else 0
        out = []
        for seq, asset, decision in zip(log["seq"].tolist(), log["asset_id"], log["decision"]):
            if decision == "undo":
                if stack:
                    out.append((key[0], *stack.pop(), -1))
            elif made < self.length:
                made += 1
                stack.append((seq, asset, decision))
                out.append((key[0], seq, asset, decision, 1))
        self.made.update((made,))
        self.stack.clear()
        if stack:
            self.stack.put(stack)
        yield pd.DataFrame(out, columns=["queue_id", "seq", "asset_id", "decision", "change"])

    def close(self) -> None:
        pass


def use_state(spark: SparkSession) -> None:
    """Lets the streams that start from now on keep their state where lists are supported."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def changes(log: DataFrame, length: int = PAGE) -> DataFrame:
    """(queue_id, seq, asset_id, decision, change) from a stream of (queue_id, seq, asset_id, decision): 1 for a
    decision that is made, -1 for one that is taken back. Within a micro-batch rows go by seq; batches must come in order."""
    rows = log.select(F.col("queue_id").cast("long"), F.col("seq").cast("long"), "asset_id", "decision")
    return rows.groupBy("queue_id").transformWithStateInPandas(UndoStack(length), CHANGES, "append", "None")


def standing(found: DataFrame) -> DataFrame:
    """The decisions that changes leave standing."""
    return found.groupBy("queue_id", "seq", "asset_id", "decision").agg(F.sum("change").alias("n")).where("n > 0").drop("n")
