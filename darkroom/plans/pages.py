"""The review queue as a sorted table, read page by page."""

from __future__ import annotations

import bisect
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.operators.queue import queue_order


@dataclass(frozen=True)
class Cursor:
    """A place in a queue table: the part and the place in it that the next page begins at."""

    part: int = 0
    place: int = 0


class Pages:
    """A queue in order, in parts by range. How many rows each part has is known, so the n-th page, or the one after a
    cursor, is read from the one or two parts it lies in. A new queue is a new table; cursors belong to theirs."""

    def __init__(self, spark: SparkSession, path: str, counts: dict[int, int]):
        self.spark, self.path = spark, path
        self.parts = sorted(p for p, n in counts.items() if n)
        self.starts = [0]
        for p in self.parts:
            self.starts.append(self.starts[-1] + counts[p])

    @staticmethod
    def write(queue: DataFrame, folder: str, parts: int = 32) -> Pages:
        """The queue, sorted by queue_order() over all its rows."""
        path, order = f"{folder.rstrip('/')}/queue-{uuid.uuid4().hex}", queue_order()
        at = F.monotonically_increasing_id()
        rows = queue.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", at)
        rows = rows.select("*", F.shiftright("_at", 33).cast("int").alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("place")).drop("_at")
        rows.write.partitionBy("part").parquet(path)
        return Pages.open(queue.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Pages:
        found = spark.read.parquet(path).groupBy("part").count().collect() if Pages._any(spark, path) else []
        return Pages(spark, path, {r["part"]: r["count"] for r in found})

    @staticmethod
    def _any(spark: SparkSession, path: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return any(f.isDirectory() for f in fs.listStatus(p))

    def __len__(self) -> int:
        return self.starts[-1]

    def page(self, number: int, size: int = 1000) -> DataFrame:
        """Rows number * size and on, with position, their place in the whole queue; unordered, sort by it."""
        return self._rows(number * size, size)

    def after(self, cursor: Cursor, size: int = 1000) -> tuple[DataFrame, Cursor | None]:
        """The next rows from a cursor on, and the cursor behind them, or None at the end."""
        begin = self.starts[self.parts.index(cursor.part)] + cursor.place if cursor.part in self.parts else 0
        return self._rows(begin, size), self.cursor(begin + size)

    def cursor(self, position: int) -> Cursor | None:
        if position >= len(self):
            return None
        k = bisect.bisect_right(self.starts, position) - 1
        return Cursor(self.parts[k], position - self.starts[k])

    def _rows(self, begin: int, size: int) -> DataFrame:
        end = min(begin + size, len(self))
        some = [(p, s, self.starts[k + 1]) for k, (p, s) in enumerate(zip(self.parts, self.starts)) if s < end and begin < self.starts[k + 1]]
        if not some:
            return self.spark.range(0).selectExpr("cast(null as string) as id", "id as position")
        rows = self.spark.read.parquet(self.path).where(F.col("part").isin([p for p, _, _ in some]))
        place = F.lit(False)
        start = F.lit(None).cast("long")
        for p, s, e in some:
            place = place | ((F.col("part") == p) & F.col("place").between(max(begin, s) - s, min(end, e) - s - 1))
            start = F.when(F.col("part") == p, F.lit(s).cast("long")).otherwise(start)
        return rows.where(place).withColumn("position", start + F.col("place")).drop("part", "place")
