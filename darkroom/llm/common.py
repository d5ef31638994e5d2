"""What the operators of this subpackage share: reading tables, staging, batches of rows."""

from __future__ import annotations

import ctypes
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.sources.staging import shared_dir, staged  # noqa: F401

#: A word is a run of anything but ASCII white space; bytes.split() cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(n: int) -> int:
    return 1 << max(0, (int(n) - 1).bit_length())


def give_back() -> None:
    """Gives memory that is free back to the system, as idle workers stay beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(of: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The function of batches, after which a worker gives back what it took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(batches)
        give_back()

    return run


def slices(batch: pa.RecordBatch, lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of about `most` bytes each; a single row may be larger. Memory that is free after a batch
    goes back to the system."""
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
    give_back()


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, at most so many rows go to a Python worker together: a bound on memory where rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(before, most) if before > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def literal_rows(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A few rows from the driver as a literal of the plan; fields is a list of `name: type`."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def bounded_broadcast(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Broadcasts df when its counted rows stay under a bound; else it is joined by shuffling."""
    return F.broadcast(df) if rows <= most else df


def joined_by_count(rows: DataFrame, found: DataFrame, key: str, held: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the other columns of found by a key that stands there once, where its column `held` says how many rows have
    it, of `total` rows.

    Keys of more than a fair share of the rows, of which there are 4 a partition at most, are broadcast, so that their rows
    stay where they are. All other keys are joined by shuffling. how is inner or left.
    """
    fair = total // (4 * shuffle_partitions(rows.sparkSession))
    hot = F.broadcast(found.where(F.col(held) > fair).drop(held))
    rest = found.where(F.col(held) <= fair).drop(held)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest.hint("merge"), key, how))
