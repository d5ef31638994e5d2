"""Centroid clustering by sort-means over integer vectors.

Each round orders the centroids by their distance from each centroid. A vector scans that order from the centroid it
was assigned to before and stops strictly beyond twice the distance to it: no centroid there can be nearer, nor as near.
Vectors lie in blocks that keep their last assignment. A round reads the blocks, writes them with the new one, and adds
up each task's sums on the way, so only sums by centroid reach the driver, and a lost executor costs part of one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import arrow_rows, literal_rows, staged

#: Vectors of a block, and blocks that go to a Python worker together.
BLOCK, BLOCKS = 2048, 8
#: Sums are sent in parts of so many bits, so that no column overflows however many tasks there are.
LIMB = 40
#: Distances and sums of them that a long cannot hold are returned as the largest long.
LONGEST = (1 << 63) - 1


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, factor: int = 256) -> DataFrame:
    """(id, vector): components x as floor(factor * x) with x as double, kept as doubles, which hold these integers exactly.
    Only vectors of `width` components are kept, none of them null or non-finite (before and after the product)."""
    wide = F.transform(F.col(vector_col), lambda v: v.cast("double") * factor)
    fine = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # floor() of Spark gives a long, which large components exceed; numpy floors in the tasks
    return df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == width) & fine).select(F.col(id_col).cast("long").alias("id"), wide.alias("vector"))


@dataclass(frozen=True)
class Centres:
    """Centroids as exact integers, their squared distances from each other, and the orders these give."""

    rows: np.ndarray
    apart: np.ndarray
    order: np.ndarray

    @staticmethod
    def of(rows: list[list[int]]) -> Centres:
        found = np.array(rows, dtype=object)
        apart = np.array([[sum((a - b) ** 2 for a, b in zip(x, y)) for y in rows] for x in rows], dtype=object)
        order = np.array([sorted((c for c in range(len(rows)) if c != own), key=lambda c: (apart[own, c], c)) for own in range(len(rows))], dtype=np.int64)
        if _fits(found):
            found, apart = found.astype(np.int64), apart.astype(np.int64)
        return Centres(found, apart, order.reshape(len(rows), -1))


def _fits(rows: np.ndarray) -> bool:
    """Whether squared distances of vectors within these bounds fit 62 bits."""
    most = int(max(np.abs(rows).max(), 1)) if rows.size else 1
    return 4 * most * most * max(rows.shape[1], 1) < 1 << 60


def nearest(rows: np.ndarray, before: np.ndarray, centres: Centres) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row, ties to the smaller number; before is where its scan begins."""
    best, least = before.copy(), np.zeros(len(rows), dtype=rows.dtype)
    for own in np.unique(before):
        at = np.nonzero(before == own)[0]
        first = ((rows[at] - centres.rows[own]) ** 2).sum(axis=1)
        low, name, live = first.copy(), np.full(len(at), own), np.arange(len(at))
        for other in centres.order[own].tolist():
            live = live[centres.apart[own, other] <= 4 * first[live]]
            if not len(live):
                break
            far = ((rows[at[live]] - centres.rows[other]) ** 2).sum(axis=1)
            better = (far < low[live]) | ((far == low[live]) & (other < name[live]))
            low[live[better]], name[live[better]] = far[better], other
        best[at], least[at] = name, low
    return best, least


def _packed(rows: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them; the first byte names it. Doubles hold any of them."""
    most = np.abs(rows).max() if rows.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind[1].encode() + kind[2].encode() + rows.astype(kind).tobytes()


def _unpacked(data: bytes, width: int, exact: bool) -> np.ndarray:
    rows = np.frombuffer(data, dtype=f"<{data[:2].decode()}", offset=2).reshape(-1, width)
    if exact:
        return rows.astype(np.int64)
    return np.array([[int(x) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    at = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield at, value & ((1 << LIMB) - 1)
        value, at = value >> LIMB, at + 1
    yield at, value


_SUM = pa.struct([("cluster", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])
_BLOCKS = "ids array<long>, data binary, cluster binary, sums array<struct<cluster: int, place: int, limb: int, value: long>>"


def _read(batch: pa.RecordBatch, width: int, centres: Centres, first: bool) -> Iterator[tuple[pa.Array, bytes, np.ndarray, np.ndarray]]:
    """(ids, packed vectors, vectors, assignment before) of each block; vectors come as rows in the first round."""
    if first:
        data = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
        found = [(batch.column(0), _packed(data), np.zeros(len(batch), dtype=np.int32))] if len(batch) else []
    else:
        rows = [i for i, x in enumerate(batch.column(0)) if x.is_valid]
        found = [(batch.column(0)[i].values, batch.column(1)[i].as_py(), np.frombuffer(batch.column(2)[i].as_py(), dtype="<i4")) for i in rows]
    for ids, data, before in found:
        rows = np.frombuffer(data, dtype=f"<{data[:2].decode()}", offset=2).reshape(-1, width)
        exact = centres.rows.dtype == np.int64 and _fits(rows.astype(np.float64))
        yield ids, data, _unpacked(data, width, exact), before


def _round(df: DataFrame, width: int, centres: Centres, first: bool) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for ids, data, rows, before in _read(batch, width, centres, first):
                best, _ = nearest(rows, before, centres)
                for c in np.unique(best).tolist():
                    some = rows[best == c]
                    for place, value in enumerate([len(some), *some.sum(axis=0).tolist()]):
                        total[c, place] = total.get((c, place), 0) + value
                yield _blocks_of([ids.to_pylist()], [data], [best.astype("<i4").tobytes()], [None])
        sums = [{"cluster": c, "place": p, "limb": limb, "value": v} for (c, p), value in total.items() for limb, v in _limbs(value)]
        yield _blocks_of([None], [None], [None], [sums])

    return staged(df.mapInArrow(of, _BLOCKS), "round", "zstd")


def _blocks_of(ids: list, data: list, cluster: list, sums: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(data, pa.binary()), pa.array(cluster, pa.binary()), pa.array(sums, pa.list_(_SUM))], names=["ids", "data", "cluster", "sums"])


def _moved(blocks: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """Each centroid as floor(sum / count) of its vectors; an empty one stays."""
    parts = blocks.where("sums is not null").select(F.inline("sums")).groupBy("cluster", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total: dict[tuple[int, int], int] = {}
    for r in parts.collect():  # centroids times components
        total[r.cluster, r.place] = total.get((r.cluster, r.place), 0) + (int(r.value) << (LIMB * r.limb))
    return [[total[c, p + 1] // total[c, 0] for p in range(len(row))] if total.get((c, 0)) else row for c, row in enumerate(centres)]


def seeds(df: DataFrame, k: int, order: Column) -> list[list[int]]:
    """The k vectors of df (id, vector) that come first by order; equal ones by their components. Null ids come last."""
    found = df.orderBy(F.col("id").isNull(), order, "vector").limit(k).select("vector").collect()
    return [[int(np.floor(x)) for x in r.vector] for r in found]


def sort_means(df: DataFrame, start: list[list[int]], rounds: int = 5) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) per row of df (id, vector), as quantised() gives them, and the final centroids.

    A round assigns all vectors, then moves centroids; vectors are assigned once more at the end. All sums and
    distances are exact whole numbers, whatever their size; a distance that a long cannot hold is LONGEST. Null and
    repeated ids stay, each row counts. No rows, or no centroids, give no rows. Other columns are not read.
    """
    spark = df.sparkSession
    if not start:
        return df.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), []
    width, centres = len(start[0]), start
    blocks = df.select("id", "vector")
    for i in range(rounds):
        with arrow_rows(spark, BLOCKS if i else BLOCK):
            blocks = _round(blocks, width, Centres.of(centres), i == 0)
        centres = _moved(blocks, centres)
    last = Centres.of(centres)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, rows, before in _read(batch, width, last, rounds == 0):
                best, least = nearest(rows, before, last)
                far = pa.array([min(x, LONGEST) for x in least.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pc.cast(ids, pa.int64()), pa.array(best.astype(np.int32)), far], names=["id", "cluster", "distance"])

    with arrow_rows(spark, BLOCKS if rounds else BLOCK):
        return staged(blocks.mapInArrow(of, "id long, cluster int, distance long"), "clusters"), centres


def with_inertia(found: DataFrame, centres: list[list[int]]) -> DataFrame:
    """found (id, cluster, distance) with cluster_inertia, inertia and centroid_sha256, the hash of the components of its
    centroid as decimal numbers joined by commas. A row for each centroid is all that is joined."""
    spark, exact = found.sparkSession, F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(exact.alias("s")).collect()}
    rows = [
        {"cluster": c, "cluster_inertia": min(sums.get(c, 0), LONGEST), "inertia": min(sum(sums.values()), LONGEST), "centroid_sha256": hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()}
        for c, row in enumerate(centres)
    ]
    table = literal_rows(spark, rows, "cluster: int, cluster_inertia: long, inertia: long, centroid_sha256: string")
    return found.join(F.broadcast(table), "cluster")
