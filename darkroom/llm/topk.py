"""Exact top-k by inner product: columnar branch and bound over blocks of dimensions.

Candidates lie in vertical blocks, dimension by dimension. For each query a block's partial products are added up
some dimensions at a time; the norms of what remains bound what a candidate can still gain, and candidates that
cannot reach the query's k-th best score are dropped from the block before the next dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkroom.llm.common import shuffle_partitions, staged

BLOCK_ROWS, QUERY_ROWS, DIMENSIONS = 4096, 8192, 16
#: Bytes of candidates, and of queries, that one task holds.
GROUP_BYTES = 64 << 20
#: Doubles add up whole numbers exactly below EXACT; scores beyond a long are returned as its nearest end.
EXACT, LONGEST = float(1 << 53), (1 << 63) - 1
#: Bytes that hold any score of finite doubles, to put those beyond a long in order.
WIDE = 280
#: Fixed value: an odd multiplier that spreads partitions over slots.
SPREAD = 0x9E3779B97F4A7C15


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """(id, vector): each component x as floor(factor * x) with x as double. Rows whose id or vector is null, or
    whose vector holds a null or a non-finite component, are left out."""
    x = F.col(vector_col)
    good = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))) & ~F.isnan(v.cast("double")))
    # from 2^53 on a double is whole, and may exceed the long that floor() gives
    whole = lambda v: F.when(F.abs(v) < float(1 << 53), F.floor(F.when(F.abs(v) < float(1 << 53), v)).cast("double")).otherwise(v)
    return df.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: whole(v.cast("double") * factor)).alias("vector"))


def best_of_block(query: np.ndarray, columns: np.ndarray, ids: np.ndarray, rest: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of candidates of a block that may be among a query's k best; least is a score to reach.

    columns has a row for each dimension; rest[b] the norms of the candidates from dimension block b on.
    """
    left = np.sqrt(np.array([np.dot(query[d:], query[d:]) for d in range(0, len(query), DIMENSIONS)] + [0.0]))
    alive = np.nonzero(ids != own)[0]
    sums = np.zeros(len(alive))
    for b, d in enumerate(range(0, len(query), DIMENSIONS)):
        part = columns[d : d + DIMENSIONS]
        sums = sums + query[d : d + DIMENSIONS] @ (part if len(alive) == part.shape[1] else part[:, alive])
        gain = left[b + 1] * rest[b + 1][alive] * (1 + 1e-9)
        if len(alive) > k:  # the k-th best of what is sure already bounds from below
            least = max(least, np.partition(sums - gain, len(sums) - k)[len(sums) - k] - 1e-6)
        keep = sums + gain >= least - 1e-6
        alive, sums = alive[keep], sums[keep]
    return ids[alive], sums


def exact_best(query: np.ndarray, columns: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """(score, id) of a query's k best in a block in whole numbers of any size, for vectors that doubles cannot add up."""
    whole = [int(x) for x in query]
    scores = sum((q * np.array([int(x) for x in column], dtype=object) for q, column in zip(whole, columns) if q), np.zeros(len(ids), dtype=object))
    return sorted(((s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != own), key=lambda x: (-x[0], x[1]))[:k]


def _blocks(rows: DataFrame, size: int, groups: int) -> DataFrame:
    """(width, slot, ids, data): vectors of one width, up to `size` together. A partition deals its blocks to slots in
    turn, beginning at one that follows from its number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = ((TaskContext.get().partitionId() * SPREAD) % (1 << 64)) >> 33
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            widths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            starts = vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py()
            for width in np.unique(widths):
                rows = np.nonzero(widths == width)[0]
                for i in range(0, len(rows), size):
                    some = rows[i : i + size]
                    data = flat[starts[some][:, None] + np.arange(width)]
                    turn += 1
                    yield pa.RecordBatch.from_arrays([pa.array([int(width)], pa.int32()), pa.array([turn % groups], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()]), pa.array([data.astype("<f8").tobytes()])], names=["width", "slot", "ids", "data"])

    return rows.mapInArrow(of, "width int, slot int, ids binary, data binary")


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, groups: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each row of queries its k best rows of df but its own id; ties to smaller ids.

    df and queries have id and vector, as quantised() gives them; other columns are not read. Only vectors of equal
    length are compared. Scores are exact integers: where vectors are so long that doubles might round, whole numbers of
    any size are added up instead, and a score beyond a long is ranked by its value and returned as the end of the
    range. Fewer than k rows are all returned.
    Repeated rows of df count as often as they stand there; a query id that stands there several times is asked once, with
    the smallest of its vectors. No rows give no rows.

    Queries meet candidates in a grid: blocks of either are dealt to groups of about GROUP_BYTES at most, and a task has
    one group of both.
    """
    spark = df.sparkSession
    df = df.select("id", "vector")
    queries = staged(queries.groupBy("id").agg(F.min("vector").alias("vector")), "asked")
    of = lambda rows: (rows.agg(F.sum(F.size("vector"))).first()[0] or 0) * 8 // GROUP_BYTES + 1
    groups, query_groups = groups or max(8, shuffle_partitions(spark), of(df)), of(queries)
    asked = staged(_blocks(queries, QUERY_ROWS, query_groups).withColumnRenamed("slot", "query_slot"), "queries")
    held = _blocks(df, BLOCK_ROWS, groups).withColumn("query_slot", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
    spread = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, bytes | None]] = []
        width = key[0].as_py()
        blocks = []
        for ids, data in zip(right.column("ids").to_pylist(), right.column("data").to_pylist()):
            ids = np.frombuffer(ids, dtype="<i8")
            columns = np.ascontiguousarray(np.frombuffer(data, dtype="<f8").reshape(len(ids), width).T)
            rest = [np.sqrt((columns[d:] ** 2).sum(axis=0)) for d in range(0, width, DIMENSIONS)] + [np.zeros(len(ids))]
            blocks.append((ids, columns, rest))
        for ids, data in zip(left.column("ids").to_pylist(), left.column("data").to_pylist()):
            ids = np.frombuffer(ids, dtype="<i8")
            for query, vector in zip(ids.tolist(), np.frombuffer(data, dtype="<f8").reshape(len(ids), width)):
                norm = float(np.sqrt(np.square(vector).sum()))
                wide = [block for block in blocks if not norm * float(block[2][0].max(initial=0.0)) < EXACT]
                best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0)
                for block_ids, columns, rest in blocks if not wide else ():
                    least = best[-1] if len(best) == k else -np.inf
                    found, scores = best_of_block(vector, columns, block_ids, rest, query, k, least)
                    best_ids, best = np.concatenate([best_ids, found]), np.concatenate([best, scores])
                    order = np.lexsort((best_ids, -best))[:k]
                    best_ids, best = best_ids[order], best[order]
                pairs = list(zip(best.astype(np.int64).tolist(), best_ids.tolist()))
                for block_ids, columns, _ in blocks if wide else ():
                    pairs = sorted(pairs + exact_best(vector, columns, block_ids, query, k), key=lambda x: (-x[0], x[1]))[:k]
                out += [(query, i, max(-LONGEST, min(s, LONGEST)), None if -LONGEST < s < LONGEST else (s + (1 << 8 * WIDE - 1)).to_bytes(WIDE, "big")) for s, i in pairs]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64()), "beyond": pa.array(cols[3], pa.binary())})

    found = spread.groupBy("width", "slot", "query_slot").cogroup(held.groupBy("width", "slot", "query_slot")).applyInArrow(search, "query_id long, id long, score long, beyond binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
