"""A uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Rows lie in partitions. The matrix says how many rows each partition sends to each shard; drawn from the multivariate
hypergeometric law, it makes the outcome that of one uniform shuffle. Each partition permutes its rows and cuts them by
its row of the matrix; each shard permutes what it receives. Partitions, permutations and the matrix follow from
hashes and a seed, so a lost task that runs again deals its rows out in the same way.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkroom.llm.common import literal_rows, power_of_two, shuffle_partitions

#: Groups that a shard's rows are ranked in; their sizes give each group's first slot.
GROUPS = 16


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows drawn from good + bad are good: inversion from the mode outward."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = max(low, min(high, (draws + 1) * (good + 1) // (good + bad + 2)))
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    left = right = math.exp(log(good, mode) + log(bad, draws - mode) - log(good + bad, draws))
    u = rng.random() - left
    down = up = mode
    while u > 0 and (down > low or up < high):
        if up < high:
            right *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= right
            if u <= 0:
                return up
        if down > low:
            left *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= left
            if u <= 0:
                return down
    return mode


def matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; shard sizes differ by at most one."""
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rng, out = random.Random(seed), []
    for size in sizes:
        row, free, left = [], sum(room), size
        for s in range(shards):
            n = hypergeometric(rng, room[s], free - room[s], left)
            row.append(n)
            free -= room[s]
            left -= n
        room = [r - n for r, n in zip(room, row)]
        out.append(row)
    return out


def sharded(rows: DataFrame, keys: list[str], shards: int = 40, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """All rows and columns of rows with shard (0 to shards - 1) and slot (from 0 without gaps in each shard).

    keys are columns that tell rows apart and decide where they fall; rows that agree in all of them are spread over
    neighbouring places by no particular rule. Null keys are values like any other. Shard sizes differ by at most one;
    with fewer rows than shards some are empty. Columns named shard or slot are replaced. No rows give no rows.

    Only the sizes of the partitions, a fixed number of them, reach the driver.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    partitions = partitions or power_of_two(max(64, 2 * shuffle_partitions(spark)))
    h = lambda salt: F.xxhash64(F.lit(salt), F.lit(seed), *keys)
    names = {n: "_" + n for n in ("part", "rank", "group", "within", "ends")}
    while any(v in rows.columns for v in names.values()):
        names = {n: "_" + v for n, v in names.items()}
    part, rank, group, within, cut = names.values()
    dealt = rows.withColumn(part, F.pmod(h("partition"), F.lit(partitions)).cast("int"))
    sizes = [0] * partitions
    for p, n in dealt.groupBy(part).count().collect():
        sizes[p] = n
    table = matrix(sizes, shards, seed)
    ends = []
    for row in table:
        at, sums = 0, []
        for n in row:
            at += n
            sums.append(at)
        ends.append(sums)
    # for each partition the rank at which each shard's rows end
    cuts = literal_rows(spark, [{part: p, cut: e} for p, e in enumerate(ends)], f"{part}: int, {cut}: array<long>")
    local = Window.partitionBy(part).orderBy(h("local"), *keys)
    ranked = dealt.withColumn(rank, F.row_number().over(local)).join(F.broadcast(cuts), part)
    shard = F.size(F.filter(cut, lambda e: e < F.col(rank))).cast("int")
    sent = ranked.withColumn("shard", shard).drop(cut, part, rank).withColumn(group, F.pmod(h("arrived"), F.lit(GROUPS)).cast("int"))
    groups = sent.groupBy("shard", group).count()
    before = Window.partitionBy("shard").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    firsts = groups.select("shard", group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(within))
    arrived = Window.partitionBy("shard", group).orderBy(h("slot"), *keys)
    placed = sent.withColumn("slot", F.row_number().over(arrived) - 1).join(F.broadcast(firsts), ["shard", group])
    return placed.withColumn("slot", (F.col("slot") + F.col(within)).cast("long")).drop(group, within)
