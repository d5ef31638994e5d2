"""Connected components of a list of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from darkroom.sources.staging import staged

#: A node with more than so many links, or one in so many of all links, is a hub.
HUB_LINKS, HUB_SHARE = 200, 10_000


def _with_nearest(pairs: DataFrame, links: int) -> DataFrame:
    """pairs (a, b) with m, the smallest of a and all its neighbours; min() combines before the shuffle.

    The pairs of a hub are not brought together: hubs are few by their definition, twice HUB_SHARE at most, and are
    broadcast. Those of all other nodes are joined by shuffling.
    """
    nearest = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(HUB_LINKS, links // HUB_SHARE)
    hubs = F.broadcast(nearest.where(hub).select("a", "m"))
    rest = pairs.join(hubs.select("a"), "a", "left_anti").join(nearest.where(~hub).select("a", "m").hint("merge"), "a")
    return pairs.join(hubs, "a").unionByName(rest).select("a", "b", "m")


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_nearest(both, n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """Links run from the larger to the smaller node here."""
    low = links.groupBy("a").agg(F.min("b").alias("b"))
    return _with_nearest(links, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low)


def _settled(links: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct links, written and read back, with their number and a checksum, taken on the way."""
    seen = Observation()
    found = links.where("a <> b").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    out = staged(found, "links")
    return out, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a, b: long), root being the smallest node of its component.

    Loops and repeated links do no harm; no links give no rows. Each step is written to the shared
    folder, so a lost executor costs at most one step, and only a count and a checksum reach the driver.
    The links between each node and the hub of its component are all that is left at the end.
    """
    now, mark = _settled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(most_rounds):
        if not mark[0]:
            break
        large, sign = _settled(_large_star(now, mark[0]))
        now, sign = _settled(_small_star(large, sign[0]))
        if sign == mark:
            break
        mark = sign
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
