"""Tiered work: pending rows by tier, the next batch, and how device states pace it."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions.scalars import f32

#: Batch sizes by thermal state, the memory that tier 3 needs, and the junk that it is asked about.
NOMINAL_BATCH, FAIR_BATCH, HOT_BATCH, LEAST_RAM_GB = 32, 16, 4, 6
AMBIGUOUS = (0.35, 0.70)


@dataclass(frozen=True)
class SchedulerState:
    batch_size: int = NOMINAL_BATCH
    paused: bool = False
    pause_reason: str = ""
    tier1: int = 0
    tier2: int = 0
    tier3: int = 0
    cursor: str = ""

    def observed(self, thermal: str) -> SchedulerState:
        """After a thermal state was seen: heat pauses and shrinks batches, and only a pause by heat ends by cooling."""
        if thermal in ("serious", "critical"):
            return replace(self, paused=True, pause_reason=f"thermal:{thermal}", batch_size=HOT_BATCH)
        size = min(self.batch_size, FAIR_BATCH) if thermal == "fair" else NOMINAL_BATCH
        resumed = self.pause_reason.startswith("thermal:")
        return replace(self, batch_size=size, paused=self.paused and not resumed, pause_reason="" if resumed else self.pause_reason)

    def can_run_vlm(self, power: str, ram_gb: int) -> bool:
        return not self.paused and ram_gb >= LEAST_RAM_GB and power in ("charging", "full")

    def progressed(self, tier: int, done: int, cursor: str = "") -> SchedulerState:
        return replace(self, **{f"tier{tier}": getattr(self, f"tier{tier}") + done}, cursor=cursor)

    def as_dict(self) -> dict:
        return asdict(self)


def ids_below_tier(assets: DataFrame, tier: int) -> DataFrame:
    """Rows that have not completed a tier; sort by created_at descending, then id."""
    return assets.where((F.col("tier_completed") < tier) & ~F.col("is_favorite") & ~F.col("is_hidden"))


def ambiguous(assets: DataFrame, low: float = AMBIGUOUS[0], high: float = AMBIGUOUS[1]) -> DataFrame:
    """Rows past tier 2 whose junk lies between bounds; sort by distance from 0.5, then id."""
    return assets.where((F.col("tier_completed") == 2) & F.col("junk").between(f32(low), f32(high)))


def next_batch(assets: DataFrame, state: SchedulerState, vlm: bool = False) -> DataFrame:
    """(tier, id, position) of the next batch: the first tier with pending rows, as many as its batch holds.

    One plan: the pending rows of each tier are cut to its batch by a limit, and the lowest tier present stays.
    """
    if state.paused:
        return assets.select(F.lit(0).alias("tier"), "id", F.lit(0).alias("position")).where("false")
    newest = [F.desc("created_at"), F.asc("id")]
    tiers = [(1, ids_below_tier(assets, 1), newest, state.batch_size), (2, ids_below_tier(assets, 2), newest, state.batch_size)]
    if vlm:
        tiers.append((3, ambiguous(assets), [F.asc(F.abs(F.col("junk") - f32(0.5))), F.asc("id")], max(1, state.batch_size // 4)))
    out = None
    for tier, pending, order, n in tiers:
        cut = pending.orderBy(*order).limit(n)
        cut = cut.select(F.lit(tier).alias("tier"), "id", F.row_number().over(Window.orderBy(*order)).alias("position"))
        out = cut if out is None else out.unionByName(cut)
    lowest = F.min("tier").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("_low", lowest).where("tier = _low").drop("_low")


def whole_batch(assets: DataFrame, vlm: bool = False) -> DataFrame:
    """(tier, id, position) of all pending rows, the lowest tier of each; positions sort as those of next_batch() do. Nothing
    is cut, sorted or numbered."""
    age = F.coalesce(-F.unix_micros("created_at"), F.lit(2**63 - 1))
    tiers = [(1, ids_below_tier(assets, 1)), (2, ids_below_tier(assets, 2).where("tier_completed >= 1")), (3, ambiguous(assets))]
    out = None
    for tier, pending in tiers[: 3 if vlm else 2]:
        first, second = (F.lit(0).cast("long"), F.abs(F.col("junk") - f32(0.5))) if tier == 3 else (age, f32(0))
        some = pending.select(F.lit(tier).alias("tier"), "id", F.struct(first.alias("age"), second.alias("distance"), "id").alias("position"))
        out = some if out is None else out.unionByName(some)
    return out


def reachable(batch: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch whose id is among the live ones, and the missing ones."""
    ids = live.select("id").distinct()
    return batch.join(ids, "id", "left_semi"), batch.join(ids, "id", "left_anti")


def pruned(assets: DataFrame, live: DataFrame) -> DataFrame:
    """assets with the pending ones (below tier 2) that live (id) no longer holds hidden and marked done."""
    gone = reachable(assets.where("tier_completed < 2"), live)[1].select("id", F.lit(True).alias("_gone"))
    lost = F.coalesce("_gone", F.lit(False))
    df = assets.join(gone, "id", "left").withColumns({"is_hidden": F.col("is_hidden") | lost, "tier_completed": F.when(lost, 2).otherwise(F.col("tier_completed"))})
    return df.select(*assets.columns)


def device_fold(log: DataFrame, group: str = "device_id", seq: str = "seq") -> DataFrame:
    """log (device, seq, thermal) with batch_size and paused after each row, by windows alone.

    Heat sets the batch to 4 and a nominal state to 32; a fair one keeps what stands, 16 at most. So the last row that
    was not fair settles the size, and heat alone pauses.
    """
    order = Window.partitionBy(group).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    size = F.when(F.col("thermal").isin("serious", "critical"), HOT_BATCH).when(F.col("thermal") != "fair", NOMINAL_BATCH)
    last = F.coalesce(F.last(size, ignorenulls=True).over(order), F.lit(NOMINAL_BATCH))
    fair = F.col("thermal") == "fair"
    return log.withColumns({"batch_size": F.when(fair, F.least(last, F.lit(FAIR_BATCH))).otherwise(last).cast("int"), "paused": F.col("thermal").isin("serious", "critical")})
