"""The review queue, and decisions folded from their log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions.scalars import f32
from darkroom.operators.fusion import BACKUP_SLACK, LEAST_JUNK, LEAST_MISS
from darkroom.sources.schema import label_of
from darkroom.sources.weights import Weights

DECISIONS = ("keep", "toss", "skip", "undo")


def eligible(junk: float, miss: float) -> Column:
    """Stored scores against thresholds, softer where a label other than spaces names a backup."""
    backed = F.coalesce(F.length(F.trim("secondary_backup_label")) > 0, F.lit(False))
    reach = lambda c, t, least: F.col(c) >= F.when(backed, F.greatest(f32(t) - f32(BACKUP_SLACK), f32(least))).otherwise(f32(t))
    return reach("junk", junk, LEAST_JUNK) | reach("miss", miss, LEAST_MISS)


def kept_ids(decisions: DataFrame) -> DataFrame:
    return decisions.where("decision = 'keep'").select(F.col("asset_id").alias("id")).distinct()


def queue_order() -> list[Column]:
    """Heaviest first, then largest, then the worse score; ids settle ties."""
    return [F.desc("byte_size"), F.desc(F.col("pixel_width") * F.col("pixel_height")), F.desc(F.greatest("junk", "miss")), F.asc("id")]


def review_queue(assets: DataFrame, decisions: DataFrame, weights: Weights = Weights(), labels: list[str] | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Assets to review: neither favourite nor hidden, eligible, not the best of a cluster, not kept before, with any
    of the labels if some are given. Rows whose reasons are null are dropped. Unordered; sort by queue_order()."""
    df = waiting(assets, weights).join(kept_ids(decisions), "id", "left_anti")
    if deleted is not None:
        df = df.join(deleted.select("id").distinct(), "id", "left_anti")
    return in_categories(df, labels or [])


def waiting(assets: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Assets to review whatever was decided."""
    df = assets.where(~F.col("is_favorite") & ~F.col("is_hidden")).where(eligible(weights.junk_queue_threshold, weights.miss_queue_threshold))
    return df.where(F.col("cluster_id").isNull() | ~F.coalesce("is_best_in_cluster", F.lit(False))).where(F.col("reasons").isNotNull())


def in_categories(df: DataFrame, labels: list[str]) -> DataFrame:
    if not labels:
        return df
    return df.where(F.exists("reasons", lambda r: F.coalesce(label_of(r["kind"]), r["kind"]).isin(*labels)))


def reason_chips(reasons: Column, cluster_size: Column) -> Column:
    """Reasons as chips (kind, title, related_id): the two cluster kinds become one that leads to the best shot."""
    cluster = ("NearDuplicate", "LowerAesthetic")
    said = F.get(F.filter(reasons, lambda r: r["kind"] == "NearDuplicate"), F.lit(0))["detail"]
    best = F.nullif(F.trim(F.regexp_extract(said, r"^Near duplicate of (?s)(.*)$", 1)), F.lit(""))
    title = F.concat(F.greatest(cluster_size, F.lit(2)).cast("string"), F.lit(" similar photos — tap for best"))
    chip = lambda kind, text, related: F.struct(kind.alias("kind"), text.alias("title"), related.alias("related_id"))
    one = F.when(best.isNotNull(), F.array(chip(F.lit("Similar photos"), title, best))).otherwise(F.array().cast("array<struct<kind: string, title: string, related_id: string>>"))
    rest = F.transform(
        F.filter(reasons, lambda r: ~r["kind"].isin(*cluster)),
        lambda r: chip(F.coalesce(label_of(r["kind"]), r["kind"]), F.when(r["detail"] == "", F.coalesce(label_of(r["kind"]), r["kind"])).otherwise(r["detail"]), F.lit(None).cast("string")),
    )
    return F.concat(one, rest)


def folded(log: DataFrame, group: str = "queue_id", seq: str = "seq") -> DataFrame:
    """The decisions of a log that no undo has taken back, as rows of it.

    An undo takes back the last standing decision, and does nothing when none stands. With h the number of
    decisions that stand after a row, a decision stands if no later row has a smaller h.
    """
    order = Window.partitionBy(group).orderBy(seq)
    upto, onward = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    step = F.when(F.col("decision") == "undo", -1).otherwise(1)
    df = log.withColumn("_s", F.sum(step).over(upto))
    df = df.withColumn("_h", F.col("_s") - F.least(F.lit(0), F.min("_s").over(upto))).withColumn("_low", F.min("_h").over(onward))
    return df.where((F.col("decision") != "undo") & (F.col("_low") >= F.col("_h"))).drop("_s", "_h", "_low")


def accepted(log: DataFrame, lengths: DataFrame, group: str = "queue_id", seq: str = "seq") -> DataFrame:
    """log without decisions made when the queue (queue_id, length) was empty: undo never gives items back."""
    order = Window.partitionBy(group).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    made = F.sum(F.when(F.col("decision") == "undo", 0).otherwise(1)).over(order)
    df = log.withColumn("_made", made).join(lengths, group, "left")
    return df.where((F.col("decision") == "undo") | (F.col("_made") <= F.coalesce("length", F.lit(0)))).drop("_made", "length")


def without_keeps(decisions: DataFrame, undone: DataFrame) -> DataFrame:
    """decisions without any keep of the assets in undone (asset_id)."""
    keeps = decisions.where("decision = 'keep'").join(undone.select("asset_id").distinct(), "asset_id", "left_anti")
    return decisions.where("decision <> 'keep'").unionByName(keeps.select(*decisions.columns))
