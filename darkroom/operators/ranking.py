"""The best shot of each cluster, and what is said of the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions.scalars import clamp, f32, ratio, rounded_text
from darkroom.operators import sessions
from darkroom.operators.pairs import ClusterConfig
from darkroom.operators.ranges import in_ranges
from darkroom.operators.sessions import large_groups
from darkroom.sources.staging import staged

#: A cluster of more rows is not ranked in one window.
LONG = 50_000
#: What a row gets from its cluster.
RANK = ("cluster_id", "rank_no", "best_id", "rank_delta")


def composite() -> Column:
    """aesthetic, face quality and sharpness (both within 0 and 1) less misses; unknown parts count 0.5."""
    face = F.when(F.coalesce(F.col("features.face.face_count") > 0, F.lit(False)), clamp(F.col("features.face.avg_capture_quality"))).otherwise(f32(0.5))
    sharp = F.when(F.col("features.pixel").isNotNull(), clamp(ratio(F.col("features.pixel.blur_variance"), f32(200)))).otherwise(f32(0.5))
    return F.col("aesthetic") * f32(0.45) + face * f32(0.20) + sharp * f32(0.20) - F.col("miss") * f32(0.35)


def ranks(scored: DataFrame, long: int = LONG) -> DataFrame:
    """scored (cluster_id, pos, id, rank_score and more) with rank_no (1 is best), best_id and rank_delta, the score that
    is missing to the best. Ties go to the smaller pos; clusters of one row are left out.

    A cluster is ranked in one window; those of more than `long` rows, which are few, by ranges.
    """
    order = Window.partitionBy("cluster_id").orderBy(F.desc("rank_score"), "pos")
    top = F.max(F.struct("rank_score", (-F.col("pos")).alias("p"), "id"))
    large = staged(scored.groupBy("cluster_id").agg(top.alias("_top"), F.count("*").alias("_n")).where(F.col("_n") > max(1, long)).select("cluster_id", "_top"), "large")
    some = bool(large.limit(1).count())
    columns = [*scored.columns, "rank_no", F.col("_top.id").alias("best_id"), (F.col("_top.rank_score") - F.col("rank_score")).alias("rank_delta")]
    whole = Window.partitionBy("cluster_id")
    rest = scored.join(F.broadcast(large.select("cluster_id")), "cluster_id", "left_anti") if some else scored
    out = rest.withColumns({"rank_no": F.row_number().over(order), "_top": top.over(whole), "_n": F.count("*").over(whole)}).where("_n >= 2").select(*columns)
    if not some:
        return out
    placed = in_ranges(scored.join(F.broadcast(large), "cluster_id"), "cluster_id", [F.desc("rank_score"), F.asc("pos")], "rank_no")
    return out.unionByName(placed.withColumn("rank_no", F.col("rank_no").cast("int")).select(*columns))


def ranks_of(rows: DataFrame, long: int = LONG, more: tuple[str, ...] = (), alone: bool = False) -> DataFrame:
    """(id, cluster_id, rank_score, rank_no, best_id, rank_delta and more) of the members of groups of two or more, from the rows of sessions.grouped()
    that carry rank_score: what ranks() finds by cluster_id and pos, with one shuffle for ids of clusters, order by time and ranks.
    With alone, rows of no group are there too, without these."""
    names = ["id", "cluster_id", "rank_score", "rank_no", "best_id", (F.col("_best") - F.col("rank_score")).alias("rank_delta"), *more]
    order = [F.desc("rank_score"), F.desc("at"), F.asc("id")]
    rest, large = large_groups(rows, long)
    group = Window.partitionBy("root")
    best = group.orderBy(*order)
    out = rest.withColumns({
        "rank_no": F.row_number().over(best), "best_id": F.first("id").over(best), "_best": F.first("rank_score").over(best), "cluster_id": F.min("id").over(group), "_n": F.count("*").over(group),
    })
    out = out.withColumns({c: F.when(F.col("_n") >= 2, F.col(c)) for c in ("cluster_id", "rank_no", "best_id", "_best")}) if alone else out.where("_n >= 2")
    out = out.select(*names)
    if large is None:
        return out
    placed = in_ranges(large, "cluster_id", order, "rank_no")
    first = placed.where("rank_no = 1").select("cluster_id", F.col("id").alias("best_id"), F.col("rank_score").alias("_best"))
    return out.unionByName(placed.withColumn("rank_no", F.col("rank_no").cast("int")).join(F.broadcast(first), "cluster_id").select(*names))


def with_ranks(df: DataFrame, made: Callable[[DataFrame], DataFrame], config: ClusterConfig = ClusterConfig(), long: int = LONG, vectors: DataFrame | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, at, the columns named by carried, cluster_id, rank_no, best_id, rank_delta) of every row of df, the last four null for rows of no group.

    df has created_at and what made() makes the rest from: id, the columns that sessions.clusters() takes, and rank_score (see
    sessions.settled()). Rows are shuffled once, by time, in the form df has them, and those of groups that reach over a cell of time once more, by group.
    """
    names = ["id", "at", *carried, *RANK]
    narrow = df.withColumn("at", F.unix_micros("created_at")).drop("created_at")
    rows, links, done = sessions.settled(narrow.where("at is not null"), config, long, vectors, carried, made=made)
    found = ranks_of(sessions.rooted(rows, links), long, ("at", *carried), alone=True).select(*names)
    timeless = made(narrow.where("at is null")).select("id", "at", *carried, *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in RANK])
    return done.select(*names).unionByName(found).unionByName(timeless)


def told(ranked: DataFrame) -> DataFrame:
    """Rows with ranks (rank_no, rank_delta, best_id) and reasons, with is_best_in_cluster and, for those that are not, two more reasons.
    Reasons may have some of their fields only; then the two have these."""
    gap, fields = F.col("rank_delta"), ranked.schema["reasons"].dataType.elementType.names
    reason = lambda kind, detail, confidence: F.struct(*[x.alias(f) for f, x in (("kind", F.lit(kind)), ("detail", detail), ("confidence", confidence)) if f in fields])
    more = F.array(
        reason("LowerAesthetic", F.concat(F.lit("1 better shot(s) in this burst (Δ"), rounded_text(gap, 2), F.lit(")")), clamp(f32(0.5) + gap * f32(0.4))),
        reason("NearDuplicate", F.concat(F.lit("Near duplicate of "), F.col("best_id")), f32(0.8)),
    )
    return ranked.withColumns({"is_best_in_cluster": F.col("rank_no") == 1, "reasons": F.when(F.col("rank_no") > 1, F.concat("reasons", more)).otherwise(F.col("reasons"))})


def ranked(members: DataFrame, long: int = LONG) -> DataFrame:
    """members (cluster_id, pos, id and fused columns) with rank_score, ranks() and what told() adds."""
    return told(ranks(members.withColumn("rank_score", composite()), long))


def ranked_clusters(members: DataFrame) -> DataFrame:
    """(cluster_id, best_id, toss_ids worst first, reasons_by_id worst first) of each cluster."""
    losers = ranked(members)
    worst = lambda *cols: F.transform(F.sort_array(F.collect_list(F.when(F.col("rank_no") > 1, F.struct("rank_no", *cols))), asc=False), lambda x: x)
    out = losers.groupBy("cluster_id").agg(F.first("best_id").alias("best_id"), worst("id", "reasons").alias("l"))
    return out.select("cluster_id", "best_id", F.transform("l", lambda x: x["id"]).alias("toss_ids"), F.transform("l", lambda x: F.struct(x["id"].alias("id"), x["reasons"].alias("reasons"))).alias("reasons_by_id"))


def kinds_as_text(reasons: Column) -> Column:
    """The kinds of reasons in one text, which takes far less room in a shuffle than an array of them."""
    return F.array_join(F.transform(reasons, lambda r: r["kind"]), ",")


def kinds_of_text(text: Column) -> Column:
    """Reasons with a kind alone, from kinds_as_text()."""
    return F.transform(F.filter(F.split(text, ","), lambda k: k != ""), lambda k: F.struct(k.alias("kind")))


def with_clusters(assets: DataFrame, ranks: DataFrame, kinds_only: bool = False, fuse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """assets with cluster_id, best flag, reasons and junk (at least 0.6 for the others) rewritten from ranks (id, cluster_id, rank_no,
    rank_delta, best_id); what an earlier pass left is cleared first. Assets are shuffled once, by id; with kinds_only their reasons
    have a kind alone and go as a short text; with fuse, scores and reasons are made after that shuffle and do not go along. Files are far smaller than their rows, so the join does not go by their size."""
    # all that is asked of a rank is whether it is the first
    found = ranks.select("id", "cluster_id", F.least("rank_no", F.lit(2)).alias("rank_no"), "rank_delta", "best_id")
    assets = assets.withColumn("reasons", kinds_as_text(F.col("reasons"))) if kinds_only else assets
    df = assets.drop("cluster_id", "is_best_in_cluster").join(found.hint("merge"), "id", "left")
    df = fuse(df) if fuse else df
    return rewritten(df.withColumn("reasons", kinds_of_text(F.col("reasons"))) if kinds_only else df)


def rewritten(fused: DataFrame) -> DataFrame:
    """Fused assets with their ranks (cluster_id, rank_no, rank_delta, best_id, null for those in no cluster), with best flag, reasons and junk (at
    least 0.6 for the others) rewritten from these."""
    loser, df = F.col("rank_no") > 1, told(fused)
    return df.withColumns({
        "is_best_in_cluster": F.coalesce("is_best_in_cluster", F.lit(False)), "junk": F.when(loser, F.greatest("junk", f32(0.6))).otherwise(F.col("junk")),
    }).drop("rank_no", "rank_delta", "best_id")


def recent(assets: DataFrame, limit: int) -> DataFrame:
    """The newest `limit` assets that are neither favourite nor hidden, of which those past tier 0 stay."""
    newest = assets.where("not is_favorite and not is_hidden").orderBy(F.desc("created_at"), "id").limit(limit)
    return newest.where("tier_completed >= 1")
