"""Near-duplicate candidates: a band join over time by buckets, then place and likeness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.functions.scalars import cosine, hamming, haversine_m
from darkroom.sources.staging import staged


@dataclass(frozen=True)
class ClusterConfig:
    seconds: int = 30
    hamming: int = 10
    cosine: float = 0.88
    metres: float | None = 50.0


def band_pairs(df: DataFrame, time_col: str, seconds: int, id_col: str = "id", suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """All pairs of rows at most `seconds` apart, each once, the earlier (then smaller id) first.

    Times count to the microsecond. Each row meets the rows of its bucket and the one before in an equi-join, so no row
    is compared with all. Rows without a time pair with none. Columns come twice, with suffixes; gap is in whole seconds.
    """
    at = F.unix_micros(time_col)
    limit, width = seconds * 1_000_000, max(1, seconds) * 1_000_000
    df = df.where(F.col(time_col).isNotNull())
    left = df.select(*[F.col(c).alias(c + suffixes[0]) for c in df.columns], at.alias("_ta"), F.floor(at / width).alias("_bucket"))
    right = df.select(*[F.col(c).alias(c + suffixes[1]) for c in df.columns], at.alias("_tb"), F.explode(F.array(F.floor(at / width), F.floor(at / width) - 1)).alias("_bucket"))
    a, b = id_col + suffixes[0], id_col + suffixes[1]
    gap = F.col("_tb") - F.col("_ta")
    joined = left.join(right, "_bucket").where((gap <= limit) & ((gap > 0) | ((gap == 0) & (F.col(a) < F.col(b)))))
    return joined.withColumn("gap", F.floor(gap / 1_000_000).cast("long")).drop("_ta", "_tb", "_bucket")


def near_place(metres: float | None) -> Column:
    """Within so many metres; a missing coordinate, or no limit, passes."""
    if metres is None:
        return F.lit(True)
    far = haversine_m(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b"))
    return F.coalesce(far <= metres, F.lit(True))


def same_burst() -> Column:
    return F.coalesce((F.col("burst_id_a") == F.col("burst_id_b")) & (F.col("burst_id_a") != ""), F.lit(False))


def similar(config: ClusterConfig) -> Column:
    return F.coalesce(hamming(F.col("dhash_a"), F.col("dhash_b")) <= config.hamming, F.lit(False))


def links(df: DataFrame, config: ClusterConfig = ClusterConfig()) -> DataFrame:
    """(id_a, id_b) of rows that belong together. df has id, created_at, latitude, longitude, burst_id, dhash and
    optionally vector. Vectors meet only for near pairs that neither burst nor hash links. With a column fresh, only
    pairs of which one row is fresh are looked at."""
    fresh = ["fresh"] if "fresh" in df.columns else []
    pairs = band_pairs(df.select("id", "created_at", "latitude", "longitude", "burst_id", "dhash", *fresh), "created_at", config.seconds)
    if fresh:
        pairs = pairs.where("fresh_a or fresh_b")
    pairs = pairs.where(near_place(config.metres)).select("id_a", "id_b", "gap", (same_burst() | similar(config)).alias("linked"))
    if "vector" not in df.columns:
        return pairs.where("linked").select("id_a", "id_b", "gap")
    pairs = staged(pairs, "pairs")  # read twice below, joined once
    own = df.where("vector is not null")
    both = pairs.where("not linked").join(own.select(F.col("id").alias("id_a"), F.col("vector").alias("vector_a")), "id_a")
    both = both.join(own.select(F.col("id").alias("id_b"), F.col("vector").alias("vector_b")), "id_b")
    close = F.coalesce(cosine(F.col("vector_a"), F.col("vector_b")) >= config.cosine, F.lit(False))
    return pairs.where("linked").unionByName(both.where(close).select("id_a", "id_b", "gap", "linked")).select("id_a", "id_b", "gap")


def sessions(df: DataFrame, time_col: str, seconds: int, by: str) -> DataFrame:
    """df with session: how many gaps of more than `seconds` lie before a row, in each group of `by`. For one order of all
    rows see operators.sessions.numbered."""
    w = Window.partitionBy(by).orderBy(time_col)
    at = F.unix_micros(time_col)
    new = F.coalesce(at - F.lag(at).over(w) > seconds * 1_000_000, F.lit(True)).cast("int")
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
