"""The engine in SQL: temporary functions and views over a view of assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.functions.scalars import EARTH_M, UTILITY_KEYWORDS
from darkroom.operators import fusion, queue
from darkroom.sources.schema import REASON_LABELS
from darkroom.sources.weights import Weights


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _functions(assets: str) -> list[str]:
    hits = " + ".join(f"cast(contains(lower(coalesce(t, '')), {_text(k)}) as int)" for k in UTILITY_KEYWORDS)
    labels = " ".join(f"when {_text(k)} then {_text(v)}" for k, v in REASON_LABELS.items())
    half = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
    far = f"2 * {EARTH_M} * asin(sqrt(case when {half} > 1 then 1 else {half} end))"  # least() would take a null for 1
    far_of = far.replace("lat1", "a.latitude").replace("lat2", "b.latitude").replace("lon1", "a.longitude").replace("lon2", "b.longitude")
    width, at = "(greatest(seconds, 1) * 1000000L)", "unix_micros(created_at)"
    bands = f"""
      from (select *, {at} as at, floor({at} / {width}) as band from {assets} where created_at is not null) a
      join (select *, {at} as at, explode(array(floor({at} / {width}), floor({at} / {width}) - 1)) as band from {assets} where created_at is not null) b
        on a.band = b.band and b.at - a.at <= seconds * 1000000L and (b.at > a.at or (b.at = a.at and a.id < b.id))"""
    same = "coalesce(a.burst_id = b.burst_id and a.burst_id <> '', false)"
    return [
        "luma(r int, g int, b int) returns int return cast(floor((299 * r + 587 * g + 114 * b) / 1000) as int)",
        "hamming(a bigint, b bigint) returns int return bit_count(a ^ b)",
        f"haversine_m(lat1 double, lon1 double, lat2 double, lon2 double) returns double return {far}",
        "within_window(a timestamp, b timestamp, seconds int) returns boolean return abs(unix_micros(a) - unix_micros(b)) div 1000000 <= seconds",
        "byte_size_of(size bigint, width bigint, height bigint) returns bigint return case when coalesce(size, 0) > 0 then size else width * height div 4 end",
        f"keyword_hits(t string) returns int return {hits}",
        f"reason_label(kind string) returns string return case kind {labels} end",
        f"band_pairs(seconds int) returns table (id_a string, id_b string, gap bigint) return select a.id, b.id, (b.at - a.at) div 1000000 {bands}",
        f"""band_records(seconds int) returns table (id_a string, id_b string, gap bigint, latitude_a double, longitude_a double, dhash_a bigint, latitude_b double, longitude_b double, dhash_b bigint)
          return select a.id, b.id, (b.at - a.at) div 1000000, a.latitude, a.longitude, a.dhash, b.latitude, b.longitude, b.dhash {bands}""",
        f"""near_links(seconds int, bits int, metres double) returns table (id_a string, id_b string) return select a.id, b.id {bands}
          where coalesce({far_of} <= metres, true) and ({same} or coalesce(bit_count(a.dhash ^ b.dhash) <= bits, false))""",
    ]


FUNCTIONS = ("luma", "hamming", "haversine_m", "within_window", "byte_size_of", "keyword_hits", "reason_label", "band_pairs", "band_records", "near_links")


def register(spark: SparkSession, assets: DataFrame, decisions: DataFrame | None = None, weights: Weights = Weights(), prefix: str = "dark_") -> dict[str, str]:
    """Registers functions and views in a session and gives their names.

    assets is what the store holds. Views: assets (with dhash beside the features), fused (scores and reasons by the weights), chips
    (id, kind, title, related_id) and queue (with position by the queue's order in a window of its own, so select a
    page of it by order and limit). Functions are those of FUNCTIONS, of which band_pairs,
    band_records (pairs with place and hash of both, so that no join by id follows) and near_links are table functions.
    """
    name = {x: prefix + x for x in (*FUNCTIONS, "assets", "fused", "chips", "queue")}
    assets.withColumn("dhash", F.col("features.pixel.dhash")).createOrReplaceTempView(name["assets"])
    fused = fusion.fused(assets, weights)
    fused.createOrReplaceTempView(name["fused"])
    chips = fused.select("id", F.explode(queue.reason_chips(F.col("reasons"), F.lit(1))).alias("c")).select("id", "c.*")
    chips.createOrReplaceTempView(name["chips"])
    none = spark.createDataFrame([], "asset_id string, decision string")
    queue.review_queue(fused, none if decisions is None else decisions, weights).createOrReplaceTempView(name["queue"])
    for text in _functions(name["assets"]):
        spark.sql(f"create or replace temporary function {prefix}{text}")
    return name
