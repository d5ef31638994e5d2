"""Assets from the event and embedding tables: deterministic metadata and signals, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = """
 'a'||cast(n as {text}) as id, n as seq, date_trunc('second', ts) as created_at, user_id, event_type,
 n%37=0 as is_favorite, n%53=0 as is_hidden, (event_type='view' and n%3=0) as is_screenshot, n%3<>0 as is_burst, n%7=0 as is_live,
 case when n%97=0 then '' when n%3<>0 then 'b'||cast(n {div} 3 as {text}) end as burst_id,
 case when n%4<>3 then cast(37.77 as double)+cast(n%5 as double)*cast(0.0002 as double) end as latitude,
 case when n%4<>3 then cast(-122.42 as double)+cast(n%7 as double)*cast(0.0002 as double) end as longitude,
 cast(1000+n%3000 as bigint) as pixel_width, cast(800+n%2000 as bigint) as pixel_height,
 case when n%10=9 then cast(0 as bigint) else (n*7919)%9000000 end as byte_size, n%6<>0 as is_locally_available,
 case when n%8=0 then 'Google Photos' when n%8=1 then '  ' end as secondary_backup_label,
 cast(value as float) as blur_variance,
 cast(cast((n*13)%100 as double)/100 as float) as dark_fraction, cast(cast((n*17)%100 as double)/100 as float) as bright_fraction,
 {xor} as dhash, cast(n%3 as int) as tier_completed, cast(n%4 as int) as face_count,
 cast(cast((n*29)%100 as double)/100 as float) as face_quality, n%9=0 as any_blink, n%13=0 as any_looking_away, n%17=0 as any_mouth_open,
 n%19=0 as has_document, n%23=0 as has_barcode, cast((n%29) {div} 26 as int) as utility_keyword_hits,
 cast(cast((n*31)%100 as double)/10 as float) as aesthetic_raw"""
_HASH = "cast(case event_type when 'view' then 0 when 'click' then 4095 when 'error' then 16773120 when 'signup' then 68702699520 else -1 end as bigint)"

#: DuckDB: common table expressions that end with `assets`.
SQL = (
    "base as (select event_id n, ts, user_id, event_type, value from events), assets as (select "
    + _COLUMNS.format(text="varchar", div="//", xor=f"xor({_HASH}, n%16)")
    + ", cast(dark_fraction as float) > 0.85::float and blur_variance < 20::float as is_pocket_shot from base)"
)


def flat_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of SQL's `assets`."""
    return _flat_of(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("n"), "ts", "user_id", "event_type", "value"))


def _flat_of(events: DataFrame, *more: str) -> DataFrame:
    columns = _split(_COLUMNS.format(text="string", div="div", xor=f"({_HASH} ^ (n%16))"))
    pocket = (F.col("dark_fraction") > F.lit(0.85).cast("float")) & (F.col("blur_variance") < F.lit(20).cast("float"))
    return events.selectExpr(*columns, *more).withColumn("is_pocket_shot", pocket)


def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, created_at, event_type, value): what assets are made of, in the least room. assets_of() makes them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_id").alias("n"), F.date_trunc("second", "ts").alias("created_at"), "event_type", F.col("value").cast("float").alias("value"))


def assets_of(rows: DataFrame) -> DataFrame:
    """assets() from rows with what narrow() gives, the time as `at` in microseconds; other columns of rows stay. user_id is null."""
    events = rows.withColumns({"ts": F.timestamp_micros("at"), "user_id": F.lit(None).cast("long")})
    return _featured(_flat_of(events, *[c for c in rows.columns if c != "event_type"]), [c for c in rows.columns if c != "event_type"])


def with_vectors(flat: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """flat with vector, the embedding of row number seq modulo their count."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    return flat.withColumn("_v", F.col("seq") % F.lit(vectors.count())).join(vectors, "_v", "left").drop("_v")


def naming_vectors(flat: DataFrame, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """flat with vector_id, which names the vectors that with_vectors() would add, and these (vector_id, vector)."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vector_id"), F.col("embedding").alias("vector"))
    return flat.withColumn("vector_id", F.col("seq") % F.lit(vectors.count())), vectors


def _split(text: str) -> list[str]:
    """A select list at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset rows with the nested features that fusion reads."""
    return _featured(flat_assets(spark, sf_dir))


def _featured(flat: DataFrame, more: list[str] = []) -> DataFrame:
    count = lambda flag: F.when(F.col(flag), 1).otherwise(0).cast("int")
    zero = F.lit(0.0).cast("float")
    features = F.struct(
        F.struct("blur_variance", "dark_fraction", "bright_fraction", zero.alias("mean_luminance"), "dhash", "is_pocket_shot", zero.alias("uniformity")).alias("pixel"),
        F.struct(
            "face_count", F.col("face_quality").alias("avg_capture_quality"), count("any_blink").alias("blink_count"), count("any_looking_away").alias("looking_away_count"),
            count("any_mouth_open").alias("mouth_open_count"), "any_blink", "any_looking_away", "any_mouth_open",
        ).alias("face"),
        F.struct(F.lit(False).alias("has_dense_text"), "has_barcode", "has_document", F.lit(0).alias("text_block_count"), "utility_keyword_hits").alias("text"),
        F.lit(None).cast("struct<subject_placement: float, subject_coverage: float, cropped_subject: boolean>").alias("composition"),
        F.struct(F.lit(None).cast("array<float>").alias("embedding"), "aesthetic_raw", F.lit(None).cast("array<struct<label: string, similarity: float>>").alias("junk_similarities")).alias("embedding"),
        F.lit(None).cast("struct<category: string, ephemeral: boolean, reason: string, confidence: float>").alias("vlm"),
    )
    from darkroom.sources.schema import META_COLUMNS

    return flat.select(*META_COLUMNS, "seq", "user_id", "event_type", "tier_completed", features.alias("features"), *more)
