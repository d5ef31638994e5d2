"""Face, text, composition and zero-shot signals from observation tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from darkroom.functions.scalars import cosine, f32, keyword_hits

MOST_PROMPTS = 10_000
#: Limits of eye and mouth openings and of the head's angles.
BLINK_EAR, YAW, PITCH, MOUTH_OPEN = 0.18, 0.35, 0.45, 0.55

#: Prompts of utility shots; the first eight are the built-in ones.
JUNK_PROMPTS = (
    "a photo of a parking garage pillar",
    "a photo of a Wi-Fi router label",
    "a photo of a whiteboard with notes",
    "a photo of a package tracking slip",
    "a screenshot of a meme",
    "a photo of a receipt",
    "a photo of a QR code or barcode sticker",
    "a blurry accidental pocket photo",
    "a photo of a shipping label on a cardboard box",
    "a photo of a document on a desk",
)


def aspect_ratio(points: Column) -> Column:
    """Height over width of some points; null with fewer than four, or no width."""
    span = lambda k: F.array_max(F.transform(points, lambda p: p[k])) - F.array_min(F.transform(points, lambda p: p[k]))
    return F.when((F.size(points) >= 4) & (span("x") > 1e-5), span("y") / F.when(span("x") > 1e-5, span("x")))


def blink(left: Column, right: Column) -> Column:
    closed = lambda eye: F.coalesce(aspect_ratio(eye) < BLINK_EAR, F.lit(False))
    return closed(left) | closed(right)


def looking_away(yaw: Column, pitch: Column) -> Column:
    zero = F.lit(0.0)
    return (F.abs(F.coalesce(yaw, zero)) > YAW) | (F.abs(F.coalesce(pitch, zero)) > PITCH)


def mouth_open(lips: Column) -> Column:
    return F.coalesce(aspect_ratio(lips) > MOUTH_OPEN, F.lit(False))


def face_features(faces: DataFrame) -> DataFrame:
    """(asset_id, face_count, avg_capture_quality, counts, flags) from (asset_id, quality, blink, away, mouth): flags
    are given. The mean divides by all faces, those without a quality too."""
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).cast("int")
    out = faces.groupBy("asset_id").agg(
        F.count("*").cast("int").alias("face_count"),
        (F.coalesce(F.sum(F.col("quality").cast("double")), F.lit(0.0)) / F.count("*")).alias("avg_capture_quality"),
        count("blink").alias("blink_count"), count("away").alias("looking_away_count"), count("mouth").alias("mouth_open_count"),
    )
    return out.select("*", *[(F.col(c) > 0).alias(f) for c, f in (("blink_count", "any_blink"), ("looking_away_count", "any_looking_away"), ("mouth_open_count", "any_mouth_open"))])


def text_features(blocks: DataFrame, keywords: tuple[str, ...] | None = None) -> DataFrame:
    """(asset_id, text_block_count, has_dense_text, utility_keyword_hits) from (asset_id, seq, text).

    Keywords are looked for in the lower-cased blocks joined by spaces, so one may span two blocks.
    """
    joined = blocks.groupBy("asset_id").agg(
        F.count("*").cast("int").alias("text_block_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))), lambda b: b["text"]), " ").alias("joined"),
    )
    hits = keyword_hits(F.col("joined"), keywords) if keywords else keyword_hits(F.col("joined"))
    return joined.select("asset_id", "text_block_count", (F.col("text_block_count") >= 4).alias("has_dense_text"), hits.cast("int").alias("utility_keyword_hits"))


def text_block(assets: DataFrame, blocks: DataFrame, barcodes: DataFrame, documents: DataFrame, keywords: tuple[str, ...] | None = None) -> DataFrame:
    """(asset_id, text) for each of assets (asset_id): the whole text part of its features.

    From text blocks (asset_id, seq, text), barcodes (asset_id), and found documents (asset_id, seq, confidence), of which the
    first counts. An asset without any of them has no dense text, no hits and no flags.
    """
    found = text_features(blocks, keywords)
    codes = barcodes.select("asset_id").distinct().withColumn("has_barcode", F.lit(True))
    first = documents.groupBy("asset_id").agg(F.min(F.struct("seq", "confidence"))["confidence"].alias("c"))
    first = first.select("asset_id", document_flag(F.array("c")).alias("has_document"))
    rows = assets.select("asset_id").distinct().join(found, "asset_id", "left").join(codes, "asset_id", "left").join(first, "asset_id", "left")
    no, none = F.lit(False), F.lit(0)
    return rows.select("asset_id", F.struct(
        F.coalesce("has_dense_text", no).alias("has_dense_text"), F.coalesce("has_barcode", no).alias("has_barcode"), F.coalesce("has_document", no).alias("has_document"),
        F.coalesce("text_block_count", none).alias("text_block_count"), F.coalesce("utility_keyword_hits", none).alias("utility_keyword_hits"),
    ).alias("text"))


def document_flag(confidences: Column) -> Column:
    return F.coalesce(F.get(confidences, F.lit(0)) > 0.5, F.lit(False))


def composition(boxes: DataFrame) -> DataFrame:
    """(asset_id, placement, coverage, cropped) of each asset's box of most confidence, from (asset_id, seq, confidence,
    x, y, w, h); the earlier box wins a tie. No box at all is for the caller: 0.5, 0.3 and false."""
    first = boxes.groupBy("asset_id").agg(F.max(F.struct(F.col("confidence"), (-F.col("seq")).alias("s"), "x", "y", "w", "h")).alias("b"))
    x, y, w, h = (F.col(f"b.{k}") for k in "xywh")
    anchors = [(a / 3, b / 3) for a in (1, 2) for b in (1, 2)] + [(0.5, 0.5)]
    away = F.least(*[F.hypot(F.lit(a) - (x + w / 2), F.lit(b) - (y + h / 2)) for a, b in anchors])
    m = 0.02
    return first.select(
        "asset_id",
        F.greatest(F.lit(0.0), 1.0 - away * 2).alias("placement"),
        F.least(F.lit(1.0), w * h * 2.5).alias("coverage"),
        ((x < m) | (x + w > 1 - m) | (y < m) | (y + h > 1 - m)).alias("cropped"),
    )


def stub_embedding(width: Column, height: Column) -> Column:
    """The 64 numbers that stand for an embedding where no model runs."""
    f = lambda x, d: (x % d).cast("float") / f32(d)
    small = (F.least(width, F.lit(32)) + F.least(height, F.lit(32))).cast("float") / f32(64)
    return F.concat(F.array(f(width, 251), f(height, 251), f(width * height, 997), small), F.array_repeat(f32(0), 60))


def prompts_from_lines(lines: DataFrame) -> DataFrame:
    """(label, vector) from text lines (seq, value): blank lines and those that begin with # are left out, and the
    vectors are one-hot stubs of 64 numbers."""
    kept = lines.where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    order = F.row_number().over(Window.orderBy("seq")) - 1
    hot = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("at") % 64, f32(1)).otherwise(f32(0)))
    return kept.withColumn("at", order).select(F.trim("value").alias("label"), hot.alias("vector"))


def builtin_prompts(spark: SparkSession, count: int = 8) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(JUNK_PROMPTS[:count])), "seq long, value string")
    return prompts_from_lines(rows)


def read_prompts(spark: SparkSession, path: str | None) -> DataFrame:
    """(label, vector) from a JSON file that holds an array of them; the built-in ones where there is no such file, or
    it holds none."""
    if path is not None:
        try:
            found = spark.read.schema("label string, vector array<float>").option("multiLine", True).json(path).where("label is not null and vector is not null")
            if found.limit(1).count():
                return found
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return builtin_prompts(spark)


def zero_shot(assets: DataFrame, prompts: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, similarities: array<struct<label, similarity>>) in label order. prompts (label, vector) must be few, as a
    prompt file is; they are joined to each row as one array, and a query with more than MOST_PROMPTS fails."""
    few = prompts.limit(MOST_PROMPTS + 1).agg(F.sort_array(F.collect_list(F.struct("label", "vector"))).alias("prompts"))
    refused = F.raise_error(F.lit(f"more than {MOST_PROMPTS} prompts")).cast(few.schema["prompts"].dataType)
    few = few.select(F.when(F.size("prompts") > MOST_PROMPTS, refused).otherwise(F.col("prompts")).alias("prompts"))
    similar = F.transform("prompts", lambda p: F.struct(p["label"].alias("label"), cosine(F.col(vector_col), p["vector"], 1e-9, True).cast("float").alias("similarity")))
    return assets.select(id_col, vector_col).crossJoin(F.broadcast(few)).select(id_col, similar.alias("similarities"))


def top_similarity(similarities: Column) -> Column:
    """The struct (similarity, i, label) of the largest similarity; the last wins a tie."""
    return F.array_max(F.transform(similarities, lambda x, i: F.struct(x["similarity"].alias("similarity"), i.alias("i"), x["label"].alias("label"))))


def group_miss(members: DataFrame) -> DataFrame:
    """members (group_id, id, miss) with group_miss: in groups of two or more only where a sibling is clean."""
    w = Window.partitionBy("group_id")
    clean = F.bool_or(~F.col("miss")).over(w)
    return members.withColumn("group_miss", F.when(F.count("*").over(w) < 2, F.col("miss")).otherwise(F.col("miss") & clean))


def classify_stub(df: DataFrame) -> DataFrame:
    """The answer of no model: unknown, not ephemeral, confidence 0."""
    return df.withColumn("vlm", F.struct(F.lit("unknown").alias("category"), F.lit(False).alias("ephemeral"), F.lit("").alias("reason"), f32(0).alias("confidence")))
