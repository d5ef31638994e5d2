"""Fusion of signals into junk, miss and aesthetic scores with ordered reasons: one projection of column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.functions.analyzers import top_similarity
from darkroom.functions.scalars import at_least, clamp, f32, ratio, rounded_text
from darkroom.sources.weights import Weights

SIMILARITY = 0.28
BACKUP_SLACK, LEAST_JUNK, LEAST_MISS = 0.08, 0.35, 0.40


@dataclass(frozen=True)
class Rule:
    """A reason with what it adds to a score. score is None for reasons that only inform."""

    kind: str
    when: Column
    detail: Column
    confidence: Column
    score: str | None = None
    effect: Column | None = None

    def holds(self) -> Column:
        return F.coalesce(self.when, F.lit(False))

    def reason(self) -> Column:
        return F.when(self.holds(), F.struct(F.lit(self.kind).alias("kind"), self.detail.alias("detail"), clamp(self.confidence).alias("confidence")))


def signal_rules(w: Weights) -> list[Rule]:
    """The rules on signals. Their order, the texts of their details and their shares."""
    c = lambda path: F.col(f"features.{path}")
    blur, dark, bright = c("pixel.blur_variance"), c("pixel.dark_fraction"), c("pixel.bright_fraction")
    top, vlm = F.col("_top"), c("vlm.confidence")
    percent = lambda x: rounded_text(x * f32(100), 0)
    faces = lambda n, what: F.concat(F.greatest(c(n), F.lit(1)).cast("string"), F.lit(f" face(s) {what}"))

    def junk(kind: str, when: Column, detail, weight: float, share: float | None = None, confidence: Column | None = None) -> Rule:
        said = detail if isinstance(detail, Column) else F.lit(detail)
        effect = f32(weight) if share is None else f32(weight) * f32(share)
        return Rule(kind, when, said, effect if confidence is None else confidence, "junk", effect)

    def miss(kind: str, when: Column, detail, weight: float) -> Rule:
        said = detail if isinstance(detail, Column) else F.lit(detail)
        return Rule(kind, when, said, f32(weight), "miss", f32(weight))

    likely = F.least(f32(w.zero_shot_junk) * clamp(top["similarity"]), f32(0.95))
    ephemeral = f32(w.vlm_ephemeral_junk) * clamp(vlm)
    return [
        junk("PocketShot", c("pixel.is_pocket_shot"), "Near-uniform / accidental capture", w.pocket_junk),
        junk("Blur", (blur < f32(w.blur_hard)), F.concat(F.lit("Very blurry (laplacian "), rounded_text(blur, 1), F.lit(")")), w.blur_junk, 0.9, f32(w.blur_junk)),
        junk("Blur", (blur >= f32(w.blur_hard)) & (blur < f32(w.blur_soft)), F.concat(F.lit("Soft focus (laplacian "), rounded_text(blur, 1), F.lit(")")), w.blur_junk, 0.6),
        junk("Underexposed", (dark > f32(w.dark_threshold)) & ~F.isnan(dark), F.concat(percent(dark), F.lit("% near-black pixels")), w.dark_junk),
        junk("Overexposed", (bright > f32(w.bright_threshold)) & ~F.isnan(bright), F.concat(percent(bright), F.lit("% clipped highlights")), w.bright_junk),
        junk("Screenshot", F.col("is_screenshot"), "Device screenshot", w.screenshot_junk, 0.5),
        junk("ReceiptOrDocument", c("text.has_document") | (c("text.utility_keyword_hits") > 0), "Document / receipt-like text", w.text_document_junk),
        junk("BarcodeOrLabel", c("text.has_barcode"), "Barcode or QR detected", w.barcode_junk),
        Rule("UtilityJunk", (top["similarity"] > f32(SIMILARITY)) & ~F.isnan(top["similarity"]), F.concat(F.lit("Looks like: "), top["label"]), likely, "junk", likely),
        Rule("VlmEphemeral", c("vlm.ephemeral"), F.concat(c("vlm.category"), F.lit(" — "), c("vlm.reason")), ephemeral, "junk", ephemeral),
        miss("Blink", c("face.any_blink"), faces("face.blink_count", "mid-blink"), w.blink_miss),
        miss("LookingAway", c("face.any_looking_away"), faces("face.looking_away_count", "looking away"), w.looking_away_miss),
        miss("MouthOpen", c("face.any_mouth_open") & F.lit(w.experimental_mouth), "Mouth open / mid-chew (experimental)", w.mouth_open_miss),
    ]


def aesthetic(w: Weights) -> Column:
    """The weighted mean of the components that are present, on a base of 0.35; 0.5 without any."""
    c = lambda path: F.col(f"features.{path}")
    raw = c("embedding.aesthetic_raw")
    model = F.when(raw > f32(1.5), clamp(ratio(raw - f32(1), f32(9)))).otherwise(clamp(raw))
    exposure = f32(1) - F.least(c("pixel.dark_fraction") + c("pixel.bright_fraction"), f32(1)) * f32(0.5)
    sharp = clamp(ratio(c("pixel.blur_variance"), f32(200))) * f32(0.7) + exposure * f32(0.3)
    placed = c("composition.subject_placement") * f32(0.6) + clamp(c("composition.subject_coverage")) * f32(0.4)
    placed = F.when(c("composition.cropped_subject"), placed * f32(0.7)).otherwise(placed)
    parts = [
        (c("embedding").isNotNull(), model, w.aesthetic_from_model),
        (c("pixel").isNotNull(), sharp, w.aesthetic_from_sharpness),
        (c("composition").isNotNull(), placed, w.aesthetic_from_composition),
        (F.coalesce(c("face.face_count") > 0, F.lit(False)), clamp(c("face.avg_capture_quality")), w.aesthetic_from_face_quality),
    ]
    total, weights = f32(0.5), f32(0)
    for present, value, weight in parts:
        total = total + F.when(present, value * f32(weight)).otherwise(f32(0))
        weights = weights + F.when(present, f32(weight)).otherwise(f32(0))
    mean = ratio(total - f32(0.5), F.greatest(weights, f32(1e-6)))
    return F.when(weights > 0, clamp(f32(0.35) + mean * f32(0.65))).otherwise(f32(0.5))


def thresholds(w: Weights) -> tuple[Column, Column]:
    """Junk and miss from which a row is queued; softer for rows with a backup label."""
    soft = lambda t, least: F.greatest(f32(t) - f32(BACKUP_SLACK), f32(least))
    backed = has_backup()
    return (
        F.when(backed, soft(w.junk_queue_threshold, LEAST_JUNK)).otherwise(f32(w.junk_queue_threshold)),
        F.when(backed, soft(w.miss_queue_threshold, LEAST_MISS)).otherwise(f32(w.miss_queue_threshold)),
    )


def backup_text() -> Column:
    return F.regexp_replace("secondary_backup_label", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def has_backup() -> Column:
    return F.coalesce(backup_text() != "", F.lit(False))


def fused(assets: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """assets with junk, miss, aesthetic, reasons and should_queue; earlier ones of these columns are replaced.

    Scores are the largest effect, not a sum, and at most 1. Favourites and hidden assets get junk 0, miss 0, aesthetic 1, no
    reasons and are not queued. Missing parts of the features fire no rule.
    """
    w = weights
    df = assets.drop("junk", "miss", "aesthetic", "reasons", "should_queue").withColumn("_top", top_similarity(F.col("features.embedding.junk_similarities")))
    rules = signal_rules(w)
    score = lambda name: clamp(at_least(*[F.when(r.holds(), r.effect) for r in rules if r.score == name]))
    df = df.withColumns({"_junk": score("junk"), "_miss": score("miss"), "_aesthetic": aesthetic(w), "_reasons": F.filter(F.array(*[r.reason() for r in rules]), lambda r: r.isNotNull())})
    junk, miss = thresholds(w)
    near = (F.col("_junk") >= f32(w.junk_queue_threshold) - f32(BACKUP_SLACK)) | (F.col("_miss") >= f32(w.miss_queue_threshold) - f32(BACKUP_SLACK)) | (F.size("_reasons") > 0)
    informing = [
        Rule("CloudOriginal", ~F.col("is_locally_available"), F.lit("Full-res in iCloud Photos (Optimize Storage)"), f32(0.55)),
        Rule("SecondaryBackup", has_backup() & near, F.concat(F.lit("You said you also back up to "), backup_text()), f32(0.5)),
    ]
    spared = F.coalesce(F.col("is_favorite"), F.lit(False)) | F.coalesce(F.col("is_hidden"), F.lit(False))
    reasons = F.concat("_reasons", F.filter(F.array(*[r.reason() for r in informing]), lambda r: r.isNotNull()))
    none = F.array().cast("array<struct<kind: string, detail: string, confidence: float>>")
    out = df.withColumns({
        "junk": F.when(spared, f32(0)).otherwise(F.col("_junk")), "miss": F.when(spared, f32(0)).otherwise(F.col("_miss")),
        "aesthetic": F.when(spared, f32(1)).otherwise(F.col("_aesthetic")), "reasons": F.when(spared, none).otherwise(reasons),
        "should_queue": ~spared & ((F.col("_junk") >= junk) | (F.col("_miss") >= miss)),
    })
    return out.drop("_top", "_junk", "_miss", "_aesthetic", "_reasons")
