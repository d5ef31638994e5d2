"""The schema of assets and what goes with it: reason kinds, categories, JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = """struct<
 pixel: struct<blur_variance: float, dark_fraction: float, bright_fraction: float, mean_luminance: float, dhash: bigint, is_pocket_shot: boolean, uniformity: float>,
 face: struct<face_count: int, avg_capture_quality: float, blink_count: int, looking_away_count: int, mouth_open_count: int, any_blink: boolean, any_looking_away: boolean, any_mouth_open: boolean>,
 text: struct<has_dense_text: boolean, has_barcode: boolean, has_document: boolean, text_block_count: int, utility_keyword_hits: int>,
 composition: struct<subject_placement: float, subject_coverage: float, cropped_subject: boolean>,
 embedding: struct<embedding: array<float>, aesthetic_raw: float, junk_similarities: array<struct<label: string, similarity: float>>>,
 vlm: struct<category: string, ephemeral: boolean, reason: string, confidence: float>>""".replace("\n", "")

META = (
    "id string, created_at timestamp, is_favorite boolean, is_hidden boolean, is_screenshot boolean, is_burst boolean, is_live boolean, "
    "burst_id string, latitude double, longitude double, pixel_width bigint, pixel_height bigint, byte_size bigint, "
    "is_locally_available boolean, secondary_backup_label string"
)
REASONS = "array<struct<kind: string, detail: string, confidence: float>>"
ASSETS = f"{META}, features {FEATURES}, junk float, miss float, aesthetic float, reasons {REASONS}, cluster_id string, is_best_in_cluster boolean, tier_completed int, analyzed_at timestamp"
META_COLUMNS = [x.strip().split(" ")[0] for x in META.split(",")]

#: Reason kinds and their labels.
REASON_LABELS = {
    "Blur": "Blurry",
    "Underexposed": "Too dark",
    "Overexposed": "Blown out",
    "PocketShot": "Pocket / accidental",
    "Screenshot": "Screenshot",
    "Blink": "Blink detected",
    "LookingAway": "Looking away",
    "MouthOpen": "Mouth open (experimental)",
    "ReceiptOrDocument": "Looks like a document",
    "BarcodeOrLabel": "Barcode / label",
    "UtilityJunk": "Utility junk",
    "NearDuplicate": "Near duplicate",
    "LowerAesthetic": "Better shot exists",
    "VlmEphemeral": "Ephemeral utility shot",
    "CloudOriginal": "iCloud original",
    "SecondaryBackup": "Secondary backup",
    "Custom": "Flagged",
}

#: Review categories and the reason labels in each.
CATEGORY_LABELS = {
    "duplicates": ["Near duplicate", "Better shot exists"],
    "utilityJunk": ["Pocket / accidental", "Screenshot", "Looks like a document", "Barcode / label", "Utility junk", "Ephemeral utility shot"],
    "socialMisses": ["Blink detected", "Looking away", "Mouth open (experimental)"],
    "quality": ["Blurry", "Too dark", "Blown out"],
}


def label_of(kind: Column) -> Column:
    """The label of a reason kind; of an unknown one, null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in REASON_LABELS.items() for x in pair]), kind)


def labels_for(categories: list[str]) -> list[str]:
    """Labels that a choice of categories admits: all categories admit everything ([]), none admits nothing."""
    if set(categories) >= set(CATEGORY_LABELS):
        return []
    return [x for c in CATEGORY_LABELS if c in categories for x in CATEGORY_LABELS[c]] or ["__none__"]


def reason_dimension(spark: SparkSession) -> DataFrame:
    """(kind, label, category) of every reason; three kinds belong to no category."""
    of = {label: c for c, labels in CATEGORY_LABELS.items() for label in labels}
    return spark.createDataFrame([(k, v, of.get(v)) for k, v in REASON_LABELS.items()], "kind string, label string, category string")


def _raw(kind: T.DataType, field: str = "") -> T.DataType:
    """The type that a field has in JSON records: pairs are arrays, unsigned hashes are decimals."""
    if field == "junk_similarities":
        return T.ArrayType(T.ArrayType(T.StringType()))
    if field == "dhash":
        return T.DecimalType(20, 0)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _raw(f.dataType, f.name)) for f in kind.fields])
    return kind


def _unsigned(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(20,0)")


def features_from_json(text: Column) -> Column:
    """Features from their JSON text; null, malformed or incomplete parts give null structs, never structs of defaults."""
    kind = T._parse_datatype_string(FEATURES)
    return F.element_at(F.transform(F.array(F.from_json(text, _raw(kind))), lambda raw: _from_raw(raw, kind)), 1)


def _from_raw(raw: Column, kind: T.StructType) -> Column:
    """Features from what their JSON text holds; a lambda's variable, so that the text is parsed once."""
    parts = []
    for part in kind.fields:
        fields = []
        for f in part.dataType.fields:
            x = raw[part.name][f.name]
            if f.name == "dhash":
                x = F.when(x >= _unsigned(1 << 63), x - _unsigned(1 << 64)).otherwise(x).cast("long")
            elif f.name == "junk_similarities":
                x = F.transform(x, lambda p: F.struct(p[0].alias("label"), p[1].cast("float").alias("similarity")))
            fields.append(x.alias(f.name))
        whole = raw[part.name].isNotNull()
        for f in part.dataType.fields:
            whole = whole & raw[part.name][f.name].isNotNull()
        parts.append(F.when(whole, F.struct(*fields)).alias(part.name))
    return F.struct(*parts)


def _json(x: Column) -> Column:
    """The JSON text of a struct or array, with nulls written out; null itself is the text null."""
    return F.coalesce(F.to_json(x, {"ignoreNullFields": "false"}), F.lit("null"))


def _pairs_json(similarities: Column) -> Column:
    """[["label", number], ...]: arrays of mixed types, which no type of Spark has."""
    pair = lambda p: F.concat(F.regexp_replace(F.to_json(F.array(p["label"])), r"\]$", ""), F.lit(","), F.coalesce(p["similarity"].cast("string"), F.lit("null")), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(similarities, pair), ","), F.lit("]"))


def features_to_json(features: Column) -> Column:
    """The JSON text of features: hashes unsigned, similarities as pairs of text and number, missing parts null."""
    kind, parts = T._parse_datatype_string(FEATURES), []
    for part in kind.fields:
        fields = []
        for f in part.dataType.fields:
            x = features[part.name][f.name]
            if f.name == "dhash":
                wide = x.cast("decimal(20,0)")
                x = F.when(x < 0, wide + _unsigned(1 << 64)).otherwise(wide).cast("decimal(20,0)")
            if f.name != "junk_similarities":
                fields.append(x.alias(f.name))
        text = _json(F.struct(*fields))
        if part.name == "embedding":
            similar = F.coalesce(_pairs_json(features["embedding"]["junk_similarities"]), F.lit("null"))
            text = F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"junk_similarities":'), similar, F.lit("}"))
        parts += [F.lit(f'"{part.name}":'), F.when(features[part.name].isNotNull(), text).otherwise(F.lit("null")), F.lit(",")]
    return F.when(features.isNotNull(), F.concat(F.lit("{"), *parts[:-1], F.lit("}")))


SCORES = ("junk", "miss", "aesthetic")
#: What stands in a record beside meta, features and scores.
_REST = ("reasons", "cluster_id", "is_best_in_cluster", "tier_completed", "analyzed_at")


def _record_type() -> T.StructType:
    """A record as its JSON has it: metadata and scores nested, features raw."""
    flat = T._parse_datatype_string(ASSETS)
    nested = [
        T.StructField("meta", T.StructType([flat[c] for c in META_COLUMNS])), T.StructField("features", _raw(flat["features"].dataType)),
        T.StructField("scores", T.StructType([flat[c] for c in SCORES])), *[flat[c] for c in _REST], T.StructField("_corrupt_record", T.StringType()),
    ]
    return T.StructType(nested)


def record_problem(df: DataFrame) -> Column:
    """Why a parsed record is none: its text does not fit the schema, or it has no id or time."""
    broken = F.when(F.col("_corrupt_record").isNotNull(), F.concat(F.lit("not a record: "), F.substring("_corrupt_record", 1, 200)))
    return broken.when(F.col("meta.id").isNull(), F.lit("no id")).when(F.col("meta.created_at").isNull(), F.lit("no time"))


def read_records(spark: SparkSession, path: str, lines: bool = False, errors: str = "refuse") -> DataFrame:
    """Asset records from JSON files that hold an array of them, or one; with lines, one on each line.

    Records have meta and scores nested, hashes unsigned and similarities as pairs, as write_records leaves them. What
    does not fit, or has no id or time, fails the read; with errors="report" it stays as a row of nulls whose column error says why.
    """
    kind = _record_type()
    # a read of the corrupt column alone is what Spark refuses; all columns are read here
    rows = spark.read.schema(kind).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    problem = record_problem(rows)
    feature_type = T._parse_datatype_string(FEATURES)
    features = F.element_at(F.transform(F.array("features"), lambda raw: _from_raw(raw, feature_type)), 1)
    of = {c: F.col(f"meta.{c}") for c in META_COLUMNS} | {"features": features} | {c: F.col(f"scores.{c}") for c in SCORES} | {c: F.col(c) for c in _REST}
    names = T._parse_datatype_string(ASSETS).fieldNames()
    if errors == "report":
        return rows.select(*[F.when(problem.isNull(), of[c]).alias(c) for c in names], problem.alias("error"))
    fine = F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(of["id"])
    return rows.select(fine.alias("id"), *[of[c].alias(c) for c in names if c != "id"])


def records_json(df: DataFrame) -> DataFrame:
    """(value): the JSON text of each record."""
    flat = lambda names: _json(F.struct(*names))
    rest = F.regexp_replace(flat(_REST), r"^\{", "")
    features = F.coalesce(features_to_json(F.col("features")), F.lit("{}"))
    return df.select(F.concat(F.lit('{"meta":'), flat(META_COLUMNS), F.lit(',"features":'), features, F.lit(',"scores":'), flat(SCORES), F.lit(","), rest).alias("value"))


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON, one on each line; read_records(lines=True) reads them back unchanged."""
    records_json(df).write.mode("overwrite").text(path)
