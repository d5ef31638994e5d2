"""Column functions: distances, clamps, texts. All stay in the JVM; single precision where the scores have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0

#: Words that mark utility shots.
UTILITY_KEYWORDS = (
    "wifi", "wi-fi", "ssid", "password", "passwd", "tracking", "shipment", "order #", "invoice", "receipt", "total", "subtotal",
    "parking", "level", "garage", "http://", "https://", "barcode",
)


def f32(x: float) -> Column:
    return F.lit(float(x)).cast("float")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within bounds; NaN stays NaN as in f32 clamps, null stays null."""
    return F.when(x < f32(low), f32(low)).when((x > f32(high)) & ~F.isnan(x), f32(high)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b in single precision."""
    return (a / b).cast("float")


def at_least(*xs: Column) -> Column:
    """The largest that is neither null nor NaN, and 0 at least."""
    return F.greatest(f32(0), *[F.when(~F.isnan(x), x) for x in xs])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places; null if a coordinate is."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    h = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, least_norm: float = 1e-12, truncate: bool = False) -> Column:
    """Cosine of two arrays. Unequal or zero lengths give null, or with truncate the common prefix counts; a
    product of norms under least_norm gives 0."""
    if truncate:
        n = F.least(F.size(a), F.size(b))
        a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    value = F.when(norms < least_norm, F.lit(0.0)).otherwise(_dot(a, b) / F.when(norms >= least_norm, norms))
    return value if truncate else F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value)


def within_window(a: Column, b: Column, seconds: int) -> Column:
    """Whether two times are at most so many whole seconds apart: parts of a second are cut off, unlike in band_pairs."""
    return F.floor(F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1_000_000) <= seconds


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def pocket_shot(uniformity: Column, dark: Column, blur: Column) -> Column:
    return (uniformity > f32(0.92)) | ((dark > f32(0.85)) & (blur < f32(20)))


def keyword_hits(text: Column, keywords: tuple[str, ...] = UTILITY_KEYWORDS) -> Column:
    """How many of the keywords the lower-cased text holds anywhere; 0 for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def byte_size(size: Column, width: Column, height: Column) -> Column:
    """The size, or a quarter byte for each pixel where none is known."""
    return F.when(F.coalesce(size, F.lit(0)) > 0, size).otherwise(F.floor(width * height / 4).cast("long"))


def resource_bytes(sizes: Column, width: Column, height: Column) -> Column:
    """The bytes of a shot: those of all its resources whose size is known, or an estimate by its pixels."""
    known = F.aggregate(F.coalesce(sizes, F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return byte_size(known, width, height)


def locally_available(primary: Column, every: Column) -> Column:
    """Whether all primary resources are local; without primary ones all resources count, and none is local."""
    return F.when(F.size(primary) > 0, F.forall(primary, lambda x: x)).when(F.size(every) > 0, F.forall(every, lambda x: x)).otherwise(F.lit(True))


def is_burst(represents: Column, burst_id: Column) -> Column:
    """Whether a shot belongs to a burst: it stands for one, or names one."""
    return F.coalesce(represents, F.lit(False)) | burst_id.isNotNull()


def created(at: Column) -> Column:
    """A missing date is the distant past: the first day of year 1."""
    return F.coalesce(at, F.lit("0001-01-01 00:00:00").cast("timestamp"))


def backup_label(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(" + ", *parts), F.lit(""))


def rounded_text(x: Column, digits: int) -> Column:
    """x with so many decimals, ties of its exact value to even."""
    exact = F.bround(x.cast("double").try_cast("decimal(38,18)"), digits)
    return F.coalesce(exact.cast(f"decimal(30,{digits})").cast("string"), x.cast("string"), F.lit(""))


def score_badge(junk: Column, miss: Column, aesthetic: Column) -> Column:
    percent = lambda x: rounded_text(x * f32(100), 0)
    return F.concat(F.lit("junk "), percent(junk), F.lit("% · miss "), percent(miss), F.lit("% · aesthetic "), percent(aesthetic), F.lit("%"))


def checksum_matches(data: Column, expected: Column) -> Column:
    return F.sha2(data, 256) == F.lower(expected)
