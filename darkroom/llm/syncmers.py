"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is read as words. A k-mer is 2 s consecutive words; it is a closed syncmer if, of the s-word substrings in it,
the one with the smallest hash is the first or the last. Whether a k-mer is chosen depends on its own words alone, so
texts that share a passage share the anchors inside it, wherever the passage stands.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.llm.common import literal_rows, power_of_two, shuffle_partitions

#: Words of the inner substring; k is twice as many. Two of three k-mers are chosen with 2, so that texts of a few words
#: have several anchors too.
S = 2
#: Words end at ASCII white space; longer runs are cut into parts of so many characters.
UNIT = r"[^\x20\x09-\x0D]{1,16}"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shifted(x: Column, n: int) -> Column:
    """x without its first n elements."""
    return F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))


def _cut(x: Column, n: int) -> Column:
    """x without its last n elements."""
    return F.slice(x, 1, F.greatest(F.size(x) - n, F.lit(0)))


def _paired(x: Column, n: int, f) -> Column:
    """f(x[i], x[i + n]) for all i with both."""
    return F.zip_with(_cut(x, n), _shifted(x, n), f)


def anchors(text: Column, s: int = S) -> Column:
    """Hashes of the closed syncmers of a text, in text order, as array<int>; equal texts have equal anchors.

    s is a power of two. A text of fewer than 2 s words has one anchor, of all its words; one without words (or
    null) has none.
    """
    if s < 1 or s & (s - 1):
        raise ValueError("s must be a power of two")
    hashed = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)), lambda w: F.xxhash64(w))

    def inner(h: Column, n: int = 1) -> Column:
        return h if n == s else _let(_paired(h, n, lambda a, b: F.xxhash64(a, b)), lambda x: inner(x, 2 * n))

    def least(x: Column, n: int = 1) -> Column:  # over s + 1 neighbours: s of them by doubling, then one more
        if n == s:
            return _paired(x, 1, lambda a, b: F.least(a, b))
        return _let(_paired(x, n, lambda a, b: F.least(a, b)), lambda y: least(y, 2 * n))

    def chosen(m: Column) -> Column:
        edges = _paired(m, s, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        marked = F.zip_with(edges, least(m), lambda e, low: F.when((e["a"] == low) | (e["b"] == low), F.xxhash64(e["a"], e["b"]).bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int"))
        return F.filter(marked, lambda x: x.isNotNull())

    def of(h: Column) -> Column:
        few = F.transform(F.filter(F.array(F.xxhash64(h)), lambda _: F.size(h) > 0), lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int"))
        return F.when(F.size(h) < 2 * s, few).otherwise(_let(inner(h), chosen))

    return _let(hashed, of)


def fingerprint(found: Column) -> Column:
    """Anchors as text: eight hex digits each, in text order."""
    return F.lower(F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x.cast("long") + F.lit(1 << 31)), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of anchors: 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * common / total)


def _bucket(value: Column, cuts: list) -> Column:
    """Number of cuts below a value, found in two steps so that many cuts stay cheap."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    long = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    before = F.size(F.filter(long([r[-1] for r in rows]), lambda c: c < value))
    fine = F.filter(F.coalesce(F.get(F.array(*map(long, rows)), before), F.array().cast("array<bigint>")), lambda c: c < value)
    return before * step + F.size(fine)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, then=None) -> DataFrame:
    """docs (id_col, text_col) as id, text, next_id, next_text: the row that follows by descending id, the first after the last.

    Null ids come last; rows of equal id follow each other by a hash of their text. Null texts count as empty, repeated rows
    stay, other columns of docs are left out, and no rows give no rows. Rows are dealt to buckets of
    neighbouring ids, and each bucket also gets a copy of the row that follows its last. An id that fills more than a
    bucket, null or not, has several, by ranges of the hash. Each text is shuffled once.
    then(df, window) may add columns in the same order without another shuffle.
    """
    spark = docs.sparkSession
    buckets = buckets or max(2, shuffle_partitions(spark))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = [i / buckets for i in range(1, buckets)]
    known = rows.agg(F.percentile_approx("id", share, 10_000), F.count("*"), F.count("id")).first()
    often = Counter(known[0] or [])
    heavy = [v for v, n in often.items() if n > 1]  # at most half as many as there are buckets
    cuts = sorted(set(often) | {v - 1 for v in heavy if v > -(1 << 63)})
    split = [cuts.index(v) for v in heavy] + ([-1] if (known[1] - known[2]) * buckets > known[1] else [])
    order = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    keyed = rows.withColumn("bucket", F.when(F.col("id").isNull(), -1).otherwise(_bucket(F.col("id"), cuts)).cast("int"))
    bits = power_of_two(buckets).bit_length() - 1
    part = F.shiftright(F.xxhash64("text"), 64 - bits) + (1 << bits >> 1) if bits else F.lit(0)
    keyed = keyed.withColumn("bucket", F.shiftleft(F.col("bucket").cast("long"), bits) + F.when(F.col("bucket").isin(split), part).otherwise(0)) if split else keyed.withColumn("bucket", F.col("bucket").cast("long"))
    firsts = keyed.groupBy("bucket").agg(F.max(F.struct(order.alias("o"), F.xxhash64("text").alias("h"))).alias("first"))
    # at most one row for each bucket: the bucket whose last row the first of this one follows
    ring = sorted((r["bucket"], r["first"]["o"], r["first"]["h"]) for r in firsts.collect())
    plan = [{"bucket": b, "o": o, "h": h, "earlier": ring[(i + 1) % len(ring)][0]} for i, (b, o, h) in enumerate(ring)]
    ghosts = F.broadcast(literal_rows(spark, plan, "bucket: long, o: long, h: long, earlier: long"))
    leads = (order == F.col("o")) & (F.xxhash64("text") == F.col("h"))
    copies = F.when(leads, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost")), F.struct(F.col("earlier").alias("b"), F.lit(1).alias("ghost"))))
    copies = copies.otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))))
    dealt = keyed.join(ghosts, "bucket").select("id", "text", F.explode(copies).alias("to")).select("id", "text", "to.b", "to.ghost")
    window = Window.partitionBy("b").orderBy("ghost", F.desc_nulls_last("id"), F.desc(F.xxhash64("text")))
    if then is not None:
        dealt = then(dealt)
    following = [F.lead(c).over(window).alias(f"next_{c}") for c in dealt.columns if c not in ("b", "ghost")]
    return dealt.select("*", *following).where("ghost = 0").drop("b", "ghost")
