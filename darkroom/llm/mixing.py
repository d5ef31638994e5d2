"""Mixing sources to target weights with hash thresholds found from nested histograms.

Each document has a 60-bit hash. A source that is to give m times its size and a bit more takes every document m
times, and once more those whose hash lies under a threshold. Token counts summed by source and hash bucket tell the
bucket in which the budget ends; only documents of that bucket are counted again, in finer buckets, until a bucket is
one hash value. So nothing is sorted, and a document's fate follows from its own hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkroom.llm.common import WORD, bounded_broadcast, staged

HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key as text; a null key hashes like ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, weigh 1, 2, ..., cycle, 1, ... and share the sum of all sizes; no target
    is above `most` times its source's size, and what is cut off is shared again by weight among the others. That
    settles where the targets of all other sources are weight times one rate: sources sorted by their limit per
    weight reach it one after the other. All windows run over one row for each source.
    """
    w = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", ((F.row_number().over(w) - 1) % cycle + 1).cast("double"))
    ranked = ranked.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onward = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    rated = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("spent"),
        F.sum("weight").over(onward).alias("open"),
        F.sum(F.col("source_size").cast("double")).over(every).alias("total"),
    ).withColumn("rate", (F.col("total") - F.col("spent")) / F.col("open"))
    final = F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "rate"))).over(every)["rate"]
    return rated.withColumn("final", final).select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("final")).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, cycle: int = 3, most: int = 3, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with size, source_size, target and copies (how often the mix takes the row).

    size is a column expression, by default the words of the text. A source takes whole copies of all its rows, then one
    more of rows in hash order while their sum stays within the target. The hash is that of id and text, so rows
    that agree in one of them, such as those of a null id, are drawn apart; rows that agree in both stand or fall
    together. A source without words has target 0 and copies 0, and so has every row of an empty text in effect. Null
    sources are one source. Reruns agree. Columns with
    these names are replaced; all others stay, whatever they are called. Null texts have size 0, repeated rows count
    each. No rows give no rows. Plans hold a row for each source, so sources are taken to be some thousands at most.
    """
    size = word_count(F.col(text_col)) if size is None else size
    key = hash60(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, text_col)]) if text_col in docs.columns else F.col(id_col))
    docs = docs.drop("size", "source_size", "target", "copies")
    slim = staged(docs.select(F.col(source_col).alias("source"), key.alias("h"), size.alias("size")), "sizes")
    per_source = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = per_source.withColumn("copies", whole.cast("long"))
    plan = staged(plan.withColumn("budget", F.floor("target").cast("long") - F.col("copies") * F.col("source_size")), "targets")
    few = plan.count()

    # edge: the hash prefix whose bucket the budget ends in; left: what is left of the budget there
    edges = plan.select("source", F.lit(0).cast("long").alias("edge"), F.col("budget").alias("left"))
    for level in range(HASH_BITS // LEVEL_BITS):
        keep, shift = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level + 1)
        inside = slim.join(bounded_broadcast(edges, few), slim["source"].eqNullSafe(edges["source"])).where(F.shiftright("h", keep) == F.col("edge"))
        buckets = inside.groupBy(slim["source"], F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), (F.max("h") - F.min("h")).alias("n"), F.max("left").alias("left"))
        upto = Window.partitionBy("source").orderBy("bucket")
        summed = buckets.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") > F.col("left"))
        first = summed.groupBy("source").agg(F.min(F.struct("bucket", (F.col("left") - (F.col("upto") - F.col("size"))).alias("left"), "n")).alias("e"))
        first = staged(first.select("source", F.col("e.bucket").alias("edge"), F.col("e.left").alias("left"), F.col("e.n").alias("n")), "edges")
        edges = first.drop("n")
        if not first.agg(F.max("n")).first()[0]:  # one hash value in each bucket that a budget ends in
            break
    # a row is under the threshold if its prefix is under the edge; at the edge nothing more fits
    last = edges.select(F.col("source").alias("edge_source"), "edge")
    names = {n: "_" + n for n in ("of_source", "whole", "edge")}
    while any(v in docs.columns for v in names.values()):
        names = {n: "_" + v for n, v in names.items()}
    of_source, whole, edge = names.values()
    rule = plan.join(last, plan["source"].eqNullSafe(last["edge_source"]), "left").select(
        F.col("source").alias(of_source), "source_size", "target", F.col("copies").alias(whole), F.col("edge").alias(edge)
    )
    rule = staged(rule, "rules")
    sized = docs.withColumn("size", size)
    taken = F.when(F.col("source_size") == 0, 0).otherwise(
        F.col(whole) + F.coalesce(F.shiftright(key, shift) < F.col(edge), F.lit(True)).cast("long")
    )
    joined = sized.join(bounded_broadcast(rule, few), sized[source_col].eqNullSafe(rule[of_source]))
    return joined.select(*docs.columns, "size", "source_size", "target", taken.cast("long").alias("copies"))
