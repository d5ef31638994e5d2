"""Precision, recall and F1 of label sets, by category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_report(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(category, tp, fp, fn, precision, recall, f1, support) from (file, labels: array<string>) on both sides.

    Categories are those of either side; predictions for files without gold add a category, but no counts.
    """
    flat = lambda df, name: df.select("file", F.explode(F.coalesce("labels", F.array().cast("array<string>"))).alias("category")).distinct().withColumn(name, F.lit(1))
    g, p = flat(gold, "g"), flat(predicted, "p")
    known = gold.select("file").distinct().withColumn("known", F.lit(True))
    both = g.join(p, ["file", "category"], "full_outer").join(known, "file", "left")
    counted = both.groupBy("category").agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("g").isNull() & F.col("p").isNotNull() & F.coalesce("known", F.lit(False))).alias("fp"),
        F.count_if(F.col("g").isNotNull() & F.col("p").isNull()).alias("fn"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    out = counted.withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn")))
    return out.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall"))).withColumn("support", c("tp") + c("fn"))
