"""A training-data pipeline over the documents table, each stage by an operator of darkroom.llm.

The stages in order: the quality classifier drops what it rejects, near-dedup keeps one document of each group,
substring dedup removes repeated word windows, mixing repeats or drops documents towards the sources' targets, and
BPE encoding and decoding ends it. Each stage reads what the one before has written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm import bpe, mixing, quality, repeats, shingles
from darkroom.llm.common import bounded_broadcast, joined_by_count, shared_dir, staged, table

#: Ids that are broadcast at most, about 16 MB of them; more are joined by shuffling.
MOST_BROADCAST = 500_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels that are not held out.

    A null or empty text is judged as a text without words. Each row is judged by its text alone, so repeated rows stay or
    go together, and null ids do no harm. No documents give none.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where("predicted = 1").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: texts whose five-word shingles have a Jaccard likeness of 0.8 or more, or
    SimHash fingerprints within two bits. Null and empty texts are copies of each other. No documents give none.

    The row of the smallest id stays (null ids come last), of repeated ids that of the smallest text hash, and of
    repeated rows one. Rows are told apart by id and text hash, so of two texts with one id each has its own fate. Texts
    are not shuffled while the rows to drop are few enough to broadcast: their number is counted first.
    """
    found = staged(shingles.near_copies(docs, width=5).select("id", "hash", "root"), "components")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "hash")
    groups = found.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = staged(groups.select("root", F.col("first.id").alias("kept"), F.col("first.hash").alias("kept_hash"), "n"), "groups")
    rows = joined_by_count(found, groups, "root", "n", found.count())
    rows = rows.groupBy("id", "hash", (F.col("id").eqNullSafe(F.col("kept")) & (F.col("hash") == F.col("kept_hash"))).alias("stays")).agg(F.count("*").alias("n"))
    rows = staged(rows.withColumnsRenamed({"id": "_id", "hash": "_hash"}), "decided")
    drop, twice = rows.where("not stays").select("_id", "_hash"), rows.where("stays and n > 1").select("_id", "_hash")
    many, again = drop.count(), twice.count()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    docs = docs.select(*COLUMNS)
    left = docs.join(bounded_broadcast(drop, many, MOST_BROADCAST), same, "left_anti")
    if again:
        few = bounded_broadcast(twice, again, MOST_BROADCAST)
        left = left.join(few, same, "left_anti").unionByName(left.join(few, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return left


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; untouched texts stay as they are, and emptied ones go.

    A null or empty text has no window and stays. Repeated rows repeat each other's windows, so those of 35 words or more
    lose them all. Ids are not looked at. No documents give none.
    """
    out = repeats.without_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to three times. Null sources are one source. A document without
    words weighs nothing and comes as often as its hash says; a source without words is left out whole. Rows that agree in id and
    text are taken together. No documents give none."""
    out = mixing.mixed(docs)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).where("copies > 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document of the mix. A null or empty text has no ids; repeated rows are encoded each, and
    other columns stay. No documents give none."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_near_copies),
    ("repeats", remove_repeats),
    ("mix", mix_sources),
    ("encode", encode),
]
#: Fitted models, hashes that DuckDB lacks and tokenizers stand between the tables and the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
