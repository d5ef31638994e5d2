"""Other forms of tokenizer files, rules that pay, exact scores of long vectors, mixes of repeated ids, held-out quality,
uniform places, buckets of one id."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm import bpe, grammar, mixing, quality, sharding, syncmers, topk
from darkroom.llm.common import joined_by_count

tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
TEXTS = ["Hello  there, don't.\n\n x", "", " lead", "ÜNÏ ſtraße ’q’ 日本 👍", "a" * 5000 + " b", "1,234.5 ... <|endoftext|> \x00 é́", "w " * 3000]


def test_files_of_other_forms(spark, tmp_path):
    from tokenizers import Tokenizer, decoders, normalizers, pre_tokenizers

    byte, word = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    assert grammar.byte_encoder(tokenizers.path("byte_bpe_50k.json")).usual and bpe.encoder(tokenizers.path("word_bpe_49k.json")).usual
    byte.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=True)])
    byte.save(str(tmp_path / "byte.json"))
    enc = grammar.ByteEncoder(str(tmp_path / "byte.json"))
    ids, lengths = enc.encode_all(TEXTS)
    assert not enc.usual and np.split(ids, np.cumsum(lengths)[:-1])[0].tolist() == byte.encode(TEXTS[0], add_special_tokens=False).ids
    assert ids.tolist() == [i for t in TEXTS for i in byte.encode(t, add_special_tokens=False).ids]
    word.normalizer, word.decoder = normalizers.Sequence([normalizers.NFC()]), decoders.BPEDecoder(suffix="</w>")
    word.save(str(tmp_path / "word.json"))
    texts = [*TEXTS, "Long Text. " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encoded(docs, str(tmp_path / "word.json")).collect():
        want = word.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == want and r.decoded == word.decode(want, skip_special_tokens=False)


def test_every_rule_is_used(spark):
    rng = np.random.default_rng(8)
    for ids in (rng.integers(0, 30, 60_000), np.repeat(rng.integers(0, 9, 8000), rng.integers(1, 9, 8000)), rng.zipf(1.3, 80_000) % 900):
        lengths = np.array([len(ids) // 2, 0, len(ids) - len(ids) // 2])
        symbols, numbers, rules = grammar.repair(ids, lengths, 1000)
        uses = np.bincount(np.concatenate([symbols, rules.ravel()]).astype(np.int64), minlength=1000 + len(rules))[1000:]
        alone = np.bincount(symbols.astype(np.int64), minlength=1000 + len(rules))[1000:]
        # a rule that stands once stands in another rule, which stands more often
        assert len(rules) > 50 and uses.min() >= 1 and not ((uses == 1) & (alone == 1)).any()
        sizes = grammar.expansion_lengths(rules, 1000)
        g = grammar.Grammar(symbols.tobytes(), rules.tobytes(), sizes[1000:].astype("<u4").tobytes(), np.zeros(1, "<u8").tobytes(), 1000)
        assert g.expand(g.symbols).tolist() == ids.tolist() and numbers.sum() == len(symbols)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e17, 1e36])
def test_top_k_of_long_vectors(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(20) * scale).astype(np.float32).astype(float).tolist()) for i in range(120)]
    rows += [(200, rows[7][1]), (201, rows[7][1])]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("id % 50 = 0"), 5, groups=3).collect():
        got[r.query_id].append((r["rank"], r.id, r.score))
    assert set(got) == {0, 50, 100, 200}
    for q, found in got.items():
        best = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:5]
        assert sorted(found) == [(k + 1, i, max(-topk.LONGEST, min(-s, topk.LONGEST))) for k, (s, i) in enumerate(best)]


def test_mix_of_null_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 999, 4))
    rows = [(None, text(), "a") for _ in range(50)] + [(7, text(), "b") for _ in range(50)] + [(i, text(), s) for s in "cd" for i in range(100, 150)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = collections.Counter(), {}
    for r in out:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 4 for s in "abcd") and len(out) == len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_of_rows_that_no_fit_saw(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(quality.held_out("doc_id")).select("score", "predicted", "quality").collect()
    score, label = np.array([r.score for r in out]), np.array([r.quality for r in out])
    rank = np.empty(len(out))
    rank[np.argsort(score)] = np.arange(len(out))
    good = label == 1
    area = (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())
    assert len(out) > 80 and np.mean([r.predicted == r.quality for r in out]) >= 0.97 and area >= 0.98


def test_places_are_uniform(spark):
    """Each of 20 partitions' rows over 8 shards: counts as even as a uniform shuffle gives them (chi-square, 4 sigma)."""
    rows = spark.range(0, 8000, 1, 20).select(F.col("id").alias("doc_id"), F.lit(0).alias("x"))
    out = sharding.sharded(rows, ["doc_id", "x"], 8).collect()
    shard, half = np.zeros((20, 8)), np.zeros((20, 2))
    for r in out:
        shard[r.doc_id // 400, r.shard] += 1
        half[r.doc_id // 400, int(r.slot >= 500)] += 1
    for table in (shard, half):
        expected = 400 / table.shape[1]
        free = 19 * (table.shape[1] - 1)
        value = ((table - expected) ** 2 / expected).sum()
        assert abs(value - free) <= 4 * np.sqrt(2 * free), value
    assert collections.Counter(r.shard for r in out) == dict.fromkeys(range(8), 1000) and all(sorted(r.slot for r in out if r.shard == s) == list(range(1000)) for s in range(8))


@pytest.mark.parametrize("heavy", [None, 5, -3, 10**12])
def test_next_rows_of_one_id(spark, heavy):
    rng = np.random.default_rng(1)
    rows = [(int(i), f"t{i}") for i in rng.integers(-50, 50, 60)] + [(heavy, f"h{k}") for k in range(300)] + [(None, "n"), (10**13, "top"), (heavy, "h3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = syncmers.with_next(df, buckets=8, then=lambda x: x.withColumn("bucket", F.spark_partition_id()))
    got = sorted(map(tuple, out.select("id", "text", "next_id", "next_text").collect()), key=str)
    hashed = dict(df.select("text", F.xxhash64("text")).distinct().collect())
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashed[r[1]]))
    assert got == sorted(((*a, *b) for a, b in zip(order, order[1:] + order[:1])), key=str)


def test_joins_by_count(spark):
    rows = [(i, "hot") for i in range(500)] + [(i, f"k{i % 50}") for i in range(500, 700)] + [(1000, "alone"), (1001, None)]
    df = spark.createDataFrame(rows, "id long, key string")
    found = df.where("key <> 'alone'").groupBy("key").agg(F.count("*").alias("n")).withColumn("v", F.upper("key"))
    left = joined_by_count(df, found, "key", "n", df.count(), "left").select("id", "key", "v")
    assert sorted(map(tuple, left.collect())) == sorted((i, k, k.upper() if k not in (None, "alone") else None) for i, k in rows)
    assert joined_by_count(df, found, "key", "n", df.count()).count() == 700
