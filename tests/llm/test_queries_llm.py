"""Registered queries without SQL against brute force on small tables with nulls, empty and repeated rows and clashing names."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm import mixing, queries, simhash, syncmers, topk

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 300, n))
    out = [(i, text(int(rng.integers(1, 90))), "en", f"s{i % 3}") for i in range(60)]
    out += [(100 + i, out[5][1], "en", "s0") for i in range(12)]
    out += [(200, None, "en", None), (201, "", "en", "s1"), (202, " \n ", "de", "s1"), (203, text(7000), "en", "s2"), (204, "Ünï ſtraße 日本 👍 x" * 9, "de", "s2")]
    return out


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit("clash") for c in ("b", "whole", "edge", "of_source", "ids", "size")}).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(r[0], int(len(r[1] or "") > 100)) for r in rows[:50]]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_op2_and_op5(spark, sf, rows):
    from tokenizers import Tokenizer

    byte, word = (Tokenizer.from_file(tokenizers.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))
    got, start = {r.doc_id: r for r in queries.op2_token_grammar(spark, sf).collect()}, 0
    for i, text, *_ in sorted(rows):
        ids = byte.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: r for r in queries.op5_bpe(spark, sf).collect()}
    for i, text, *_ in rows:
        ids = word.encode(text or "", add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_op3(spark, sf, rows):
    got = queries.op3_quality(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_op8(spark, sf, rows):
    got = {r.doc_id: r for r in queries.op8_syncmers(spark, sf).collect()}
    order = sorted(rows, reverse=True)
    for (i, text, *_), (after, following, *_) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints = lambda f: {f[k : k + 8] for k in range(0, len(f), 8)}
        like = lambda a, b: 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))
        own = prints(got[i].fingerprint)
        assert got[i].near_edited == pytest.approx(like(own, prints(got[i].edited_fingerprint)))
        assert got[i].near_next == pytest.approx(like(own, prints(got[after].fingerprint)))
    assert len({got[i].fingerprint for i in [5, *range(100, 112)]}) == 1
    assert sum(got[r[0]].near_edited > 0.2 for r in rows[:60] if len((r[1] or "").split()) >= 9) >= 0.95 * sum(len((r[1] or "").split()) >= 9 for r in rows[:60])


def test_syncmer_places(spark):
    """The k-mers that are chosen are those whose smallest inner substring is at an edge, in text order."""
    rng = np.random.default_rng(12)
    text = " ".join(f"w{x}" for x in rng.integers(0, 50, 200))
    s = syncmers.S
    units = text.split()
    df = spark.createDataFrame([(text,)], "t string")
    assert s == 2
    hashed = {u: h for u, h in spark.createDataFrame([(u,) for u in set(units)], "u string").select("u", F.xxhash64("u")).collect()}
    pair = lambda xs: [r[1] for r in sorted(spark.createDataFrame([(k, *x) for k, x in enumerate(xs)], "k int, a long, b long").select("k", F.xxhash64("a", "b")).collect())]
    h = [hashed[u] for u in units]
    inner = pair(list(zip(h, h[1:])))
    whole = pair(list(zip(inner, inner[s:])))
    want = [(w & 0xFFFFFFFF) - (1 << 31) for k, w in enumerate(whole) if min(inner[k : k + s + 1]) in (inner[k], inner[k + s])]
    assert df.select(syncmers.anchors(F.col("t"))).first()[0] == want


def test_op9(spark, sf, rows):
    got = {r.doc_id: r for r in queries.op9_simhash(spark, sf).collect()}
    prints = {i: simhash.fingerprint_of(text, 3, 42) for i, text, *_ in rows}
    first, changed = {i: i for i in prints}, True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and first[a] < first[b]:
                    first[b], changed = first[a], True
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", first[i]) for i, p in prints.items()}


def test_op10(spark, sf, rows):
    got = queries.op10_sharding(spark, sf).collect()
    text = {i: (t or "").encode() for i, t, *_ in rows}
    assert sorted(r.doc_id for r in got) == sorted(text)
    assert all(r["size"] == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert max(slots) <= 39 and all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op1_clash(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mixed(docs).collect()
    assert len(out) == len(rows) and {r.whole for r in out} == {r.edge for r in out} == {r.of_source for r in out} == {"clash"}


def test_op4_groups(spark):
    """Contiguous ids are dealt to all groups evenly; a query id with several vectors is asked with the smallest."""
    ids = spark.range(0, 200_000, 1, 4).select("id", F.array(F.col("id").cast("double")).alias("vector"))
    counts = [r["count"] for r in topk._blocks(ids, topk.BLOCK_ROWS, 8).groupBy("slot").count().collect()]
    assert len(counts) == 8 and max(counts) <= 3 * min(counts)
    rows = spark.createDataFrame([(1, [1.0]), (2, [5.0]), (2, [-1.0]), (3, [2.0]), (3, [2.0])], "id long, vector array<double>").withColumn("score", F.lit("clash"))
    found = [(r.query_id, r["rank"], r.id, r.score) for r in topk.top_k(rows, rows.where("id = 2"), 5, groups=2).collect()]
    assert sorted(found) == [(2, 1, 1, -1), (2, 2, 3, -2), (2, 3, 3, -2)]
