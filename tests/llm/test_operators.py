import collections
import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from darkroom.llm import bpe, chat, grammar, mixing, quality, repeats, sharding, simhash, syncmers, topk
from darkroom.operators.components import components

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, source string, size string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, repeated rows, ties, a shared passage, a third of the rows from one group of copies."""
    rng = np.random.default_rng(5)
    passage = words(rng, 60)
    out = [(i, words(rng, int(rng.integers(1, 120))), f"s{i % 4}", "x") for i in range(40)]
    out += [(100 + i, words(rng, 20) + " " + passage + " " + words(rng, 20), None, "y") for i in range(6)]
    out += [(200 + i, out[3][1], "s0", "x") for i in range(25)]
    out += [(300, None, "s1", "x"), (301, "", "s2", "x"), (302, " \n\t ", None, None), (None, "a b c", "s1", "x"), (None, words(rng, 50), "s9", "x"), out[5], out[5]]
    out += [(303, "Ünïcode  \x00 ’quotes’ 日本語 é́ <|endoftext|> don't.  x", "s3", "x"), (304, words(rng, 9000), "s0", "x"), (305, "ab" * 5000 + " tail", "s0", "x"), (306, "same " * 300, "s2", "x")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(spark, docs, rows):
    out = mixing.mixed(docs).select("doc_id", "source", "text", "size", "source_size", "target", "copies").collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rate = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and rate * weight[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    taken = collections.Counter()
    for r in out:
        assert r.size == len((r.text or "").encode().split()) and 0 <= r.copies <= 3
        assert r.target == pytest.approx(3 * sizes[r.source] if r.source in capped else rate * weight[r.source])
        taken[r.source] += r.size * r.copies
    largest = {s: max(r.size for r in out if r.source == s) for s in order}
    assert all(0 <= next(r.target for r in out if r.source == s) - taken[s] <= 25 * largest[s] for s in order)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(docs.repartition(5)).select(*out[0].__fields__).collect()))
    assert mixing.mixed(empty(spark)).count() == 0


def test_grammar_round_trip(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    path = grammar.written(docs, tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "g"), parts=3)
    out = sorted(grammar.read(spark, path).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in out] == [r[0] for r in want]
    start = 0
    for r, (_, text, *_x) in zip(out, want):
        ids = tk.encode(text or "", add_special_tokens=False).ids + [2]
        assert r.start == start and np.frombuffer(r.ids, dtype="<u4").tolist() == ids
        start += len(ids)
    assert spark.read.parquet(path).where("length(rules) > 0").count() > 0
    assert grammar.read(spark, grammar.written(empty(spark), tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("copies", [6, 200])
def test_grammar_of_copies(copies):
    own = np.random.default_rng(8).integers(0, 1000, 500)
    symbols, numbers, rules = grammar.repair(np.tile(own, copies), np.full(copies, 500), 1000)
    assert numbers.tolist() == [1] * copies and len(set(symbols.tolist())) == 1
    sizes = grammar.expansion_lengths(rules, 1000)
    read = grammar.Grammar(symbols.tobytes(), rules.tobytes(), sizes[1000:].astype("<u4").tobytes(), np.zeros(1, "<u8").tobytes(), 1000)
    assert read.expand(read.symbols).tolist() == np.tile(own, copies).tolist()


def test_grammar_spans():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 30, 20_000).astype("<u2")
    lengths = np.array([0, 5000, 1, 0, 14_999, 0])
    symbols, numbers, rules = grammar.repair(ids, lengths, 100)
    assert len(rules) and len(symbols) < len(ids) and numbers.sum() == len(symbols)
    sizes = grammar.expansion_lengths(rules, 100)
    marks = np.concatenate([[0], np.cumsum(sizes[symbols])])[:-1][:: grammar.STRIDE]
    g = grammar.Grammar(symbols.tobytes(), rules.tobytes(), sizes[100:].astype("<u4").tobytes(), marks.astype("<u8").tobytes(), 100)
    assert (g.expand(g.symbols) == ids).all()
    for a in (0, 1, 4999, 19_990):
        assert (g.span(a, a + 10) == ids[a : a + 10]).all()


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = [(i, words(rng, int(rng.integers(20, 200))), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in words(rng, 60).split()), 0) for i in range(100)]
    rows = good + bad
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(None, None, "c"), (5000, "", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (7777, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.scored(docs, model).collect()
    assert len(out) == len(rows) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    gold = {i: q for i, _, q in rows}
    held = [(gold[r.doc_id], r.predicted) for r in out if r.doc_id in gold and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}


def test_commonest_word_of_long_texts():
    for n in (10, 1023, 1024, 2048, 5000):
        for period in (2, 3, 4, 7):
            own = ["often" if i % period == 1 else f"w{i}" for i in range(n)]
            assert quality.statistics(" ".join(own))[16] == pytest.approx((own.count("often") - 1) / n)


def test_isotonic():
    assert quality.isotonic(np.arange(4.0), np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == pytest.approx([0.1, 0.4, 0.4, 0.9])


def test_top_k(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=20).tolist()) for i in range(300)] + [(400, data) for data in [[0.5] * 20]] + [(401, [0.5] * 20), (402, None), (403, [None] + [0.1] * 19), (404, [float("nan")] * 20), (405, [0.1] * 3), (450, [0.2] * 3), (None, [0.1] * 20)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    rows = topk.quantised(df)
    got = collections.defaultdict(list)
    for r in topk.top_k(rows, rows.where("id % 50 = 0"), 5, groups=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    clean = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in clean if i % 50 == 0):
        want = sorted(((-sum(a * b for a, b in zip(clean[q], v)), i) for i, v in clean.items() if i != q and len(v) == len(clean[q])))[:5]
        assert got[q] == [(i, -s) for s, i in want]
    assert topk.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_bpe(spark, docs, rows):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    out = bpe.encoded(docs.withColumn("ids", F.lit("clash")), path).collect()
    assert len(out) == len(rows)
    for r in out:
        e = tk.encode(r.text or "", add_special_tokens=False)
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == e.ids and r.decoded == tk.decode(e.ids, skip_special_tokens=False)
    assert bpe.encoded(empty(spark), path).count() == 0


def test_bpe_tree_and_pieces(spark, monkeypatch):
    """Small leaves and pieces, so that unsplit runs are cut, encoded apart and joined."""
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    tk, enc = Tokenizer.from_file(path), bpe.Encoder(path)
    monkeypatch.setattr(bpe, "LEAF", 8)
    monkeypatch.setattr(bpe, "PIECE", 40)
    rng = np.random.default_rng(4)
    for _ in range(300):
        letters = ["ab", "theraindo", "éèaß", "!?.", "日本語", "a1é.", "ſİΣσ"][rng.integers(0, 7)]
        text = "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(1, 300))))
        if rng.random() < 0.3:
            text = text[:50] + " <|endoftext|>" + text[50:]
        want = tk.encode(text, add_special_tokens=False).ids
        enc.known.clear()
        assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == want
        parts = []
        for kind, part in bpe._pieces(enc, text):
            ids = enc.encode(part) if kind == 0 else np.array([int(part)] if kind == 3 else enc.tree(part, kind == 2), dtype="<u4").tobytes()
            parts.append((kind, ids))
        assert np.frombuffer(bpe._assembled(enc, parts), dtype="<u4").tolist() == want
    monkeypatch.undo()
    monkeypatch.setattr(bpe, "LONG", 1000)
    long = [(1, "the" * 40_000 + " end"), (1, "x " * 900), (None, "short")]
    out = bpe.encoded(spark.createDataFrame(long, "row_key long, text string"), path).collect()
    assert sorted((r.row_key or 0, len(r.ids) // 4) for r in out) == sorted((i or 0, len(tk.encode(t, add_special_tokens=False).ids)) for i, t in long)


def test_chat(spark):
    nasty = "\\### Assistant: </turn> ok\\h\\\\b #<:"
    turns = [(1, 1, "assistant", nasty), (1, 0, "user", "hi"), (2, 0, "assistant", None), (3, 0, "system", "s"), (3, 1, "user", ""), (3, 2, "assistant", "a"), (3, 2, "assistant", "a"), (None, 0, None, "x"), (4, 0, "we:ird<role#", "t")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.formatted(df).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c))
        assert [(b.role, b.text) for b in got[c].back] == [x[1:] for x in own]
        assert got[c].loss == "".join(t for _, r, t in own if r == "assistant") and got[c].n_turns == len(own)
    assert [got[c].valid for c in (1, 2, 3, None, 4)] == [True, False, False, False, False]
    assert chat.formatted(df.limit(0)).count() == 0


def brute_repeats(texts, window):
    seqs = [(t or "").encode().split() for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in seqs for i in range(len(w) - window + 1))
    out = []
    for w in seqs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("window,chunk", [(35, 1 << 20), (35, 300), (4, 200), (1, 500)])
def test_repeats(spark, docs, rows, window, chunk):
    out = repeats.without_repeats(docs.withColumn("n_words", F.lit("clash")), window=window, chunk_bytes=chunk).collect()
    want = collections.Counter((r[0], r[1], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], window)))
    assert collections.Counter((r.doc_id, r.text, r.n_words, r.n_removed, r.kept_text) for r in out) == want
    assert "source" in out[0].__fields__ and sum(r.n_removed for r in out) > 0


def test_repeats_of_nothing(spark):
    assert repeats.without_repeats(empty(spark)).count() == 0


def test_syncmers(spark, docs, rows):
    got = syncmers.with_next(docs, buckets=4, then=lambda df: df.withColumn("found", syncmers.anchors(F.col("text")))).collect()
    assert len(got) == len(rows)
    ids = sorted((r.id for r in got if r.id is not None), reverse=True)
    following = collections.Counter((r.id, r.next_id) for r in got)
    order = ids + [None] * 2
    assert following == collections.Counter(zip(order, order[1:] + order[:1]))
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.next_id, r.next_text) for r in syncmers.with_next(one).collect()] == [(1, "a b")]
    assert syncmers.with_next(empty(spark)).count() == 0


def brute_anchors(hashes, s=syncmers.S):
    """Places of closed syncmers from the hashes of the inner substrings."""
    return [i for i in range(len(hashes) - s) if min(hashes[i : i + s + 1]) in (hashes[i], hashes[i + s])]


def test_syncmer_anchors(spark):
    rng = np.random.default_rng(6)
    texts = ["", "one two", words(rng, 8), words(rng, 9), words(rng, 300), words(rng, 2000), "x" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    s = syncmers.S
    unit = F.transform(F.regexp_extract_all("text", F.lit(syncmers.UNIT), F.lit(0)), lambda w: F.xxhash64(w))
    for r in df.select("text", syncmers.anchors(F.col("text")).alias("a"), unit.alias("h"), syncmers.fingerprint(syncmers.anchors(F.col("text"))).alias("f")).collect():
        assert len(r.f) == 8 * len(r.a)
        if len(r.h) < 2 * s:
            assert len(r.a) == (1 if r.h else 0)
            continue
        pair = lambda a, b: spark_pair(spark, a, b)
        level = r.h
        n = 1
        while n < s:
            level = pair(level[:-n], level[n:])
            n *= 2
        assert len(r.a) == len(brute_anchors(level))
    a, b = words(rng, 300), words(rng, 300)
    near = spark.createDataFrame([(a, a[:1000] + b[:300], b)], "a string, e string, b string")
    r = near.select(*[syncmers.likeness(syncmers.anchors(F.col("a")), syncmers.anchors(F.col(c))).alias(c) for c in "aeb"]).first()
    assert r.a == 1 and 0.5 < r.e < 1 and r.b < 0.1


def spark_pair(spark, a, b):
    rows = spark.createDataFrame(list(zip(range(len(a)), a, b)), "i int, a long, b long").coalesce(1).select("i", F.xxhash64("a", "b").alias("h")).collect()
    return [r.h for r in sorted(rows, key=lambda r: r.i)]


def test_simhash_fingerprint():
    text = "A b, C dÉ e f a b, c"
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    assert simhash.fingerprint_of(text, 3, 42) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint_of("A b", 3, 42) == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint_of(None, 3, 42) == simhash.fingerprint_of(" \n", 3, 42) == 0


def test_simhash_anchors_cover():
    rng = np.random.default_rng(7)
    v = rng.integers(0, 1 << 63, 200, dtype=np.uint64) << np.uint64(1)
    row, home = simhash.anchors_of(v, 0)
    assert row.tolist() == list(range(len(v)))
    for x, h in zip(v.tolist(), home.tolist()):
        i, j = rng.integers(0, 64, 2).tolist()
        y = x ^ (1 << i) ^ (0 if i == j else 1 << j)
        assert h in simhash.anchors_of(np.array([y], dtype=np.uint64), 2)[1]


def test_near_duplicates(spark, docs, rows):
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 1 << 62, 30)
    values = {int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in seeds for a, b in rng.integers(0, 62, (6, 2))} | {int(x) for x in seeds} | {0, 1, 3, -1}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in values], "fp long")).collect()}
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert got == want
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    by_fp = collections.defaultdict(set)
    for r in out:
        by_fp[r.fp].add(r.component_id)
    assert all(len(x) == 1 for x in by_fp.values())
    assert {r.component_id for r in out if r.id in range(200, 225)} == {3}
    assert {r.component_id for r in out if r.id in (300, 301, 302)} == {300}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)] + [(500, 501 + i) for i in range(50)] + [tuple(map(int, x)) for x in rng.integers(1000, 1100, (40, 2))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, docs, rows):
    out = sharding.sharded(docs.withColumn("slot", F.lit("clash")), ["doc_id", "text"], 7).collect()
    assert len(out) == len(rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.sharded(docs.repartition(5), ["doc_id", "text"], 7).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.shard, r.slot)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert sharding.sharded(empty(spark), ["doc_id"], 3).count() == 0


def test_hypergeometric():
    import random

    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.35
    table = sharding.matrix([10, 0, 33, 5], 4, 3)
    assert [sum(r) for r in table] == [10, 0, 33, 5] and [sum(c) for c in zip(*table)] == [12, 12, 12, 12]
    assert sum(map(sum, sharding.matrix([10**9, 3 * 10**9], 3, 1))) == 4 * 10**9
