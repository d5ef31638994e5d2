"""Each stage of the pipeline against brute force over what the stage before kept."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from darkroom.llm import quality, simhash

SF = "/root/testdata/sf0.001"


def test_near_copies_are_all_found(spark):
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(30)]
    texts = []
    for _ in range(40):  # each with copies of one to three changed words, and a passage that all of them hold
        base = [f"w{i}" for i in rng.integers(0, 3000, int(rng.integers(40, 160)))] + common
        for changes in (0, 1, 2, 3):
            copy = list(base)
            for at in rng.integers(0, len(copy), changes):
                copy[at] = f"x{rng.integers(0, 10**9)}"
            texts.append(" ".join(copy))
    texts += [texts[1], texts[0].upper(), None, "", "two words", "two  words", "two other"]
    sets = [set(map(int, simhash.shingles_of(x, 5, 42))) for x in texts]
    prints = [simhash.fingerprint_of(x, 5, 42) for x in texts]
    first, far = list(range(len(texts))), 0
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                like = 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
                near = bin(prints[a] ^ prints[b]).count("1") <= 2
                far += like and not near
                if (like or near) and first[a] < first[b]:
                    first[b], changed = first[a], True
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [i for i, f in enumerate(first) if i == f] and far > 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    """Near copies are texts of a Jaccard likeness of 0.8 or more on five words, or of SimHash fingerprints within two bits;
    the stages after it run on what that leaves."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept.append(docs.collect())
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert set(corpus_pipeline.COLUMNS) <= set(docs.columns)
    every, good, single, cut, mix = kept
    out = docs.collect()

    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.score(np.array([quality.statistics(r.text) for r in every]))
    assert {r.doc_id for r in good} == {r.doc_id for r, s in zip(every, score) if s >= 0.5} and len(good) < len(every)

    sets = {r.doc_id: set(map(int, simhash.shingles_of(r.text, 5, 42))) for r in good}
    prints = {r.doc_id: simhash.fingerprint_of(r.text, 5, 42) for r in good}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or bin(prints[a] ^ prints[b]).count("1") <= 2)
    ]
    first = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(first[a], first[b])
            changed |= first[a] != low or first[b] != low
            first[a] = first[b] = low
    assert sorted(r.doc_id for r in single) == sorted(d for d in first if first[d] == d) and len(single) < len(good)

    words = {r.doc_id: r.text.encode().split() for r in single}
    count = collections.Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {}
    for r in single:
        w = words[r.doc_id]
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        if not gone or len(gone) < len(w):
            want[r.doc_id] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else r.text
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)

    times = collections.Counter(r.doc_id for r in mix)
    size = {r.doc_id: len(r.text.encode().split()) for r in cut}
    assert set(times) <= set(size) and max(times.values()) <= 3
    assert abs(sum(size[d] * n for d, n in times.items()) - sum(size.values())) <= 20 * max(size.values())

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert collections.Counter(r.doc_id for r in out) == times
    for r in out:
        ids = tk.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids and r.decoded == tk.decode(ids, skip_special_tokens=False)


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, x, "en", s, len(x or "")) for i, x, s in rows], ROWS)


def test_near_copies_are_dropped_by_row(spark):
    a, b, c = ("one two three four five six seven", "a quite different text of some words here", "nothing like the others at all it seems")
    left = corpus_pipeline.keep_one_of_near_copies(spark, rows_of(spark, [(1, a, "s"), (2, b, "s"), (2, a, "s"), (3, c, "s")]), "")
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, a), (2, b), (3, c)]
    rows = [(None, a, "s"), (None, a, "s"), (None, b, "s"), (5, c, "s"), (5, c, "s"), (7, c.upper(), "s"), (8, None, "s"), (9, "", "s"), (9, "", None)]
    left = corpus_pipeline.keep_one_of_near_copies(spark, rows_of(spark, rows), "").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in left))) == sorted(map(str, [(None, a), (None, b), (5, c), (8, None)]))


def test_many_copies_and_shared_shingles(spark):
    """Fingerprints, components and shingles that many rows hold, which go without a shuffle by their key."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 40, n)]
    text = word(60)
    rows = [(i, " ".join(text), "s") for i in range(300)]
    for i in range(300, 500):
        near = list(text)
        near[int(rng.integers(0, 60))] = f"x{i}"
        rows.append((i, " ".join(near), "s"))
    rows += [(i, " ".join(word(50)), "s") for i in range(500, 560)]
    left = corpus_pipeline.keep_one_of_near_copies(spark, rows_of(spark, rows), "")
    assert sorted(r.doc_id for r in left.collect()) == [0, *range(500, 560)]


def test_stages_on_odd_rows_and_none(spark, tmp_path):
    long = " ".join(f"w{i * i % 997}" for i in range(5000))
    rows = [(1, None, None), (2, "", "s"), (3, " \n", "s"), (4, long, "s"), (4, long, "s"), (None, long + " end", "t"), (None, "x y z", None), (5, "same " * 100, "t"), (6, "Ünï 日本 👍", "t")]
    spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = rows_of(spark, rows).withColumns({c: F.lit("clash") for c in ("id", "hash", "_id", "_hash", "root", "score", "size", "copies", "copy", "ids", "kept_text")})
    for docs in (extra, extra.where("false")):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and (out.count() <= 3 * n), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert out and {r.doc_id for r in out} < set(docs)
    for r in out:
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == tk.encode(r.text, add_special_tokens=False).ids
        assert set(r.text.split()) <= set(docs[r.doc_id].split())
