"""Large families of texts about as unlike as the limit: long sketches leave few pairs to compare and lose none."""

import random

import numpy as np
from pyspark.sql import functions as F

from darkroom.llm import shingles


def test_long_sketches_tell_more_sets_apart_and_never_alike_ones(spark):
    rng, rows = np.random.default_rng(3), []
    for share in np.linspace(0.6, 1.0, 81):
        whole = rng.integers(-(2**63), 2**63 - 1, 900)
        n = int(390 * share)
        x, y = whole[:390], np.concatenate([whole[:n], whole[390 : 390 + 390 - n]])
        rows.append((9 * n >= 4 * 780, 390, *(z for s in (x, y) for w in (shingles.SKETCH, shingles.FINE) for z in [shingles._sketch(s, w).tolist()])))
    df = spark.createDataFrame(rows, "alike boolean, n int, x_bits array<long>, x_fine array<long>, y_bits array<long>, y_fine array<long>")
    short = shingles._overlapping(F.col("n"), F.col("x_bits"), F.col("n"), F.col("y_bits"))
    long = shingles._finely_overlapping(F.col("n"), F.col("x_fine"), F.col("n"), F.col("y_fine"))
    none = shingles._finely_overlapping(F.col("n"), F.lit(None).cast("array<long>"), F.col("n"), F.lit(None).cast("array<long>"))
    found = df.select("alike", short.alias("short"), long.alias("long"), none.alias("none")).collect()
    assert all(r.long and r.short for r in found if r.alike) and all(r.none for r in found)
    unlike = [r for r in found if not r.alike]
    assert 2 * sum(r.long for r in unlike) < sum(r.short for r in unlike)


def test_a_family_at_the_limit_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(shingles, "MANY", 8)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"m{rng.random()}" if rng.random() < 0.022 else w for w in base) for _ in range(45)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(45))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(45):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.component_id for r in shingles.near_copies(df).collect()}
    assert got == {i: find(i) for i in range(45)} and len(set(got.values())) > 1
