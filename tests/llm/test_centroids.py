"""Sort-means against plain assignment to the nearest of all centroids."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.llm import centroids, queries


def nearest(row, centres):
    return min((sum((a - b) ** 2 for a, b in zip(row, c)), i) for i, c in enumerate(centres))


def brute(rows, centres, rounds):
    for _ in range(rounds):
        of = [nearest(r, centres)[1] for r in rows]
        for c in range(len(centres)):
            mine = [r for r, x in zip(rows, of) if x == c]
            if mine:
                centres = [*centres[:c], [sum(x) // len(mine) for x in zip(*mine)], *centres[c + 1 :]]
    return [nearest(r, centres) for r in rows], centres


def vectors(rng, n, width, scale=1.0):
    return [(rng.standard_normal(width) * scale).round(3).tolist() for _ in range(n)]


@pytest.mark.parametrize("scale", [0.01, 1.0, 300.0, 1e6, 1e30])
def test_against_all_distances(spark, scale):
    rng = np.random.default_rng(4)
    rows = vectors(rng, 150, 6, scale)
    rows += [rows[3]] * 40 + [[0.0] * 6, [-x for x in rows[5]]]
    bad = [None, [], [1.0] * 5, [1.0] * 7, [1.0] * 5 + [None], [1.0] * 5 + [float("nan")], [float("inf")] + [1.0] * 5]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(rows + bad)], "vec_id long, embedding array<double>, cluster string").repartition(3)
    df = centroids.quantised(df, width=6)
    whole = [[math.floor(256 * x) for x in r] for r in rows]
    start = centroids.seeds(df, 9, F.col("id"))
    assert start == whole[:9]
    start[8] = [10**6] * 6  # stays empty where vectors are small
    found, centres = centroids.sort_means(df, start, 4)
    got = {r.id: (r.distance, r.cluster) for r in found.collect()}
    want, wanted = brute(whole, start, 4)
    assert got == {i: (min(d, centroids.LONGEST), c) for i, (d, c) in enumerate(want)} and centres == wanted


def test_few_rows_nulls_and_none(spark, tmp_path):
    rows = [(1, [0.5] * 64), (1, [0.5] * 64), (None, [0.25] * 64), (4, [0.75] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.withColumn("id", F.lit("clash")).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    got = sorted(map(tuple, queries.op13_centroids(spark, f"{tmp_path}/a").collect()), key=str)
    of = lambda x: hashlib.sha256(",".join([str(x)] * 64).encode()).hexdigest()
    assert got == [(1, 0, 0, 0, 0, of(128)), (1, 0, 0, 0, 0, of(128)), (None, 2, 0, 0, 0, of(64))]
    df.where("false").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    none = queries.op13_centroids(spark, f"{tmp_path}/b")
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_scans_stop_and_sums_are_exact():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-5, 5, (60, 8)) + 1000 * i for i in range(6)])
    centres = centroids.Centres.of(rows[::20].tolist())
    best, least = centroids.nearest(rows, np.repeat(np.arange(18), 20), centres)
    assert [(d, c) for d, c in zip(least.tolist(), best.tolist())] == [nearest(r, centres.rows.tolist()) for r in rows.tolist()]
    for value in (0, 1, -1, 1 << 40, -(1 << 40), (1 << 200) + 5, -(1 << 200) - 7):
        assert sum(v << (centroids.LIMB * at) for at, v in centroids._limbs(value)) == value
