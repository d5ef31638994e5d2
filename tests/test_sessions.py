"""Sessions over one order of all rows, and clusters within them, against plain loops; new assets against whole passes."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkroom.operators import incremental, pairs, sessions

T0 = dt.datetime(2024, 1, 1)
FLAT = "id string, created_at timestamp, latitude double, longitude double, burst_id string, dhash long, vector array<float>"


def library(rng, n, span):
    rows = []
    for i in range(n):
        at = None if rng.random() < 0.03 else T0 + dt.timedelta(microseconds=rng.randrange(span) * rng.choice([1, 1_000_000]) % (span * 1_000_000))
        place = (None, None) if rng.random() < 0.3 else (10 + rng.randrange(3) * 1e-4, 20.0 + rng.randrange(2) * 1e-3)
        vector = None if rng.random() < 0.3 else [float(x) for x in np.eye(4)[rng.randrange(4)] + 0.1][: rng.choice([4, 4, 4, 3])]
        rows.append((f"a{i:04}", at, *place, rng.choice([None, "", "b1", "b2", "b3"]), rng.choice([None, 0, 0b11, (1 << 40) - 1, -1]), vector))
    return rows


def linked(a, b, config):
    gap = (b[1] - a[1]) / dt.timedelta(microseconds=1)
    if abs(gap) > config.seconds * 1e6:
        return False
    if config.metres is not None and None not in (a[2], b[2]):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        if 2 * 6_371_000 * math.asin(math.sqrt(h)) > config.metres:
            return False
    if a[4] and a[4] == b[4] or None not in (a[5], b[5]) and ((a[5] ^ b[5]) & (2**64 - 1)).bit_count() <= config.hamming:
        return True
    if a[6] is None or b[6] is None or len(a[6]) != len(b[6]):
        return False
    x, y = np.array(a[6]), np.array(b[6])
    return float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) >= config.cosine


def brute(rows, config):
    rows = [r for r in rows if r[1] is not None]
    root = {r[0]: r[0] for r in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if linked(a, b, config):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append(r)
    return {(k, r[0], pos) for k, g in groups.items() if len(g) > 1 for pos, r in enumerate(sorted(g, key=lambda r: (-(r[1] - T0).total_seconds(), r[0])))}


@pytest.mark.parametrize("span,long,parts", [(4000, 20_000, 4), (4000, 3, 4), (300, 20_000, 7), (300, 10, 3), (40_000, 20_000, 1), (40_000, 2, 9)])
def test_clusters_against_all_pairs(spark, span, long, parts):
    rows = library(random.Random(span + long), 260, span)
    config = pairs.ClusterConfig(seconds=20, hamming=1, cosine=0.95)
    df = spark.createDataFrame(rows, FLAT).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {tuple(r) for r in sessions.clusters(df, config, long).collect()}
        without = {tuple(r) for r in sessions.clusters(df.drop("vector"), config, long).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows, config) and without == brute([(*r[:6], None) for r in rows], config)


def test_one_time_and_none(spark):
    rows = [(f"x{i:03}", T0, None, None, "b", None, None) for i in range(300)]
    df = spark.createDataFrame(rows, FLAT)
    got = sessions.clusters(df).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.pos)] == [r[0] for r in rows] and {r.cluster_id for r in got} == {"x000"}
    assert sessions.clusters(df.where("false")).count() == 0 and sessions.clusters(df.withColumn("created_at", F.lit(None).cast("timestamp"))).count() == 0


def test_clusters_join_nothing_by_id(spark):
    """One shuffle by time; no join but that of a row per task."""
    df = spark.createDataFrame(library(random.Random(1), 100, 400), FLAT)
    plan = sessions.clusters(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Join") <= 3


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_sessions_over_all_rows(spark, parts):
    rng = random.Random(parts)
    times = [None] * 3 + [T0 + dt.timedelta(seconds=rng.randrange(3000) + rng.choice([0, 0.5])) for _ in range(400)] + [T0 + dt.timedelta(seconds=777)] * 50
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, at timestamp").withColumn("name", F.lit("x")).repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = sessions.numbered(df, "at", 7)
        got = {r.id: r.session for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out.columns == ["id", "at", "name", "session"]
    nulls = sorted(got[i] for i, t in enumerate(times) if t is None)
    assert nulls == [1, 2, 3]
    number, last, want = 3, None, {}
    for t, i in sorted((t, i) for i, t in enumerate(times) if t is not None):
        number += last is None or t - last > dt.timedelta(seconds=7)
        want[i], last = number, t
    assert {i: got[i] for i in want} == want
    assert sessions.numbered(df.where("false"), "at", 7).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_new_assets_give_what_a_whole_pass_gives(spark, seed):
    rng = random.Random(seed)
    rows, config = library(rng, 150, 600), pairs.ClusterConfig(seconds=15, hamming=1, cosine=0.95)
    rng.shuffle(rows)
    df, known = spark.createDataFrame([], "cluster_id string, id string"), []
    for i in range(0, 150, 50):
        some = rows[i : i + 50]
        known += some
        new = spark.createDataFrame([(r[0],) for r in some], "id string")
        df = spark.createDataFrame(incremental.extended(df, spark.createDataFrame(known, FLAT), new, config).collect(), "cluster_id string, id string")
        assert {tuple(r) for r in df.collect()} == {(c, x) for c, x, _ in brute(known, config)}
    none = spark.createDataFrame([], "id string")
    assert {tuple(r) for r in incremental.extended(df, spark.createDataFrame(known, FLAT), none, config).collect()} == {tuple(r) for r in df.collect()}
