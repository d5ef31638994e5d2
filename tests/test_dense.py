"""Many rows in reach of each other: nothing of the size of their pairs is made, and no group lies in one window."""

import random

import pytest
from pyspark.sql import functions as F

from darkroom.functions import pixels
from darkroom.operators import incremental, pairs, ranking, sessions
from darkroom.plans import catalogue
from test_sessions import FLAT, brute, library


def test_a_long_session_joins_no_pairs(spark, monkeypatch):
    def never(*_):
        raise AssertionError("pairs were joined")

    monkeypatch.setattr(pairs, "links", never)
    n = 25_000
    df = spark.range(n).select(
        F.format_string("a%05d", "id").alias("id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 5).alias("created_at"), F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"), F.lit(None).cast("string").alias("burst_id"), F.lit(7).cast("long").alias("dhash"), F.lit(None).cast("array<float>").alias("vector"),
    )
    got = sessions.clusters(df).agg(F.count("*"), F.count_distinct("cluster_id"), F.min("cluster_id"), F.max_by("id", "pos"), F.max("pos")).first()
    assert tuple(got) == (n, 1, "a00000", "a00000", n - 1)


def test_dense_rows_against_all_pairs(spark):
    rng, config = random.Random(5), pairs.ClusterConfig(seconds=2, hamming=1, cosine=0.95)
    rows = library(rng, 300, 150)
    df = spark.createDataFrame(rows, FLAT)
    assert {tuple(r) for r in sessions.clusters(df, config).collect()} == brute(rows, config)
    known = rows[:200]
    before = spark.createDataFrame([(c, x) for c, x, _ in brute(known, config)], "cluster_id string, id string")
    new = spark.createDataFrame([(r[0],) for r in rows[200:]], "id string")
    for long in (sessions.LONG, 40):
        assert {tuple(r) for r in incremental.extended(before, df, new, config, long).collect()} == {(c, x) for c, x, _ in brute(rows, config)}


@pytest.mark.parametrize("long", [1, 4])
def test_ranks_by_ranges_are_those_of_windows(spark, long):
    rng = random.Random(long)
    rows = [(f"c{i % 3 if i < 60 else i}", i, f"a{i:03}", rng.choice([None, 0.5, rng.random(), float("nan")])) for i in range(70)]
    df = spark.createDataFrame(rows, "cluster_id string, pos int, id string, rank_score double")
    text = lambda out: sorted(map(str, out.collect()))
    assert text(ranking.ranks(df, long)) == text(ranking.ranks(df)) and ranking.ranks(df, long).count() == 60


def test_pairs_of_vectors_join_nothing_for_each_pair(spark):
    """Vectors go by time, not to each pair: one shuffle, and pairs as plain loops find them."""
    rows = library(random.Random(8), 200, 300)
    df = spark.createDataFrame(rows, FLAT)
    out = sessions.cosine_pairs(df, 15, 0.9)
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    some = sorted((r for r in rows if r[1] and r[6]), key=lambda r: (r[1], r[0]))
    near = [(a, b) for i, a in enumerate(some) for b in some[i + 1 :] if (b[1] - a[1]).total_seconds() <= 15 and len(a[6]) == len(b[6])]
    assert {(r.id_a, r.id_b) for r in out.collect()} == {(a[0], b[0]) for a, b in near if cos(a[6], b[6]) >= 0.9}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_images_of_one_colour_are_not_resized(monkeypatch):
    images, want = [bytes([v, v, v, 255]) * 64 for v in range(256)], pixels.analyze_all(8, 8, [bytes([9, 9, 9, 255]) * 64])
    monkeypatch.setattr(pixels, "resized", lambda *_: 1 / 0)
    got = pixels.analyze_all(8, 8, images)
    assert got["mean_luminance"].tolist() == list(range(256)) and not got["dhash"].any() and all(got[c][9] == want[c][0] for c in want)


def test_records_of_pairs_need_no_join_by_id(spark):
    from darkroom.plans import catalogue

    plan = catalogue.queries()["q55_sql_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_a_store_sorts_ranges_smaller_than_buckets(spark, tmp_path):
    from darkroom.plans import catalogue
    from darkroom.sources import adapter, store

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        kept = store.Store(spark, str(tmp_path / "s"), buckets=2)
        rows = catalogue._as_stored(adapter.assets(spark, "/root/testdata/sf0.001"))
        kept.replace(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(list((tmp_path / "s" / "assets").rglob("*.parquet"))) >= 12 and kept.assets().count() == rows.count()


@pytest.mark.parametrize(("long", "parts"), [(sessions.LONG, 4), (sessions.LONG, 1), (40, 4)])
def test_named_vectors_give_what_held_ones_give(spark, long, parts):
    rng, config = random.Random(11), pairs.ClusterConfig(seconds=2, hamming=1, cosine=0.95)
    rows = library(rng, 300, 150)
    some = sorted({tuple(r[6]) for r in rows if r[6]})
    named = [(*r[:6], some.index(tuple(r[6])) if r[6] else None if i % 2 else -1) for i, r in enumerate(rows)]
    df = spark.createDataFrame(named, FLAT.rsplit(",", 1)[0] + ", vector_id long")
    vectors = spark.createDataFrame([(i, list(x)) for i, x in enumerate([*some, (9.0, 9.0)])], "vector_id long, vector array<float>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert {tuple(r) for r in sessions.clusters(df, config, long, vectors).collect()} == brute(rows, config)
        assert sessions.clusters(df.limit(0), config, long, vectors).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_of_a_vector_go_to_a_cell_once(spark):
    """100 rows of one cell name two vectors: two rows hold one, and the rows themselves none."""
    dealt = spark.range(100).selectExpr("id", "0L as cell", "true as own", "true as head", "id % 3 as vector_id")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vector_id long, vector array<float>")
    out = sessions._with_vectors(dealt, vectors)
    assert out.count() == 102 and {(r.cell, r.vector_id) for r in out.where("vector is not null and id is null and not own").collect()} == {(0, 0), (0, 1)}
    assert out.where("vector is not null").count() == 2


@pytest.mark.parametrize("long", [1, 4, sessions.LONG])
def test_ranks_of_carried_scores_are_those_of_members(spark, long):
    """Scores that rows carry to their clusters give the ranks that members joined with their scores have."""
    rng, config = random.Random(21), pairs.ClusterConfig(seconds=2, hamming=1, cosine=0.95)
    rows = library(rng, 200, 120)
    scores = [(r[0], rng.choice([None, 0.5, rng.random(), float("nan")])) for r in rows]
    df = spark.createDataFrame(rows, FLAT).join(spark.createDataFrame(scores, "id string, rank_score float"), "id")
    got = ranking.ranks_of(sessions.grouped(df, config, long, carried=("rank_score",)), long)
    wanted = ranking.ranks(sessions.clusters(df, config).join(df.select("id", "rank_score"), "id"))
    assert sorted(map(str, got.select(*wanted.drop("pos").columns).collect())) == sorted(map(str, wanted.drop("pos").collect()))
    assert wanted.count() > 50


def test_ranks_join_nothing_by_id(spark):
    """Of the rows of clusters one shuffle is left, by cluster; kinds go to the queue as a text, not as an array."""
    folder = "/root/testdata/sf0.001"
    plan = catalogue._ranks(spark, folder)._jdf.queryExecution().toString()
    assert "Join" not in plan.split("Physical Plan")[1] and plan.split("Physical Plan")[1].count("Exchange") == 1
    wide, narrow = (ranking.with_clusters(catalogue._fused(spark, folder), catalogue._ranks(spark, folder), x) for x in (False, True))
    kinds = lambda df: sorted(map(tuple, df.select("id", "is_best_in_cluster", "junk", catalogue._kinds().alias("kinds")).collect()), key=str)
    assert kinds(narrow) == kinds(wide) and narrow.schema["reasons"].dataType.elementType.names == ["kind"]


def test_scores_are_made_after_the_join_with_ranks(spark):
    from darkroom.operators import fusion
    from darkroom.sources import adapter

    assets = adapter.assets(spark, "/root/testdata/sf0.001")
    ranks = spark.createDataFrame([("a1", "a1", 1, 0.0, "a1"), ("a2", "a1", 2, 0.25, "a1")], "id string, cluster_id string, rank_no int, rank_delta float, best_id string")
    late, early = ranking.with_clusters(assets, ranks, fuse=fusion.fused), ranking.with_clusters(fusion.fused(assets), ranks)
    under = lambda df: (p := df._jdf.queryExecution().optimizedPlan().toString())[p.index("Join") :]
    assert "Soft focus" in under(early) and "Soft focus" not in under(late)
    text = lambda df: sorted(map(str, df.select(*sorted(early.columns)).collect()))
    assert text(late) == text(early)


@pytest.mark.parametrize("long", [1, 4, sessions.LONG])
def test_ranks_made_in_the_cell_are_those_of_members(spark, long):
    """Every row, those without a time too, has the rank that ranks() finds; groups within a cell get it there, without a shuffle by group."""
    rng, config = random.Random(22), pairs.ClusterConfig(seconds=2, hamming=1, cosine=0.95)
    rows = [*library(rng, 200, 120), ("zz", None, None, None, None, None, None)]
    scores = [(r[0], rng.choice([None, 0.5, 0.0, rng.random(), float("nan")])) for r in rows]
    df = spark.createDataFrame(rows, FLAT).join(spark.createDataFrame(scores, "id string, rank_score float"), "id").withColumn("twice", F.concat("id", "id"))
    late = lambda x: x.withColumn("id", F.substring("twice", F.lit(1), F.length("twice") / 2))
    got = ranking.with_ranks(df.drop("id"), late, config, long, carried=("twice",)).select("id", "twice", *ranking.RANK)
    clustered = ranking.ranks(sessions.clusters(df, config).join(df.select("id", "rank_score"), "id")).select("id", *ranking.RANK)
    wanted = df.select("id", "twice").join(clustered, "id", "left")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())) and wanted.where("rank_no > 1").count() > 25
    flat = sessions._flat(df, "rank_score")
    rest, _, done = sessions.settled(flat, config)
    assert rest.count() + done.count() == df.where("created_at is not null").count() and done.where("rank_no > 1").count() > 10


def test_the_queue_shuffles_what_assets_are_made_of(spark, monkeypatch):
    """Signals are made after the shuffle by time, and no row is joined to its rank by id."""
    seen = []

    def noted(df, *args):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, *args)

    kept = sessions.staged
    monkeypatch.setattr(sessions, "staged", noted)
    plan = catalogue._clustered(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    cells = next(x for x in seen if "RepartitionByExpression" in x)
    assert "Join" not in plan and "latitude" not in cells[cells.index("RepartitionByExpression") :].split("Join")[0]
