import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkroom.functions import analyzers, pixels, scalars
from darkroom.operators import fusion, pairs, queue, ranking, scheduler, sessions
from darkroom.operators.evaluation import score_report
from darkroom.plans.engine import Engine
from darkroom.sources import schema
from darkroom.sources.store import upserted
from darkroom.sources.weights import Weights

T0 = dt.datetime(2024, 1, 1)
PIXEL = dict(blur_variance=300.0, dark_fraction=0.0, bright_fraction=0.0, mean_luminance=100.0, dhash=0, is_pocket_shot=False, uniformity=0.1)
FACE = dict(face_count=1, avg_capture_quality=0.5, blink_count=0, looking_away_count=0, mouth_open_count=0, any_blink=False, any_looking_away=False, any_mouth_open=False)


def asset(id, at=0, pixel=None, face=None, text=None, embedding=None, vlm=None, **more):
    features = dict(pixel=pixel, face=face, text=text, composition=None, embedding=embedding, vlm=vlm)
    base = dict(
        id=id, created_at=T0 + dt.timedelta(seconds=at), is_favorite=False, is_hidden=False, is_screenshot=False, is_burst=False, is_live=False, burst_id=None, latitude=None, longitude=None,
        pixel_width=100, pixel_height=100, byte_size=1000, is_locally_available=True, secondary_backup_label=None, features=features, junk=0.0, miss=0.0, aesthetic=0.5, reasons=[],
        cluster_id=None, is_best_in_cluster=False, tier_completed=1, analyzed_at=None,
    )
    return base | more


def frame(spark, *rows):
    return spark.createDataFrame([T.Row(**r) for r in rows], T._parse_datatype_string(schema.ASSETS))


def fuse(spark, row, weights=Weights()):
    return fusion.fused(frame(spark, row), weights).first()


def kinds(r):
    return [x.kind for x in r.reasons]


def test_fusion_rules(spark):
    r = fuse(spark, asset("a", is_locally_available=False))
    assert kinds(r) == ["CloudOriginal"] and not r.should_queue and r.aesthetic == pytest.approx(0.5)
    r = fuse(spark, asset("a", pixel=PIXEL | dict(is_pocket_shot=True, blur_variance=1.0, uniformity=0.99)))
    assert r.should_queue and r.junk > 0.8 and kinds(r) == ["PocketShot", "Blur"]
    r = fuse(spark, asset("a", face=FACE | dict(face_count=2, blink_count=1, any_blink=True)))
    assert r.should_queue and r.miss > 0.7 and r.reasons[0].detail == "1 face(s) mid-blink"
    r = fuse(spark, asset("a", is_favorite=True, pixel=PIXEL | dict(is_pocket_shot=True)))
    assert (r.junk, r.miss, r.aesthetic, r.reasons, r.should_queue) == (0, 0, 1, [], False)
    away, w = FACE | dict(any_looking_away=True), Weights(looking_away_miss=0.55)
    assert not fuse(spark, asset("a", face=away), w).should_queue
    r = fuse(spark, asset("a", face=away, secondary_backup_label=" Google "), w)
    assert r.should_queue and kinds(r) == ["LookingAway", "SecondaryBackup"] and r.reasons[1].detail.endswith("to Google")
    assert not fuse(spark, asset("a", face=away, secondary_backup_label="  "), w).should_queue


def test_fusion_details_and_scores(spark):
    r = fuse(spark, asset("a", pixel=PIXEL | dict(blur_variance=24.25, dark_fraction=0.625, bright_fraction=0.5)))
    assert [x.detail for x in r.reasons] == ["Very blurry (laplacian 24.2)", "62% near-black pixels", "50% clipped highlights"]
    assert r.junk == pytest.approx(0.495) and r.reasons[0].confidence == pytest.approx(0.55) and not r.should_queue
    similar = dict(embedding=None, aesthetic_raw=5.5, junk_similarities=[("a", 0.5), ("b", 0.5), ("c", 0.1)])
    vlm = dict(category="meme", ephemeral=True, reason="joke", confidence=2.0)
    r = fuse(spark, asset("a", embedding=similar, vlm=vlm, is_screenshot=True))
    assert [(x.kind, x.detail) for x in r.reasons] == [("Screenshot", "Device screenshot"), ("UtilityJunk", "Looks like: b"), ("VlmEphemeral", "meme — joke")]
    assert r.junk == pytest.approx(0.9) and r.aesthetic == pytest.approx(0.35 + 0.65 * 0.5)
    r = fuse(spark, asset("a", pixel=PIXEL | dict(dark_fraction=float("nan"))))
    assert kinds(r) == []


def test_weights():
    w = Weights(blink_miss=0.9)
    assert Weights.from_toml(w.to_toml()) == w and w.of_reason("Blink") == 0.9 and w.of_reason("Custom") == 0.5
    with pytest.raises(ValueError):
        Weights.from_toml("version = 1")


def test_pixels(spark):
    black, checks = bytes([0, 0, 0, 255]) * 4096, b"".join(bytes([255 * ((x // 4 + y // 4) % 2)] * 3 + [255]) for y in range(64) for x in range(64))
    r = pixels.analyze(64, 64, black)
    assert r["is_pocket_shot"] and r["uniformity"] > 0.9
    r = pixels.analyze(64, 64, checks)
    assert r["blur_variance"] > 50 and not r["is_pocket_shot"]
    assert pixels.analyze(10, 10, bytes(10))["error"] and pixels.analyze(0, 10, b"")["error"]
    flat = bytes([100, 50, 200, 255]) * 1024
    assert pixels.analyze(32, 32, flat)["dhash"] == pixels.analyze(32, 32, flat + b"x")["dhash"] == 0
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (9, 9))
    df = spark.createDataFrame([(1, y, x, int(grey[y, x])) for y in range(9) for x in range(9)], "image int, y int, x int, g int")
    assert pixels.laplacian_stats(df).first().variance == pytest.approx(pixels.laplacian_variance(grey[None])[0])
    assert pixels.exposure_stats(df).select("mean", "dark", "bright", "uniformity").first()[:] == pytest.approx(tuple(x[0] for x in pixels.exposure(grey[None])))
    out = spark.createDataFrame([(64, 64, checks), (10, 10, b"short"), (None, 1, None)], "w int, h int, d binary").select(pixels.signals(F.col("w"), F.col("h"), F.col("d")).alias("s")).collect()
    assert out[0].s.blur_variance > 50 and out[1].s.error and out[2].s.dhash is None


def test_analyzers(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.1), (0.0, 0.1)]
    df = spark.createDataFrame([(square, square[:3], None)], "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>, c array<struct<x: double, y: double>>")
    r = df.select(analyzers.aspect_ratio(F.col("a")).alias("r"), analyzers.blink(F.col("a"), F.col("b")).alias("x"), analyzers.blink(F.col("b"), F.col("c")).alias("y"), analyzers.mouth_open(F.col("c")).alias("z")).first()
    assert r.r == pytest.approx(0.1) and r.x and not r.y and not r.z
    lines = spark.createDataFrame(list(enumerate(["# note", "", " one ", "two"])), "seq long, value string")
    prompts = analyzers.prompts_from_lines(lines).collect()
    assert [(p.label, p.vector.index(1.0)) for p in prompts] == [("one", 0), ("two", 1)] and analyzers.builtin_prompts(spark).count() == 8
    vectors = spark.createDataFrame([("a", [0.6, 0.8]), ("b", [0.0, 0.0])], "id string, embedding array<float>")
    got = {r.id: [(s.label, round(s.similarity, 3)) for s in r.similarities] for r in analyzers.zero_shot(vectors, analyzers.prompts_from_lines(lines)).collect()}
    assert got == {"a": [("one", 0.6), ("two", 0.8)], "b": [("one", 0.0), ("two", 0.0)]}


def test_clusters_and_chains(spark):
    rows = [asset("a", 0, PIXEL | dict(dhash=0xF0)), asset("b", 5, PIXEL | dict(dhash=0xF1)), asset("c", 100, PIXEL | dict(dhash=0x0F))]
    rows += [asset(f"d{i:03}", 1000 + 30 * i, PIXEL | dict(dhash=-1)) for i in range(40)]
    rows += [asset("e", 5000, burst_id="x", latitude=0.0, longitude=0.0), asset("f", 5001, burst_id="x", latitude=1.0, longitude=0.0), asset("g", 5002, burst_id="x"), asset("h", 5100, burst_id=""), asset("i", 5101, burst_id="")]
    df = frame(spark, *rows).select("id", "created_at", "latitude", "longitude", "burst_id", F.col("features.pixel.dhash").alias("dhash"))
    got = {}
    for r in sessions.clusters(df).collect():
        got.setdefault(r.cluster_id, []).append((r.pos, r.id))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {"a": ["b", "a"], "d000": [f"d{i:03}" for i in reversed(range(40))], "e": ["g", "f", "e"]}


def test_band_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    times = [rng.randrange(400) for _ in range(120)]
    df = spark.createDataFrame([(f"{i:03}", T0 + dt.timedelta(seconds=t)) for i, t in enumerate(times)], "id string, at timestamp")
    got = {(r.id_a, r.id_b) for r in pairs.band_pairs(df, "at", 7).collect()}
    order = sorted((t, f"{i:03}") for i, t in enumerate(times))
    assert got == {(a, b) for n, (s, a) in enumerate(order) for t, b in order[n + 1 :] if t - s <= 7}


def test_cosine_and_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.0], [0.0, 0.0, 0.0])], "a array<float>, b array<float>, c array<float>, z array<float>")
    c = lambda x, y, **k: scalars.cosine(F.col(x), F.col(y), **k)
    r = df.select(c("a", "b").alias("same"), c("a", "c").alias("odd"), c("a", "c", truncate=True).alias("cut"), c("a", "z").alias("zero"), scalars.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("m")).first()
    assert r.same == pytest.approx(1) and r.odd is None and r.cut == pytest.approx(1) and r.zero == 0 and r.m == pytest.approx(111_195, rel=1e-3)


def test_ranking(spark):
    trio = [(0.3, 300.0, 0.0, 0.4), (0.9, 90.0, 0.0, 0.9), (0.5, 150.0, 0.0, 0.5)]
    rows = [asset(f"r{i}", 0, PIXEL | dict(blur_variance=b), FACE | dict(avg_capture_quality=f), aesthetic=a, miss=m) for i, (a, b, m, f) in enumerate(trio)]
    rows += [asset("m0", 0, PIXEL | dict(blur_variance=100.0), FACE | dict(avg_capture_quality=0.8), aesthetic=0.7), asset("m1", 0, PIXEL | dict(blur_variance=100.0), FACE | dict(avg_capture_quality=0.8), aesthetic=0.75, miss=0.9), asset("alone")]
    members = frame(spark, *rows).drop("cluster_id").withColumn("cluster_id", F.substring("id", 1, 1)).withColumn("pos", F.lit(0))
    got = {r.cluster_id: r for r in ranking.ranked_clusters(members).collect()}
    assert set(got) == {"r", "m"} and got["r"].best_id == "r1" and len(got["r"].toss_ids) == 2 and got["m"].best_id == "m0"
    worst = got["m"].reasons_by_id[0]
    assert [x.kind for x in worst.reasons] == ["LowerAesthetic", "NearDuplicate"] and worst.reasons[1].detail == "Near duplicate of m0"


def test_queue_fold_against_a_stack(spark):
    rng = random.Random(5)
    log, want = [], set()
    for q in range(60):
        stack, left = [], 12
        for seq in range(rng.randrange(1, 40)):
            d = rng.choice(["keep", "toss", "skip", "undo"])
            log.append((q, seq, f"{q}-{seq}", d))
            if d == "undo":
                if stack:
                    stack.pop()
            elif left:
                left -= 1
                stack.append(f"{q}-{seq}")
        want |= set(stack)
    df = spark.createDataFrame(log, "queue_id int, seq int, asset_id string, decision string")
    lengths = df.select("queue_id").distinct().withColumn("length", F.lit(12))
    assert {r.asset_id for r in queue.folded(queue.accepted(df, lengths)).collect()} == want


def test_scheduler(spark):
    s = scheduler.SchedulerState()
    hot = s.observed("serious")
    assert hot.paused and hot.batch_size == 4 and hot.observed("fair").batch_size == 4 and not hot.observed("fair").paused and hot.observed("nominal").batch_size == 32
    assert not s.can_run_vlm("battery", 8) and s.can_run_vlm("charging", 8) and not s.can_run_vlm("charging", 4)
    rows = frame(spark, asset("p", tier_completed=0), asset("q", tier_completed=1), asset("r", tier_completed=2, junk=0.5))
    batch = lambda df, state=s: [(r.tier, r.id) for r in scheduler.next_batch(df, state, vlm=True).collect()]
    assert batch(rows) == [(1, "p")] and batch(rows.where("id <> 'p'")) == [(2, "q")] and batch(rows.where("id = 'r'")) == [(3, "r")] and batch(rows, hot) == []
    rng = random.Random(2)
    log = [(d, i, rng.choice(["nominal", "fair", "serious", "critical"])) for d in range(5) for i in range(30)]
    got = {(r.device_id, r.seq): (r.batch_size, r.paused) for r in scheduler.device_fold(spark.createDataFrame(log, "device_id int, seq int, thermal string")).collect()}
    for d in range(5):
        now = scheduler.SchedulerState()
        for dev, i, thermal in log:
            if dev == d:
                now = now.observed(thermal)
                assert got[d, i] == (now.batch_size, now.paused)


def test_evaluation(spark):
    gold = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", ["x"])], "file string, labels array<string>")
    said = spark.createDataFrame([("a", ["x"]), ("b", ["x"]), ("zzz", ["only"])], "file string, labels array<string>")
    got = {r.category: (r.tp, r.fp, r.fn, r.precision, r.recall, r.support) for r in score_report(gold, said).collect()}
    assert got == {"x": (1, 1, 1, 0.5, 0.5, 2), "y": (0, 0, 1, 0.0, 0.0, 1), "only": (0, 0, 0, 0.0, 0.0, 0)}


def test_json_codec(spark):
    text = json.dumps({"pixel": PIXEL | {"dhash": 2**64 - 2}, "embedding": {"embedding": [0.5], "aesthetic_raw": 1.0, "junk_similarities": [["a", 0.25]]}, "text": {"has_barcode": True}})
    r = spark.createDataFrame([(text,), ("{nope",), (None,)], "t string").select(schema.features_from_json(F.col("t")).alias("f")).collect()
    assert r[0].f.pixel.dhash == -2 and r[0].f.embedding.junk_similarities[0].similarity == 0.25 and r[0].f.text is None and r[0].f.face is None
    assert r[1].f.pixel is None and r[2].f.vlm is None


def test_upsert_keeps_analysis(spark):
    stored = frame(spark, asset("a", junk=0.9, tier_completed=2), asset("b"))
    new = frame(spark, asset("a", byte_size=7), asset("n", byte_size=9, tier_completed=2)).withColumn("at", F.lit(1))
    new = new.unionByName(frame(spark, asset("a", byte_size=8)).withColumn("at", F.lit(2)))
    got = {r.id: (r.byte_size, round(r.junk, 2), r.tier_completed) for r in upserted(stored, new, "at").collect()}
    assert got == {"a": (8, 0.9, 2), "b": (1000, 0.0, 1), "n": (9, 0.0, 0)}


def test_engine_session(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.upsert_meta(frame(spark, *[asset(x, i * 100, byte_size=s) for i, (x, s) in enumerate((("small", 1), ("large", 8), ("medium", 3), ("hidden", 9)))]))
    assert e.asset_count() == 4 and sorted(i for _, i in e.next_work_batch()) == ["hidden", "large", "medium", "small"]
    bad = PIXEL | dict(is_pocket_shot=True)
    e.save_fused(frame(spark, *[asset(x, i * 100, bad, byte_size=s, is_hidden=x == "hidden") for i, (x, s) in enumerate((("small", 1), ("large", 8), ("medium", 3), ("hidden", 9)))]), 1)
    assert e.rebuild_review_queue() == 3 and e.peek_review()["id"] == "large"
    assert e.decide("toss") == "large" and e.decide("keep") == "medium" and e.decide("undo") == "medium" and e.remaining_review() == 1
    assert e.staged_toss_ids() == ["large"] and e.staged_bytes() == 8
    assert e.decide("keep") == "small" and e.decide("keep") is None
    assert e.commit_deletes() == (1, 8) and e.staged_toss_ids() == []
    assert e.rebuild_review_queue() == 1 and e.peek_review()["id"] == "medium"
    e.set_change_token("t1")
    assert e.get_change_token() == "t1" and e.observe_device("critical").paused and Engine(spark, str(tmp_path / "store")).state.paused
    e.record_batch_progress(1, 4, "small")
    assert e.state.tier1 == 4
    e.set_review_category_labels(schema.labels_for(["duplicates"]))
    assert e.rebuild_review_queue() == 0
    e.set_review_category_labels([])
    e.store.upsert(frame(spark, asset("x", 5000), asset("y", 5001)))
    e.save_fused(frame(spark, asset("x", 5000, PIXEL | dict(dhash=1)), asset("y", 5001, PIXEL | dict(dhash=3, blur_variance=100.0))), 1)
    assert e.recluster_recent(10) == 1 and e.recluster_recent(10) == 1
    r = {r.id: r for r in e.store.assets().where("id in ('x', 'y')").collect()}
    assert r["x"].is_best_in_cluster and r["y"].junk == pytest.approx(0.6) and kinds(r["y"]) == ["LowerAesthetic", "NearDuplicate"]
    e.prune(spark.createDataFrame([("y",)], "id string"))
    assert {r.id: (r.is_hidden, r.tier_completed) for r in e.store.assets().where("id in ('x', 'y')").collect()} == {"x": (True, 2), "y": (False, 1)}


def test_streaming_feed(spark, tmp_path):
    from darkroom.streaming import feed

    source = str(tmp_path / "in")
    frame(spark, asset("a", 0, PIXEL | dict(is_pocket_shot=True)), asset("b")).write.parquet(source)
    e = Engine(spark, str(tmp_path / "store"))
    feed.ingest(feed.changes(spark, source), e, str(tmp_path / "check")).awaitTermination()
    assert e.asset_count() == 2 and e.rebuild_review_queue() == 1
    log = str(tmp_path / "log")
    spark.createDataFrame([(1, 0, "serious"), (1, 1, "fair"), (2, 0, "fair")], "device_id long, seq int, thermal string").coalesce(1).write.parquet(log)
    stream = feed.paced(spark.readStream.schema("device_id long, seq int, thermal string").parquet(log))
    q = stream.writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.device_id, r.thermal, r.batch_size, r.paused) for r in spark.table("paced").collect()) == [(1, "fair", 4, False), (1, "serious", 4, True), (2, "fair", 16, False)]


def test_cli(spark, tmp_path, capsys):
    from darkroom.cli import main

    path = str(tmp_path / "r.json")
    meta = {"id": "a", "created_at": "2024-01-01T00:00:00Z", "is_favorite": False, "is_hidden": False, "is_screenshot": False, "is_locally_available": True}
    rows = [{"meta": meta, "features": {"pixel": PIXEL}, "scores": {"junk": 0.0, "miss": 0.0, "aesthetic": 0.5}, "reasons": []}]
    rows.append(rows[0] | {"meta": meta | {"id": "b"}})
    (tmp_path / "r.json").write_text(json.dumps(rows))
    assert main(["weights"]) == main(["fuse", path]) == main(["cluster", path]) == main(["rank", path]) == 0
    out = capsys.readouterr().out
    assert "blur_junk" in out and '"member_ids":["a","b"]' in out and '"best_id":"a"' in out


def test_pixel_signals_of_every_event(spark, tmp_path):
    from darkroom.plans import catalogue

    ids = list(range(0, 310, 7)) + [1000, 1001, 2**40 + 3]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    found = {r.event_id: r for r in catalogue.q48(spark, str(tmp_path)).collect()}
    assert sorted(found) == ids
    for i, r in found.items():  # an image of one colour has its value as mean, no edges and no differences
        v = (299 * (i % 256) + 587 * (i % 256) + 114 * (i % 256)) // 1000
        assert r.mean_luminance == v and r.blur_variance == 0 and r.dhash == 0 and r.uniformity == 1 and r.is_pocket_shot and r.error is None
        assert r.dark_fraction == (v < 16) and r.bright_fraction == (v >= 240)
