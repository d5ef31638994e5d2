"""Streams: the cascade over restarts, undo stacks over micro-batches; classifiers; the engine in SQL; images and listings."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_engine import FACE, PIXEL, T0, asset, frame

from darkroom.functions import analyzers, classifier, pixels, scalars
from darkroom.operators import fusion, pairs, queue
from darkroom.plans import sql
from darkroom.plans.engine import Engine
from darkroom.sources import library, schema
from darkroom.streaming import cascade, decisions, feed


def test_cascade_over_a_restart(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    frame(spark, *[asset(f"a{i}", i, tier_completed=0) for i in range(6)]).coalesce(1).write.parquet(source)
    e, seen, broken = Engine(spark, str(tmp_path / "store")), [], [True]

    def analyze(rows, tier):
        got = rows.collect()
        if tier == 2 and broken:
            broken.clear()
            raise RuntimeError("worker lost")
        seen.extend((r.id, tier) for r in got)
        return frame(spark, *[asset(r.id, i, PIXEL, FACE) for i, r in enumerate(got) if r.id != "a1"])

    live = spark.createDataFrame([(f"a{i}",) for i in range(20) if i != 4], "id string")
    c = cascade.Cascade(e, analyze, live)
    with pytest.raises(Exception, match="worker lost"):
        c.start(feed.changes(spark, source), check).awaitTermination()
    assert sorted(seen) == [(f"a{i}", 1) for i in (0, 1, 2, 3, 5)]
    c = cascade.Cascade(Engine(spark, str(tmp_path / "store")), analyze, live)
    c.start(feed.changes(spark, source), check).awaitTermination()
    frame(spark, asset("b", 9, tier_completed=0), asset("a1", 1, tier_completed=0)).coalesce(1).write.mode("append").parquet(source)
    c.start(feed.changes(spark, source), check).awaitTermination()
    assert sorted(seen) == sorted([(f"a{i}", 1) for i in (0, 1, 2, 3, 5)] + [(f"a{i}", 2) for i in (0, 2, 3, 5)])
    rows = {r.id: r for r in e.store.assets().collect()}
    assert rows["a4"].is_hidden and rows["b"].is_hidden and rows["a1"].tier_completed == 0 and rows["a0"].tier_completed == 2
    assert [(r.id, r.tier) for r in c.failed().collect()] == [("a1", 1)]


def test_undo_over_micro_batches(spark, tmp_path):
    import random

    rng, log, want = random.Random(9), [], set()
    for q in range(15):
        stack, left = [], 12
        for seq in range(40):
            d = rng.choice(["keep", "toss", "skip", "undo"])
            log.append((q, seq, f"{q}-{seq}", d))
            if d == "undo":
                if stack:
                    stack.pop()
            elif left:
                left -= 1
                stack.append((q, seq, f"{q}-{seq}", d))
        want |= set(stack)
    source, kind = str(tmp_path / "log"), "queue_id long, seq long, asset_id string, decision string"
    for low, high in ((0, 17), (17, 40)):
        rows = [r for r in log if low <= r[1] < high]
        rng.shuffle(rows)
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    decisions.use_state(spark)
    try:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        q = decisions.changes(stream, 12).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert len([p for p in q.recentProgress if p.numInputRows]) == 2
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = decisions.standing(spark.read.parquet(str(tmp_path / "out")))
    assert {(r.queue_id, r.seq, r.asset_id, r.decision) for r in out.collect()} == want
    whole = spark.createDataFrame(log, kind)
    folded = queue.folded(queue.accepted(whole, whole.select("queue_id").distinct().withColumn("length", F.lit(12))))
    assert {(r.queue_id, r.seq, r.asset_id, r.decision) for r in folded.collect()} == want


def test_classifiers(spark, tmp_path):
    loads = str(tmp_path)

    def load():
        import uuid

        open(f"{loads}/{uuid.uuid4().hex}", "w").close()
        return lambda images: [("ticket", len(x) > 2, f"{len(x)} bytes", 1.5) if x != b"?" else None for x in images]

    classifier.register("fake", load)
    rows = frame(spark, *[asset(f"a{i}", i) for i in range(4)]).withColumn("rgba", F.when(F.col("id") == "a0", b"abcd").when(F.col("id") == "a1", b"x").when(F.col("id") == "a2", b"?")).coalesce(1)
    out = classifier.classified(rows, "fake")
    got = {r.id: r.vlm for r in out.collect()}
    assert tuple(got["a0"]) == ("ticket", True, "4 bytes", 1.0) and tuple(got["a1"])[:2] == ("ticket", False) and got["a2"] is None and got["a3"] is None
    out.collect()
    assert 1 <= len(list(tmp_path.iterdir())) <= 4  # loaded once a worker, not once a batch or row
    parts = T._parse_datatype_string(schema.FEATURES).fieldNames()
    fused = fusion.fused(out.withColumn("features", F.struct(*[F.col("vlm").cast(T._parse_datatype_string(schema.FEATURES)["vlm"].dataType).alias(c) if c == "vlm" else F.col(f"features.{c}").alias(c) for c in parts])))
    said = {r.id: [x.kind for x in r.reasons] for r in fused.collect()}
    assert said == {"a0": ["VlmEphemeral"], "a1": [], "a2": [], "a3": []}
    stub = classifier.classified(rows).where("id = 'a0'").first().vlm
    assert tuple(stub) == ("unknown", False, "", 0.0) and analyzers.classify_stub(rows).first().vlm.category == "unknown" and "stub" in classifier.names()
    with pytest.raises(ValueError):
        classifier.classified(rows, "none")


def test_sql_surface(spark):
    rows = [asset(f"a{i:02}", 7 * i, PIXEL | dict(dhash=i % 4, is_pocket_shot=i % 3 == 0, blur_variance=20.0 * i), latitude=None if i % 7 == 3 else 1.0 + i % 2 * 1e-4, longitude=2.0, burst_id="b" if i % 5 == 0 else None, byte_size=i) for i in range(30)]
    df = frame(spark, *rows)
    log = spark.createDataFrame([("a03", "keep")], "asset_id string, decision string")
    name = sql.register(spark, df, log)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 0
    flat = df.select("id", "created_at", "latitude", "longitude", "burst_id", F.col("features.pixel.dhash").alias("dhash"))
    assert same(spark.sql(f"select * from {name['band_pairs']}(30)"), pairs.band_pairs(flat, "created_at", 30).select("id_a", "id_b", "gap"))
    assert same(spark.sql(f"select id_a, id_b from {name['near_links']}(30, 1, 50.0)"), pairs.links(flat, pairs.ClusterConfig(30, 1, 2.0, 50.0)).select("id_a", "id_b"))
    fused = fusion.fused(df)
    assert same(spark.sql(f"select id, junk, miss, should_queue from {name['fused']}"), fused.select("id", "junk", "miss", "should_queue"))
    chips = fused.select("id", F.explode(queue.reason_chips(F.col("reasons"), F.lit(1))).alias("c")).select("id", "c.kind", "c.title")
    assert same(spark.sql(f"select id, kind, title from {name['chips']}"), chips)
    assert same(spark.sql(f"select id from {name['queue']}"), queue.review_queue(fused, log).select("id"))
    c = F.col
    words = spark.sql(f"select id, {name['luma']}(200, 100, pixel_height) l, {name['hamming']}(dhash, 6) h, round({name['haversine_m']}(latitude, longitude, 1.0, 2.0), 6) m, {name['byte_size_of']}(byte_size, pixel_width, pixel_height) b, {name['keyword_hits']}('WiFi Total') k, {name['reason_label']}('Blur') r from {name['assets']}")
    wanted = df.select("id", scalars.luma(F.lit(200), F.lit(100), c("pixel_height")), scalars.hamming(c("features.pixel.dhash"), F.lit(6).cast("long")), F.round(scalars.haversine_m(c("latitude"), c("longitude"), F.lit(1.0), F.lit(2.0)), 6), scalars.byte_size(c("byte_size"), c("pixel_width"), c("pixel_height")), scalars.keyword_hits(F.lit("WiFi Total")), F.lit("Blurry"))
    assert same(words, wanted)


def test_windows_of_whole_seconds(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(at(0), at(30.9)), (at(30.9), at(0)), (at(0.5), at(31.5)), (at(0), at(30)), (at(0.9), at(30)), (at(0), None)], "a timestamp, b timestamp")
    want = [True, True, False, True, True, None]
    assert [r[0] for r in df.select(scalars.within_window(F.col("a"), F.col("b"), 30)).collect()] == want
    name = sql.register(spark, frame(spark, asset("a")))
    assert [r[0] for r in df.select(F.expr(f"{name['within_window']}(a, b, 30)")).collect()] == want


def test_listing(spark):
    photo = lambda n, local, kind="photo": (kind, n, local)
    rows = [
        ("a", None, None, None, ["screenshot", "live"], None, "b1", (1.0, 2.0), 100, 40, [photo(7, True), photo(5, False, "adjustment"), photo(None, True, "paired_video")]),
        ("b", T0, True, True, None, True, None, None, 100, 41, [photo(0, False)]), ("c", T0, False, False, [], False, None, None, 10, 10, None), ("d", T0, False, False, [], False, None, None, 10, 10, [photo(3, False, "adjustment")]),
    ]
    got = {r.id: r for r in library.projected(spark.createDataFrame(rows, library.LISTING)).withColumn("created_at", F.year("created_at")).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.created_at, a.is_screenshot, a.is_live, a.is_burst, a.latitude, a.byte_size, a.is_locally_available) == (1, True, True, True, 1.0, 12, True)
    assert (b.is_burst, b.is_favorite, b.byte_size, b.is_locally_available, b.latitude) == (True, True, 1025, False, None)
    assert (c.is_burst, c.byte_size, c.is_locally_available, d.byte_size, d.is_locally_available) == (False, 25, True, 3, False)


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    (tmp_path / "a.ppm").write_bytes(b"P6\n# note\n7 5\n255\n" + rgb.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"P5 7 5 255\n" + rgb[..., 0].tobytes())
    rgba = np.concatenate([rgb, rgb[..., :1]], axis=2)
    (tmp_path / "c.pam").write_bytes(b"P7\nWIDTH 7\nHEIGHT 5\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" + rgba.tobytes())
    line = np.zeros((5, 24), dtype=np.uint8)
    line[:, :21] = rgb[::-1][..., [2, 1, 0]].reshape(5, 21)
    (tmp_path / "d.bmp").write_bytes(b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 120, 0, 54, 40, 7, 5, 1, 24, 0, 120, 0, 0, 0, 0) + line.tobytes())
    (tmp_path / "e.ppm").write_bytes(b"P6 70 50 255\nshort")
    (tmp_path / "g.ppm").write_bytes(b"\x89PNG....")
    (tmp_path / "h.ppm").write_bytes(b"P6 1000 25 255\n" + bytes([50, 60, 70]) * 25000)
    rows = {r.path.rsplit("/", 1)[1]: r for r in library.read_images(spark, str(tmp_path), most=100).collect()}
    opaque = np.concatenate([rgb, np.full((5, 7, 1), 255, np.uint8)], axis=2)
    grey = np.concatenate([np.repeat(rgb[..., :1], 3, axis=2), np.full((5, 7, 1), 255, np.uint8)], axis=2)
    assert rows["a.ppm"].rgba == rows["d.bmp"].rgba == opaque.tobytes() and rows["b.pgm"].rgba == grey.tobytes() and rows["c.pam"].rgba == rgba.tobytes()
    assert [rows[f"{x}.ppm"].error for x in "eg"] == ["truncated image", "unknown image format"] and rows["e.ppm"].rgba is None
    assert (rows["h.ppm"].width, rows["h.ppm"].height) == (100, 3) and set(rows["h.ppm"].rgba) == {50, 60, 70, 255}
    only = library.read_images(spark, str(tmp_path), names="*.ppm").select("path")
    assert only.count() == 4 and "content" not in only._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    seen = library.read_images(spark, str(tmp_path), names="[a-d].*").select(pixels.signals(F.col("width"), F.col("height"), F.col("rgba")).alias("s"))
    assert seen.where("s.error is null").count() == 4


def test_halves_round_up_and_thumbnails(spark):
    assert pixels.fitted(1000, 25, 100) == (100, 3) and pixels.fitted(10, 20, 100) == (10, 20) and pixels.fitted(5000, 1, 100) == (100, 1) and pixels.fitted(2000, 250, 100) == (100, 13)
    w, h, data = pixels.thumbnail(200, 100, bytes([9, 8, 7, 255]) * 20000, 50)
    assert (w, h, set(data)) == (50, 25, {7, 8, 9, 255})


def test_text_blocks_with_flags(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "asset_id string")
    blocks = spark.createDataFrame([("a", i, x) for i, x in enumerate(["Wi-Fi", "pass", "word", None])], "asset_id string, seq int, text string")
    codes = spark.createDataFrame([("b",), ("b",)], "asset_id string")
    docs = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("b", 0, 0.6)], "asset_id string, seq int, confidence double")
    got = {r.asset_id: tuple(r.text) for r in analyzers.text_block(ids, blocks, codes, docs).collect()}
    assert got == {"a": (True, False, False, 4, 1), "b": (False, True, True, 0, 0), "c": (False, False, False, 0, 0)}


def test_prompts_from_files(spark, tmp_path):
    assert analyzers.read_prompts(spark, None).count() == 8 and analyzers.read_prompts(spark, str(tmp_path / "none.json")).count() == 8
    (tmp_path / "p.json").write_text('[{"label": "x", "vector": [1, 0]}, {"label": null, "vector": [1]}]')
    assert [r.label for r in analyzers.read_prompts(spark, str(tmp_path / "p.json")).collect()] == ["x"]
    assert analyzers.builtin_prompts(spark, 10).count() == 10
