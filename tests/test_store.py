"""The store: buckets that change alone, commits of two writers, the log of decisions, bucketed tables, pages of the queue."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.dataframe import DataFrame
from test_engine import FACE, PIXEL, asset, frame

from darkroom.operators import queue
from darkroom.operators.scheduler import SchedulerState, next_batch, whole_batch
from darkroom.plans import catalogue
from darkroom.plans.engine import Engine
from darkroom.plans.pages import Cursor, Pages
from darkroom.sources import schema, store
from darkroom.sources.bucketed import Bucketed
from darkroom.sources.store import Store


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/assets/**/*.parquet", recursive=True)}


def test_a_change_writes_its_buckets_alone(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=8)
    s.upsert(frame(spark, *[asset(f"a{i:03}", i) for i in range(200)]))
    before, commit = files(tmp_path), s._commit_of(s.version())
    assert len(commit) == 8
    at = {r.id: r.b for r in s.assets().select("id", s.bucket().alias("b")).collect()}
    two = [x for x in sorted(at) if at[x] == 3][:2]
    s.upsert(frame(spark, *[asset(x, byte_size=7) for x in two]))
    after = s._commit_of(s.version())
    assert {b for b in commit if commit[b] != after[b]} == {"3"}
    new = set(files(tmp_path)) - set(before)
    assert new and all("bucket=3" in p for p in new) and all(files(tmp_path)[p] == t for p, t in before.items())
    got = {r.id: r.byte_size for r in s.assets().collect()}
    assert len(got) == 200 and all(got[x] == (7 if x in two else 1000) for x in got)
    plan = s.assets_of(spark.createDataFrame([(two[0],)], "id string"))
    assert {f.split("bucket=")[1][0] for f in plan.inputFiles() if "bucket=" in f} == {"3"} and [r.id for r in plan.collect()] == two[:1]
    assert s.asset(two[1])["byte_size"] == 7 and s.asset("none") is None
    assert Store(spark, str(tmp_path), buckets=99).buckets == 8


def test_save_and_put_in_one_merge(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=4)
    s.upsert(frame(spark, asset("a", byte_size=1), asset("b", byte_size=2)))
    s.save(frame(spark, asset("a", byte_size=3, junk=0.75, tier_completed=1), asset("c", byte_size=4, junk=0.25, tier_completed=1)))
    assert {r.id: (r.byte_size, r.junk, r.tier_completed) for r in s.assets().collect()} == {"a": (3, 0.75, 1), "b": (2, 0.0, 0), "c": (4, 0.25, 1)}
    s.put(s.assets().where("id = 'b'").withColumn("is_hidden", F.lit(True)))
    assert {r.id: r.is_hidden for r in s.assets().collect()} == {"a": False, "b": True, "c": False}
    s.replace(s.assets().where("id <> 'a'"))
    assert sorted(r.id for r in s.assets().collect()) == ["b", "c"]
    s.upsert(frame(spark))
    assert s.assets().count() == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    s, other = Store(spark, str(tmp_path), buckets=2), Store(spark, str(tmp_path), buckets=2)
    s.upsert(frame(spark, asset("a")))
    real, met = Store._written, []

    def between(self, *args):
        if not met:
            met.append(1)
            other.upsert(frame(spark, asset("b")))
        return real(self, *args)

    monkeypatch.setattr(Store, "_written", between)
    s.upsert(frame(spark, asset("c")))
    assert sorted(r.id for r in s.assets().collect()) == ["a", "b", "c"] and s.version() == 3
    reader = s.assets()
    s.upsert(frame(spark, asset("d")))
    assert reader.count() == 3 and s.assets().count() == 4


def test_older_versions_are_read_and_moved(spark, tmp_path):
    old = frame(spark, asset("a"), asset("b")).drop("byte_size", "is_locally_available", "secondary_backup_label")
    old.write.parquet(f"{tmp_path}/assets/v5")
    s = Store(spark, str(tmp_path), buckets=4)
    s._put("snapshot", "5")
    assert {r.id: (r.byte_size, r.is_locally_available, r.secondary_backup_label) for r in s.assets().collect()} == {"a": (0, True, None), "b": (0, True, None)}
    assert s.asset("b")["byte_size"] == 0
    s.upsert(frame(spark, asset("a", byte_size=9)))
    assert {r.id: r.byte_size for r in s.assets().collect()} == {"a": 9, "b": 0} and s.version() == 6 and "*" not in s._commit_of(6)
    assert store.migrated(old).select("byte_size", "is_locally_available").distinct().collect() == [T.Row(byte_size=0, is_locally_available=True)]


def test_many_decisions_leave_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_ENTRIES", 40)
    s = Store(spark, str(tmp_path))
    last, begin = {}, None
    for i in range(300):
        a, d = f"a{i * 7 % 60}", ("keep", "toss", "clear_keep", "skip", "keep")[i % 5]
        s.log_decision(a, d, i)
        last.setdefault(a, []).append(d)
        if i == 250:  # one fold comes between
            begin = s.decisions()
    kept = {a for a, ds in last.items() if [d for d in ds if "keep" in d][-1:] == ["keep"]}
    assert {r.asset_id for r in s.decisions().where("decision = 'keep'").collect()} == kept
    assert s.decisions().where("decision = 'toss'").count() == 60 and s.decisions().where("decision = 'clear_keep'").count() == 0
    assert begin.count() > 0
    found = [f for _, _, names in os.walk(f"{tmp_path}/decisions") for f in names if not f.startswith(".") and not f.startswith("_")]
    assert len(found) < 150
    s.decide(spark.createDataFrame([("zz", "keep", 10**6), ("a0", "clear_keep", 10**6)], store.DECISIONS))
    s.fold_decisions()
    assert {r.asset_id for r in s.decisions().where("decision = 'keep'").collect()} == (kept | {"zz"}) - {"a0"}


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    b = Bucketed(spark, str(tmp_path), 4)
    rows = frame(spark, *[asset(f"a{i:02}", i, junk=0.9) for i in range(40)])
    b.write(rows, "assets")
    b.write(spark.createDataFrame([(f"a{i:02}",) for i in range(0, 60, 3)], "id string"), "ids")
    b.write(spark.createDataFrame([(f"a{i:02}", "keep" if i % 2 else "skip", i) for i in range(40)], store.DECISIONS), "decisions", "asset_id")
    b.write(spark.createDataFrame([("c", f"a{i:02}", i) for i in range(5)], "cluster_id string, id string, pos int"), "members")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = b.lookup(), b.not_kept(), b.members()
        for df in found:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan, plan
        assert [df.count() for df in found] == [14, 20, 5]
        other = Bucketed(spark, str(tmp_path), 4, prefix="again")
        again = other.attach("assets", schema.ASSETS.replace("\n", ""), b.folder("assets"))
        ids = other.attach("ids", "id string", b.folder("ids"))
        joined = again.join(ids.hint("merge"), "id")
        assert joined.count() == 14 and "Exchange hash" not in joined._jdf.queryExecution().executedPlan().toString()
        other.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        b.drop()
    assert not spark.sql(f"show tables like '{b.prefix}_*'").collect()


def test_pages_of_the_queue(spark, tmp_path):
    rows = [(f"a{i:03}", i * 37 % 11, 2, i % 3, 0.5, i % 7 / 7) for i in range(230)]
    df = spark.createDataFrame(rows, "id string, byte_size long, pixel_width long, pixel_height long, junk float, miss float").repartition(5)
    want = [r.id for r in df.orderBy(*queue.queue_order()).collect()]
    pages = Pages.write(df, str(tmp_path), parts=6)
    assert len(pages) == 230 and len(pages.parts) > 2
    joined = []
    for n in range(12):
        page = pages.page(n, 20)
        joined += [r.id for r in page.orderBy("position").collect()]
        assert n > 11 or len({f.split("part=")[1] for f in page.inputFiles()}) >= 1
    assert joined == want and pages.page(50, 20).count() == 0
    first = pages.page(0, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in first and "part#" in first.split("PartitionFilters")[1][:60]
    at, walked = Cursor(), []
    while at is not None:
        page, at = Pages.open(spark, pages.path).after(at, 64)
        walked += [r.id for r in page.orderBy("position").collect()]
    assert walked == want
    none = Pages.write(df.where("false"), str(tmp_path), parts=3)
    assert len(none) == 0 and none.page(0).count() == 0


def test_cascade_run(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    ids = [f"a{i}" for i in range(12)]
    e.upsert_meta(frame(spark, *[asset(x, i) for i, x in enumerate(ids)]))
    seen = []

    def analyze(rows, tier):
        got = rows.collect()
        seen.extend((r.id, tier) for r in got)
        kept = [asset(r.id, i, PIXEL | dict(is_pocket_shot=tier == 1), FACE) for i, r in enumerate(got) if r.id != "a3"]
        return frame(spark, *kept)

    live = spark.createDataFrame([(x,) for x in ids if x not in ("a5", "a7")], "id string")
    assert e.run_cascade(analyze, live) == 12 + 9
    assert sorted(seen) == sorted([(x, t) for x in ids for t in (1, 2) if x not in ("a3", "a5", "a7")] + [("a3", 1)])
    rows = {r.id: r for r in e.store.assets().collect()}
    assert all(rows[x].is_hidden and rows[x].tier_completed == 2 for x in ("a5", "a7")) and rows["a3"].tier_completed == 0 and rows["a0"].tier_completed == 2
    seen.clear()
    e.run_cascade(analyze, live)
    assert seen == [("a3", 1)]
    assert e.asset("a0")["id"] == "a0" and e.lookup(spark.createDataFrame([("a0",), ("zz",)], "id string")).count() == 1
    e.save_fused(frame(spark, asset("a0", 0, PIXEL | dict(is_pocket_shot=True), byte_size=5)), 2)
    assert e.rebuild_review_queue() == 1 and e.decide("toss") == "a0" and e.commit_deletes() == (1, 5) and (e.deleted_count, e.freed_bytes) == (1, 5)


def test_cascade_takes_all_that_is_pending(spark, tmp_path, monkeypatch):
    rows = [asset(f"a{i:03}", i % 50, tier_completed=i % 2) for i in range(400)]
    e = Engine(spark, str(tmp_path / "paced"))
    e.upsert_meta(frame(spark, *rows[:300]))
    e.state = SchedulerState(batch_size=200)
    assert e.run_cascade(lambda due, tier: due) == 600 and e.store.assets().where("tier_completed = 2").count() == 300
    e = Engine(spark, str(tmp_path / "whole"))
    e.store.replace(frame(spark, *rows, asset(None)))
    live, seen = spark.createDataFrame([(f"a{i:03}",) for i in range(390)], "id string"), []

    def analyze(due, tier):
        seen.append((tier, due.count()))
        return due.where("id <> 'a000'")

    assert e.run_cascade(analyze, live, paced=False) == 200 + 394 and seen == [(1, 195), (2, 389)]
    assert {r.id: r.tier_completed for r in e.store.assets().collect()} == {r["id"]: 0 if r["id"] == "a000" else 2 for r in rows} | {None: 1}
    assert e.store.assets().where("is_hidden").count() == 10 and (e.state.tier1, e.state.tier2) == (194, 389)
    e.store.replace(frame(spark, *rows))
    assert e.run_cascade(lambda due, tier: due, most=250, paced=False) == 250 and e.store.assets().where("tier_completed = 0").count() == 0
    e.store.replace(frame(spark, *rows))
    assert e.run_cascade(lambda due, tier: due, live.where("false"), paced=False) == 400 and e.store.assets().where("is_hidden and tier_completed = 2").count() == 400
    # the query on top cuts nothing either
    cuts, limit = [], DataFrame.limit
    monkeypatch.setattr(DataFrame, "limit", lambda df, n: cuts.append(n) or limit(df, n))
    rows = spark.createDataFrame([(i, i * 1000, 1, "view", 1.0) for i in range(60)], "event_id long, us long, user_id long, event_type string, value double")
    rows.select("event_id", F.timestamp_micros("us").alias("ts"), "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    left = {r.id: (r.is_hidden, r.tier_completed) for r in catalogue.queries()["q71_cascade"](spark, str(tmp_path)).collect()}
    want = {}
    for n in range(60):
        due, gone = n % 3 < 2 and n % 37 and n % 53, n % 11 == 0
        want[f"a{n}"] = (n % 53 == 0 or bool(due and gone), 2 if due and (gone or n % 7) else n % 3)
    assert left == want and cuts and max(cuts) == 1


def test_whole_batch(spark):
    rows = [asset(x, at, tier_completed=0) for x, at in (("p", 3), ("q", 1), ("r", 1))] + [asset("s", 2), asset("t", 2, is_favorite=True), asset("u", 5, tier_completed=2, junk=0.5), asset("v", 5, tier_completed=2, junk=0.625)]
    df = frame(spark, *rows)
    got = lambda **more: [(r.tier, r.id) for r in whole_batch(df, **more).orderBy("tier", "position").collect()]
    assert got() == [(1, "p"), (1, "q"), (1, "r"), (2, "s")] and got(vlm=True) == got() + [(3, "u"), (3, "v")]
    assert [i for _, i in got()[:3]] == [r.id for r in next_batch(df, SchedulerState()).orderBy("position").collect()]


def test_records_in_their_own_layout(spark, tmp_path):
    meta = dict(id="x1", created_at="2024-05-01T10:00:00.250Z", is_favorite=False, is_hidden=False, is_screenshot=True, is_burst=False, is_live=False, burst_id=None, latitude=1.5, longitude=None,
                pixel_width=10, pixel_height=20, byte_size=30, is_locally_available=True, secondary_backup_label=None)
    embedding = dict(embedding=[0.5, 0.25], aesthetic_raw=6.5, junk_similarities=[["a \"receipt\"", 0.375], ["meme", 0.25]])
    record = dict(meta=meta, features=dict(pixel=PIXEL | {"dhash": 2**63 + 5}, face=FACE, text=None, composition=None, embedding=embedding, vlm=None), scores=dict(junk=0.5, miss=0.25, aesthetic=0.75),
                  reasons=[dict(kind="Blur", detail="x", confidence=0.5)], cluster_id=None, is_best_in_cluster=False, tier_completed=2, analyzed_at=None)
    (tmp_path / "one.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "many.json").write_text(json.dumps([record, record | {"meta": meta | {"id": "x2"}}]))
    r = schema.read_records(spark, str(tmp_path / "one.json")).first()
    assert (r.id, r.features.pixel.dhash, r.features.embedding.junk_similarities[0].label, r.junk, r.aesthetic, r.latitude) == ("x1", -(2**63) + 5, 'a "receipt"', 0.5, 0.75, 1.5)
    rows = schema.read_records(spark, str(tmp_path / "many.json"))
    assert rows.columns == T._parse_datatype_string(schema.ASSETS).fieldNames() and rows.count() == 2
    schema.write_records(rows, str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted(glob.glob(f"{tmp_path}/out/part-*")) for x in open(f) if x.strip()]
    back = next(x for x in lines if x["meta"]["id"] == "x1")
    at = back["meta"].pop("created_at")
    assert at.startswith("2024-05-01T10:00:00.25") and back == json.loads(json.dumps(record)) | {"meta": {k: v for k, v in meta.items() if k != "created_at"}}
    again = schema.read_records(spark, str(tmp_path / "out"), lines=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "bad.json").write_text('{"meta": {"id": "y", "created_at": "2024-05-01T10:00:00Z", "pixel_width": "wide"}}\n{"meta": {}}\n{nope\n' + json.dumps(record) + "\n")
    told = schema.read_records(spark, str(tmp_path / "bad.json"), lines=True, errors="report").collect()
    assert [r.id for r in told if r.error is None] == ["x1"] and sorted(r.error.split(":")[0] for r in told if r.error) == ["no id", "not a record", "not a record"]
    with pytest.raises(Exception, match="not a record|no id"):
        schema.read_records(spark, str(tmp_path / "bad.json"), lines=True).collect()
