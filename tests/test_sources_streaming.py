import json
import os

import pytest
from pyspark.sql import functions as F

from framelore import schemas
from framelore.config import DEFAULTS
from framelore.operators import datasets as ds, incidents as inc
from framelore.sources import files
from framelore.streaming import live
from tests.scenes import frame_list, person, scene


def test_annotations_report_every_problem(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("video,start,end,label,split,notes\nv/a.mp4,00:01:12,00:01:16.5,phone_snatch,train,x\n,,,,,\nv/b.mp4,1:10,70,normal,,\n"
                 "v/c.mp4,5,4,nonsense,train,\nv/d.mp4,x,4,,dev,\n/abs/e.mp4,0,2.5,Normal,val,\n")
    spans, problems = files.read_annotations(spark, str(p), "/root")
    assert sorted((r.video, r.start, r.end, r.label, r.split) for r in spans.collect()) == [
        ("/abs/e.mp4", 0.0, 2.5, "normal", "val"), ("/root/v/a.mp4", 72.0, 76.5, "phone_snatch", "train")]
    assert sorted((r.video, r.problem.split(" ")[0]) for r in problems.collect()) == [
        ("v/b.mp4", "end"), ("v/c.mp4", "end"), ("v/c.mp4", "unknown"), ("v/d.mp4", "blank"), ("v/d.mp4", "cannot"), ("v/d.mp4", "unknown")]
    with pytest.raises(ValueError):
        files.read_annotations(spark, str(p), strict=True)
    (tmp_path / "b.csv").write_text("video,start\nx,1\n")
    with pytest.raises(ValueError, match="missing required"):
        files.read_annotations(spark, str(tmp_path / "b.csv"))


def test_box_labels_and_audit(spark, tmp_path):
    for d in ("images/train", "labels/train"):
        os.makedirs(tmp_path / d)
    for n in ("a", "b", "c", "d"):
        (tmp_path / f"images/train/{n}.jpg").write_bytes(b"x")
    (tmp_path / "labels/train/a.txt").write_text("0 .5 .5 .1 .2\n1 0 0 .1 0 .1 .1\nbad\n0 1 2 3\n")
    (tmp_path / "labels/train/b.txt").write_text("")
    (tmp_path / "labels/train/c.txt").write_text("0 .5 .5 .5 .5\n")
    images, labels = files.read_box_labels(spark, str(tmp_path))
    got = {(os.path.basename(r.image), r.kind): round(r.area_pct, 6) for r in ds.with_area(labels).collect()}
    assert got == {("a.jpg", "box"): 2.0, ("a.jpg", "polygon"): 0.5, ("c.jpg", "box"): 25.0}
    s = ds.audit_summary(images, labels).first()
    assert (s.images, s.labelled, s.negatives, s.missing) == (4, 2, 1, 1)
    kept = {os.path.basename(r.image): r.reason for r in ds.filter_by_scale(labels, images).collect()}
    assert kept == {"a.jpg": "fits", "b.jpg": "negative", "c.jpg": "too_big", "d.jpg": "negative"}


def test_registries_round_trip_and_malformed_is_loud(spark, tmp_path):
    (tmp_path / "cams.json").write_text(json.dumps({"_comment": {"name": "x"}, "cam1": {"name": "Gate", "area": "North"}}))
    (tmp_path / "rec.json").write_text(json.dumps({"recipients": [{"name": "A", "areas": ["north"]}]}))
    assert [(r.id, r.name) for r in files.read_registry(spark, str(tmp_path / "cams.json"), schemas.CAMERAS).collect()] == [("cam1", "Gate")]
    assert [r.name for r in files.read_registry(spark, str(tmp_path / "rec.json"), schemas.RECIPIENTS, "recipients").collect()] == ["A"]
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(Exception):
        files.read_registry(spark, str(tmp_path / "bad.json"), schemas.CAMERAS).collect()
    root = str(tmp_path / "reg")
    assert files.load_registry(spark, root) is None
    files.save_registry(spark.range(2), root)
    files.save_registry(spark.range(5), root)
    assert files.load_registry(spark, root).count() == 5


def test_failed_scorer_leaves_an_error_not_an_answer(spark):
    def boom(pdf):
        raise RuntimeError("model not loaded")
    rows = files.score_with(spark.range(3), boom, "id long, text string, error string").collect()
    assert len(rows) == 3 and all("model not loaded" in r.error and r.text is None for r in rows)
    with pytest.raises(ValueError):
        files.detect_with(spark.range(1), boom, [], "id long, class_id int, error string")


def run(spark, df, tmp_path, mode="append"):
    name = "q" + os.urandom(4).hex()
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    q.awaitTermination(90)
    return spark.table(name)


def test_streaming_cooldown_equals_batch(spark, tmp_path):
    ev = spark.createDataFrame([(i, i % 2, "k", 1000.0 + (i * 7) % 101, "high", .9) for i in range(80)],
                               "event_id long, source long, cooldown_key string, t double, severity string, score double").withColumn("event_ts", F.timestamp_seconds("t"))
    # Files in time order, as a feed delivers them.
    for part in range(4):
        ev.filter((F.col("t") >= 1000 + part * 26) & (F.col("t") < 1026 + part * 26)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    later = ev.limit(1).withColumn("source", F.lit(999).cast("long")).withColumn("event_ts", F.timestamp_seconds(F.lit(9999)))  # lets the watermark pass
    later.write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("event_ts", "5 seconds")
    got = {r.event_id for r in run(spark, live.cooldown_stream(s, 12.0), tmp_path).filter("source < 999").collect()}
    want = {r.event_id for r in inc.min_gap(ev, ["source", "cooldown_key"], "t", 12.0, "event_id").collect()}
    assert got == want


def test_streaming_tracker_equals_batch(spark, tmp_path):
    from framelore.operators import tracks as tr
    frames = [[person(300 + (5 * i if i > 20 else 0), 300), person(700, 300)] for i in range(40)]
    rows = tr.with_ticks(scene(spark, frames, 1.0, 1000.0), frame_list(spark, 40, 1.0, 1000.0)).withColumn("event_ts", F.timestamp_seconds("t"))
    later = rows.limit(1).withColumn("source", F.lit(999).cast("long")).withColumn("event_ts", F.timestamp_seconds(F.lit(9999)))  # lets the watermark pass
    rows.unionByName(later).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("event_ts", "5 seconds")
    out = run(spark, live.track_stream(s, DEFAULTS.patched(loiter_s=30.0)), tmp_path)
    got = {r.det_id: r.track_id for r in out.collect()}
    want = {r.det_id: r.track_id for r in tr.track(scene(spark, frames, 1.0, 1000.0), frames=frame_list(spark, 40, 1.0, 1000.0)).collect()}
    assert got == want
    assert out.filter("dwell_alert").count() == 1


def test_streaming_sessions_and_crowd(spark, tmp_path):
    ev = spark.createDataFrame([(1, "a", t, "high", .5) for t in (10.0, 15.0, 25.0, 80.0, 300.0)], "source long, type string, t double, severity string, score double") \
              .withColumn("event_ts", F.timestamp_seconds("t"))
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")).withWatermark("event_ts", "1 second")
    assert sorted((r.first_t, r["count"]) for r in run(spark, live.incident_stream(s), tmp_path).collect()) == [(10.0, 3), (80.0, 1)]
    c = spark.createDataFrame([(1, i, t, n) for i, (t, n) in enumerate(((99.0, 1), (99.5, 1), (100.0, 1), (100.5, 1), (101.0, 1), (101.5, 9), (160.0, 1), (200.0, 1)))],
                              "source long, frame_no long, t double, people long").withColumn("event_ts", F.timestamp_seconds("t"))
    c.coalesce(1).write.parquet(str(tmp_path / "c"))
    s = spark.readStream.schema(c.schema).parquet(str(tmp_path / "c")).withWatermark("event_ts", "1 second")
    assert "crowd_surge" in {r.type for r in run(spark, live.crowd_stream(s), tmp_path).collect()}
