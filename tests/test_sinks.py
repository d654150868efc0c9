import json
import os

from pyspark.sql import functions as F

from framelore.config import DEFAULTS
from framelore.sources import files
from framelore.streaming import live


def test_file_sinks(spark, tmp_path):
    c = spark.createDataFrame([(1, 0.0, 4.0, 3.5, 2, ""), (1, 9.0, 13.0, 0.1, 1, "normal")], "source long, start double, end double, score double, people_max long, label string")
    files.write_candidates(c, str(tmp_path / "cand"))
    got = spark.read.option("header", True).csv(str(tmp_path / "cand")).orderBy("start").collect()
    assert [(r.start, r.label) for r in got] == [("0.00", None), ("9.00", "normal")] and "score=3.50 people=2" in got[0].notes
    files.write_jsonl(spark.createDataFrame([("train", 1), ("holdout", 2)], "split string, x int"), str(tmp_path / "sft"))
    assert sorted(os.listdir(tmp_path / "sft"))[-2:] == ["split=holdout", "split=train"]
    log = spark.createDataFrame([("chat", 1.0), ("flag", 2.0), ("other", 3.0)], "type string, s double").withColumn("tstamp", F.timestamp_seconds("s"))
    files.write_conv_log(log, str(tmp_path / "conv"))
    conv = spark.read.json(str(tmp_path / "conv"))
    assert conv.count() == 3 and [r.given_type for r in conv.filter("type = 'quarantined'").collect()] == ["other"]
    for n in ("b.MP4", "a.mkv", "c.txt"):
        (tmp_path / n).write_bytes(b"123")
    assert [(r.name, r.size) for r in files.list_videos(spark, str(tmp_path / "*.*")).collect()] == [("a.mkv", 3), ("b.MP4", 3)]
    files.cached(spark.range(3), str(tmp_path / "cache"))
    assert files.cached(spark.range(9), str(tmp_path / "cache")).count() == 3
    assert files.cached(spark.range(9), str(tmp_path / "cache"), rescan=True).count() == 9


def stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path).withWatermark("event_ts", "1 second")


def test_contacts_corroboration_and_batch_sinks(spark, tmp_path):
    touch = [(1, 1, 2, 100 + i * 0.5) for i in range(5)] + [(1, 3, 4, 100.0), (1, 5, 6, 100.0), (1, 5, 6, 101.2), (1, 1, 2, 200.0), (1, 1, 2, 200.5), (1, 9, 9, 400.0)]
    t = spark.createDataFrame(touch, "source long, a_track_id long, b_track_id long, t double").withColumn("event_ts", F.timestamp_seconds("t"))
    q = (live.contact_stream(stream(spark, t, str(tmp_path / "t"))).writeStream.format("memory").queryName("contacts")
         .option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start())
    q.awaitTermination(60)
    got = sorted((r.a_track_id, r.start_t, r.contact_frames) for r in spark.table("contacts").collect())
    assert got == [(1, 100.0, 3), (1, 200.0, 2), (5, 100.0, 2)]

    ev = spark.createDataFrame([(1, "a", "high", 0.9, 10.0), (2, "a", "low", 0.3, 11.0)], "event_id long, type string, severity string, score double, t double").withColumn("event_ts", F.timestamp_seconds("t"))
    seen = []
    q = live.alert_sink(stream(spark, ev, str(tmp_path / "e")), str(tmp_path / "out"), str(tmp_path / "c2"), lambda b: seen.append(b.count())).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out/alerts")).count() == 2 and sum(seen) == 2

    (tmp_path / "cfg").mkdir()
    (tmp_path / "cfg/1.json").write_text("\n".join(json.dumps(r) for r in [
        {"key": "min_score", "value": "0.2", "set_no": 1}, {"key": "min_score", "value": "0.5", "set_no": 2}, {"key": "unknown", "value": "1", "set_no": 3}]))
    used = []
    live.with_live_config(str(tmp_path / "cfg"), lambda b, cfg: used.append(b.filter(F.col("score") >= cfg.min_score).count()), DEFAULTS)(ev, 0)
    assert used == [1]


def test_registry_grows_batch_by_batch(spark, tmp_path):
    sig = lambda at: [1.0 if i % 32 in (at, 16 + at % 8, 24 + at % 8) else 0.0 for i in range(96)]
    row = lambda i, at: (i, float(i), "vehicle", "car", "car", sig(at), 1.0)
    schema = "sighting_id long, t double, kind string, cls string, label string, signature array<double>, aspect double"
    apply = live.registry_stream(None, str(tmp_path / "reg"))
    apply(spark.createDataFrame([row(1, 0), row(2, 3)], schema), 0)
    for _ in range(2):  # delivered again: nothing is counted twice
        apply(spark.createDataFrame([row(3, 3), row(4, 5)], schema), 1)
    reg = {r.entity_id: r.samples for r in files.load_registry(spark, str(tmp_path / "reg")).collect()}
    assert reg == {"veh_1": 1, "veh_2": 2, "veh_4": 1}
    assert spark.read.parquet(str(tmp_path / "reg/links")).count() == 4
