"""Streams whose rows arrive shuffled, late within the watermark and file by file, against the batch rules."""
import os
import random

import pytest
from pyspark.sql import functions as F

from framelore.config import DEFAULTS
from framelore.operators import captions as cap, incidents as inc, rules, tracks as tr
from framelore.streaming import live
from tests.scenes import frame_list, person, scene, vehicle

DELAY = 20.0
END = 1e6  # an instant of another source that lets the watermark pass everything before it


def arriving(spark, df, path, seed, files=5, end=True):
    """A stream of ``df`` in files: arrival is event time plus up to DELAY / 2, ties and neighbours swapped."""
    rng = random.Random(seed)
    rows = sorted((r.t + rng.random() * DELAY / 2, i, r) for i, r in enumerate(df.collect()))
    size = -(-len(rows) // files)
    for k in range(0, len(rows), size):
        part = [r for *_, r in rows[k:k + size]]
        rng.shuffle(part)
        spark.createDataFrame(part, df.schema).withColumn("event_ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(path)
    if end:
        last = {f.name: None for f in df.schema} | {"source": 999, "t": END} | ({"cls": "person"} if "cls" in df.columns else {})
        spark.createDataFrame([tuple(last[f.name] for f in df.schema)], df.schema).withColumn("event_ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("event_ts", f"{DELAY:g} seconds")


def finished(spark, df, tmp_path):
    name = "q" + os.urandom(4).hex()
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name)


def same(got, want, cols):
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    a = sorted((key(r) for r in got.select(*cols).collect()), key=str)
    b = sorted((key(r) for r in want.select(*cols).collect()), key=str)
    assert a == b and a


def test_cooldown(spark, tmp_path):
    rng = random.Random(1)
    ev = spark.createDataFrame([(i, i % 2, "k", 1000.0 + round(rng.random() * 300, 1)) for i in range(150)], "event_id long, source long, cooldown_key string, t double")
    got = finished(spark, live.cooldown_stream(arriving(spark, ev, str(tmp_path / "in"), 2), 12.0), tmp_path)
    same(got.filter("source < 999"), inc.min_gap(ev, ["source", "cooldown_key"], "t", 12.0, "event_id"), ["event_id", "t"])


def test_crowd(spark, tmp_path):
    rng = random.Random(3)
    cfg = DEFAULTS.patched(crowd_surge=3, crowd_dispersal=3, crowd_density=6)
    counts = spark.createDataFrame([(s, f, 50.0 + f * (0.5 if s else 1.3), max(0, int(4 + 4 * rng.random() * (f % 11 > 5) - 3 * (f % 7 == 0)))) for s in (0, 1) for f in range(90)],
                                   "source long, frame_no long, t double, people long")
    got = finished(spark, live.crowd_stream(arriving(spark, counts, str(tmp_path / "in"), 4), cfg), tmp_path)
    want = rules.crowd_events(counts, cfg)
    assert len({r.type for r in want.collect()}) == 3
    same(got, want, ["source", "frame_no", "t", "type", "severity", "detail"])


def test_corroboration_however_old_the_signals(spark, tmp_path):
    rng = random.Random(5)
    hits = spark.createDataFrame([(i, i % 3, round(rng.random() * 400, 1), 0, rng.choice(["weapon_reported", "violence_reported", "crowd_panic_reported"]), 0.6) for i in range(80)],
                                 "caption_id long, source long, t double, pattern_no int, type string, base double")
    # Source 2 has one signal long before its captions, source 1 falls silent for minutes.
    times = [(0, round(rng.random() * 400, 1)) for _ in range(60)] + [(1, 20.0), (1, 21.0), (1, 380.0), (2, 0.1)]
    sig = spark.createDataFrame([(s, t, rng.sample(["knife", "person", "car"], 2), [], rng.randrange(5)) for s, t in times + [(0, hits.first().t)]],
                                "source long, t double, classes array<string>, actions array<string>, people long").dropDuplicates(["source", "t"])
    got = finished(spark, live.corroborate_stream(arriving(spark, hits, str(tmp_path / "h"), 6), arriving(spark, sig, str(tmp_path / "s"), 7)), tmp_path)
    same(got.filter("source < 999"), cap.corroborate(hits, sig), ["caption_id", "type", "corroborated", "score"])


@pytest.mark.parametrize("dt", [1.0, 5.0])
def test_tracker_and_loitering(spark, tmp_path, dt):
    """At 0.2 frames a second a track misses fifteen frames in 75 seconds and goes on."""
    frames = [[person(300, 300)] * (not 30 <= i < 44) + [person(700 + (i % 2) * 30, 300)] + [vehicle("car", 100 + 6 * i, 400)] * (i % 20 != 5) for i in range(70)]
    dets, every = scene(spark, frames, dt, 1000.0), frame_list(spark, 70, dt, 1000.0)
    rows = tr.with_ticks(dets, every)
    ticks = tr.with_ticks(every, every)
    want, cfg = tr.track(dets, frames=every), DEFAULTS.patched(loiter_s=25.0)
    out = finished(spark, live.track_stream(arriving(spark, rows, str(tmp_path / "r"), 8), cfg, arriving(spark, ticks, str(tmp_path / "t"), 9)), tmp_path).filter("source < 999")
    same(out, want, ["det_id", "track_id"])
    same(out.filter("dwell_alert and cls = 'person'"), tr.loitering(want, cfg), ["source", "t"])


def test_trackers_without_tracks_are_forgotten(spark, tmp_path):
    dets, every = scene(spark, [[person(300, 300)] if i < 5 or i > 60 else [] for i in range(70)], 1.0, 1000.0), frame_list(spark, 70, 1.0, 1000.0)
    out = finished(spark, live.track_stream(arriving(spark, tr.with_ticks(dets, every), str(tmp_path / "r"), 8), DEFAULTS, arriving(spark, tr.with_ticks(every, every), str(tmp_path / "t"), 9), ["person"]), tmp_path)
    assert out.filter("source = 1").select("track_id").distinct().count() == 2


def test_snatch(spark, tmp_path):
    def ride(exit_px, stay=0):
        xs, x = [], 300.0
        for i in range(90):
            xs.append(x)
            x += 0 if 560 <= x < 570 and len(xs) < 27 + stay else 10 if x < 560 else exit_px
        return [[vehicle("motorcycle", v, 330, 90, 90)] + [person(600, 280)] * (i % 9 != 4) for i, v in enumerate(xs) if v < 1900]
    scenes = [scene(spark, ride(*how), 0.1, 100.0, s).withColumn("det_id", F.col("det_id") + 10_000 * s) for s, how in enumerate([(16,), (10,), (16, 40), (22, 3)])]
    dets = scenes[0].unionByName(scenes[1]).unionByName(scenes[2]).unionByName(scenes[3])
    tracks = tr.track(dets)
    want = tr.snatch_trajectory(tracks)
    got = finished(spark, live.snatch_stream(arriving(spark, tr.pair_samples(tracks), str(tmp_path / "p"), 10)), tmp_path)
    same(got, want, ["source", "frame_no", "t", "score", "detail", "cooldown_key"])
