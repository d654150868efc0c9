"""Frames where nothing was found count as much as the others."""
import os
import subprocess
import sys

from pyspark.sql import functions as F

from framelore.config import DEFAULTS
from framelore.operators import captions as cap, metrics, routing, rules
from framelore.plans import review
from tests.scenes import frame_list, person, scene

CFG = DEFAULTS.patched(crowd_surge=4, crowd_dispersal=4, crowd_density=99)


def test_an_emptied_scene_is_a_dispersal(spark):
    dets = scene(spark, [[person(100 * k) for k in range(9)]] * 8)
    frames = frame_list(spark, 11)
    counts = rules.people_counts(dets, None, frames)
    assert [r.people for r in counts.orderBy("frame_no").collect()] == [9] * 8 + [0] * 3
    got = {r.t for r in rules.crowd_events(counts, CFG).filter("type = 'crowd_dispersal'").collect()}
    assert got == {r.t for r in frames.filter("frame_no >= 8").collect()}
    assert rules.crowd_events(rules.people_counts(dets), CFG).filter("type = 'crowd_dispersal'").isEmpty()


def test_people_only_the_pose_model_saw(spark):
    dets = scene(spark, [[person()], []])
    posed = spark.createDataFrame([(1, 1, 0), (1, 1, 1)], "source long, frame_no long, person_idx long")
    counts = rules.people_counts(dets, posed, frame_list(spark, 2)).orderBy("frame_no").collect()
    assert [(r.detector_people, r.people) for r in counts] == [(1, 1), (0, 2)]


def test_an_empty_frame_clears_the_signals(spark):
    dets = scene(spark, [[person()], [], []])
    hits = spark.createDataFrame([(1, 1, 0.25, "person_seen_reported", 0.5)], "caption_id long, source long, t double, type string, base double")
    stale = cap.corroborate(hits, cap.signals(dets)).first()
    fresh = cap.corroborate(hits, cap.signals(dets, None, frame_list(spark, 3))).first()
    assert stale.corroborated and not fresh.corroborated


def test_wildcard_recipients_meet_every_alert_once(spark):
    alerts = spark.range(500).select(F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, "North").otherwise(None).alias("area"), F.lit("high").alias("severity"))
    who = spark.createDataFrame([("a", ["*"], "low"), ("b", [" north "], "high"), ("c", None, "critical"), ("d", [], "medium"), ("e", ["north", "NORTH"], "low")],
                                "recipient string, areas array<string>, min_severity string")
    got = routing.route_alerts(alerts, who).groupBy("recipient").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("d")).collect()
    assert {r.recipient: (r.n, r.d) for r in got} == {"a": (500, 500), "b": (250, 250), "d": (500, 500), "e": (250, 250)}


def test_neighbour_distance_over_blocks(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    bank, x = rng.standard_normal((90, 5)), rng.standard_normal((12, 5))
    b = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(bank)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(k % 3, k, v.tolist()) for k, v in enumerate(x)], "span_id long, row_id long, embedding array<double>")
    barred = {(0, k) for k in range(60)} | {(1, 5)}
    out = spark.createDataFrame(sorted(barred), "span_id long, vec_id long")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = unit(x) @ unit(bank).T
    for excluded in (None, out):
        got = {r.row_id: r.distance for r in metrics.knn_distance(q, b, 4, excluded, block=20).collect()}
        for k in range(12):
            s = [sim[k, v] for v in range(90) if excluded is None or (k % 3, v) not in barred]
            assert abs(got[k] - (1 - np.mean(sorted(s)[-4:]))) < 1e-6


def test_after_hours_and_report_sections(spark):
    dets = scene(spark, [[person()]] * 6, dt=1.0)
    starts = spark.createDataFrame([(1, "2024-01-01 23:30:00")], "source long, s string").select("source", F.to_timestamp("s").alias("started"))
    events = review.detect_events(dets, cfg=CFG, frames=frame_list(spark, 6, dt=1.0), starts=starts)
    assert "after_hours_presence" in {r.type for r in events.collect()}
    people = spark.createDataFrame([("p1", 1, "person", "red top"), ("v1", 1, "vehicle", "white van")], "entity_id string, source long, kind string, label string")
    seen = spark.createDataFrame([("p1", 1, "00:01"), ("v1", 1, "00:02")], "entity_id string, seq long, timecode string")
    links = spark.createDataFrame([("p1", 1, "violence", "high", 1.0, "involved"), ("p1", 2, "violence", "high", 9.0, "present"), ("v1", 3, "vehicle_collision", "high", 2.0, "involved")],
                                  "entity_id string, event_id long, type string, severity string, t double, role string")
    report = review.build_report(events, None, None, 20.0, top=5, appearances=20, entities=people, sightings=seen, links=links)
    assert {"persons", "vehicles", "repeat_subjects"} <= {r.section for r in report.select("section").distinct().collect()}


def test_workers_get_the_package(tmp_path):
    """A session started outside the repository folder, with nothing on the Python path."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "from framelore.session import build_session\n"
            "s = build_session(master='local[2]', **{'spark.ui.enabled': 'false'})\n"
            "def f(batches):\n    import framelore.dims\n    yield from batches\n"
            "print('rows', s.range(3).mapInArrow(f, 'id long').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 3" in done.stdout, done.stderr[-2000:]
