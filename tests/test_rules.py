from framelore.config import DEFAULTS
from framelore.operators import incidents, rules
from tests.scenes import box, person, pose, scene

PB = [100, 100, 180, 300]


def types(df):
    return sorted(r.type for r in df.collect())


def test_knife_near_a_person_without_pose_is_critical(spark):
    e = rules.weapon_events(scene(spark, [[person(), box("knife", 150, 150)]])).collect()
    assert [(r.type, r.severity) for r in e] == [("weapon_brandished", "critical")]
    assert "no pose data" in e[0].detail


def test_knife_far_away_is_lower(spark):
    e = rules.weapon_events(scene(spark, [[person(50, 50), box("knife", 1200, 650)]])).collect()
    assert [(r.type, r.severity) for r in e] == [("weapon_visible", "high")]


def test_weak_weapon_is_ignored(spark):
    d = scene(spark, [[person(), box("knife", 150, 150, conf=0.3)]])
    assert rules.weapon_events(d, cfg=DEFAULTS.patched(weapon_conf=0.6)).collect() == []


def test_held_beats_near(spark):
    p = pose(spark, [(PB, {10: (190, 220, .9)})])
    held = rules.weapon_events(scene(spark, [[person(), box("knife", 185, 215, 20, 20)]]), p).collect()[0]
    near = rules.weapon_events(scene(spark, [[person(), box("knife", 240, 260, 20, 20)]]), p).collect()[0]
    assert (held.type, held.severity, near.type) == ("weapon_brandished", "critical", "weapon_near_person")
    assert held.score > near.score
    assert held.evidence["attachment"] == "held" and held.evidence["hand"] == "right"
    assert [held.subject.x1, held.subject.y1, held.subject.x2, held.subject.y2] == PB


def test_burglary_tool_needs_a_person(spark):
    assert rules.weapon_events(scene(spark, [[box("crowbar", 500, 500)]])).collect() == []
    p = pose(spark, [(PB, {10: (190, 220, .9)})])
    e = rules.weapon_events(scene(spark, [[person(), box("crowbar", 185, 215, 20, 20)]]), p).collect()
    assert [(r.type, r.severity) for r in e] == [("crime_tool_held", "high")]


def test_carried_and_vocabulary_spelling(spark):
    p = pose(spark, [(PB, {10: (190, 400, .1)})])
    e = rules.weapon_events(scene(spark, [[person(), box("Baseball_Bat", 120, 200, 20, 20, .9)]]), p).collect()
    assert [(r.type, r.severity) for r in e] == [("weapon_carried", "high")]


def test_grip_tolerance_scales_with_the_person(spark):
    from framelore.operators.relate import grip_matches
    near = grip_matches(scene(spark, [[box("knife", 340, 300, 10, 10)]]), pose(spark, [([100, 100, 300, 600], {10: (310, 300, .9)})]))
    far = grip_matches(scene(spark, [[box("knife", 165, 140, 10, 10)]]), pose(spark, [([100, 100, 130, 180], {10: (135, 140, .9)})]))
    assert near.count() == 1 and far.count() == 0


def test_elbow_stands_in_for_a_hidden_wrist(spark):
    from framelore.operators.relate import hand_points
    h = hand_points(pose(spark, [(PB, {8: (150, 200, .8)})])).collect()
    assert [r.hand for r in h] == ["right (elbow)"]


def preds(spark, *rows):
    return spark.createDataFrame([(1, 0, 0.0, i, l, c) for i, (l, c) in enumerate(rows)],
                                 "source long, frame_no long, t double, rank int, label string, confidence double")


def test_violence_needs_two_people(spark):
    p = preds(spark, ("punching/slapping", 0.9))
    one = rules.people_counts(scene(spark, [[person()]]))
    two = rules.people_counts(scene(spark, [[person(), person(400)]]))
    assert types(rules.action_events(p, one)) == []
    assert types(rules.action_events(p, two)) == ["violence"]


def test_a_theft_at_rank_three_counts_and_pose_can_see_the_second_person(spark):
    p = preds(spark, ("walking towards each other", 0.6), ("hand waving", 0.2), ("grab other person's stuff", 0.3))
    posed = pose(spark, [(PB, {}), (PB, {})])
    e = rules.action_events(p, rules.people_counts(scene(spark, [[person()]]), posed)).collect()
    assert [r.type for r in e] == ["snatch_theft"]


def test_falling_and_benign(spark):
    assert [(r.type, r.severity) for r in rules.distress_events(preds(spark, ("falling", 0.8))).collect()] == [("person_down", "high")]
    assert rules.distress_events(preds(spark, ("hand waving", 0.95))).collect() == []


def test_zone_uses_feet(spark):
    zone = [{"name": "platform edge", "polygon": [[0, .8], [1, .8], [1, 1], [0, 1]]}]
    assert types(rules.zone_events(scene(spark, [[person(600, 400, 80, 250)]]), zone)) == ["zone_intrusion"]
    assert types(rules.zone_events(scene(spark, [[person(600, 50, 80, 200)]]), zone)) == []


def test_crowd_surge_and_dispersal(spark):
    counts = spark.createDataFrame([(1, i, 1000 + t, n) for i, (t, n) in enumerate(
        [(0.0, 1), (0.5, 1), (1.0, 1), (1.5, 1), (2.5, 9), (3.5, 1)])], "source long, frame_no long, t double, people long")
    cfg = DEFAULTS.patched(crowd_surge=4, crowd_dispersal=4)
    for width in (600.0, 1.0):
        e = rules.crowd_events(counts, cfg, width).collect()
        assert sorted((r.type, r.t) for r in e) == [("crowd_density", 1002.5), ("crowd_dispersal", 1003.5), ("crowd_surge", 1002.5)]


def test_persistence(spark):
    rows = [(i, 1, i, float(i), i, "gun", c, 0.0, 0.0, 1.0, 1.0) for i, c in
            enumerate([.31, .35, .33, .2, .9, .32, .31, .4])]
    d = spark.createDataFrame(rows, "det_id long, source long, frame_no long, t double, tick long, cls string, confidence double, "
                                    "x1 double, y1 double, x2 double, y2 double")
    got = {r.tick: (r.reason, r.confidence) for r in rules.persist_detections(d).collect()}
    assert got == {2: ("sustained", .35), 4: ("confirmed", .9), 6: ("sustained", .9), 7: ("sustained", .4)}


def test_union_has_stable_ids_and_timecodes(spark):
    d = scene(spark, [[person(), box("knife", 150, 150)]], t0=107.32)
    a, b = (rules.all_events(rules.weapon_events(d)).collect()[0] for _ in range(2))
    assert a.timecode == "00:01:47.320" and a.event_id == b.event_id


def test_cooldown(spark):
    ev = spark.createDataFrame([(i, 1, "k", t, .9, "high") for i, t in enumerate([1000.0, 1002.0, 1015.0])],
                               "event_id long, source long, cooldown_key string, t double, score double, severity string")
    kept = incidents.finalise(ev, DEFAULTS.patched(cooldown_s=10.0)).orderBy("t").collect()
    assert [r.t for r in kept] == [1000.0, 1015.0]
