"""Queries over detections: relations, rules and tracks."""
from pyspark.sql import functions as F

from contract.base import Registry, add_view, with_views
from framelore.config import DEFAULTS
from framelore.operators import relate, rules, tracks as tr

R = Registry()

# Poses of the people in view: wrists and elbows; every other joint is unseen.
add_view("pose", ["det"], """
SELECT source, frame_no, t, obj_idx AS person_idx, det_id, x1, y1, x2, y2, confidence, frame_w, frame_h,
       x1 + 80 AS wx, y1 + 120 AS wy, CASE WHEN obj_idx % 2 = 0 THEN 0.9 ELSE 0.1 END AS wc,
       x1 + 70 AS ex, y1 + 90 AS ey, CASE WHEN det_id % 3 = 0 THEN 0.8 ELSE 0.2 END AS ec
FROM det WHERE cls = 'person'""")
add_view("act", ["events"], """
SELECT event_id % 8 AS source, CAST(floor(event_id / 64) AS BIGINT) AS frame_no,
       CAST(CAST(floor(event_id / 64) AS BIGINT) AS DOUBLE) / 2 AS t, CAST(floor((event_id % 64) / 8) AS BIGINT) AS rank,
       CASE event_type WHEN 'click' THEN 'punching/slapping' WHEN 'view' THEN 'touch pocket' WHEN 'error' THEN 'falling'
            WHEN 'purchase' THEN 'walking towards each other' ELSE 'shake fist' END AS label,
       CAST(CAST(round(value * 100) AS BIGINT) % 100 AS DOUBLE) / 100 AS confidence
FROM events""")
ZONES = [{"name": "edge", "polygon": [[0.0, 0.6], [0.35, 0.6], [0.3, 1.0], [0.0, 1.0]], "severity": "high"},
         {"name": "dock", "polygon": [[0.4, 0.5], [0.9, 0.5], [0.65, 0.95]]},
         {"name": "line", "polygon": [[0.0, 0.0], [1.0, 1.0]]}]
TOOL_SQL = """tools AS (SELECT * FROM det WHERE cls = 'knife'), persons AS (SELECT * FROM det WHERE cls = 'person')"""
IOU = """CASE WHEN least({a}.x2, {b}.x2) > greatest({a}.x1, {b}.x1) AND least({a}.y2, {b}.y2) > greatest({a}.y1, {b}.y1)
 THEN (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))
 / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1)
    - (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) ELSE 0 END"""


def poses(T):
    j = lambda x, y, c: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(c).cast("double").alias("c"))
    none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("c"))
    joints = [none] * 8 + [j("ex", "ey", "ec"), none, j("wx", "wy", "wc")] + [none] * 6
    return T.pose.withColumn("keypoints", F.array(*joints))


def tools(T):
    return T.det.filter("cls = 'knife'")


def persons(T):
    return T.det.filter("cls = 'person'")


def points(T):
    """The true object as a ready-made track."""
    return T.det.withColumn("track_id", F.col("obj_idx")).withColumn("tick", F.col("frame_no") + 1)


HANDS_SQL = """hands AS (
  SELECT source, frame_no, person_idx, CASE WHEN wc >= 0.3 THEN wx ELSE ex END AS hx, CASE WHEN wc >= 0.3 THEN wy ELSE ey END AS hy,
         CASE WHEN wc >= 0.3 THEN 'right' ELSE 'right (elbow)' END AS hand, {tol} * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS lim
  FROM pose WHERE (wc >= 0.3 OR ec >= 0.3)),
near AS (SELECT t.source, t.frame_no, t.det_id, h.person_idx, h.hand, h.lim,
         sqrt(power(greatest(t.x1 - hx, 0, hx - t.x2), 2) + power(greatest(t.y1 - hy, 0, hy - t.y2), 2)) AS d
         FROM tools t JOIN hands h ON h.source = t.source AND h.frame_no = t.frame_no),
grips AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY 1 - d / lim DESC, person_idx) AS n FROM near WHERE d <= lim) z WHERE n = 1)"""
R.query("grip_matches", with_views("WITH " + TOOL_SQL + "," + HANDS_SQL.format(tol=0.6) + """
SELECT source, frame_no, det_id, person_idx, hand, round(d, 1) AS d, round(1 - d / lim, 2) AS grip FROM grips""", "det", "pose"))(
    lambda T: relate.grip_matches(tools(T), poses(T), 0.6).select("source", "frame_no", "det_id", "person_idx", "hand",
                                                                  F.col("distance_px").alias("d"), F.round("grip", 2).alias("grip")))
CARRY_SQL = """carry AS (SELECT * FROM (
  SELECT t.source, t.frame_no, t.det_id, p.det_id AS person_id,
         greatest(least(t.x2, p.x2) - greatest(t.x1, p.x1), 0) * greatest(least(t.y2, p.y2) - greatest(t.y1, p.y1), 0)
         / greatest((t.x2 - t.x1) * (t.y2 - t.y1), 1) AS frac,
         row_number() OVER (PARTITION BY t.det_id ORDER BY p.det_id) AS n
  FROM {loose} t JOIN persons p ON p.source = t.source AND p.frame_no = t.frame_no
  WHERE greatest(least(t.x2, p.x2) - greatest(t.x1, p.x1), 0) * greatest(least(t.y2, p.y2) - greatest(t.y1, p.y1), 0)
         / greatest((t.x2 - t.x1) * (t.y2 - t.y1), 1) >= 0.55) z WHERE n = 1)"""
R.query("carried", with_views("WITH " + TOOL_SQL + "," + CARRY_SQL.format(loose="(SELECT * FROM det WHERE cls IN ('knife', 'backpack'))") + """
SELECT source, frame_no, det_id, person_id, round(frac, 3) AS containment FROM carry""", "det"))(
    lambda T: relate.carried(T.det.filter("cls IN ('knife', 'backpack')"), persons(T)).drop("person_box"))
NEAR_SQL = """prox AS (SELECT t.det_id, min(sqrt(power((t.x1 + t.x2) / 2 - (p.x1 + p.x2) / 2, 2) + power((t.y1 + t.y2) / 2 - (p.y1 + p.y2) / 2, 2))
              / sqrt(1280.0 * 1280 + 720.0 * 720)) AS pd FROM tools t JOIN persons p ON p.source = t.source AND p.frame_no = t.frame_no GROUP BY t.det_id)"""
R.query("nearest_person", with_views("WITH " + TOOL_SQL + "," + NEAR_SQL + """
SELECT t.source, t.frame_no, t.det_id, round(pd, 6) AS person_distance FROM tools t JOIN prox USING (det_id) WHERE pd <= 0.25""", "det"))(
    lambda T: relate.nearest_person(tools(T), persons(T)).withColumn("person_distance", F.round("person_distance", 6)))
CONTACT_SQL = f"""contact AS (
  SELECT a.source, a.frame_no, a.t, a.obj_idx AS a_track_id, b.obj_idx AS b_track_id, 'vehicle' AS contact, {IOU.format(a='a', b='b')} AS iou,
         a.cls AS a_cls, b.cls AS b_cls
  FROM det a JOIN det b ON a.source = b.source AND a.frame_no = b.frame_no AND a.obj_idx < b.obj_idx
  WHERE a.cls IN ('car', 'motorcycle') AND b.cls IN ('car', 'motorcycle')
  UNION ALL
  SELECT a.source, a.frame_no, a.t, a.obj_idx, b.obj_idx, 'pedestrian', {IOU.format(a='a', b='b')}, a.cls, b.cls
  FROM det a JOIN det b ON a.source = b.source AND a.frame_no = b.frame_no WHERE a.cls IN ('car', 'motorcycle') AND b.cls = 'person')"""
R.query("box_contacts", with_views("WITH " + CONTACT_SQL + """
SELECT source, frame_no, a_track_id, b_track_id, contact, round(iou, 6) AS iou FROM contact WHERE iou >= 0.08""", "det"))(
    lambda T: relate.box_contacts(points(T)).select("source", "frame_no", "a_track_id", "b_track_id", "contact", F.round("iou", 6).alias("iou")))


def polygon_sql(poly) -> str:
    parts = []
    for i, (xi, yi) in enumerate(poly):
        xj, yj = poly[i - 1]
        a = {"xi": f"({xi} * 1280)", "yi": f"({yi} * 720)", "xj": f"({xj} * 1280)", "yj": f"({yj} * 720)"}
        parts.append("CASE WHEN ({yi} > y2) <> ({yj} > y2) AND (x1 + x2) / 2 < ({xj} - {xi}) * (y2 - {yi}) / "
                     "(CASE WHEN {yj} - {yi} = 0 THEN 1e-9 ELSE {yj} - {yi} END) + {xi} THEN 1 ELSE 0 END".format(**a))
    return "(" + " + ".join(parts) + ") % 2 = 1"


ZONE_SQL = " UNION ALL ".join(f"SELECT source, frame_no, t, '{z['name']}' AS zone, '{z.get('severity') or 'medium'}' AS severity, det_id "
                              f"FROM det WHERE cls = 'person' AND {polygon_sql(z['polygon'])}" for z in ZONES[:2])
R.query("in_zones", with_views(f"SELECT source, frame_no, zone, min(det_id) AS det_id FROM ({ZONE_SQL}) z GROUP BY ALL", "det"))(
    lambda T: relate.in_zones(persons(T), ZONES).select("source", "frame_no", "zone", "det_id"))
R.query("zone_events", with_views(f"""SELECT source, frame_no, 'zone_intrusion' AS type, severity, 'Intrusion: ' || zone AS label, 0.65::DOUBLE AS score
FROM ({ZONE_SQL}) z GROUP BY ALL""", "det"))(
    lambda T: rules.zone_events(T.det, ZONES).select("source", "frame_no", "type", "severity", "label", "score"))

# ── weapon rule: pose is known for even sources only, so every branch is used ──
WEAPON_SQL = "WITH " + TOOL_SQL + "," + HANDS_SQL.format(tol=0.18) + "," + \
    CARRY_SQL.format(loose="(SELECT * FROM tools WHERE det_id NOT IN (SELECT det_id FROM grips))") + "," + NEAR_SQL + """,
posed AS (SELECT DISTINCT source, frame_no, TRUE AS hp FROM pose),
w AS (SELECT t.source, t.frame_no, t.det_id, 0.85 * t.confidence AS base, g.d, round(1 - g.d / g.lim, 3) AS grip, c.frac,
             CASE WHEN pd <= 0.25 THEN pd END AS pd, coalesce(hp, FALSE) AS hp
      FROM tools t LEFT JOIN grips g ON g.det_id = t.det_id LEFT JOIN carry c ON c.det_id = t.det_id LEFT JOIN prox p ON p.det_id = t.det_id
      LEFT JOIN posed o ON o.source = t.source AND o.frame_no = t.frame_no WHERE t.confidence >= 0.45)
SELECT source, frame_no,
       CASE WHEN grip IS NOT NULL THEN 'weapon_brandished' WHEN frac IS NOT NULL AND hp THEN 'weapon_carried'
            WHEN pd IS NOT NULL AND NOT hp THEN 'weapon_brandished' WHEN pd IS NOT NULL THEN 'weapon_near_person' ELSE 'weapon_visible' END AS type,
       CASE WHEN grip IS NOT NULL THEN 'critical' WHEN frac IS NOT NULL AND hp THEN 'high'
            WHEN pd IS NOT NULL AND NOT hp THEN 'critical' ELSE 'high' END AS severity,
       round(least(1.0, CASE WHEN grip IS NOT NULL THEN base + 0.10 + 0.20 * grip WHEN frac IS NOT NULL AND hp THEN base * 0.75 + 0.05
            WHEN pd IS NOT NULL AND NOT hp THEN base + 0.15 WHEN pd IS NOT NULL THEN base * 0.85 ELSE base * 0.8 END) + 1e-9, 3) AS score
FROM w"""
R.query("weapon_events", with_views(WEAPON_SQL, "det", "pose"))(
    lambda T: rules.weapon_events(T.det, poses(T)).select("source", "frame_no", "type", "severity", "score"))

ACTION_SQL = """WITH m(label, type, base, two, sev, bar) AS (VALUES ('punching/slapping', 'violence', 0.90::DOUBLE, TRUE, 'critical', 0.40::DOUBLE),
  ('touch pocket', 'pickpocket', 0.80, TRUE, 'high', 0.25), ('shake fist', 'altercation', 0.30, FALSE, 'low', 0.40)),
b AS (SELECT a.*, m.type, base, two, sev, row_number() OVER (PARTITION BY a.source, a.frame_no ORDER BY base * a.confidence DESC, rank) AS n
      FROM act a JOIN m ON m.label = a.label WHERE a.confidence >= bar),
p AS (SELECT d.source, d.frame_no, count(*) FILTER (cls = 'person') AS people FROM det d GROUP BY ALL)
SELECT b.source, b.frame_no, type, label AS action, people,
       CASE WHEN sev = 'critical' AND least(1.0, base * (0.5 + confidence / 2)) < 0.7 THEN 'high' ELSE sev END AS severity
FROM b JOIN p ON p.source = b.source AND p.frame_no = b.frame_no WHERE n = 1 AND (NOT two OR people >= 2)"""
R.query("action_events", with_views(ACTION_SQL, "act", "det"))(
    lambda T: rules.action_events(T.act, rules.people_counts(T.det)).select(
        "source", "frame_no", "type", F.col("evidence")["action"].alias("action"), F.col("evidence")["person_count"].cast("long").alias("people"), "severity"))
R.query("distress_events", with_views("""
SELECT source, frame_no, 'person_down' AS type, 'high' AS severity, round(0.70 * (0.5 + max(confidence) / 2), 4) AS score FROM act
WHERE label = 'falling' AND confidence >= 0.40 GROUP BY source, frame_no""", "act"))(
    lambda T: rules.distress_events(T.act).select("source", "frame_no", "type", "severity",
                                                  F.round(0.70 * (0.5 + F.col("evidence")["confidence"].cast("double") / 2), 4).alias("score")))

CROWD = DEFAULTS.patched(crowd_surge=2, crowd_dispersal=2, crowd_density=4)
COUNT_SQL = "c AS (SELECT source, frame_no, t, count(*) FILTER (cls = 'person') AS people FROM det GROUP BY ALL)"
R.query("crowd_events", with_views("WITH " + COUNT_SQL + """,
w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t) AS hist, first_value(people) OVER z AS f, max(people) OVER z AS pk, count(*) OVER z AS n
      FROM c WINDOW z AS (PARTITION BY source ORDER BY t RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)),
ok AS (SELECT * FROM w WHERE hist >= 5 AND n >= 3)
SELECT source, frame_no, 'crowd_surge' AS type, 'medium' AS severity, 'Person count rose ' || f || ' → ' || people || ' in 4s' AS detail FROM ok WHERE people - f >= 2
UNION ALL SELECT source, frame_no, 'crowd_dispersal', 'high', 'Person count fell ' || pk || ' → ' || people || ' in 4s' FROM ok WHERE pk - people >= 2 AND pk >= 2
UNION ALL SELECT source, frame_no, 'crowd_density', 'low', people || ' people in frame' FROM ok WHERE people >= 4""", "det"))(
    lambda T: rules.crowd_events(rules.people_counts(T.det), CROWD).select("source", "frame_no", "type", "severity", "detail"))
R.query("after_hours_events", """
WITH b AS (SELECT event_id % 8 AS source, CAST(floor(event_id / 64) AS BIGINT) AS frame_no, min(ts) AS event_ts,
                  count(*) FILTER (user_id % 10 <> 9 AND CAST(floor((event_id % 64) / 8) AS BIGINT) < 4) AS people FROM events GROUP BY ALL)
SELECT source, frame_no, 'after_hours_presence' AS type, people || ' person(s) detected at ' || printf('%02d', hour(event_ts)) || ':00' AS detail
FROM b WHERE people > 0 AND (hour(event_ts) >= 22 OR hour(event_ts) < 6)""")(
    lambda T: rules.after_hours_events(rules.people_counts(T.det).join(
        T.events.groupBy((F.col("event_id") % 8).alias("source"), F.floor(F.col("event_id") / 64).alias("frame_no"))
        .agg(F.min("ts").alias("event_ts")), ["source", "frame_no"])).select("source", "frame_no", "type", "detail"))
R.query("persist_detections", with_views("""
WITH b AS (SELECT source, cls, frame_no, det_id, confidence AS c, row_number() OVER (PARTITION BY source, cls, frame_no ORDER BY confidence DESC, det_id) AS n FROM det),
w AS (SELECT *, count(*) FILTER (c >= 0.30) OVER z AS k, max(c) OVER z AS peak FROM b WHERE n = 1
      WINDOW z AS (PARTITION BY source, cls ORDER BY frame_no RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT source, cls, frame_no + 1 AS tick, CASE WHEN c >= 0.80 THEN 'confirmed' ELSE 'sustained' END AS reason,
       CASE WHEN c >= 0.80 THEN c ELSE peak END AS confidence FROM w WHERE c >= 0.80 OR k = 3""", "det"))(
    lambda T: rules.persist_detections(points(T), 0.30, 3, 0.80).select("source", "cls", "tick", "reason", "confidence"))

# ── tracks ───────────────────────────────────────────────────────────────────
SPEED_SQL = """pts AS (SELECT source, obj_idx AS track_id, cls, t, frame_no, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x1, y1, x2, y2 FROM det),
sp AS (SELECT p.*, row_number() OVER o AS k, first_value(t) OVER h AS ft, first_value(cx) OVER h AS fx, first_value(cy) OVER h AS fy,
       last_value(t) OVER a AS ot, last_value(cx) OVER a AS ox, last_value(cy) OVER a AS oy FROM pts p
       WINDOW o AS (PARTITION BY source, track_id ORDER BY t), h AS (PARTITION BY source, track_id ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
              a AS (PARTITION BY source, track_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 0.5 PRECEDING)),
speed AS (SELECT *, CASE WHEN k < 2 THEN 0.0 WHEN ot >= ft THEN sqrt(power(cx - ox, 2) + power(cy - oy, 2)) / (t - ot)
                 WHEN t - ft > 1e-6 THEN sqrt(power(cx - fx, 2) + power(cy - fy, 2)) / (t - ft) ELSE 0.0 END AS speed FROM sp)"""
R.query("track_speed", with_views("WITH " + SPEED_SQL + " SELECT source, track_id, t, round(speed, 4) AS speed FROM speed", "det"))(
    lambda T: tr.track_speed(points(T)).select("source", "track_id", "t", F.round("speed", 4).alias("speed")))
R.query("track_heading", with_views("WITH " + SPEED_SQL + """,
h AS (SELECT source, track_id, t, k, CASE WHEN ot >= ft THEN cx - ox ELSE cx - fx END AS dx, CASE WHEN ot >= ft THEN cy - oy ELSE cy - fy END AS dy FROM sp)
SELECT source, track_id, t, round(CASE WHEN k >= 2 AND sqrt(dx * dx + dy * dy) > 1e-6 THEN dx / sqrt(dx * dx + dy * dy) END, 4) AS heading_x FROM h""", "det"))(
    lambda T: tr.track_speed(points(T)).select("source", "track_id", "t", F.round("heading_x", 4).alias("heading_x")))
R.query("peak_speed", with_views("WITH " + SPEED_SQL + """,
r AS (SELECT DISTINCT source, track_id, t - 2.0 AS since, t AS until FROM pts WHERE cls IN ('car', 'motorcycle'))
SELECT r.source, r.track_id, r.until, round(coalesce(max(speed), 0), 4) AS peak FROM r LEFT JOIN speed s
ON s.source = r.source AND s.track_id = r.track_id AND s.t BETWEEN r.since AND r.until GROUP BY ALL""", "det"))(
    lambda T: tr.peak_speed(tr.track_speed(points(T)), points(T).filter("cls IN ('car', 'motorcycle')")
                            .select("source", "track_id", (F.col("t") - 2.0).alias("since"), F.col("t").alias("until")).distinct())
    .select("source", "track_id", "until", F.round("peak_speed", 4).alias("peak")))
DWELL_SQL = SPEED_SQL + """,
o AS (SELECT source, track_id, t, cx, cy, row_number() OVER (PARTITION BY source, track_id ORDER BY t) AS k FROM pts),
dw AS (SELECT source, track_id, t, k, cx AS ax, cy AS ay, t AS since FROM o WHERE k = 1
  UNION ALL
  SELECT n.source, n.track_id, n.t, n.k,
    CASE WHEN sqrt(power(n.cx - d.ax, 2) + power(n.cy - d.ay, 2)) / sqrt(1280.0 * 1280 + 720.0 * 720) > 0.06 THEN n.cx ELSE d.ax END,
    CASE WHEN sqrt(power(n.cx - d.ax, 2) + power(n.cy - d.ay, 2)) / sqrt(1280.0 * 1280 + 720.0 * 720) > 0.06 THEN n.cy ELSE d.ay END,
    CASE WHEN sqrt(power(n.cx - d.ax, 2) + power(n.cy - d.ay, 2)) / sqrt(1280.0 * 1280 + 720.0 * 720) > 0.06 THEN n.t ELSE d.since END
  FROM dw d JOIN o n ON n.source = d.source AND n.track_id = d.track_id AND n.k = d.k + 1)"""
R.query("track_dwell", with_views("WITH " + DWELL_SQL + " SELECT source, track_id, t, since AS anchor_t, t - since AS dwell FROM dw", "det", recursive=True))(
    lambda T: tr.track_dwell(points(T)).select("source", "track_id", "t", "anchor_t", "dwell"))
R.query("loitering", with_views("WITH " + DWELL_SQL.replace("FROM det)", "FROM det WHERE cls = 'person')") + """
SELECT source, track_id, min(t) AS t, 'loitering' AS type FROM dw d WHERE t - since >= 20 AND NOT EXISTS (SELECT 1 FROM o WHERE o.source = d.source AND o.track_id = d.track_id
  AND o.k BETWEEN d.k - 59 AND d.k AND sqrt(power(o.cx - d.ax, 2) + power(o.cy - d.ay, 2)) / sqrt(1280.0 * 1280 + 720.0 * 720) > 0.06) GROUP BY source, track_id, since""", "det", recursive=True))(
    lambda T: tr.loitering(points(T), DEFAULTS.patched(loiter_s=20.0)).select(
        "source", F.col("evidence")["track_id"].cast("long").alias("track_id"), "t", "type"))
R.query("unattended", with_views("WITH " + DWELL_SQL.replace("FROM det)", "FROM det WHERE cls = 'backpack')") + """,
far AS (SELECT d.source, d.track_id, d.t, d.since FROM dw d WHERE d.t - d.since >= 10 AND NOT EXISTS (
  SELECT 1 FROM det p, det b WHERE p.cls = 'person' AND p.source = d.source AND p.t = d.t AND b.source = d.source AND b.t = d.t AND b.obj_idx = d.track_id
  AND sqrt(power((p.x1 + p.x2) / 2 - (b.x1 + b.x2) / 2, 2) + power((p.y1 + p.y2) / 2 - (b.y1 + b.y2) / 2, 2)) / sqrt(1280.0 * 1280 + 720.0 * 720) <= 0.18))
SELECT source, track_id, min(t) AS t, 'unattended_object' AS type FROM far GROUP BY source, track_id, since""", "det", recursive=True))(
    lambda T: tr.unattended(points(T), DEFAULTS.patched(unattended_s=10.0, unattended_distance=0.18)).select(
        "source", F.col("evidence")["track_id"].cast("long").alias("track_id"), "t", "type"))
R.query("unowned", with_views("""
SELECT b.source, b.frame_no, b.det_id FROM det b WHERE b.cls = 'backpack' AND NOT EXISTS (SELECT 1 FROM det p WHERE p.cls = 'person' AND p.source = b.source
AND p.frame_no = b.frame_no AND sqrt(power((p.x1 + p.x2) / 2 - (b.x1 + b.x2) / 2, 2) + power((p.y1 + p.y2) / 2 - (b.y1 + b.y2) / 2, 2))
    / sqrt(1280.0 * 1280 + 720.0 * 720) <= 0.22)""", "det"))(
    lambda T: tr.unowned(T.det.filter("cls = 'backpack'"), persons(T)).select("source", "frame_no", "det_id"))
COLLISION_SQL = "WITH " + SPEED_SQL + "," + CONTACT_SQL + """,
hit AS (SELECT * FROM contact WHERE iou >= 0.08),
n1 AS (SELECT *, CASE WHEN t - lag(t) OVER q <= 5 THEN 0 ELSE 1 END AS brk FROM hit WINDOW q AS (PARTITION BY source, a_track_id, b_track_id ORDER BY t)),
n2 AS (SELECT *, sum(brk) OVER (PARTITION BY source, a_track_id, b_track_id ORDER BY t) AS no FROM n1),
c0 AS (SELECT source, a_track_id AS a, b_track_id AS b, no, min(contact) AS contact, min(t) AS s FROM n2 GROUP BY ALL),
fr AS (SELECT DISTINCT source, t FROM det),
c1 AS (SELECT c0.*, (SELECT min(t) FROM fr WHERE fr.source = c0.source AND fr.t >= c0.s + 1.0) AS j FROM c0),
c2 AS (SELECT c1.*, (SELECT count(*) FROM n2 WHERE n2.source = c1.source AND n2.a_track_id = c1.a AND n2.b_track_id = c1.b AND n2.no = c1.no AND n2.t <= c1.j) AS f,
  coalesce((SELECT max(speed) FROM speed x WHERE x.source = c1.source AND x.track_id = c1.a AND x.t BETWEEN c1.s - 2 AND c1.s), 0) AS pa,
  coalesce((SELECT max(speed) FROM speed x WHERE x.source = c1.source AND x.track_id = c1.b AND x.t BETWEEN c1.s - 2 AND c1.s), 0) AS pb,
  (SELECT arg_max(speed, x.t) FROM speed x WHERE x.source = c1.source AND x.track_id = c1.a AND x.t <= c1.j) AS qa,
  (SELECT arg_max(speed, x.t) FROM speed x WHERE x.source = c1.source AND x.track_id = c1.b AND x.t <= c1.j) AS qb,
  sqrt(1280.0 * 1280 + 720.0 * 720) AS dg FROM c1 WHERE j IS NOT NULL),
c3 AS (SELECT *, contact = 'pedestrian' OR pa >= pb AS astr FROM c2 WHERE f >= 2),
c4 AS (SELECT *, CASE WHEN astr THEN a ELSE b END AS striker_id, CASE WHEN astr THEN pa ELSE pb END AS ps, CASE WHEN astr THEN pb ELSE pa END AS po,
              CASE WHEN astr THEN qa ELSE qb END AS qs, CASE WHEN astr THEN qb ELSE qa END AS qo, CASE WHEN contact = 'vehicle' THEN 0.05 ELSE 0.03 END AS fl FROM c3)
SELECT source, j AS t, CASE WHEN contact = 'vehicle' THEN 'vehicle_collision' ELSE 'vehicle_pedestrian_collision' END AS type, striker_id, f AS contact_frames,
       round(ps / dg, 4) AS approach_speed
FROM c4 WHERE ps / dg >= fl AND (qs <= 0.45 * ps OR (po / dg >= fl AND qo <= 0.45 * po) OR (po / dg < 0.005 AND qo / dg > 0.02))"""
R.query("collisions", with_views(COLLISION_SQL, "det"))(
    lambda T: tr.collisions(points(T), DEFAULTS.patched(track_max_misses=10**6)).select(
        "source", "t", "type", "striker_id", "contact_frames", "approach_speed"))
R.query("snatch_trajectory")(lambda T: tr.snatch_trajectory(points(T), DEFAULTS.patched(snatch_contact=0.15)).drop("evidence"))
R.query("track")(lambda T: tr.track(T.det).select("det_id", "source", "cls", "frame_no", "track_id"))


def left_scene(T):
    from framelore.session import materialise
    t = tr.track(T.det)
    speeds = materialise(tr.track_speed(t), "speeds")
    found = materialise(tr.collisions(t, speeds=speeds), "collisions")
    return tr.left_scene(tr.lost_tracks(t, t.select("source", "tick", "t")), found, speeds).drop("evidence")


R.query("left_scene")(left_scene)
R.query("event_subjects", with_views("""
WITH e AS (SELECT det_id AS event_id, source, frame_no, CASE WHEN obj_idx = 7 THEN 'pursuit_reported' ELSE 'collision_reported' END AS type, x1, y1, x2, y2, cls
           FROM det WHERE obj_idx IN (4, 7)),
p AS (SELECT e.event_id, d.source, d.frame_no, d.cls, d.det_id, row_number() OVER (PARTITION BY e.event_id ORDER BY (d.x2 - d.x1) * (d.y2 - d.y1) DESC, d.det_id) AS n
      FROM e JOIN det d ON d.source = e.source AND d.frame_no = e.frame_no AND d.cls = 'person' WHERE type = 'pursuit_reported'),
v AS (SELECT e.event_id, d.source, d.frame_no, d.cls, d.det_id, row_number() OVER (PARTITION BY e.event_id ORDER BY (d.x2 - d.x1) * (d.y2 - d.y1) DESC, d.det_id) AS n
      FROM e JOIN det d ON d.source = e.source AND d.frame_no = e.frame_no AND d.cls IN ('car', 'motorcycle'))
SELECT event_id, source, frame_no, cls, 'involved' AS role, 0 AS place FROM e WHERE type = 'collision_reported'
UNION ALL SELECT event_id, source, frame_no, cls, 'present', n FROM p WHERE n <= 4 UNION ALL SELECT event_id, source, frame_no, cls, 'present', n FROM v WHERE n <= 4""", "det"))(
    lambda T: relate.event_subjects(
        T.det.filter("obj_idx IN (4, 7)").select(F.col("det_id").alias("event_id"), "source", "frame_no",
            F.when(F.col("obj_idx") == 7, "pursuit_reported").otherwise("collision_reported").alias("type"),
            F.when(F.col("obj_idx") == 4, F.struct("cls", "x1", "y1", "x2", "y2")).alias("subject")),
        T.det).select("event_id", "source", "frame_no", "cls", "role", "place"))


def union_of_rules(T):
    t = points(T)
    people = rules.people_counts(T.det)
    return rules.all_events(rules.weapon_events(T.det), rules.distress_events(T.act), rules.zone_events(T.det, ZONES),
                            rules.action_events(T.act, people)).select("source", "frame_no", "type", "severity", "rule", "timecode")


from contract.incidents import tc  # noqa: E402
R.query("all_events", with_views("""WITH tools AS (SELECT * FROM det WHERE cls = 'knife' AND confidence >= 0.45), persons AS (SELECT * FROM det WHERE cls = 'person'),
""" + NEAR_SQL + f""",
a AS ({ACTION_SQL})
SELECT t.source, t.frame_no, CASE WHEN pd <= 0.25 THEN 'weapon_brandished' ELSE 'weapon_visible' END AS type, CASE WHEN pd <= 0.25 THEN 'critical' ELSE 'high' END AS severity,
       'crime_tool_detection' AS rule, {tc('t.t')} AS timecode FROM tools t LEFT JOIN prox p USING (det_id)
UNION ALL SELECT source, frame_no, 'person_down', 'high', 'action_recognition', {tc('t')} FROM act WHERE label = 'falling' AND confidence >= 0.40 GROUP BY source, frame_no, t
UNION ALL SELECT source, frame_no, 'zone_intrusion', severity, 'zone_intrusion', {tc('t')} FROM ({ZONE_SQL}) z GROUP BY source, frame_no, severity, zone, t
UNION ALL SELECT source, frame_no, type, severity, 'action_recognition', {tc('frame_no / 2.0')} FROM a""", "det", "act"))(union_of_rules)
