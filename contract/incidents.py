"""Queries over scored events, with their oracles."""
from pyspark.sql import functions as F

from contract.base import Registry, add_view, with_views
from framelore import dims
from framelore.config import DEFAULTS
from framelore.operators import incidents as inc

R = Registry()

RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def tc(t: str) -> str:
    return (f"printf('%02d:%02d:%06.3f', CAST(floor(({t}) / 3600) AS BIGINT), "
            f"CAST(floor((({t}) - floor(({t}) / 3600) * 3600) / 60) AS BIGINT), ({t}) - floor(({t}) / 60) * 60)")


def kept(src: str, keys: str, gap: float, where: str = "TRUE") -> str:
    """Recursive walk: the first row of each key, then always the first row at least ``gap`` later."""
    on = " AND ".join(f"n.{k} = k.{k}" for k in keys.split(", "))
    return f"""
WITH c AS (SELECT * FROM {src} WHERE {where}),
i AS (SELECT {keys}, t, min(event_id) AS event_id FROM c GROUP BY {keys}, t),
k AS (SELECT {keys}, min(t) AS t FROM i GROUP BY {keys}
      UNION ALL
      SELECT {", ".join("k." + x for x in keys.split(", "))}, (SELECT min(n.t) FROM i n WHERE {on} AND n.t - k.t >= {gap}) FROM k
      WHERE k.t IS NOT NULL),
kept AS (SELECT c.* FROM c JOIN i USING (event_id) WHERE ({', '.join('c.' + x for x in keys.split(', '))}, c.t) IN (SELECT {keys}, t FROM k WHERE t IS NOT NULL))
"""


def clusters(src: str, gap: float, extra: str = "") -> str:
    """Text after which ``incidents`` is one row per incident of ``src``."""
    return f"""
s1 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY source, type ORDER BY t, event_id) <= {gap} THEN 0 ELSE 1 END AS brk FROM {src}),
s2 AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY source, type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incident_no,
              {RANK} AS rk FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY source, type, incident_no ORDER BY t, event_id) AS n_first,
              row_number() OVER (PARTITION BY source, type, incident_no ORDER BY rk DESC, t, event_id) AS n_sev FROM s2),
incidents AS (SELECT source, type, incident_no, count(*) AS count, min(t) AS first_t, max(t) AS last_t, max(score) AS peak_score,
              max(rk) AS severity_rank, max(CASE WHEN n_first = 1 THEN label END) AS label,
              max(CASE WHEN n_sev = 1 THEN severity END) AS severity, max(CASE WHEN n_sev = 1 THEN detail END) AS detail,
              max(CASE WHEN n_first = 1 THEN event_id END) AS first_event_id{extra}
              FROM s3 GROUP BY source, type, incident_no)
"""


# ── flagship: alerts → floors and cooldown → incidents → ordered actions ─────
def review_actions(alerts, cfg=DEFAULTS, gap=20.0):
    events = alerts.withColumn("cooldown_key", F.col("type"))
    return inc.recommended_actions(inc.cluster_events(inc.finalise(events, cfg), gap))


R.query("review_actions", with_views(kept("alerts", "source, type", 12.0, f"score >= 0.40 AND {RANK} >= 1") + ","
        + clusters("kept", 20.0) + f"""
SELECT source, type, severity AS priority, {tc('first_t')} AS timecode, first_t AS video_time_s,
       'Review ' || {tc('first_t')} || ' — automated signal raised; verify against the footage.'
       || CASE WHEN count > 1 THEN ' (' || count || ' occurrences to ' || {tc('last_t')} || ')' ELSE '' END AS action,
       'detector' AS evidence_tier
FROM incidents""", "alerts", recursive=True))(lambda T: review_actions(T.alerts))

COOL = DEFAULTS.patched(cooldown_s=60.0)
R.query("cooldown", with_views(kept("ev", "source, type", 60.0) + "SELECT event_id, source, type, t FROM kept", "ev", recursive=True))(
    lambda T: inc.min_gap(T.ev, ["source", "type"], "t", 60.0, "event_id").select("event_id", "source", "type", "t"))
R.query("finalise", with_views(kept("ev", "source, type", 60.0, f"score >= 0.40 AND {RANK} >= 1")
        + "SELECT event_id, source, type, t, score, severity FROM kept", "ev", recursive=True))(
    lambda T: inc.finalise(T.ev.withColumn("cooldown_key", F.col("type")), COOL)
    .select("event_id", "source", "type", "t", "score", "severity"))

R.query("cluster_events", with_views("WITH " + clusters("ev", 45.0, """,
              max(CASE WHEN n_first = 1 THEN rule END) AS rule, bool_or(repeat_subject) AS any_repeat""") + f"""
SELECT i.source, i.type, i.incident_no, count, first_t, last_t, peak_score, i.label,
       i.severity, i.detail, first_event_id, i.rule, any_repeat, {tc('first_t')} AS first_timecode, {tc('last_t')} AS last_timecode,
       coalesce(s.snapshots, '') AS snapshots
FROM incidents i LEFT JOIN (
  SELECT source, type, incident_no, string_agg(snapshot, ',' ORDER BY n) AS snapshots
  FROM (SELECT *, row_number() OVER (PARTITION BY source, type, incident_no ORDER BY t, event_id) AS n FROM s2 WHERE snapshot IS NOT NULL)
  WHERE n <= 5 GROUP BY source, type, incident_no) s
ON s.source = i.source AND s.type = i.type AND s.incident_no = i.incident_no""", "ev"))(
    lambda T: inc.cluster_events(T.ev, 45.0, 5).withColumn("snapshots", F.array_join("snapshots", ","))
    .select("source", "type", "incident_no", "count", "first_t", "last_t", "peak_score", "label", "severity", "detail",
            "first_event_id", "rule", "any_repeat", "first_timecode", "last_timecode", "snapshots"))

R.query("event_counts", with_views("""
SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM ev GROUP BY severity
UNION ALL SELECT 'type', type, count(*) FROM ev GROUP BY type UNION ALL SELECT 'total', 'all', count(*) FROM ev""", "ev"))(
    lambda T: inc.event_counts(T.ev))

R.query("report_summary", with_views("WITH " + clusters("ev", 45.0) + f""",
lead AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY severity_rank DESC, round(first_t, 2), type) AS a,
                row_number() OVER (PARTITION BY source ORDER BY first_t, type) AS b FROM incidents),
ty AS (SELECT source, type, row_number() OVER (PARTITION BY source ORDER BY n DESC, f, type) AS r
       FROM (SELECT source, type, count(*) AS n, min(t) AS f FROM ev GROUP BY source, type))
SELECT source, count(*) AS incidents, count(*) FILTER (severity = 'critical') AS critical_count,
       count(*) FILTER (severity = 'high') AS high_count,
       max(CASE WHEN b = 1 THEN {tc('first_t')} END) AS first_incident_timecode,
       count(*) || ' distinct incident(s). Highest-priority: ' || max(CASE WHEN a = 1 THEN label END) || ' at '
       || max(CASE WHEN a = 1 THEN {tc('first_t')} END) || ' (' || max(CASE WHEN a = 1 THEN severity END) || ').' AS headline,
       (SELECT string_agg(type, ',' ORDER BY r) FROM ty WHERE ty.source = lead.source AND r <= 5) AS dominant_types
FROM lead GROUP BY source""", "ev"))(
    lambda T: inc.summary(inc.cluster_events(T.ev, 45.0), T.ev, top=5).withColumn("dominant_types", F.array_join("dominant_types", ",")))

# ── entities = customers, incident links = orders, sightings = orders by date ──
add_view("links", ["alerts"], """
SELECT event_id, entity_id, t, CASE event_id % 4 WHEN 0 THEN 'vehicle_collision' WHEN 1 THEN 'vehicle_left_scene' WHEN 2 THEN 'violence'
       ELSE 'theft_reported' END AS type, severity, CASE WHEN o_orderstatus = 'F' THEN 'involved' ELSE 'present' END AS role FROM alerts""")
add_view("ents", ["customer"], """
SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN 'person' ELSE 'vehicle' END AS kind, c_name AS label,
       CASE WHEN c_custkey % 3 = 0 THEN 'P' || CAST(c_custkey AS VARCHAR(20)) END AS plate, CAST(c_nationkey AS BIGINT) AS source,
       c_acctbal FROM customer""")
add_view("sights", ["links"], """
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY t, event_id) AS seq, 'day ' || CAST(CAST(t AS BIGINT) AS VARCHAR(20)) AS timecode
FROM links""")

SECTION = """
SELECT e.entity_id, e.label, {cols},
       coalesce(s.n, 0) AS appearance_count, coalesce(l.n, 0) AS incident_count, coalesce(s.shown, '') AS appearances
FROM ents e
LEFT JOIN (SELECT entity_id, count(*) AS n, string_agg(timecode, ',' ORDER BY seq) FILTER (back <= 20) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) AS back FROM sights) z GROUP BY entity_id) s
  ON s.entity_id = e.entity_id
LEFT JOIN (SELECT entity_id, count(*) AS n, count(*) FILTER (role = 'involved') AS inv, count(*) FILTER (role <> 'involved') AS pres,
                  count(*) FILTER (type LIKE 'vehicle_%') AS crash, bool_or(type = 'vehicle_left_scene') AS lefts FROM links GROUP BY entity_id) l
  ON l.entity_id = e.entity_id
WHERE e.kind = '{kind}'"""
R.query("people_section", with_views(SECTION.format(
    kind="person", cols="coalesce(l.inv, 0) AS involved_count, coalesce(l.pres, 0) AS present_only_count"), "ents", "sights"))(
    lambda T: inc.people_section(T.ents.drop("plate"), T.sights, T.links, 20).drop("basis")
    .withColumn("appearances", F.array_join("appearances", ",")))
R.query("vehicle_section", with_views(SECTION.format(
    kind="vehicle", cols="e.plate, coalesce(l.crash, 0) AS collision_events, coalesce(l.crash > 0, FALSE) AS involved_in_collision, "
                         "coalesce(l.lefts, FALSE) AS left_scene"), "ents", "sights"))(
    lambda T: inc.vehicle_section(T.ents, T.sights, T.links, 20).drop("basis").withColumn("appearances", F.array_join("appearances", ",")))
R.query("repeat_subjects", with_views("""
SELECT l.entity_id, l.event_id, l.type, l.severity, l.t, e.kind, e.label, c.n AS incident_count
FROM links l JOIN ents e ON e.entity_id = l.entity_id
JOIN (SELECT entity_id, count(*) AS n FROM links GROUP BY entity_id HAVING count(*) > 1) c ON c.entity_id = l.entity_id""", "ents", "links"))(
    lambda T: inc.repeat_subjects(T.ents, T.links))
R.query("prior_incidents", with_views("""
SELECT event_id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY t, event_id) - 1 AS prior_incidents,
       row_number() OVER (PARTITION BY entity_id ORDER BY t, event_id) > 1 AS repeat_subject FROM links""", "links"))(
    lambda T: inc.prior_incidents(T.links, 365.0).select("event_id", "entity_id", "prior_incidents", "repeat_subject"))

# ── observations and caveats ─────────────────────────────────────────────────
R.query("observations", """
SELECT doc_id AS caption_id, CAST(doc_id AS DOUBLE) * 4 AS t, text FROM documents
WHERE NOT starts_with(lower(text), 'no incident observed') ORDER BY doc_id LIMIT 40""")(
    lambda T: inc.observations(T.documents.select(F.col("doc_id").alias("caption_id"), (F.col("doc_id") * 4.0).alias("t"), "text"), 40))


def caveat_facts(T):
    return T.ev.groupBy("source").agg(
        F.count_if(F.col("severity") == "info").alias("captions"), F.count_if(F.col("score") < 0.31).alias("vlm_errors"),
        F.count_if(F.col("score") > 0.98).alias("vlm_empty"), (F.max("user_id") % 9).alias("stride")).select(
        "*", (F.col("source") % 2 == 0).alias("enable_vlm"), (F.col("source") % 3 == 0).alias("enable_pose"),
        (F.col("source") % 4 == 0).alias("weapon_model_loaded"), F.lit(None).cast("string").alias("last_vlm_error"))


R.query("caveats", with_views("WITH " + clusters("ev", 45.0) + """,
f AS (SELECT source, count(*) FILTER (severity = 'info') AS captions, count(*) FILTER (score < 0.31) AS errs,
             count(*) FILTER (score > 0.98) AS empt, max(user_id) % 9 AS stride FROM ev GROUP BY source)
SELECT source, 1 + CASE WHEN source % 2 = 0 AND captions = 0 THEN 1 WHEN errs + empt > 0 THEN 1 ELSE 0 END
       + CASE WHEN source % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN source % 2 <> 0 THEN 1 ELSE 0 END
       + CASE WHEN source % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN stride > 4 THEN 1 ELSE 0 END + 1 AS caveats FROM f""", "ev"))(
    lambda T: inc.caveats(caveat_facts(T), inc.cluster_events(T.ev, 45.0)).select("source", F.size("caveats").cast("long").alias("caveats")))
