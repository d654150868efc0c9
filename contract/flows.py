"""End-to-end plans and file round trips over the driver's tables."""
import uuid

from pyspark.sql import functions as F

from contract.base import Registry, add_view, with_views
from contract import data, people, text  # noqa: F401  (their views are used here)
from contract.incidents import clusters, tc
from contract.perception import ZONES, poses
from framelore.config import DEFAULTS
from framelore.plans import review
from framelore.session import checkpoint_folder
from framelore.sources import files

R = Registry()
CFG = DEFAULTS.patched(loiter_s=20.0, unattended_s=10.0, crowd_surge=2, crowd_dispersal=2, crowd_density=4)


def found(T):
    """All rules; every frame of the feed counts, and the clock of each source starts in the evening, so that the night falls into it."""
    frames = T.det.select("source", "frame_no", "t").distinct()
    starts = T.det.select("source").distinct().withColumn("started", F.timestamp_seconds(F.lit(1_704_144_600) + F.col("source") * 600))
    return review.detect_events(T.det, poses(T), T.act, T.cap, ZONES, CFG, frames, starts)


R.query("detect_events")(lambda T: found(T).drop("evidence", "subject"))


def told(report):
    """A report's rows by what they are about: (source, section, key, value)."""
    body = lambda name: F.coalesce(F.get_json_object("body", f"$.{name}"), F.lit(""))
    join = lambda *names: F.concat_ws("|", *[body(n) for n in names])
    key, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, k, v in (("summary", (), ("incidents", "critical_count", "high_count")), ("incidents", ("type", "incident_no"), ("count", "severity", "detail")),
                       ("recommended_actions", ("type", "timecode"), ("priority",)), ("counts", ("severity", "type"), ("n",)), ("observations", ("caption_id",), ("text",)),
                       ("persons", ("entity_id",), ("involved_count", "present_only_count", "appearance_count")),
                       ("vehicles", ("entity_id", "plate"), ("collision_events", "left_scene", "incident_count")), ("repeat_subjects", ("entity_id", "event_id"), ("incident_count", "severity"))):
        key, value = F.when(F.col("section") == name, join(*k) if k else F.lit("")).otherwise(key), F.when(F.col("section") == name, join(*v)).otherwise(value)
    return report.select("source", "section", key.alias("key"), value.alias("value"))


def report_sql(src: str, start: str) -> str:
    """The sections that come from events alone; ``start`` is what times count from."""
    return clusters(src, 45.0) + f""",
rep AS (SELECT source, 'summary' AS section, '' AS key, count(*) || '|' || count(*) FILTER (severity = 'critical') || '|' || count(*) FILTER (severity = 'high') AS value FROM incidents GROUP BY source
UNION ALL SELECT source, 'incidents', type || '|' || incident_no, count || '|' || severity || '|' || detail FROM incidents
UNION ALL SELECT source, 'recommended_actions', type || '|' || {tc(f"(first_t - {start})")}, severity FROM incidents
UNION ALL SELECT source, 'counts', severity || '|' || type, CAST(count(*) AS VARCHAR) FROM {src} GROUP BY source, severity, type)"""


R.query("build_report", with_views("WITH " + report_sql("ev", "0") + """,
tied AS (SELECT entity_id, count(*) AS n, count(*) FILTER (role = 'involved') AS inv, count(*) FILTER (role <> 'involved') AS pres, count(*) FILTER (type LIKE 'vehicle_%') AS crash,
         bool_or(type = 'vehicle_left_scene') AS lefts FROM links GROUP BY entity_id),
seen AS (SELECT entity_id, count(*) AS n FROM sights GROUP BY entity_id)
SELECT * FROM rep
UNION ALL SELECT source, 'observations', CAST(caption_id AS VARCHAR), text FROM cap WHERE NOT starts_with(lower(text), 'no incident observed')
UNION ALL SELECT source, 'persons', CAST(e.entity_id AS VARCHAR), coalesce(inv, 0) || '|' || coalesce(pres, 0) || '|' || coalesce(s.n, 0) FROM ents e LEFT JOIN tied t ON t.entity_id = e.entity_id LEFT JOIN seen s ON s.entity_id = e.entity_id WHERE kind = 'person'
UNION ALL SELECT source, 'vehicles', e.entity_id || '|' || coalesce(plate, ''), coalesce(crash, 0) || '|' || coalesce(lefts, FALSE) || '|' || coalesce(t.n, 0) FROM ents e LEFT JOIN tied t ON t.entity_id = e.entity_id WHERE kind = 'vehicle'
UNION ALL SELECT source, 'repeat_subjects', l.entity_id || '|' || l.event_id, t.n || '|' || l.severity FROM links l JOIN tied t ON t.entity_id = l.entity_id AND t.n > 1 JOIN ents e ON e.entity_id = l.entity_id""",
    "ev", "cap", "ents", "links", "sights"))(
    lambda T: told(review.build_report(T.ev, T.cap, None, 45.0, top=5, appearances=20, entities=T.ents, sightings=T.sights, links=T.links)))
R.query("session_report", with_views("WITH se AS (SELECT *, min(t) OVER (PARTITION BY source) AS t0 FROM ev)," + report_sql("se", "(SELECT min(t) FROM ev e WHERE e.source = incidents.source)") + " SELECT * FROM rep", "ev"))(
    lambda T: told(review.session_report(T.ev, None, 45.0, top=5)))

add_view("times", ["orders"], """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR(10)) || '.5' WHEN 1 THEN ' ' || CAST(o_custkey % 60 AS VARCHAR(10)) || ':' || CAST(o_orderkey % 60 AS VARCHAR(10)) || '.25'
  WHEN 2 THEN CAST(o_custkey AS VARCHAR(10)) || ':' || CAST(o_custkey % 60 AS VARCHAR(10)) || ':0' || CAST(o_orderkey % 10 AS VARCHAR(10)) ELSE 'about ' || o_orderstatus END AS text FROM orders""")
R.query("parse_time", with_views(r"""
SELECT o_orderkey, CASE WHEN regexp_matches(trim(text), '^(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)$') THEN
  coalesce(try_cast(nullif(regexp_extract(trim(text), '^(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)$', 1), '') AS DOUBLE), 0) * 3600
  + CAST(regexp_extract(trim(text), '^(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)$', 2) AS DOUBLE) * 60 + CAST(regexp_extract(trim(text), '^(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)$', 3) AS DOUBLE)
  ELSE try_cast(trim(text) AS DOUBLE) END AS seconds FROM times""", "times"))(lambda T: T.times.select("o_orderkey", files.parse_time(F.col("text")).alias("seconds")))


def folder(T, name):
    return f"{checkpoint_folder(T.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def annotations_round_trip(T):
    p = folder(T, "annotations")
    (T.ann.select("video", F.col("start").cast("string").alias("start"), F.col("span_end").cast("string").alias("end"), "label", "split", F.lit("").alias("notes"))
     .write.option("header", True).option("emptyValue", "").csv(p))
    spans, problems = files.read_annotations(T.spark, p)
    return spans.groupBy("label", "split").agg(F.count("*").alias("n"), F.sum("start").alias("starts")).unionByName(
        problems.groupBy(F.lit("(problem)").alias("label"), F.lit("").alias("split")).agg(F.count("*").alias("n"), F.lit(0.0).alias("starts")))


R.query("read_annotations", with_views("""
SELECT label, split, count(*) AS n, sum(start) AS starts FROM ann WHERE label <> '' GROUP BY label, split UNION ALL SELECT '(problem)', '', count(*), 0 FROM ann WHERE label = ''""", "ann"))(annotations_round_trip)


def clips_round_trip(T):
    p = folder(T, "clips")
    files.write_clips(T.ann.select(F.col("ann_id").alias("clip_id"), "split", F.when(F.col("label") == "", "none").otherwise(F.col("label")).alias("label"), "start"), p)
    return files.read_clips(T.spark, p, "val").select("clip_id", "label", "start")


R.query("clip_table", with_views("SELECT ann_id AS clip_id, CASE WHEN label = '' THEN 'none' ELSE label END AS label, start FROM ann WHERE split = 'val'", "ann"))(clips_round_trip)


def pose_map(T):
    kp = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(1.0).alias("c")))
    one = T.pose.groupBy("source", "frame_no").agg(F.map_from_entries(F.collect_list(F.struct(F.col("person_idx").cast("string").alias("k"), F.struct(kp("wx", "wy").alias("keypoints")).alias("v")))).alias("people"))
    return files.flatten_pose_map(one.select(F.col("source").alias("video"), F.create_map(F.col("frame_no").cast("string"), F.col("people")).alias("poses"))) \
        .select("video", "frame_no", "person_idx", F.get("keypoints", F.lit(0))["x"].alias("x"))


R.query("flatten_pose_map", with_views("SELECT source AS video, frame_no, person_idx, wx AS x FROM pose", "pose"))(pose_map)


def instruction_files(T):
    p = folder(T, "instructions")
    c = T.sft.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "value"))).alias("c"))
    rows = c.select(F.col("conv_id").cast("string").alias("id"), F.transform("c", lambda x: F.struct(x["role"].alias("from"), x["value"].alias("value"))).alias("conversations"))
    rows.filter("CAST(id AS BIGINT) % 2 = 0").write.json(p + "/a")
    rows.filter("CAST(id AS BIGINT) % 2 = 1").write.json(p + "/b")
    samples = files.read_instruction_files(T.spark, [f"{p}/a", f"{p}/b"], lines=True)
    return files.turns_of(samples).groupBy("conv_id", "file_idx").agg(F.count("*").alias("turns")).select("conv_id", F.col("file_idx").cast("long").alias("file_idx"), "turns")


R.query("instruction_files", with_views("SELECT CAST(conv_id AS VARCHAR) AS conv_id, conv_id % 2 AS file_idx, count(*) AS turns FROM sft GROUP BY ALL", "sft"))(instruction_files)


def scored(T):
    # A stand-in scorer: the answer is the number of words.
    return files.score_with(T.documents.select("doc_id", "text"), _count_words, "doc_id long, words long, error string").select("doc_id", "words")


def _count_words(pdf):
    return pdf[["doc_id"]].assign(words=pdf["text"].str.split().str.len().astype("int64"))


R.query("score_with", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents")(scored)
