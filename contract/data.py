"""Queries over frames, datasets and metrics."""
from pyspark.sql import functions as F

from contract.base import Registry, add_view, with_views
from contract.perception import IOU, points, poses
from framelore import dims
from framelore.operators import datasets as ds, frames as fr, metrics as me

R = Registry()
N = 'CAST({} AS BIGINT)'

# ── raw model rows: one per lineitem ─────────────────────────────────────────
add_view("raw", ["lineitem"], """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 640 AS DOUBLE) AS cx, CAST(l_suppkey % 640 AS DOUBLE) AS cy, CAST(20 + l_orderkey % 200 AS DOUBLE) AS w,
       CAST(20 + l_partkey % 150 AS DOUBLE) AS h, CAST(l_quantity AS DOUBLE) / 100 AS s0, l_discount * 5 AS s1, l_tax * 5 AS s2, 1280.0 AS frame_w, 720.0 AS frame_h
FROM lineitem""")
R.query("decode_predictions", with_views("""
WITH p AS (SELECT *, greatest(s0, s1) AS c, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS k FROM raw)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(k AS BIGINT) AS class_id, CAST(trunc((cx - w / 2 - 0) / 0.5) AS BIGINT) AS x1, CAST(trunc((cy - h / 2 - 140) / 0.5) AS BIGINT) AS y1,
       CAST(trunc((cx + w / 2) / 0.5) AS BIGINT) AS x2, CAST(trunc((cy + h / 2 - 140) / 0.5) AS BIGINT) AS y2 FROM p WHERE c > 0.25""", "raw"))(
    lambda T: fr.decode_predictions(T.raw.select("l_orderkey", "l_linenumber", "l_partkey", "cx", "cy", "w", "h", F.array("s0", "s1", "s2").alias("scores"),
                                                 F.col("frame_w").cast("double"), F.col("frame_h").cast("double")), 0.25, 2)
    .select("l_orderkey", "l_linenumber", "l_partkey", "class_id", "x1", "y1", "x2", "y2"))
FOLD = """
o AS (SELECT *, row_number() OVER (PARTITION BY source, frame_no ORDER BY confidence DESC, det_id) AS k FROM det),
e AS (SELECT a.det_id AS strong, b.det_id AS weak FROM o a JOIN o b ON a.source = b.source AND a.frame_no = b.frame_no AND a.k < b.k WHERE {cond}),
r AS (SELECT source, frame_no, k, det_id, CASE WHEN k = 1 THEN [det_id] END AS kept FROM o WHERE k = 1
 UNION ALL SELECT n.source, n.frame_no, n.k, n.det_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.weak = n.det_id AND list_contains(r.kept, e.strong)) THEN r.kept ELSE list_append(r.kept, n.det_id) END
 FROM r JOIN o n ON n.source = r.source AND n.frame_no = r.frame_no AND n.k = r.k + 1),
f AS (SELECT source, frame_no, arg_max(kept, k) AS kept FROM r GROUP BY ALL)
SELECT source, frame_no, unnest(kept) AS det_id FROM f"""
R.query("nms", with_views("WITH " + FOLD.format(cond=IOU.format(a="a", b="b") + " > 0.1"), "det", recursive=True))(
    lambda T: fr.nms(T.det, 0.1).select("source", "frame_no", "det_id"))
R.query("dedup_boxes", with_views("WITH " + FOLD.format(cond="a.cls = b.cls AND " + IOU.format(a="a", b="b") + " > 0.05"), "det", recursive=True))(
    lambda T: fr.dedup_boxes(T.det, 0.05).select("source", "frame_no", "det_id"))
R.query("crop_to_frame", with_views("""
SELECT k.det_id, p.det_id AS person_id, CAST(k.w4 + greatest(0, trunc(p.x1 - (p.x2 - p.x1) * 0.25)) AS BIGINT) AS x1, CAST(10 + greatest(0, trunc(p.y1 - (p.y2 - p.y1) * 0.25)) AS BIGINT) AS y1
FROM (SELECT *, CAST(det_id % 30 AS DOUBLE) AS w4 FROM det WHERE cls = 'knife') k JOIN det p ON p.source = k.source AND p.frame_no = k.frame_no AND p.cls = 'person'""", "det"))(
    lambda T: fr.crop_to_frame(T.det.filter("cls = 'knife'").select("source", "frame_no", "det_id", "frame_w", "frame_h", (F.col("det_id") % 30).cast("double").alias("x1"),
        F.lit(10.0).alias("y1"), ((F.col("det_id") % 30) + 12).cast("double").alias("x2"), F.lit(22.0).alias("y2"))
        .join(T.det.filter("cls = 'person'").select("source", "frame_no", F.col("det_id").alias("person_id"), F.col("x1").alias("px1"), F.col("y1").alias("py1"),
                                                    F.col("x2").alias("px2"), F.col("y2").alias("py2")), ["source", "frame_no"]))
    .select("det_id", "person_id", F.col("x1").cast("long").alias("x1"), F.col("y1").cast("long").alias("y1")))
R.query("merge_detectors", with_views("""
SELECT det_id, lower(cls) AS cls, 'coco' AS det_source FROM det UNION ALL SELECT det_id, lower(cls), 'weapon_model' FROM det WHERE cls = 'knife'""", "det"))(
    lambda T: fr.merge_detectors((T.det.withColumn("cls", F.upper("cls")), "coco"), (T.det.filter("cls = 'knife'").drop("frame_w"), "weapon_model"))
    .select("det_id", "cls", "det_source"))
R.query("sample_frames", with_views("SELECT det_id, source, frame_no FROM det WHERE frame_no % 3 = 0 AND t > 1.0 AND t <= 61.0", "det"))(
    lambda T: fr.sample_frames(T.det, 3, 1.0, 60.0).select("det_id", "source", "frame_no"))
from contract.incidents import kept  # noqa: E402
add_view("caps", ["documents"], "SELECT doc_id AS event_id, lang AS source, CAST(doc_id AS DOUBLE) + CAST(n_chars % 7 AS DOUBLE) / 10 AS t FROM documents")
from framelore.operators import incidents as inc  # noqa: E402
R.query("min_gap_sample", with_views(kept("caps", "source", 4.0) + "SELECT event_id, source, t FROM kept", "caps", recursive=True))(
    lambda T: inc.min_gap(T.caps, ["source"], "t", 4.0, "event_id"))

# ── poses ────────────────────────────────────────────────────────────────────
R.query("select_top_persons", with_views("""
WITH r AS (SELECT source, frame_no, person_idx, wx, row_number() OVER (PARTITION BY source, frame_no ORDER BY confidence DESC, person_idx) AS slot FROM pose),
s AS (SELECT source, frame_no, slot FROM (SELECT DISTINCT source, frame_no FROM pose) z, (VALUES (1), (2), (3)) v(slot))
SELECT s.source, s.frame_no, s.slot, r.person_idx, CASE WHEN r.person_idx IS NOT NULL THEN r.wx ELSE 0 END AS wrist_x FROM s LEFT JOIN r ON r.source = s.source AND r.frame_no = s.frame_no AND r.slot = s.slot""", "pose"))(
    lambda T: fr.select_top_persons(poses(T), 3).select("source", "frame_no", "slot", "person_idx", F.coalesce(F.get("keypoints", F.lit(10))["x"], F.lit(0.0)).alias("wrist_x")))
R.query("repair_confidence", with_views("""
SELECT det_id, CASE WHEN det_id % 4 = 0 THEN 1.0::DOUBLE ELSE wc END AS wrist_c, CASE WHEN det_id % 4 = 0 THEN 0.0::DOUBLE ELSE 0 END AS eye_c FROM pose""", "pose"))(
    lambda T: fr.repair_confidence(poses(T).withColumn("keypoints", F.transform("keypoints", lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y"),
        F.when(F.col("det_id") % 4 == 0, F.lit(float("nan"))).otherwise(k["c"]).alias("c"))))).select(
        "det_id", F.get("keypoints", F.lit(10))["c"].alias("wrist_c"), F.get("keypoints", F.lit(0))["c"].alias("eye_c")))
add_view("joints", ["pose"], """
SELECT source * 100000 + CAST(floor(frame_no / 10) AS BIGINT) AS clip_id, source, frame_no, frame_no AS sample_no, t, person_idx AS person, 10 AS joint, wx AS x, wy AS y, wc AS c, frame_w, frame_h FROM pose
UNION ALL SELECT source * 100000 + CAST(floor(frame_no / 10) AS BIGINT), source, frame_no, frame_no, t, person_idx, 8, ex, ey, ec, frame_w, frame_h FROM pose""")
PRES = "max(CASE WHEN c > 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, frame_no, person) = 1"
R.query("normalize_pose_frame", with_views(f"""
SELECT source, frame_no, person, joint, round(CASE WHEN {PRES} THEN (x - 640) / 640 ELSE 0 END, 6) AS x, round(CASE WHEN {PRES} THEN (y - 360) / 360 ELSE 0 END, 6) AS y FROM joints""", "joints"))(
    lambda T: fr.normalize_pose(T.joints).select("source", "frame_no", "person", "joint", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")))
R.query("normalize_pose_clip", with_views(f"""
WITH m AS (SELECT clip_id, avg(x) AS mx, avg(y) AS my FROM joints WHERE c > 0.3 GROUP BY clip_id),
s AS (SELECT j.clip_id, greatest(max(abs(x - mx)), max(abs(y - my))) AS sp FROM joints j JOIN m USING (clip_id) WHERE c > 0.3 GROUP BY j.clip_id),
p AS (SELECT *, {PRES} AS pr FROM joints)
SELECT source, frame_no, person, joint, round(CASE WHEN pr THEN (x - mx) / CASE WHEN sp > 1e-6 THEN sp ELSE 1 END ELSE 0 END, 5) AS x FROM p LEFT JOIN m USING (clip_id) LEFT JOIN s USING (clip_id)""", "joints"))(
    lambda T: fr.normalize_pose(T.joints, "clip").select("source", "frame_no", "person", "joint", F.round("x", 5).alias("x")))
R.query("augment_clips")(lambda T: fr.augment_clips(T.joints, 7))
FEAT = """cen AS (SELECT source, sample_no, person, avg(x) AS px, avg(y) AS py FROM joints WHERE c > 0.3 GROUP BY ALL),
gp AS (SELECT a.source, a.sample_no, min(sqrt(power(a.px - b.px, 2) + power(a.py - b.py, 2))) / sqrt(1280.0 * 1280 + 720.0 * 720) AS gap
       FROM cen a JOIN cen b ON a.source = b.source AND a.sample_no = b.sample_no AND a.person < b.person GROUP BY ALL),
mo AS (SELECT a.source, a.sample_no, avg(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / sqrt(1280.0 * 1280 + 720.0 * 720)) AS motion
       FROM joints a JOIN joints b ON a.source = b.source AND a.person = b.person AND a.joint = b.joint AND b.sample_no = a.sample_no - 1 WHERE a.c > 0.3 AND b.c > 0.3 GROUP BY ALL),
ft AS (SELECT s.source, s.sample_no, s.t, coalesce(n, 0) AS people, gap, coalesce(motion, 0) AS motion FROM (SELECT DISTINCT source, sample_no, t FROM joints) s
       LEFT JOIN (SELECT source, sample_no, count(*) AS n FROM cen GROUP BY ALL) c USING (source, sample_no) LEFT JOIN gp USING (source, sample_no) LEFT JOIN mo USING (source, sample_no))"""
R.query("interaction_features", with_views("WITH " + FEAT + " SELECT source, sample_no, people, round(gap, 6) AS gap, round(motion, 6) AS motion FROM ft", "joints"))(
    lambda T: fr.interaction_features(T.joints).select("source", "sample_no", "people", F.round("gap", 6).alias("gap"), F.round("motion", 6).alias("motion")))
R.query("sample_motion", with_views("WITH " + FEAT + " SELECT source, sample_no, round(motion, 6) AS motion FROM mo", "joints"))(
    lambda T: fr.sample_motion(T.joints).withColumn("motion", F.round("motion", 6)))
WIN = FEAT + """,
e AS (SELECT source, min(t) AS t0, max(t) AS t1 FROM ft GROUP BY source),
ks AS (SELECT source, t0 + k AS start FROM (SELECT *, unnest(range(0, CAST(t1 - t0 AS BIGINT) + 1)) AS k FROM e) WHERE t0 + k + 4.0 <= t1 + 1e-6),
w AS (SELECT k.source, k.start, count(*) AS n, avg(CASE WHEN people >= 2 THEN 1.0 ELSE 0 END) AS multi, avg(CASE WHEN coalesce(gap, 1) < 0.18 THEN 1.0 ELSE 0 END) AS close,
      quantile_cont(motion, 0.9) AS pm, max(coalesce(gap, 1)) - min(coalesce(gap, 1)) AS sw, max(people) AS people_max
      FROM ks k JOIN ft f ON f.source = k.source AND f.t >= k.start AND f.t < k.start + 4.0 GROUP BY ALL HAVING count(*) >= 2),
rw AS (SELECT *, 2.0 * multi * close + 40.0 * pm + 4.0 * sw AS score FROM w)"""
R.query("rank_windows", with_views("WITH " + WIN + " SELECT source, start, people_max, round(score, 5) AS score FROM rw", "joints"))(
    lambda T: ds.rank_windows(fr.interaction_features(T.joints)).select("source", "start", "people_max", F.round("score", 5).alias("score")))


def rounded_windows(T):
    return ds.rank_windows(fr.interaction_features(T.joints)).withColumn("score", F.round("score", 5))


R.query("pick_candidates")(lambda T: ds.pick_candidates(rounded_windows(T), 15, 8))
R.query("merge_windows", with_views("WITH " + WIN + """,
o AS (SELECT source, start, round(score, 5) AS score, people_max, row_number() OVER (PARTITION BY source ORDER BY start) AS k FROM rw WHERE score > 0.5),
r AS (SELECT source, k, start AS a, start + 4.0 AS b FROM o WHERE k = 1
 UNION ALL SELECT n.source, n.k, CASE WHEN n.start <= r.b + 0.5 AND n.start + 4.0 - r.a <= 12.0 THEN r.a ELSE n.start END,
                  CASE WHEN n.start <= r.b + 0.5 AND n.start + 4.0 - r.a <= 12.0 THEN greatest(r.b, n.start + 4.0) ELSE n.start + 4.0 END
 FROM r JOIN o n ON n.source = r.source AND n.k = r.k + 1)
SELECT o.source, a AS start, max(b) AS "end", max(score) AS score, max(people_max) AS people_max FROM r JOIN o ON o.source = r.source AND o.k = r.k GROUP BY o.source, a""", "joints", recursive=True))(
    lambda T: ds.merge_windows(rounded_windows(T).filter("score > 0.5")))

# ── windows over spans: one span per order ───────────────────────────────────
add_view("spans", ["orders"], """
SELECT o_orderkey AS span_id, o_custkey % 50 AS video_no, CAST(o_orderkey % 97 AS DOUBLE) AS start, CAST(o_orderkey % 97 + 1 + o_custkey % 23 AS DOUBLE) AS "end",
       CAST(o_custkey % 300 AS BIGINT) AS n_frames, 25.0::DOUBLE AS fps FROM orders""".replace("25.0::DOUBLE", "CAST(25 AS DOUBLE)").replace('"end"', "span_end"))
R.query("sample_indices", with_views("""
SELECT span_id, CAST(i AS BIGINT) AS pick, CAST(CASE WHEN n_frames <= 5 THEN i WHEN i = 4 THEN n_frames - 1 ELSE floor(i * (CAST(n_frames - 1 AS DOUBLE) / 4)) END AS BIGINT) AS idx
FROM spans, range(0, 5) r(i) WHERE i < n_frames""", "spans"))(
    lambda T: fr.sample_indices(T.spans, 5).select("span_id", F.col("pick").cast("long").alias("pick"), "idx"))
R.query("clip_windows_of_length", with_views("""
SELECT span_id, CAST(c AS BIGINT) AS clip, CAST(p AS BIGINT) AS pos, CAST(CASE WHEN n_frames <= 20 THEN p % n_frames
       ELSE p + CASE WHEN c = 2 THEN n_frames - 20 ELSE floor(c * CAST(n_frames - 20 AS DOUBLE) / 2) END END AS BIGINT) AS idx
FROM spans, range(0, 3) a(c), range(0, 20) b(p) WHERE n_frames > 0""", "spans"))(
    lambda T: fr.clip_windows_of_length(T.spans, 20, 3).select("span_id", F.col("clip").cast("long").alias("clip"), F.col("pos").cast("long").alias("pos"), "idx"))
R.query("clip_windows", with_views("""
SELECT span_id, CAST(k AS BIGINT) AS k, start + k AS t_start FROM spans, range(0, 100) r(k) WHERE start + k + 16.0 / 25 <= span_end + 1e-9""", "spans"))(
    lambda T: fr.clip_windows(T.spans.withColumnRenamed("span_end", "end")).select("span_id", "k", "t_start"))
R.query("scale_windows", with_views("""
SELECT span_id, CAST(s AS BIGINT) AS scale, CAST(b AS BIGINT) AS back FROM spans, (VALUES (100, 16), (45, 7), (20, 1)) v(s, st), range(0, 26) r(b)
WHERE n_frames >= s AND b % st = 0 AND b <= n_frames - s AND b / st < 40 UNION ALL SELECT span_id, n_frames, 0 FROM spans WHERE n_frames > 0 AND n_frames < 20""", "spans"))(
    lambda T: fr.scale_windows(T.spans.withColumnRenamed("n_frames", "n"), cap=40).select("span_id", F.col("scale").cast("long").alias("scale"), "back"))
R.query("fit_length", with_views("""
SELECT span_id, array_to_string(list_transform(range(0, 12), lambda i: CASE WHEN n > 12 THEN i + CAST(floor((n - 12) / 2) AS BIGINT) ELSE i % n END), ',') AS frames
FROM (SELECT span_id, 1 + n_frames % 30 AS n FROM spans) z""", "spans"))(
    lambda T: fr.fit_length(T.spans.select("span_id", F.sequence(F.lit(0).cast("long"), F.col("n_frames") % 30).alias("frames")), 12)
    .select("span_id", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames")))
R.query("action_evidence", """
WITH p AS (SELECT l_orderkey % 500 AS buffer_id, CASE l_linenumber % 3 WHEN 0 THEN 100 WHEN 1 THEN 45 ELSE 20 END AS scale, l_suppkey % 7 AS back, l_partkey % 11 AS class_id, l_discount * 10 AS prob FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY buffer_id, class_id ORDER BY prob DESC, scale DESC, back) AS n FROM p),
r AS (SELECT buffer_id, class_id, prob AS confidence, scale, row_number() OVER (PARTITION BY buffer_id ORDER BY prob DESC, class_id) AS rank FROM b WHERE n = 1)
SELECT buffer_id, class_id, round(confidence, 6) AS confidence, CAST(scale AS BIGINT) AS scale, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5""")(
    lambda T: fr.action_evidence(T.lineitem.select((F.col("l_orderkey") % 500).alias("buffer_id"),
        F.when(F.col("l_linenumber") % 3 == 0, 100).when(F.col("l_linenumber") % 3 == 1, 45).otherwise(20).alias("scale"), (F.col("l_suppkey") % 7).alias("back"),
        (F.col("l_partkey") % 11).alias("class_id"), (F.col("l_partkey") % 11).cast("string").alias("label"), (F.col("l_discount") * 10).alias("prob")))
    .select("buffer_id", "class_id", F.round("confidence", 6).alias("confidence"), F.col("scale").cast("long").alias("scale"), F.col("rank").cast("long").alias("rank")))
R.query("eligible_hosts", with_views("SELECT det_id FROM det WHERE cls = 'person' AND y2 - y1 >= 60 AND y2 - y1 <= 396 AND y2 - y1 > 1.4 * (x2 - x1) AND (y2 - y1) * 0.18 >= 26", "det"))(
    lambda T: fr.eligible_hosts(T.det).select("det_id"))

# ── labels and spans ─────────────────────────────────────────────────────────
CATS = ["Normal", "Abuse", "Arrest", "Assault", "Fighting", "Shoplifting", "normal_videos", "Parade", "Robbery", "road accidents"]
add_view("items", ["documents"], f"""SELECT doc_id AS item_id, CASE doc_id % 10 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATS))} END AS category,
       CAST(n_chars AS DOUBLE) / 100 AS duration, lang, text FROM documents""")
LABELS = ", ".join("('%s', %s)" % (k, f"'{v}'" if v else "NULL") for k, v in dims.CATEGORY_TO_LABEL.items())
R.query("map_taxonomy", with_views(f"SELECT item_id, i.category, m.target FROM items i JOIN (VALUES {LABELS}) m(category, target) ON m.category = i.category WHERE m.target IS NOT NULL", "items"))(
    lambda T: ds.map_taxonomy(T.items, dims.CATEGORY_TO_LABEL)[0].select("item_id", "category", "target"))
R.query("unmapped_categories", with_views(f"SELECT DISTINCT category FROM items WHERE category NOT IN (SELECT category FROM (VALUES {LABELS}) m(category, target))", "items"))(
    lambda T: ds.map_taxonomy(T.items, dims.CATEGORY_TO_LABEL)[1])
R.query("provisional_spans", with_views(f"""
SELECT item_id, CASE WHEN target = 'normal' THEN 0 ELSE greatest(0, duration / 2 - 2) END AS start, CASE WHEN target = 'normal' THEN least(duration, 20) ELSE least(duration, duration / 2 + 2) END AS "end"
FROM items i JOIN (VALUES {LABELS}) m(category, target) ON m.category = i.category WHERE m.target IS NOT NULL AND duration > 1""", "items"))(
    lambda T: ds.provisional_spans(ds.map_taxonomy(T.items, dims.CATEGORY_TO_LABEL)[0]).select("item_id", "start", "end"))
R.query("video_key", r"""
SELECT page_id, split_part(split_part(split_part(regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]*$', ''), ' (', 1), '_1', 1), '_2', 1) AS k FROM pages""")(
    lambda T: T.pages.select("page_id", ds.video_key(F.col("url")).alias("k")))
add_view("ann", ["orders"], """
SELECT o_orderkey AS ann_id, 'videos/clip ' || CAST(o_custkey % 40 AS VARCHAR(10)) || CASE o_orderkey % 3 WHEN 0 THEN ' (720p, h264)' WHEN 1 THEN '_1080p_' ELSE '' END || '.mp4' AS video,
       CAST((o_orderkey * 37) % 4000 AS DOUBLE) AS start, CAST((o_orderkey * 37) % 4000 + 1 + o_orderkey % 9 AS DOUBLE) AS span_end,
       CASE o_orderkey % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'phone_snatch' WHEN 2 THEN 'assault' WHEN 3 THEN '' ELSE 'pickpocket' END AS label,
       CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders""")


def ann(T):
    return T.ann.withColumnRenamed("span_end", "end")


KEY = "'clip ' || CAST(n AS VARCHAR(10))"
R.query("incident_spans", with_views("""
SELECT split_part(split_part(split_part(regexp_replace(regexp_replace(video, '^.*/', ''), '\\.[^.]*$', ''), ' (', 1), '_1', 1), '_2', 1) AS video_key, start, span_end AS "end", label
FROM ann WHERE label NOT IN ('', 'normal')""", "ann"))(lambda T: ds.incident_spans(ann(T)))
R.query("annotation_summary", with_views("""
SELECT coalesce(split, 'all') AS split, count(*) AS spans, count(DISTINCT video) AS videos, round(sum((span_end - start) / 60), 4) AS minutes FROM ann GROUP BY ROLLUP (split)""", "ann"))(
    lambda T: ds.annotation_summary(ann(T)).withColumn("minutes", F.round("minutes", 4)))
R.query("class_counts", with_views("SELECT label, count(*) AS n FROM ann GROUP BY label", "ann"))(lambda T: ds.class_counts(ann(T)))
R.query("exclude_incident_time", with_views("""
SELECT event_id FROM ev e WHERE NOT EXISTS (SELECT 1 FROM ann a WHERE a.label NOT IN ('', 'normal') AND a.ann_id % 8 = e.source AND e.t BETWEEN a.start - 1 AND a.span_end + 1)""", "ev", "ann"))(
    lambda T: ds.exclude_incident_time(T.ev, ann(T).filter("label NOT IN ('', 'normal')").select((F.col("ann_id") % 8).alias("source"), "start", "end"), 1.0, ["source"]).select("event_id"))
R.query("leakage", with_views("""
WITH n AS (SELECT * FROM ann WHERE label = 'normal'), p AS (SELECT * FROM ann WHERE label = 'assault')
SELECT v.video, EXISTS (SELECT 1 FROM n JOIN p ON n.video = p.video AND n.start < p.span_end AND n.span_end > p.start WHERE n.video = v.video) AS overlaps
FROM (SELECT video FROM n INTERSECT SELECT video FROM p) v""", "ann"))(lambda T: ds.leakage(ann(T).filter("label = 'normal'"), ann(T).filter("label = 'assault'")))
R.query("mask_runs", with_views("""
WITH m AS (SELECT source AS video, frame_no, max(CASE WHEN cls = 'chair' THEN 1 ELSE 0 END) AS value FROM det GROUP BY ALL),
g AS (SELECT *, frame_no - row_number() OVER (PARTITION BY video, value ORDER BY frame_no) AS d FROM m)
SELECT video, value, min(frame_no) AS start, max(frame_no) + 1 AS "end" FROM g GROUP BY video, value, d""", "det"))(
    lambda T: ds.mask_runs(T.det.groupBy(F.col("source").alias("video"), "frame_no").agg(F.max((F.col("cls") == "chair").cast("int")).alias("value")), 50).drop("run"))
R.query("pose_coverage", with_views("""
SELECT span_id, label, count(*) AS frames, count(*) FILTER (people >= 3) AS detected, round(count(*) FILTER (people >= 3) / count(*)::DOUBLE, 6) AS coverage
FROM (SELECT source AS span_id, 'x' AS label, frame_no, count(*) FILTER (cls = 'person') AS people FROM det GROUP BY ALL) z GROUP BY ALL HAVING count(*) FILTER (people >= 3) / count(*)::DOUBLE >= 0.25""", "det"))(
    lambda T: ds.pose_coverage(T.det.groupBy(F.col("source").alias("span_id"), F.lit("x").alias("label"), "frame_no")
                               .agg(F.greatest(F.count_if(F.col("cls") == "person") - 2, F.lit(0)).alias("people"))).withColumn("coverage", F.round("coverage", 6)))
R.query("clip_balance", with_views("""
SELECT label, count(*) AS n, count(*) < 30 AS thin, (SELECT count(*) FROM ann WHERE label = 'normal') < (SELECT count(*) FROM ann) * 0.3 AS few_normals FROM ann GROUP BY label""", "ann"))(
    lambda T: ds.clip_balance(ann(T)))

# ── box labels: boxes and polygons from lineitem ─────────────────────────────
add_view("boxes", ["lineitem"], """
SELECT 'img_' || CAST(l_orderkey AS VARCHAR(20)) AS image, l_partkey % 4 AS class_id, CAST(l_partkey % 100 AS DOUBLE) / 1000 AS bw, CAST(l_suppkey % 90 + 1 AS DOUBLE) / 500 AS bh, l_linenumber % 2 = 0 AS poly FROM lineitem""")
AREA = "CASE WHEN poly THEN 0.5 * bw * bh * 100.0 ELSE bw * bh * 100.0 END"


def boxes(T):
    half = F.array(F.lit(0.1), F.lit(0.1), F.lit(0.1) + F.col("bw"), F.lit(0.1), F.lit(0.1), F.lit(0.1) + F.col("bh"))
    return T.boxes.withColumn("coords", F.when(F.col("poly"), half).otherwise(F.array(F.lit(0.5), F.lit(0.5), "bw", "bh")))


R.query("audit_labels", with_views(f"""
WITH a AS (SELECT *, round({AREA}, 8) AS a FROM boxes), r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY a) - 1 AS k, count(*) OVER (PARTITION BY class_id) AS n FROM a)
SELECT class_id, count(*) AS instances, count(DISTINCT image) AS images, count(*) FILTER (NOT poly) AS boxes,
  round(max(CASE WHEN k = CAST(round_even(0.1::DOUBLE * (n - 1), 0) AS BIGINT) THEN a END), 6) AS p10, round(max(CASE WHEN k = CAST(round_even(0.5::DOUBLE * (n - 1), 0) AS BIGINT) THEN a END), 6) AS median,
  round(max(CASE WHEN k = CAST(round_even(0.9::DOUBLE * (n - 1), 0) AS BIGINT) THEN a END), 6) AS p90 FROM r GROUP BY class_id""", "boxes"))(
    lambda T: ds.audit_labels(boxes(T)).select("class_id", "instances", "images", "boxes", *[F.round(c, 6).alias(c) for c in ("p10", "median", "p90")]))
R.query("audit_summary", with_views("""
WITH i AS (SELECT 'img_' || o_orderkey AS image, o_custkey % 10 <> 0 AS has_file FROM orders), l AS (SELECT image, count(*) AS n FROM boxes GROUP BY image)
SELECT count(*) AS images, count(*) FILTER (has_file AND n > 0) AS labelled, count(*) FILTER (has_file AND n IS NULL) AS negatives, count(*) FILTER (NOT has_file) AS missing,
  (SELECT round(max(c) / min(c)::DOUBLE, 6) FROM (SELECT count(*) AS c FROM boxes GROUP BY class_id)) AS imbalance FROM i LEFT JOIN l USING (image)""", "boxes"))(
    lambda T: ds.audit_summary(T.orders.select(F.concat(F.lit("img_"), F.col("o_orderkey").cast("string")).alias("image"), (F.col("o_custkey") % 10 != 0).alias("has_file")), boxes(T))
    .withColumn("imbalance", F.round("imbalance", 6)).drop("imbalanced"))
R.query("filter_by_scale", with_views(f"""
WITH i AS (SELECT 'img_' || o_orderkey AS image FROM orders), s AS (SELECT image, max({AREA}) AS big, min({AREA}) AS small, count(*) AS n FROM boxes GROUP BY image)
SELECT i.image, CASE WHEN big IS NULL THEN 'negative' WHEN big > 1.2345 THEN 'too_big' WHEN small < 0.00123 THEN 'too_small' ELSE 'fits' END AS reason, coalesce(n, 0) AS instances FROM i LEFT JOIN s USING (image)""", "boxes"))(
    lambda T: ds.filter_by_scale(boxes(T), T.orders.select(F.concat(F.lit("img_"), F.col("o_orderkey").cast("string")).alias("image")), 1.2345, 0.00123).select("image", "reason", "instances"))
R.query("mix_ratio", "SELECT count(*) AS records, count(*) FILTER (quality = 1) AS normals, round(count(*) FILTER (quality = 1) / count(*)::DOUBLE, 6) AS share FROM labels")(
    lambda T: ds.mix_ratio(T.labels, F.col("quality") == 1).select("records", "normals", F.round("share", 6).alias("share")))

# ── sampling ─────────────────────────────────────────────────────────────────
R.query("first_n", with_views("SELECT event_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, event_id) AS n FROM ev) z WHERE n <= 400", "ev"))(
    lambda T: ds.first_n(T.ev, ["source"], ["t", "event_id"], 400).select("event_id", "source"))
R.query("top_k", with_views("SELECT event_id, score FROM ev ORDER BY score DESC, event_id LIMIT 25", "ev"))(lambda T: ds.top_k(T.ev, "score", 25, ["event_id"]).select("event_id", "score"))
R.query("cap_per_category", with_views("""
SELECT category, least(count(*), CASE WHEN category = 'Normal' THEN 70 ELSE 40 END) AS n FROM items GROUP BY category""", "items"))(
    lambda T: ds.cap_per_category(T.items, 40, 70, 3, normal=F.col("category") == "Normal").groupBy("category").agg(F.count("*").alias("n")))
R.query("split")(lambda T: ds.split(T.items, {"val": 0.15, "test": 0.15}, 1).select("item_id", "split"))
R.query("weighted_sample", with_views("""
WITH line AS (SELECT item_id, CAST(floor(duration * 1000) AS DOUBLE) AS w, sum(CAST(floor(duration * 1000) AS DOUBLE)) OVER (ORDER BY item_id) AS hi FROM items WHERE floor(duration * 1000) > 0),
d AS (SELECT o_orderkey AS draw_no, ((o_custkey * 7919 + o_orderkey) % 10007 + 0.5) / 10007 * (SELECT max(hi) FROM line) AS at FROM orders)
SELECT item_id, draw_no FROM d ASOF JOIN (SELECT item_id, hi - w AS lo FROM line) l ON d.at >= l.lo""", "items"))(
    lambda T: ds.weighted_sample(T.items.withColumn("w", F.floor(F.col("duration") * 1000)), "w", 0, draws=T.orders.select(
        F.col("o_orderkey").alias("draw_no"), (((F.col("o_custkey") * 7919 + F.col("o_orderkey")) % 10007 + 0.5) / 10007).alias("u"))).select("item_id", "draw_no"))
ALIAS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.CATEGORY_ALIASES.items())
KNOWN = ", ".join(f"'{k}'" for k in dims.CATEGORY_TARGETS)
TGT = ", ".join("('%s', '%s')" % (k, (d + "\n" + "INCIDENT: " + i).replace("'", "''").replace("\n", "' || chr(10) || '")) for k, (d, i) in dims.CATEGORY_TARGETS.items())
R.query("build_sft_records", with_views(f"""
WITH n AS (SELECT item_id, category, CASE WHEN category IN ({KNOWN}) THEN category ELSE coalesce(CASE replace(lower(category), ' ', '_') {ALIAS} END, 'Normal') END AS target_category,
  NOT (category IN ({KNOWN}) OR (CASE replace(lower(category), ' ', '_') {ALIAS} END) IS NOT NULL) AS unrecognised FROM items)
SELECT item_id, category, n.target_category, response, unrecognised FROM n JOIN (VALUES {TGT}) t(target_category, response) ON t.target_category = n.target_category""", "items"))(
    lambda T: ds.build_sft_records(T.items).select("item_id", "category", "target_category", "response", "unrecognised"))

# ── embeddings as clip features, predictions, thumbnails ─────────────────────
add_view("thumbs", ["embeddings"], "SELECT vec_id AS frame_id, vec_id % 4 AS source, CAST(floor(vec_id / 4) AS DOUBLE) AS t, label FROM embeddings")


def thumbs(T):
    v = T.embeddings.select(F.col("vec_id").alias("frame_id"), F.transform("embedding", lambda x: F.round(x.cast("double") * 20 + 100, 0)).alias("vec"))
    return T.thumbs.join(v, "frame_id")


R.query("drop_near_duplicates", with_views("""
WITH v AS (SELECT t.*, list_transform(e.embedding, lambda x: round(x::DOUBLE * 20 + 100, 0)) AS vec, row_number() OVER (PARTITION BY source ORDER BY t, frame_id) AS k FROM thumbs t JOIN embeddings e ON e.vec_id = t.frame_id),
r AS (SELECT source, k, frame_id, vec, TRUE AS keep FROM v WHERE k = 1
 UNION ALL SELECT n.source, n.k, n.frame_id, CASE WHEN list_avg(list_transform(list_zip(n.vec, r.vec), lambda z: abs(z[1] - z[2]))) < 2.5 THEN r.vec ELSE n.vec END,
   list_avg(list_transform(list_zip(n.vec, r.vec), lambda z: abs(z[1] - z[2]))) >= 2.5 FROM r JOIN v n ON n.source = r.source AND n.k = r.k + 1)
SELECT source, frame_id FROM r WHERE keep""", "thumbs", recursive=True))(lambda T: ds.drop_near_duplicates(thumbs(T), 2.5).select("source", "frame_id"))
R.query("mine_negatives")(lambda T: ds.mine_negatives(
    thumbs(T), T.thumbs.groupBy("source").agg(F.min("t").alias("from_t"), F.max("t").alias("to_t")),
    T.thumbs.filter("label = 0").select("source", F.col("t").alias("start"), (F.col("t") + 1).alias("end")), 2.0, None, 2.5).drop("vec"))
add_view("preds", ["lineitem"], """SELECT l_orderkey * 10 + l_linenumber AS clip_id, l_partkey % 8 AS y_true, (l_partkey + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END) % 8 AS y_pred, l_tax AS loss FROM lineitem""")
R.query("confusion", with_views("SELECT y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL", "preds"))(lambda T: me.confusion(T.preds))
CMX = """s AS (SELECT y_true AS cls, count(*) AS support, count(*) FILTER (y_true = y_pred) AS tp FROM preds GROUP BY y_true), q AS (SELECT y_pred AS cls, count(*) AS predicted FROM preds GROUP BY y_pred),
m AS (SELECT cls, support, CASE WHEN coalesce(predicted, 0) > 0 THEN tp / predicted::DOUBLE ELSE 0 END AS precision, tp / support::DOUBLE AS recall FROM s LEFT JOIN q USING (cls)),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""
R.query("class_metrics", with_views("WITH " + CMX + " SELECT cls, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f", "preds"))(
    lambda T: me.class_metrics(T.preds).select("cls", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]))
R.query("overall_metrics", with_views("WITH " + CMX + " SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(loss), 6) AS loss, (SELECT round(avg(f1), 6) FROM f) AS macro_f1 FROM preds", "preds"))(
    lambda T: me.overall_metrics(T.preds).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "loss", "macro_f1")]))
R.query("false_crime_rate", with_views("""
SELECT count(*) AS normal_clips, count(*) FILTER (y_pred NOT IN (0, 7)) AS misflagged, round(count(*) FILTER (y_pred NOT IN (0, 7)) / count(*)::DOUBLE, 6) AS rate,
 count(*) FILTER (y_pred NOT IN (0, 7)) / count(*)::DOUBLE > 0.05 AS too_high FROM preds WHERE y_true = 0""", "preds"))(
    lambda T: me.false_crime_rate(T.preds, 0, [0, 7]).withColumn("rate", F.round("rate", 6)))
R.query("class_weights", with_views("SELECT label, n, round(tot / (k * n)::DOUBLE, 6) AS weight FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS tot, count(*) OVER () AS k FROM ann GROUP BY label) z", "ann"))(
    lambda T: me.class_weights(ann(T)).withColumn("weight", F.round("weight", 6)))
R.query("misclassified", with_views("SELECT clip_id, y_true, y_pred FROM preds WHERE y_true <> y_pred ORDER BY clip_id, y_true, y_pred LIMIT 10", "preds"))(
    lambda T: me.misclassified(T.preds, 10).select("clip_id", "y_true", "y_pred"))
TH = ", ".join(f"({t}::DOUBLE)" for t in dims.SWEEP_THRESHOLDS)
R.query("sweep_negatives", with_views(f"""
WITH s AS (SELECT source * 1000000 + frame_no AS frame_id, cls AS class_id, confidence AS score FROM det WHERE cls IN ('knife', 'chair')), th(threshold) AS (VALUES {TH}),
n AS (SELECT count(DISTINCT source * 1000000 + frame_no) AS frames FROM det), h AS (SELECT * FROM th JOIN s ON score >= threshold),
a AS (SELECT threshold, count(DISTINCT frame_id) AS frames_hit, count(*) AS detections FROM h GROUP BY threshold),
w AS (SELECT threshold, class_id, count(*) AS c, row_number() OVER (PARTITION BY threshold ORDER BY count(*) DESC, class_id) AS r FROM h GROUP BY threshold, class_id)
SELECT th.threshold, frames, coalesce(frames_hit, 0) AS frames_hit, coalesce(detections, 0) AS detections, round(100.0 * coalesce(frames_hit, 0) / frames, 6) AS rate, w.class_id AS worst_class, w.c AS worst_n
FROM th CROSS JOIN n LEFT JOIN a ON a.threshold = th.threshold LEFT JOIN w ON w.threshold = th.threshold AND r = 1""", "det"))(
    lambda T: me.sweep_negatives(T.det.filter("cls IN ('knife', 'chair')").select((F.col("source") * 1000000 + F.col("frame_no")).alias("frame_id"), F.col("cls").alias("class_id"), F.col("confidence").alias("score")),
                                 T.det.select("source", "frame_no").distinct()).withColumn("rate", F.round("rate", 6)).drop("usable"))
SPAN = """sp AS (SELECT ann_id AS span_id, ann_id % 8 AS source, start AS a, span_end AS b FROM ann WHERE label = 'assault'), sc AS (SELECT source, t, confidence AS score FROM det WHERE cls = 'knife'),
x AS (SELECT span_id, s.source, t, max(score) AS best FROM sc s JOIN sp ON sp.source = s.source AND t >= a AND t < b GROUP BY ALL)"""


def spans_scores(T):
    s = T.det.filter("cls = 'knife'").select("source", "t", F.col("confidence").alias("score"))
    p = ann(T).filter("label = 'assault'").select(F.col("ann_id").alias("span_id"), (F.col("ann_id") % 8).alias("source"), F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    return s, p


R.query("samples_in_spans", with_views("WITH " + SPAN + " SELECT * FROM x", "ann", "det"))(lambda T: me.samples_in_spans(*spans_scores(T)))
R.query("sweep_positives", with_views("WITH " + SPAN + f", th(threshold) AS (VALUES {TH}) SELECT span_id, threshold, count(*) AS frames, count(*) FILTER (best >= threshold) AS hits FROM x CROSS JOIN th GROUP BY ALL", "ann", "det"))(
    lambda T: me.sweep_positives(*spans_scores(T)))
MT = """v AS (SELECT event_id AS window_id, source, t AS centre, score FROM ev WHERE score >= 0.5), tr AS (SELECT ann_id AS truth_id, ann_id % 8 AS source, start AS tt FROM ann WHERE label = 'assault'),
m AS (SELECT window_id, truth_id FROM v JOIN tr ON tr.source = v.source AND abs(centre - tt) <= 2)"""


def matched(T):
    return me.match_truth(T.ev.select(F.col("event_id").alias("window_id"), "source", F.col("t").alias("centre"), F.col("type").alias("verdict"), "score"),
                          ann(T).filter("label = 'assault'").select(F.col("ann_id").alias("truth_id"), (F.col("ann_id") % 8).alias("source"), F.col("start").alias("truth_t")))


R.query("match_truth", with_views("WITH " + MT + " SELECT window_id, source, window_id IN (SELECT window_id FROM m) AS hit FROM v", "ev", "ann"))(lambda T: matched(T)[0].select("window_id", "source", "hit"))
R.query("sweep_prf", with_views("WITH " + MT + """, c AS (SELECT (SELECT count(*) FROM tr) AS incidents, (SELECT count(DISTINCT truth_id) FROM m) AS detected, (SELECT count(*) FROM v WHERE window_id NOT IN (SELECT window_id FROM m)) AS fp)
SELECT incidents, detected, incidents - detected AS missed, fp AS false_positives, round(detected / (detected + fp)::DOUBLE, 6) AS precision, round(detected / incidents::DOUBLE, 6) AS recall FROM c""", "ev", "ann"))(
    lambda T: me.sweep_prf(*matched(T)).select("incidents", "detected", "missed", "false_positives", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")))
KNN = """x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IN (0, 1)), b AS (SELECT vec_id AS bid, embedding::DOUBLE[] AS be FROM embeddings WHERE label >= 2),
d AS (SELECT vec_id, label, list_dot_product(e, be) / ((sqrt(list_dot_product(e, e)) + 1e-8) * (sqrt(list_dot_product(be, be)) + 1e-8)) AS s FROM x CROSS JOIN b),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS n FROM d), kd AS (SELECT vec_id, label, round(1 - avg(s), 6) AS distance FROM k WHERE n <= 8 GROUP BY ALL)"""


def distances(T):
    x = T.embeddings.filter("label IN (0, 1)").select("vec_id", "label", "embedding")
    return me.knn_distance(x, T.embeddings.filter("label >= 2")).withColumn("distance", F.round("distance", 6))


R.query("knn_distance", "WITH " + KNN + " SELECT vec_id, label, distance FROM kd")(distances)
R.query("auc", "WITH " + KNN + """ SELECT round(avg(CASE WHEN p.distance > n.distance THEN 1.0 WHEN p.distance = n.distance THEN 0.5 ELSE 0 END), 6) AS auc FROM kd p JOIN kd n ON p.label = 0 AND n.label = 1""")(
    lambda T: me.auc(distances(T).withColumn("positive", F.col("label") == 0), "distance").select(F.round("auc", 6).alias("auc")))
R.query("span_scores", "WITH " + KNN + """, s AS (SELECT vec_id % 20 AS span_id, label = 0 AS incident, distance FROM kd), nm AS (SELECT median(distance) AS m FROM s WHERE NOT incident)
SELECT span_id, incident, count(*) AS windows, round(max(distance), 6) AS "max", round(median(distance), 6) AS median, incident AND median(distance) > any_value(m) + 1e-12 AS above_normal FROM s CROSS JOIN nm GROUP BY span_id, incident""")(
    lambda T: me.span_scores(distances(T).select((F.col("vec_id") % 20).alias("span_id"), (F.col("label") == 0).alias("incident"), "distance"))
    .select("span_id", "incident", "windows", F.round("max", 6).alias("max"), F.round("median", 6).alias("median"), (F.col("incident") & (F.col("median") > F.col("normal_median") + 1e-12)).alias("above_normal")))
R.query("hold_out", """
WITH b AS (SELECT vec_id, label % 5 AS video, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE vec_id % 40 END AS a, vec_id % 40 + 3 AS b FROM embeddings), s AS (SELECT vec_id AS span_id, vec_id % 5 AS video, vec_id % 30 AS st FROM embeddings)
SELECT s.span_id, b.vec_id FROM b JOIN s ON s.video = b.video WHERE a IS NULL OR (a < st + 5 AND b > st)""")(
    lambda T: me.hold_out(T.embeddings.select("vec_id", (F.col("label") % 5).cast("long").alias("video"), F.when(F.col("vec_id") % 9 != 0, F.col("vec_id") % 40).alias("a"), (F.col("vec_id") % 40 + 3).alias("b")),
                          T.embeddings.select(F.col("vec_id").alias("span_id"), (F.col("vec_id") % 5).alias("video"), (F.col("vec_id") % 30).alias("start"), (F.col("vec_id") % 30 + 5).alias("end"))).select("span_id", "vec_id"))
