"""Files, registries, logs and feeds written and read again, and the helpers around metrics."""
from pyspark.sql import functions as F

from contract import data, text
from contract.base import Registry, with_views
from contract.flows import folder
from contract.live import feeds, finished, timed
from framelore.operators import captions as cap, frames as fr, metrics as me
from framelore.sources import files
from framelore.streaming import live

R = Registry()


def jsonl(T):
    p = folder(T, "jsonl")
    files.write_jsonl(T.ann.select("ann_id", "label", "split"), p)
    return T.spark.read.schema("ann_id long, label string, split string").json(p)


R.query("write_jsonl", with_views("SELECT ann_id, label, split FROM ann", "ann"))(jsonl)


def candidates(T):
    p = folder(T, "candidates")
    rows = T.ann.select(F.col("ann_id").alias("source"), "start", F.col("span_end").alias("end"), F.when(F.col("label") == "normal", "normal").otherwise("").alias("label"),
                        ((F.col("ann_id") % 16) / 4).alias("score"), (F.col("ann_id") % 5).alias("people_max"))
    files.write_candidates(rows, p)
    return T.spark.read.option("header", True).schema("video string, start string, end string, label string, split string, notes string").csv(p).fillna("", ["label"])


R.query("write_candidates", with_views("""
SELECT CAST(ann_id AS VARCHAR) AS video, printf('%.2f', start) AS start, printf('%.2f', span_end) AS "end", CASE WHEN label = 'normal' THEN 'normal' ELSE '' END AS label, 'train' AS split,
       CASE WHEN label = 'normal' THEN 'auto-negative score=' || printf('%.2f', (ann_id % 16) / 4.0) || ' — confirm nothing happens here'
            ELSE 'CANDIDATE score=' || printf('%.2f', (ann_id % 16) / 4.0) || ' people=' || ann_id % 5 || ' — watch and label or delete' END AS notes FROM ann""", "ann"))(candidates)


def conversation_log(T):
    p = folder(T, "conversations")
    log = T.events.select("event_id", F.col("event_type").alias("kind"), F.col("ts").alias("tstamp"), F.element_at(F.array(*[F.lit(x) for x in ("chat", "upvote", "flag", "poke")]), (F.col("event_id") % 4 + 1).cast("int")).alias("type"))
    files.write_conv_log(log, p)
    back = T.spark.read.schema("event_id long, kind string, given_type string, type string, date date").json(p)
    return back.groupBy(F.col("date").cast("string").alias("date"), "type", "given_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


R.query("write_conv_log", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CASE event_id % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'upvote' WHEN 2 THEN 'flag' ELSE 'quarantined' END AS type,
       CASE WHEN event_id % 4 = 3 THEN 'poke' END AS given_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL""")(conversation_log)


def log_appended(T):
    p = folder(T, "log")
    for part in range(3):
        files.append_log(T.ev.filter(F.col("event_id") % 3 == part).select("event_id", "source"), p)
    return T.spark.read.parquet(p).groupBy("source").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


R.query("append_log", with_views("SELECT source, count(*) AS n, max(event_id) AS last FROM ev GROUP BY source", "ev"))(log_appended)


def scan_cached(T):
    p = folder(T, "scan")
    scan = T.det.groupBy("source", "cls").agg(F.count("*").alias("n"))
    files.cached(scan, p)
    return files.cached(scan.filter("source < 0"), p)  # the second scan never runs


R.query("scan_cache", with_views("SELECT source, cls, count(*) AS n FROM det GROUP BY ALL", "det"))(scan_cached)


def registry_saved(T):
    p = folder(T, "registry")
    people = T.ents.select("entity_id", "kind", "label")
    files.save_registry(people, p)
    files.save_registry(people.filter("kind = 'vehicle'"), p, 4)
    return files.load_registry(T.spark, p).unionByName(files.load_registry(T.spark, p, before=4).filter("kind = 'person'"))


R.query("registry_round_trip", with_views("SELECT entity_id, kind, label FROM ents", "ents"))(registry_saved)


def registry_read(T):
    p = folder(T, "cameras")
    entry = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    named = T.nation.agg(F.concat_ws(",", F.collect_list(F.concat(F.lit('"cam'), F.col("n_nationkey").cast("string"), F.lit('":'), entry))).alias("e"))
    named.select(F.concat(F.lit('{"_note":{"name":"kept by hand"},'), "e", F.lit("}"))).coalesce(1).write.text(p)
    return files.read_registry(T.spark, p, "name string, region long")


R.query("read_registry", "SELECT 'cam' || n_nationkey AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")(registry_read)


def fed(T):
    """The detection feed with every tenth file row sent twice, to the end."""
    p = folder(T, "feed")
    det = T.det.select("det_id", "source", "frame_no", "t", "cls", F.timestamp_seconds(F.col("t") + 86400).alias("event_ts"))
    det.unionByName(det.filter("det_id % 10 = 0")).write.parquet(p)
    stream = live.feed(T.spark, p, "10 seconds", det.schema)
    return finished(T, stream.select("det_id", "source", "frame_no", "cls"))


R.query("feed", with_views("SELECT det_id, source, frame_no, cls FROM det", "det"))(fed)


def sunk(T):
    p = folder(T, "alerts")
    events = timed(feeds(T), feeds(T).ev.select("event_id", "source", "t", "severity", "type"))
    live.alert_sink(events, p, f"{p}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = T.spark.read.parquet(f"{p}/alerts").filter("source >= 0")
    return kept.groupBy("severity", "type").agg(F.count("*").alias("n")).join(T.spark.read.parquet(f"{p}/counters").groupBy("severity", "type").agg(F.sum("n").alias("counted")), ["severity", "type"])


R.query("alert_sink", with_views("SELECT severity, type, count(*) AS n, count(*) AS counted FROM ev GROUP BY severity, type", "ev"))(sunk)


# ── helpers of metrics ───────────────────────────────────────────────────────
R.query("sample_weights", with_views("""
WITH c AS (SELECT label, count(*) AS n FROM ann GROUP BY label)
SELECT ann_id, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 6) AS weight FROM ann JOIN c USING (label)""", "ann"))(
    lambda T: me.sample_weights(data.ann(T)).select("ann_id", F.round("weight", 6).alias("weight")))


def swept(T):
    shots = T.det.filter("cls IN ('knife', 'chair')").select((F.col("source") * 1000000 + F.col("frame_no")).alias("frame_id"), F.col("cls").alias("class_id"), F.col("confidence").alias("score"))
    return me.sweep_verdict(me.sweep_negatives(shots, T.det.select("source", "frame_no").distinct(), max_rate=90.0), me.sweep_positives(*data.spans_scores(T)))


R.query("sweep_verdict", with_views("WITH " + data.SPAN + f""", th(threshold) AS (VALUES {data.TH}),
f AS (SELECT DISTINCT source, frame_no FROM det), r AS (SELECT threshold, 100.0 * count(DISTINCT (d.source, d.frame_no)) / (SELECT count(*) FROM f) AS rate
      FROM th LEFT JOIN det d ON d.confidence >= threshold AND d.cls IN ('knife', 'chair') GROUP BY threshold),
u AS (SELECT min(threshold) AS usable_conf FROM r WHERE rate <= 90),
h AS (SELECT count(*) FILTER (n > 0) AS hit, count(*) AS spans FROM (SELECT span_id, count(*) FILTER (best >= (SELECT usable_conf FROM u)) AS n FROM x GROUP BY span_id) z)
SELECT usable_conf, CASE WHEN usable_conf IS NULL THEN 0 ELSE hit END AS spans_hit, CASE WHEN usable_conf IS NULL THEN 0 ELSE spans END AS spans,
       CASE WHEN usable_conf IS NULL THEN 'unusable' WHEN spans > 0 AND hit = 0 THEN 'blind' ELSE 'usable' END AS verdict FROM u CROSS JOIN h""", "ann", "det"))(swept)
R.query("format_summary", with_views(f"""
WITH a AS (SELECT source % 2 = 1 AS incident, {text.VERDICT} AS v FROM cap)
SELECT incident, CAST(count(*) FILTER (v <> 'malformed' AND (v = 'flagged') = incident) AS BIGINT) AS correct, count(*) FILTER (v <> 'malformed') AS judged, count(*) FILTER (v = 'malformed') AS malformed,
       round(count(*) FILTER (v <> 'malformed' AND (v = 'flagged') = incident) / nullif(count(*) FILTER (v <> 'malformed'), 0)::DOUBLE, 6) AS accuracy FROM a GROUP BY incident""", "cap"))(
    lambda T: cap.format_summary(cap.eval_format(T.cap.select(F.col("source").alias("span_id"), F.when(F.col("source") % 2 == 0, "normal").otherwise("theft").alias("label"),
                                                              F.col("caption_id").alias("answer_no"), "text"))).withColumn("accuracy", F.round("accuracy", 6)))
R.query("top_label_per_scale", """
WITH p AS (SELECT l_orderkey % 500 AS buffer_id, CASE l_linenumber % 3 WHEN 0 THEN 100 WHEN 1 THEN 45 ELSE 20 END AS scale, l_suppkey % 7 AS back, l_partkey % 11 AS class_id, l_discount * 10 AS prob FROM lineitem)
SELECT buffer_id, CAST(scale AS BIGINT) AS scale, CAST(class_id AS VARCHAR) AS label FROM (SELECT *, row_number() OVER (PARTITION BY buffer_id, scale ORDER BY prob DESC, back, class_id) AS n FROM p) z WHERE n = 1""")(
    lambda T: fr.top_label_per_scale(T.lineitem.select((F.col("l_orderkey") % 500).alias("buffer_id"), F.when(F.col("l_linenumber") % 3 == 0, 100).when(F.col("l_linenumber") % 3 == 1, 45).otherwise(20).alias("scale"),
        (F.col("l_suppkey") % 7).alias("back"), (F.col("l_partkey") % 11).alias("class_id"), (F.col("l_partkey") % 11).cast("string").alias("label"), (F.col("l_discount") * 10).alias("prob")))
    .select("buffer_id", F.col("scale").cast("long").alias("scale"), "label"))
