"""Structured Streaming forms of the rules.

Event time is ``event_ts``; ``t`` is the same instant in seconds. Rules that depend on order run
through ``replay``: rows are held until the watermark has passed them and folded in event-time
order, so late rows within the watermark give the result of the batch rule. State is keyed by
source and class, type or pair where the rule allows it, and by source where it is about all of it.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from framelore import dims
from framelore.config import DEFAULTS, RuleConfig
from framelore.functions import expr
from framelore.operators import captions, rules, tracks as tr
from framelore.sources import files
from framelore.streaming.ordered import replay


def feed(spark: SparkSession, path: str, delay: str = "10 seconds", schema: str | None = None, files_per_batch: int = 100) -> DataFrame:
    """Detections with a watermark; repeats of a detection within it are dropped."""
    raw = files.read_feed(spark, path, schema, files_per_batch) if schema else files.read_feed(spark, path, files_per_batch=files_per_batch)
    return raw.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["source", "det_id"])


def crowd_stream(counts: DataFrame, cfg: RuleConfig = DEFAULTS) -> DataFrame:
    """``crowd_events`` of a stream of frames (source, frame_no, t, event_ts, people).

    The state of a source is the ring of its counts within the window and how many frames it has had.
    """
    def fold(key: tuple, rows: pd.DataFrame, memo: dict | None, mark: float) -> tuple[list[tuple], dict]:
        ring, seen = (memo["ring"], memo["seen"]) if memo else ([], 0)
        out = []
        micros = lambda t: round(t * 1_000_000)
        for t, frames in rows.groupby("t", sort=True):
            ring = [r for r in ring if micros(r[0]) >= micros(t) - round(cfg.crowd_window_s * 1_000_000)]
            ring += [[float(t), int(p)] for p in frames["people"]]
            peak = max(p for _, p in ring)
            for no, people in zip(frames["frame_no"], frames["people"]):
                seen += 1
                if seen >= 5 and len(ring) >= 3:
                    out.append((key[0], no, float(t), ring[0][1], peak, people))
        return out, {"ring": ring, "seen": seen}

    frames = replay(counts.select("source", "frame_no", "t", "event_ts", F.col("people").cast("long").alias("people")), ["source"], ["frame_no"],
                    T.StructType([counts.schema["source"], counts.schema["frame_no"], T.StructField("t", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in ("first", "peak", "last")]]),
                    fold, idle_s=None)
    return rules.crowd_changes(frames, cfg)


def incident_stream(events: DataFrame, gap_s: float = 20.0) -> DataFrame:
    """Incidents as event-time sessions per source and type; an event just ``gap_s`` after the last one still belongs to it."""
    gap = f"{round(gap_s * 1_000_000) + 1} microseconds"
    rank = expr.severity_rank(F.col("severity"))
    return (events.groupBy("source", "type", F.session_window("event_ts", gap).alias("s"))
            .agg(F.count("*").alias("count"), F.max("score").alias("peak_score"), F.max(rank).alias("severity_rank"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
            .select("source", "type", "count", "peak_score", expr.severity_name(F.col("severity_rank")).alias("severity"), "first_t", "last_t"))


def cooldown_stream(events: DataFrame, gap: float, keys: list[str] = ["source", "cooldown_key"]) -> DataFrame:
    """``min_gap`` of a stream, late events within the watermark included; a key is forgotten once its gap is over."""
    cols = events.columns

    def fold(key: tuple, rows: pd.DataFrame, last: float | None, mark: float) -> tuple[list[tuple], float]:
        keep = []
        for i, t in enumerate(rows["t"]):
            if last is None or t - last >= gap:
                keep.append(i)
                last = float(t)
        return list(rows.iloc[keep][cols].itertuples(index=False, name=None)), last

    return replay(events, keys, ["t", "event_id"], events.schema, fold, idle_s=gap)


TRACK_OUT = "source long, cls string, det_id long, track_id long, tick long, t double, x1 double, y1 double, x2 double, y2 double, anchor_t double, dwell double, dwell_alert boolean"
#: Classes whose trackers follow the frame ticks.
TRACKED = tuple(sorted({"person", *dims.VEHICLES, *dims.ABANDONABLE}))


def track_stream(rows: DataFrame, cfg: RuleConfig = DEFAULTS, ticks: DataFrame | None = None, classes: Sequence[str] = TRACKED, history: int = 60) -> DataFrame:
    """Tracker with dwell, per source and class. ``rows`` carry ``tick``, the number of the processed frame.

    ``ticks`` (source, tick, t, event_ts) has every processed frame, also those where nothing was
    found: a track is given up by the frames it missed, never by seconds, and a tracker without
    live tracks is forgotten. Without ``ticks`` a tracker is kept. Each tick goes to the trackers of ``classes``.
    ``dwell_alert`` marks the first row at which a track has stayed for the
    loitering time, its last ``history`` points together (people), or the unattended time (bags).
    """
    reach = cfg.track_max_misses + 1
    need = ["source", "cls", "tick", "t", "event_ts", "det_id", *expr.BOX, "frame_w", "frame_h"]
    every = rows.select(*need)
    if ticks is not None:
        empty = [F.lit(None).cast(every.schema[c].dataType).alias(c) for c in need[5:]]
        every = every.unionByName(ticks.select("source", F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls"), "tick", "t", "event_ts", *empty))

    def fold(key: tuple, pdf: pd.DataFrame, saved: list | None, mark: float) -> tuple[list[tuple], list | None]:
        saved = saved or []
        live = {int(s["last"]): (s["tick"], s["box"]) for s in saved}
        memo = {int(s["last"]): s for s in saved}
        person = key[1] == "person"
        limit = cfg.loiter_s if person else cfg.unattended_s if key[1] in dims.ABANDONABLE else float("inf")
        out = []
        found = pdf[pdf["det_id"].notna()]
        info = {int(r.det_id): r for r in found.itertuples(index=False)}
        for tick, frame in tr.frames_of(found):
            for det_id, best in tr.match_frame(live, tick, frame, cfg.track_iou, reach):
                r = info[det_id]
                c = [(r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2]
                m = memo.pop(best) if best is not None else {"root": det_id, "anchor": [*c, float(r.t)], "fired": False, "tail": []}
                diag = float(np.hypot(r.frame_w, r.frame_h))
                if np.hypot(c[0] - m["anchor"][0], c[1] - m["anchor"][1]) / diag > cfg.anchor_reset:
                    m.update(anchor=[*c, float(r.t)], fired=False)
                m["tail"] = (m["tail"] + [c])[-history:]
                dwell = float(r.t) - m["anchor"][2]
                together = not person or max(np.hypot(x - m["anchor"][0], y - m["anchor"][1]) for x, y in m["tail"]) / diag <= cfg.loiter_spread
                alert = bool(not m["fired"] and dwell >= limit and together)
                m["fired"] = m["fired"] or alert
                memo[det_id] = m
                out.append((key[0], key[1], det_id, m["root"], int(tick), float(r.t), r.x1, r.y1, r.x2, r.y2, m["anchor"][2], dwell, bool(alert)))
        now = int(pdf["tick"].max()) if len(pdf) else 0
        keep = [{**memo[i], "last": i, "tick": int(k), "box": [float(x) for x in b]} for i, (k, b) in live.items() if now - k <= reach]
        return out, keep or None

    return replay(every, ["source", "cls"], ["tick", "det_id"], TRACK_OUT, fold, idle_s=None)


def contact_stream(touches: DataFrame, cfg: RuleConfig = DEFAULTS) -> DataFrame:
    """Settled contacts per pair: one row at the first touch at least ``collision_settle_s`` after it began, or at its silence; a later one starts anew.

    ``touches``: source, a_track_id, b_track_id, t, event_ts. The settled contact
    is judged on its motion by ``collisions`` in ``foreachBatch``.
    """
    schema = "source long, a_track_id long, b_track_id long, start_t double, contact_frames int"

    def fold(key: tuple, rows: pd.DataFrame, memo: dict | None, mark: float) -> tuple[list[tuple], dict | None]:
        m, out = memo, []

        def settle() -> None:
            if m is not None and not m["done"]:
                m["done"] = True
                if m["frames"] >= cfg.collision_frames:
                    out.append((*key, m["start"], m["frames"]))

        for t in map(float, rows["t"] if len(rows) else ()):
            if m is not None and t - m["last"] > cfg.collision_silence_s:
                settle()
                m = None
            if m is None:
                m = {"start": t, "last": t, "frames": 0, "done": False}
            if not m["done"]:
                m["frames"] += 1  # the judging frame counts too
                if t - m["start"] >= cfg.collision_settle_s:
                    settle()
            m["last"] = t
        if m is not None and mark > m["last"] + cfg.collision_silence_s:
            settle()
            m = None
        return out, m and {**m, "due": m["last"] + cfg.collision_silence_s + 0.001}

    return replay(touches, ["source", "a_track_id", "b_track_id"], [], schema, fold, idle_s=None)


SNATCH_OUT = "source long, v_id long, p_id long, frame_no long, t double, contact_s double, approach double, departure double, diag double, ratio double, v_cls string"


def snatch_stream(samples: DataFrame, cfg: RuleConfig = DEFAULTS, idle_s: float = 600.0) -> DataFrame:
    """``snatch_trajectory`` of a stream of pair samples (``tracks.pair_samples`` with event_ts).

    A pair goes from approach to contact to separation, and is judged once it has been
    watched for ``snatch_watch_s`` after that; it fires at most once, which is remembered until the pair has not
    been seen for ``idle_s``: a track that was given up never comes back.
    """
    def fold(key: tuple, rows: pd.DataFrame, memo: dict | None, mark: float) -> tuple[list[tuple], dict]:
        pair, peak, fired = (memo["pair"], memo["peak"], memo["fired"]) if memo else (None, 0.0, False)
        out = []
        for r in rows.itertuples(index=False):
            if fired:
                break
            before = pair
            pair, judged = tr.judge_pair(pair, float(r.t), None if pd.isna(r.close) else bool(r.close), float(r.approach), cfg)
            apart = judged is not None or (pair is not None and pair["apart"] is not None)
            fresh = apart and (before is None or before["apart"] is None)
            peak = (float(r.speed) if fresh else max(peak, float(r.speed))) if apart else 0.0
            if judged is not None:
                ratio = peak / r.diag / judged[3]
                if ratio >= cfg.snatch_ratio:
                    fired = True
                    out.append((*key, r.frame_no, judged[1], judged[2], judged[3], peak, r.diag, ratio, r.v_cls))
        return out, {"pair": pair, "peak": peak, "fired": fired}

    return tr.snatch_events(replay(samples, tr.PAIR, ["frame_no"], SNATCH_OUT, fold, idle_s=idle_s), cfg)


def corroborate_stream(hits: DataFrame, signals: DataFrame) -> DataFrame:
    """``corroborate`` of two streams: each caption hit with the last signals of its source, however long ago.

    Hits and signals (source, t, event_ts, classes, actions, people) meet in event-time order; signals at the
    instant of a hit count. A source's state is its newest signals alone.
    """
    sig = T.StructType([signals.schema[c] for c in ("t", "classes", "actions", "people")])
    hit = T.StructType([f for f in hits.schema.fields])
    both = (signals.select("source", "t", "event_ts", F.lit(0).alias("side"), F.to_json(F.struct(*sig.names)).alias("body"))
            .unionByName(hits.select("source", "t", "event_ts", F.lit(1).alias("side"), F.to_json(F.struct(*hit.names)).alias("body"))))

    def fold(key: tuple, rows: pd.DataFrame, newest: str | None, mark: float) -> tuple[list[tuple], str | None]:
        out = []
        for side, body in zip(rows["side"], rows["body"]):
            if side:
                out.append((body, newest))
            else:
                newest = body
        return out, newest

    met = replay(both, ["source"], ["t", "side"], "hit string, sig string", fold, idle_s=None)
    return captions.corroborated(met.select(F.from_json("hit", hit).alias("h"), F.from_json("sig", sig).alias("sig")).select("h.*", "sig"))


def registry_stream(sightings: DataFrame, root: str, **kw) -> Callable:
    """A ``foreachBatch`` function that enrols and matches sightings and writes a new registry snapshot.

    A retried batch starts from the registry before it and replaces its own links.
    """
    from framelore.operators import identity

    def apply(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        old = files.load_registry(spark, root, before=no)
        links, reg = identity.resolve_entities(batch, old, **kw)
        links.write.mode("overwrite").parquet(f"{root}/links/batch={no}")
        reg = reg.withColumn("first_seen", F.timestamp_seconds("first_t")).withColumn("last_seen", F.timestamp_seconds("last_t")).drop("first_t", "last_t")
        if old is not None and "first_seen" in old.columns:
            seen = old.select("entity_id", F.col("first_seen").alias("_f"), F.col("last_seen").alias("_l"))
            reg = (reg.join(seen, "entity_id", "left").withColumn("first_seen", F.coalesce("_f", "first_seen"))
                   .withColumn("last_seen", F.coalesce("last_seen", "_l")).drop("_f", "_l"))
        files.save_registry(reg, root, no)
    return apply


def alert_sink(events: DataFrame, path: str, checkpoint: str, on_event: Callable[[DataFrame], None] | None = None):
    """Append alerts and their counters; each batch is written under its number, so a retry replaces it."""
    def apply(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/alerts/batch={no}")
        (batch.groupBy("severity", "type").agg(F.count("*").alias("n"))).write.mode("overwrite").parquet(f"{path}/counters/batch={no}")
        if on_event is not None:
            on_event(batch)
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def live_counts(events: DataFrame) -> DataFrame:
    """Running counts for an ``update`` mode sink."""
    return events.groupBy("severity", "type").agg(F.count("*").alias("n"))


def with_live_config(path: str, apply: Callable[[DataFrame, RuleConfig], None], base: RuleConfig = DEFAULTS) -> Callable:
    """A ``foreachBatch`` function that reads the thresholds anew for every batch.

    ``path`` holds JSON lines of settings, the last one in force per key; unknown
    keys are ignored.
    """
    def run(batch: DataFrame, _no: int) -> None:
        spark = batch.sparkSession
        rows = spark.read.schema("key string, value string, set_no long").json(path)
        latest = rows.groupBy("key").agg(F.max_by("value", "set_no").alias("value")).filter(F.col("key").isin(list(RuleConfig.__dataclass_fields__)))
        patch = {r.key: json.loads(r.value) for r in latest.collect()}   # at most one row per setting
        apply(batch, base.patched(**patch))
    return run
