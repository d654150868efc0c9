"""Tracking and everything that needs motion: speed, dwell, collisions, snatches.

Track points have ``source, track_id, cls, frame_no, t, x1..y2, frame_w, frame_h``.
Speeds are in pixels per second unless divided by the frame diagonal.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from framelore import dims
from framelore.config import DEFAULTS, RuleConfig
from framelore.functions import expr
from framelore.operators import relate, rules, slices
from framelore.session import materialise

TRACK = ["source", "track_id"]


def frame_diag():
    return expr.diagonal(F.col("frame_w"), F.col("frame_h"))


def with_ticks(rows: DataFrame, frames: DataFrame | None = None, slice_s: float = 3600.0) -> DataFrame:
    """Number the processed frames of each source 1, 2, ... and put the number on every row."""
    frames = (frames if frames is not None else rows).select("source", "frame_no", "t").distinct()
    ticks = slices.running_total(frames, ["source"], "t", slice_s, F.lit(1), "tick", ["frame_no"])
    return rows.join(ticks.select("source", "frame_no", "tick"), ["source", "frame_no"])


# ── tracker ──────────────────────────────────────────────────────────────────

def _overlap(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    inter = w * h
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def match_frame(live: dict, tick: int, frame, iou: float, reach: int) -> list[tuple[int, int | None]]:
    """Match one frame's detections (det_id, box) to the live tracks {last det id: (tick, box)}.

    Changes ``live`` and returns (det_id, matched last det id or None) in order.
    """
    for i in [i for i, v in live.items() if tick - v[0] > reach]:
        del live[i]
    free, fresh, out = sorted(live), {}, []
    for det_id, box in frame:
        best, most = None, iou
        for i in free:
            score = _overlap(live[i][1], box)
            if score > most:
                best, most = i, score
        if best is not None:
            free.remove(best)
            live.pop(best)
        fresh[det_id] = (int(tick), box)
        out.append((det_id, best))
    live.update(fresh)
    return out


def frames_of(rows: slices.Columns):
    """(tick, [(det_id, box), ...]) of each frame; rows are in (tick, det_id) order."""
    ticks, ids, boxes = np.asarray(rows["tick"]), rows["det_id"].astype(np.int64).tolist(), np.column_stack([rows[c].astype(float) for c in expr.BOX]).tolist()
    edges = [0, *(np.flatnonzero(np.diff(ticks)) + 1).tolist(), len(ticks)] if len(ticks) else [0]
    for lo, hi in zip(edges, edges[1:]):
        yield int(ticks[lo]), list(zip(ids[lo:hi], boxes[lo:hi]))


def track(dets: DataFrame, iou: float = 0.3, max_misses: int = 15, frames: DataFrame | None = None,
          slice_ticks: int = 512) -> DataFrame:
    """Greedy overlap tracker: each detection takes the best-overlapping live track of its class.

    Classes never match one another, so (source, class) is an exact split; long
    streams are split over time by ``carry_scan``. A track's state is its last
    box and the tick it was seen, so slices agree after a short warm-up. Ties in
    overlap go to the track whose last detection id is smallest. ``track_id`` is
    the id of the first detection of the track.
    """
    rows = with_ticks(dets, frames)
    schema = T.StructType([T.StructField("det_id", T.LongType()), T.StructField("head_id", T.LongType()),
                           T.StructField("open", T.BooleanType())])
    reach = max_misses + 1

    def fold(rows: slices.Columns, state):
        # live: last det id -> [tick, box]; heads: last det id -> (head, open)
        live = {int(i): (k, b) for i, k, b in (state or [])}
        heads = {i: (i, True) for i in live}
        out = []
        for tick, frame in frames_of(rows):
            for det_id, best in match_frame(live, tick, frame, iou, reach):
                heads[det_id] = (det_id, False) if best is None else heads.pop(best)
                out.append((det_id, *heads[det_id]))
        state = [[i, int(k), [float(x) for x in b]] for i, (k, b) in sorted(live.items())]
        return dict(zip(schema.names, zip(*out))) if out else dict.fromkeys(schema.names, ()), state

    def settle(state, start):
        kept = [s for s in (state or []) if start - s[1] <= reach]
        return kept or None

    links = slices.carry_scan(rows.select("source", "cls", "tick", "det_id", *expr.BOX), ["source", "cls"], "tick",
                              slice_ticks, 4 * reach, fold, schema, ["det_id"], settle=settle)
    # A track that entered its slice from an earlier one points at its last detection there.
    # Follow those pointers by doubling; only tracks that cross a slice edge take part.
    links = materialise(links, "links")
    jumps = links.select("det_id", F.col("head_id"), "open").join(
        links.filter("open").select(F.col("head_id").alias("det_id")).distinct(), "det_id")
    jumps = materialise(jumps, "jumps")
    while not jumps.filter("open").isEmpty():
        nxt = jumps.select(F.col("det_id").alias("head_id"), F.col("head_id").alias("_h"), F.col("open").alias("_o"))
        jumps = materialise(jumps.join(nxt, "head_id", "left").select(
            "det_id", F.when(F.col("open"), F.col("_h")).otherwise(F.col("head_id")).alias("head_id"),
            (F.col("open") & F.col("_o")).alias("open")), "jumps")
    roots = jumps.select(F.col("det_id").alias("head_id"), F.col("head_id").alias("_root"))
    ids = links.join(roots, "head_id", "left").select(
        "det_id", F.when(F.col("open"), F.col("_root")).otherwise(F.col("head_id")).alias("track_id"))
    return materialise(rows.join(ids, "det_id"), "tracks")


def lost_tracks(tracks: DataFrame, frames: DataFrame, max_misses: int = 15) -> DataFrame:
    """When each track was given up: the frame of its first miss too many.

    ``frames`` lists (source, tick, t) of every processed frame.
    """
    last = tracks.groupBy(*TRACK).agg(F.max_by(F.struct("tick", "cls", *expr.BOX, "frame_w", "frame_h"), "tick").alias("l"))
    return (last.select(*TRACK, "l.*").withColumn("tick", F.col("tick") + max_misses + 1)
            .join(frames.select("source", "tick", F.col("t").alias("lost_t")).distinct(), ["source", "tick"]))


# ── speed ────────────────────────────────────────────────────────────────────

def track_speed(points: DataFrame, window: float = 0.5, history: int = 60, slice_s: float = 600.0) -> DataFrame:
    """Speed and heading from the latest point at least ``window`` old, else the oldest of the last ``history``."""
    cx, cy = expr.centroid(expr.box())
    pts = points.withColumn("cx", cx).withColumn("cy", cy)
    ctx = slices.carried(pts, TRACK, "t", slice_s, back=window)
    here = F.struct("t", "cx", "cy")
    w = Window.partitionBy(*TRACK, slices.SLICE).orderBy("t")
    old = F.last(here).over(slices.within(TRACK, "t", None, -window))
    edge = F.first(here).over(w.rowsBetween(-(history - 1), 0))
    n = F.count("*").over(w.rowsBetween(-(history - 1), 0))
    x = ctx.withColumn("_old", old).withColumn("_edge", edge).withColumn("_n", n)
    x = slices.home(x.withColumn("_from", F.when(F.col("_old.t") >= F.col("_edge.t"), F.col("_old")).otherwise(F.col("_edge"))))
    dt = F.col("t") - F.col("_from.t")
    dx, dy = F.col("cx") - F.col("_from.cx"), F.col("cy") - F.col("_from.cy")
    dist = F.sqrt(dx * dx + dy * dy)
    return (x.withColumn("speed", F.when((F.col("_n") >= 2) & (dt > 1e-6), dist / dt).otherwise(0.0))
            .withColumn("heading_x", F.when((F.col("_n") >= 2) & (dist > 1e-6), dx / dist))
            .withColumn("heading_y", F.when((F.col("_n") >= 2) & (dist > 1e-6), dy / dist))
            .drop("_old", "_edge", "_n", "_from"))


def peak_speed(speeds: DataFrame, ranges: DataFrame, out: str = "peak_speed", width: float = 2.0) -> DataFrame:
    """Highest speed of a track within ``[since, until]``; zero where nothing was seen.

    ``ranges``: source, track_id, since, until and any identifying columns.
    """
    wide = ranges.withColumn("_b", F.explode(F.sequence(slices.slice_no(F.col("since"), width), slices.slice_no(F.col("until"), width))))
    s = speeds.select(*[F.col(k).alias("_" + k) for k in TRACK], F.col("t").alias("_at"), F.col("speed").alias("_v"),
                      slices.slice_no(F.col("t"), width).alias("_sb"))
    hit = ((F.col("source") == F.col("_source")) & (F.col("track_id") == F.col("_track_id")) & (F.col("_b") == F.col("_sb"))
           & (F.col("_at") >= F.col("since")) & (F.col("_at") <= F.col("until")))
    return (wide.join(s, hit, "left").groupBy(*ranges.columns)
            .agg(F.coalesce(F.max("_v"), F.lit(0.0)).alias(out)))


# ── dwell ────────────────────────────────────────────────────────────────────

def track_dwell(points: DataFrame, reset: float = 0.06, history: int = 60, slice_s: float = 1800.0) -> DataFrame:
    """Where and since when each track has stayed: the anchor moves once it is ``reset`` diagonals away.

    Also the largest distance of the last ``history`` points from the anchor, as
    a share of the diagonal (``spread``).
    """
    cx, cy = expr.centroid(expr.box())
    pts = points.select(*TRACK, "t", cx.alias("cx"), cy.alias("cy"), frame_diag().alias("diag"))
    schema = T.StructType([f for f in pts.schema.fields] + [T.StructField(c, T.DoubleType())
                                                             for c in ("anchor_x", "anchor_y", "anchor_t", "spread")])

    def moved_at(xy: np.ndarray, diag: np.ndarray, i: int, anchor: list[float]) -> int:
        """The first row from ``i`` on that is too far from the anchor, or the end; looked for in growing steps."""
        step = 64
        while i < len(xy):
            far = np.flatnonzero(np.hypot(xy[i:i + step, 0] - anchor[0], xy[i:i + step, 1] - anchor[1]) / diag[i:i + step] > reset)
            if len(far):
                return i + int(far[0])
            i, step = i + step, 2 * step
        return len(xy)

    def fold(rows: slices.Columns, state):
        if not len(rows["t"]):
            return {**rows, **dict.fromkeys(("anchor_x", "anchor_y", "anchor_t", "spread"), ())}, state
        xy, t, diag = np.column_stack([rows["cx"], rows["cy"]]).astype(float), rows["t"].astype(float), rows["diag"].astype(float)
        tail = np.array(state["tail"]).reshape(-1, 2) if state else np.zeros((0, 2))
        anchor = state["anchor"] if state else [*map(float, xy[0]), float(t[0])]
        every = np.concatenate([tail, xy])
        n, i = len(xy), 0
        out = np.empty((n, 4))
        while i < n:
            j = moved_at(xy, diag, i, anchor)
            if j > i:
                lo = max(0, len(tail) + i - (history - 1))
                d = np.hypot(every[lo:len(tail) + j, 0] - anchor[0], every[lo:len(tail) + j, 1] - anchor[1])
                most = np.fmax.accumulate(d) if len(d) <= history else pd.Series(d).rolling(history, min_periods=1).max().to_numpy()
                out[i:j, :3] = anchor
                out[i:j, 3] = most[-(j - i):] / diag[i:j]
            if j < n:
                anchor = [float(xy[j, 0]), float(xy[j, 1]), float(t[j])]
            i = j
        return {**rows, **dict(zip(("anchor_x", "anchor_y", "anchor_t", "spread"), out.T))}, {"anchor": anchor, "tail": every[-history:].tolist()}

    def summary(rows: slices.Columns):
        xy = np.column_stack([rows["cx"], rows["cy"]]).astype(float)
        return {"lo": xy.min(0).tolist(), "hi": xy.max(0).tolist(), "diag": float(rows["diag"].min()), "tail": xy[-history:].tolist()}

    def advance(state, s):
        if state is None:
            return None
        ax, ay, _ = state["anchor"]
        worst = max(math.hypot(x - ax, y - ay) for x in (s["lo"][0], s["hi"][0]) for y in (s["lo"][1], s["hi"][1]))
        if worst / s["diag"] > reset:
            return None
        return {"anchor": state["anchor"], "tail": (state["tail"] + s["tail"])[-history:]}

    out = slices.carry_scan(pts, TRACK, "t", slice_s, 60.0, fold, schema, summary=summary, advance=advance)
    return out.withColumn("dwell", F.col("t") - F.col("anchor_t"))


def loitering(tracks: DataFrame, cfg: RuleConfig = DEFAULTS, dwell: DataFrame | None = None) -> DataFrame:
    """A person who stayed put long enough: once per anchor. Cooldown is per track."""
    people = tracks.filter(F.col("cls") == "person")
    d = dwell if dwell is not None else track_dwell(people, cfg.anchor_reset)
    hit = (d.filter((F.col("dwell") >= cfg.loiter_s) & (F.col("spread") <= cfg.loiter_spread))
           .groupBy(*TRACK, "anchor_t").agg(F.min_by(F.struct("t", "dwell"), "t").alias("m")).select(*TRACK, "m.*"))
    hit = hit.join(people.select(*TRACK, "t", "frame_no"), [*TRACK, "t"])
    return rules.as_events(hit, type=F.lit("loitering"), label=F.lit("Loitering"), category=F.lit("behaviour"),
                           severity=F.lit("low"), score=F.lit(0.45), rule="dwell_time",
                           detail=F.concat(F.lit("Person stationary for "), rules.whole(F.col("dwell")), F.lit("s")),
                           ev=rules.evidence(track_id=F.col("track_id"), dwell_s=F.bround("dwell", 1)),
                           cooldown_key=F.concat(F.lit("loitering:"), F.col("track_id").cast("string")))


def unowned(bags: DataFrame, persons: DataFrame, dist: float = 0.22) -> DataFrame:
    """Things with no person within ``dist`` diagonals in their frame; nobody at all counts as infinitely far."""
    near = relate.nearest_person(bags, persons, dist)
    return bags.join(near.select(*relate.FRAME, "det_id"), [*relate.FRAME, "det_id"], "left_anti")


def unattended(tracks: DataFrame, cfg: RuleConfig = DEFAULTS) -> DataFrame:
    """A bag that stayed put with nobody near it: once per anchor."""
    bags = tracks.filter(F.col("cls").isin(dims.ABANDONABLE))
    d = track_dwell(bags, cfg.anchor_reset).filter(F.col("dwell") >= cfg.unattended_s)
    stayed = bags.join(d.select(*TRACK, "t", "dwell", "anchor_t"), [*TRACK, "t"])
    alone = unowned(stayed, tracks.filter(F.col("cls") == "person"), cfg.unattended_distance)
    hit = (alone.groupBy(*TRACK, "anchor_t").agg(F.min_by(F.struct("t", "frame_no", "dwell", "cls"), "t").alias("m"))
           .select(*TRACK, "m.*"))
    return rules.as_events(hit, type=F.lit("unattended_object"), label=F.concat(F.lit("Unattended "), F.col("cls")),
                           category=F.lit("object"), severity=F.lit("medium"), score=F.lit(0.55), rule="unattended_object",
                           detail=F.concat(F.col("cls"), F.lit(" stationary "), rules.whole(F.col("dwell")),
                                           F.lit("s with no person within "), F.lit(f"{cfg.unattended_distance:.0%}"), F.lit(" of frame diagonal")),
                           ev=rules.evidence(**{"track_id": F.col("track_id"), "class": F.col("cls"), "dwell_s": F.bround("dwell", 1)}),
                           cooldown_key=F.concat(F.lit("unattended:"), F.col("track_id").cast("string")))


# ── collisions ───────────────────────────────────────────────────────────────

def contacts(tracks: DataFrame, cfg: RuleConfig = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Contacts of a pair and their frames: a new one opens after ``collision_silence_s`` without overlap."""
    touch = relate.box_contacts(tracks, cfg.collision_iou)
    numbered = materialise(slices.sessionize(touch, ["source", "a_track_id", "b_track_id"], "t", cfg.collision_silence_s,
                                             "contact_no"), "contacts")
    first = lambda c: F.min_by(c, "t").alias(c)
    start = numbered.groupBy("source", "a_track_id", "b_track_id", "contact", "contact_no").agg(
        F.min("t").alias("start_t"), first("a_cls"), first("b_cls"),
        *[first(p + c) for p in ("a_", "b_") for c in expr.BOX])
    return start, numbered


def collisions(tracks: DataFrame, cfg: RuleConfig = DEFAULTS, speeds: DataFrame | None = None,
               slice_s: float = 600.0) -> DataFrame:
    """Contacts whose motion right after them looks like an impact.

    Overlap alone proves nothing. A contact is judged at the first frame at least
    ``collision_settle_s`` after it began: the striker stopped, the other stopped,
    something still was shoved, or a pedestrian's track was lost.
    """
    speeds = speeds if speeds is not None else materialise(track_speed(tracks), "speeds")
    frames = tracks.select("source", "t", "frame_no", "tick").distinct()
    start, touch = contacts(tracks, cfg)
    pair = ["source", "a_track_id", "b_track_id", "contact", "contact_no"]
    c = start.withColumn("_due", F.col("start_t") + cfg.collision_settle_s)
    c = slices.asof(c, frames, ["source"], "_due", "t", slice_s, "judge", forward=True).filter(F.col("judge").isNotNull())
    c = c.select("*", F.col("judge.t").alias("t"), F.col("judge.frame_no").alias("frame_no"), F.col("judge.tick").alias("tick")).drop("judge")
    # Contact frames up to and including the frame of judgement.
    counted = (touch.join(c.select(*pair, F.col("t").alias("_until")), pair).filter(F.col("t") <= F.col("_until"))
               .groupBy(*pair).agg(F.count("*").alias("contact_frames")))
    c = c.join(counted, pair).filter(F.col("contact_frames") >= cfg.collision_frames)
    # Both parties of a contact as rows: one range join and one as-of join serve them all.
    sides = F.array(*[F.struct(F.lit(p).alias("side"), F.col(f"{p}_track_id").alias("track_id")) for p in ("a", "b")])
    party = (c.withColumn("_p", F.explode(sides)).select("*", "_p.*").drop("_p")
             .withColumn("since", F.col("start_t") - 2.0).withColumn("until", F.col("start_t")))
    party = peak_speed(speeds, party, "pre")
    party = slices.asof(party, speeds.select(*TRACK, "t", "tick", "speed", "frame_w", "frame_h"), TRACK, "t", "t", slice_s, "s")
    alive = F.col("tick") - F.col("s.tick") <= cfg.track_max_misses
    party = (party.withColumn("post", F.when(alive, F.col("s.speed")))
             .withColumn("diag", expr.diagonal(F.col("s.frame_w"), F.col("s.frame_h"))))
    of = lambda p, v: F.max(F.when(F.col("side") == p, F.col(v))).alias(f"{v}_{p}")
    c = party.groupBy(*c.columns).agg(*[of(p, v) for p in ("a", "b") for v in ("pre", "post", "diag")])
    vehicle = F.col("contact") == "vehicle"
    a_strikes = ~vehicle | (F.col("pre_a") >= F.col("pre_b"))
    side = lambda x, y, name: F.when(a_strikes, F.col(x)).otherwise(F.col(y)).alias(name)
    j = c.select("*", side("a_track_id", "b_track_id", "striker_id"), side("b_track_id", "a_track_id", "other_id"),
                 side("a_cls", "b_cls", "striker_cls"), side("b_cls", "a_cls", "other_cls"),
                 side("pre_a", "pre_b", "pre_striker"), side("pre_b", "pre_a", "pre_other"),
                 side("post_a", "post_b", "post_striker"), side("post_b", "post_a", "post_other"),
                 F.coalesce("diag_a", "diag_b").alias("diag"),
                 F.when(a_strikes, F.struct(*[F.col("a_" + x).alias(x) for x in expr.BOX]))
                 .otherwise(F.struct(*[F.col("b_" + x).alias(x) for x in expr.BOX])).alias("striker_box"))
    floor = F.when(vehicle, cfg.collision_min_speed).otherwise(cfg.pedestrian_min_speed)
    pre, pre_o = F.col("pre_striker") / F.col("diag"), F.col("pre_other") / F.col("diag")
    post, post_o = F.coalesce("post_striker", F.lit(0.0)), F.coalesce("post_other", F.lit(0.0))
    reasons = F.array_compact(F.array(
        F.when(post <= cfg.collision_decel * F.col("pre_striker"),
               F.concat(F.lit("striking "), F.col("striker_cls"), F.lit(" decelerated "), F.format_string("%.3f", pre), F.lit(" → "),
                        F.format_string("%.3f", post / F.col("diag")), F.lit(" diag/s"))),
        F.when((pre_o >= floor) & (post_o <= cfg.collision_decel * F.col("pre_other")), F.concat(F.col("other_cls"), F.lit(" decelerated sharply"))),
        F.when((pre_o < 0.005) & (post_o / F.col("diag") > 0.02), F.concat(F.lit("stationary "), F.col("other_cls"), F.lit(" was displaced"))),
        F.when(~vehicle & F.col("post_other").isNull(), "pedestrian track lost at the moment of contact")))
    j = j.filter(pre >= floor).withColumn("reasons", reasons).filter(F.size("reasons") > 0)
    score = F.when(vehicle, 0.50 + 0.35 * F.least(F.lit(1.0), pre / 0.15)).otherwise(0.55 + 0.35 * F.least(F.lit(1.0), pre / 0.12))
    score = F.least(F.lit(1.0), score)
    etype = F.when(vehicle, "vehicle_collision").otherwise("vehicle_pedestrian_collision")
    low, high = F.least("a_track_id", "b_track_id").cast("string"), F.greatest("a_track_id", "b_track_id").cast("string")
    detail = F.concat(F.when(vehicle, F.concat(F.col("striker_cls"), F.lit(" and "), F.col("other_cls"), F.lit(" in contact; ")))
                      .otherwise(F.concat(F.col("striker_cls"), F.lit(" contacted a pedestrian; "))), F.array_join("reasons", "; "))
    return j.select("source", "frame_no", "t", "tick", etype.alias("type"),
                    F.when(vehicle, "Vehicle collision").otherwise("Vehicle struck a pedestrian").alias("label"),
                    F.when(~vehicle | (score >= 0.75), "critical").otherwise("high").alias("severity"),
                    expr.round_score(score).alias("score"), detail.alias("detail"), "striker_id", "other_id", "striker_cls", "other_cls",
                    F.round(pre, 4).alias("approach_speed"), "contact_frames", "striker_box", "start_t",
                    F.concat(etype, F.lit(":"), low, F.lit(":"), high).alias("cooldown_key"))


def collision_events(found: DataFrame) -> DataFrame:
    return rules.as_events(found, label=F.col("label"), category=F.lit("traffic"), severity=F.col("severity"), score=F.col("score"),
                           rule="collision_dynamics", detail=F.col("detail"),
                           ev=rules.evidence(striker=F.col("striker_id"), other=F.col("other_id"), approach_speed=F.col("approach_speed"),
                                             contact_frames=F.col("contact_frames")),
                           subj=rules.subject(F.col("striker_cls"), F.col("striker_box"), F.col("striker_id")), cooldown_key=F.col("cooldown_key"))


def left_scene(lost: DataFrame, found: DataFrame, speeds: DataFrame, cfg: RuleConfig = DEFAULTS, slice_s: float = 600.0) -> DataFrame:
    """Vehicles that left the frame under power soon after a collision they were part of.

    Not a finding of hit-and-run: a prompt to check whether anyone stopped.
    """
    part = lambda c, role: found.select("source", F.col(c).alias("track_id"), F.col("t").alias("hit_t"), F.lit(role).alias("role"))
    parties = part("striker_id", "striker").unionByName(part("other_id", "other"))
    w = slices.asof(lost, parties, TRACK, "lost_t", "hit_t", slice_s, "hit", tie=["role"]).filter(F.col("hit").isNotNull())
    w = (w.withColumn("since", F.col("hit.hit_t")).withColumn("until", F.col("lost_t")).withColumn("role", F.col("hit.role")).drop("hit")
         .filter((F.col("until") - F.col("since") <= cfg.left_scene_window_s) & F.col("cls").isin(dims.STRIKING_VEHICLES)))
    gone = peak_speed(speeds, w, "departure", 5.0).withColumn("departure", F.col("departure") / frame_diag())
    gone = gone.filter(F.col("departure") >= cfg.left_scene_speed).withColumn("t", F.col("lost_t")).withColumn("frame_no", F.lit(None).cast("long"))
    after = F.col("until") - F.col("since")
    return rules.as_events(gone, type=F.lit("vehicle_left_scene"), label=F.lit("Vehicle left after a collision"), category=F.lit("traffic"),
                           severity=F.lit("high"), score=F.lit(0.70), rule="post_collision_departure",
                           detail=F.concat(F.col("cls"), F.lit(" involved in a collision "), rules.whole(after), F.lit("s earlier left the frame at "),
                                           F.format_string("%.3f", F.col("departure")), F.lit(" diag/s")),
                           ev=rules.evidence(track_id=F.col("track_id"), role=F.col("role"), seconds_after_impact=F.bround(after, 1)),
                           subj=rules.subject(F.col("cls"), F.struct(*expr.BOX), F.col("track_id")),
                           cooldown_key=F.concat(F.lit("vehicle_left_scene:"), F.col("track_id").cast("string")))


# ── snatch trajectory ────────────────────────────────────────────────────────

def pair_samples(tracks: DataFrame, cfg: RuleConfig = DEFAULTS, speeds: DataFrame | None = None, slice_s: float = 300.0) -> DataFrame:
    """Every frame of a vehicle beside each person it ever met at speed.

    ``close`` says whether they are in contact, null in frames without the person; ``approach`` is
    the vehicle's highest speed of the last two seconds, in diagonals per second.
    """
    speeds = speeds if speeds is not None else materialise(track_speed(tracks), "speeds")
    v = speeds.filter(F.col("cls").isin(dims.VEHICLES)).withColumn("_diag", frame_diag())
    w = slices.within(TRACK, "t", -2.0, 0)
    v = slices.home(slices.sliced(v, "t", slice_s, back=2.0).withColumn("approach", F.max("speed").over(w) / F.col("_diag")))
    v = v.select("source", "frame_no", "t", F.col("track_id").alias("v_id"), F.col("cls").alias("v_cls"), F.col("cx").alias("vx"),
                 F.col("cy").alias("vy"), F.col("_diag").alias("diag"), "approach", "speed")
    cx, cy = expr.centroid(expr.box())
    p = tracks.filter(F.col("cls") == "person").select("source", "frame_no", F.col("track_id").alias("p_id"), cx.alias("px"), cy.alias("py"))
    r = F.col("diag") * cfg.snatch_contact + 1
    gap = expr.distance((F.col("vx"), F.col("vy")), (F.col("px"), F.col("py"))) / F.col("diag")
    # Only pairs that ever meet at speed can fire; everything else drops out here.
    met = (slices.grid_join(v.filter(F.col("approach") >= cfg.snatch_approach), p, relate.FRAME,
                            (F.col("vx") - r, F.col("vy") - r, F.col("vx") + r, F.col("vy") + r), (F.col("px"), F.col("py"), F.col("px"), F.col("py")))
           .filter(gap <= cfg.snatch_contact).select("source", "v_id", "p_id").distinct())
    both = v.join(met, ["source", "v_id"]).join(p, ["source", "frame_no", "p_id"], "left")
    return both.select("source", "v_id", "p_id", "frame_no", "t", (gap <= cfg.snatch_contact).alias("close"), "approach", "speed", "diag", "v_cls")


PAIR = ["source", "v_id", "p_id"]


def judge_pair(state: dict | None, t: float, close: bool | None, approach: float, cfg: RuleConfig, parity: bool = False) -> tuple[dict | None, tuple | None]:
    """One sample of a pair: the state after it, and (apart, until, contact_s, approach) once a separation was watched long enough."""
    if close is None:
        return state, None
    if close:
        if state is None and approach >= cfg.snatch_approach:
            state = {"start": t, "approach": approach, "apart": None}
        return state, None
    if state is None:
        return None, None
    if state["apart"] is None:
        state = {**state, "apart": t}
    beside = (t if parity else state["apart"]) - state["start"]
    if beside > cfg.snatch_max_contact_s:
        return None, None
    if t - state["apart"] >= cfg.snatch_watch_s:
        return None, (state["apart"], t, beside, state["approach"])
    return state, None


def snatch_trajectory(tracks: DataFrame, cfg: RuleConfig = DEFAULTS, speeds: DataFrame | None = None, parity: bool = False,
                      slice_s: float = 300.0) -> DataFrame:
    """A vehicle closes on a person, is briefly beside them, and leaves faster than it came.

    The time beside the person ends when they separate; ``parity`` lets it run on
    until the judgement. A pair fires at most once.
    """
    speeds = speeds if speeds is not None else materialise(track_speed(tracks), "speeds")
    both = materialise(pair_samples(tracks, cfg, speeds, slice_s), "pairs")
    schema = T.StructType([both.schema[c] for c in PAIR] + [T.StructField(c, T.DoubleType()) for c in ("since", "until", "contact_s", "approach")])

    def fold(rows: slices.Columns, state):
        out = []
        for t, close, approach in zip(rows["t"].tolist(), rows["close"].tolist(), rows["approach"].tolist()):
            state, judged = judge_pair(state, t, close, approach, cfg, parity)
            if judged is not None:
                out.append((*[rows[k][0] for k in PAIR], *judged))
        return dict(zip(schema.names, zip(*out))) if out else dict.fromkeys(schema.names, ()), state

    judged = slices.carry_scan(both.filter("close is not null").select(*PAIR, "t", "close", "approach"), PAIR, "t", slice_s, 10.0, fold, schema)
    left = peak_speed(speeds, judged.withColumn("track_id", F.col("v_id")), "departure")
    left = left.join(both.select(*PAIR, F.col("t").alias("until"), "diag", "v_cls", "frame_no"), [*PAIR, "until"])
    ratio = F.col("departure") / F.col("diag") / F.col("approach")
    fired = (left.withColumn("ratio", ratio).filter(F.col("ratio") >= cfg.snatch_ratio)
             .groupBy(*PAIR).agg(F.min_by(F.struct("until", "frame_no", "contact_s", "approach", "departure", "diag", "ratio", "v_cls"), "until").alias("m"))
             .select(*PAIR, "m.*").withColumnRenamed("until", "t"))
    return snatch_events(fired, cfg)


def snatch_events(fired: DataFrame, cfg: RuleConfig = DEFAULTS) -> DataFrame:
    """Events of judged pairs, the first of each that left fast enough (source, frame_no, t, v_id, p_id, contact_s, approach, departure, diag, ratio, v_cls)."""
    score = F.least(F.lit(1.0), 0.40 + 0.25 * F.least(F.col("ratio") - 1, F.lit(1.0)) + 0.25 * (1 - F.col("contact_s") / cfg.snatch_max_contact_s))
    fired = fired.withColumn("score", F.round(score, 3)).filter(F.col("score") >= cfg.snatch_min_score)
    return rules.as_events(fired, type=F.lit("snatch_theft"), label=F.lit("Possible snatch from vehicle"), category=F.lit("trajectory"),
                           severity=F.lit("high"), score=F.col("score"), rule="snatch_trajectory",
                           detail=F.concat(F.col("v_cls"), F.lit(" closed on a pedestrian, "), F.format_string("%.1f", "contact_s"),
                                           F.lit("s alongside, then left at "), F.format_string("%.2f", "ratio"), F.lit("x its approach speed")),
                           ev=rules.evidence(vehicle_track=F.col("v_id"), person_track=F.col("p_id"), contact_s=F.bround("contact_s", 2),
                                             approach_speed=F.bround("approach", 4), departure_speed=F.bround(F.col("departure") / F.col("diag"), 4),
                                             speed_ratio=F.bround("ratio", 2)),
                           cooldown_key=F.concat(F.lit("snatch:"), F.col("v_id").cast("string"), F.lit(":"), F.col("p_id").cast("string")))
