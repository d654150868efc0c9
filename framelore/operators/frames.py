"""Frame-level reshaping: decoding, suppression, sampling, poses, windows."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from framelore import dims
from framelore.functions import expr
from framelore.operators.slices import grid_join
from framelore.session import materialise

FRAME = ["source", "frame_no"]


# ── boxes ────────────────────────────────────────────────────────────────────

def decode_predictions(raw: DataFrame, conf: float, classes: int | None = None, size: int = 640) -> DataFrame:
    """Raw model rows to boxes: best class, confidence floor, centre form to corners, letterbox undone.

    ``raw``: cx, cy, w, h, scores (class scores first; later columns such as mask
    coefficients are cut off by ``classes``), frame_w, frame_h.
    """
    scores = F.slice("scores", 1, classes) if classes is not None else F.col("scores")
    best = F.array_max(scores)
    scale = F.least(F.lit(float(size)) / F.col("frame_h"), F.lit(float(size)) / F.col("frame_w"))
    pad = lambda side: F.floor((F.lit(size) - F.floor(F.col(side) * scale)) / 2)
    undo = lambda v, side: F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("long")
    x = lambda v: undo((v - pad("frame_w")) / scale, "w")
    y = lambda v: undo((v - pad("frame_h")) / scale, "h")
    return (raw.withColumn("confidence", best).filter(F.col("confidence") > conf)
            .withColumn("class_id", F.array_position(scores, best).cast("long") - 1)
            .select(*[c for c in raw.columns if c not in ("cx", "cy", "w", "h", "scores")], "class_id", "confidence",
                    x(F.col("cx") - F.col("w") / 2).alias("x1"), y(F.col("cy") - F.col("h") / 2).alias("y1"),
                    x(F.col("cx") + F.col("w") / 2).alias("x2"), y(F.col("cy") + F.col("h") / 2).alias("y2")))


def suppress(dets: DataFrame, thr: float, same_class: bool, floor: float | None = None) -> DataFrame:
    """Greedy suppression without gathering a frame in one task.

    A box is dropped if a kept box that comes before it (higher confidence, then
    smaller id) overlaps it by more than ``thr``. Only overlapping pairs, found
    through the grid, take part; each round settles every box whose stronger
    neighbours are all settled. Boxes without a stronger neighbour — nearly all —
    need no round.
    """
    from framelore.session import materialise
    keep = [*FRAME, "det_id", "confidence", *expr.BOX] + (["cls"] if same_class else [])
    a = dets.select(*FRAME, *[F.col(c).alias("a_" + c) for c in keep[2:]])
    b = dets.select(*FRAME, *[F.col(c).alias("b_" + c) for c in keep[2:]])
    box = lambda p: tuple(F.col(p + c) for c in expr.BOX)
    stronger = (F.col("a_confidence") > F.col("b_confidence")) | ((F.col("a_confidence") == F.col("b_confidence")) & (F.col("a_det_id") < F.col("b_det_id")))
    keys = FRAME
    pairs = grid_join(a, b, keys, box("a_"), box("b_")).filter(stronger & (expr.iou(box("a_"), box("b_"), floor) > thr))
    if same_class:
        pairs = pairs.filter(F.col("a_cls") == F.col("b_cls"))
    edges = materialise(pairs.select(F.col("a_det_id").alias("by"), F.col("b_det_id").alias("det_id")), "edges")
    # state of every box that has a stronger neighbour: null until known, else dropped or not
    open_ = materialise(edges.select("det_id").distinct().withColumn("dropped", F.lit(None).cast("boolean")), "nms")
    while not open_.filter("dropped IS NULL").isEmpty():  # the strongest open box of a frame is settled by each round
        known = open_.select(F.col("det_id").alias("by"), "dropped", F.lit(True).alias("ruled"))
        # A neighbour that has no stronger one itself is kept.
        e = edges.join(known, "by", "left").withColumn("_d", F.when(F.col("ruled").isNull(), False).otherwise(F.col("dropped")))
        verdict = e.groupBy("det_id").agg(F.bool_or(~F.col("_d")).alias("hit"), F.count_if(F.col("_d").isNull()).alias("waiting"))
        open_ = materialise(verdict.select("det_id", F.when(F.coalesce("hit", F.lit(False)), True).when(F.col("waiting") == 0, False).alias("dropped")), "nms")
    return dets.join(open_.filter("dropped").select("det_id"), "det_id", "left_anti")


def nms(dets: DataFrame, iou: float = 0.45) -> DataFrame:
    """Class-agnostic non-maximum suppression per frame."""
    return suppress(dets, iou, same_class=False)


def dedup_boxes(dets: DataFrame, iou: float = 0.5) -> DataFrame:
    """One box per object when two passes saw it: same class, box areas floored at one pixel."""
    return suppress(dets, iou, same_class=True, floor=1.0)


def crop_to_frame(dets: DataFrame, pad: float = 0.25) -> DataFrame:
    """Boxes found inside a padded person crop, back in frame coordinates.

    ``dets`` carry the person box as px1..py2; crops under 10 pixels are dropped.
    """
    bw, bh = F.col("px2") - F.col("px1"), F.col("py2") - F.col("py1")
    cut = lambda v: F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
    left = F.greatest(F.lit(0), cut(F.col("px1") - bw * pad))
    top = F.greatest(F.lit(0), cut(F.col("py1") - bh * pad))
    right = F.least(F.col("frame_w").cast("long"), cut(F.col("px2") + bw * pad))
    bottom = F.least(F.col("frame_h").cast("long"), cut(F.col("py2") + bh * pad))
    usable = (bw > 1) & (bh > 1) & (right - left >= 10) & (bottom - top >= 10)
    return (dets.filter(usable).select(*[c for c in dets.columns if c not in expr.BOX],
                                       (F.col("x1") + left).alias("x1"), (F.col("y1") + top).alias("y1"),
                                       (F.col("x2") + left).alias("x2"), (F.col("y2") + top).alias("y2")))


def merge_detectors(*parts: tuple[DataFrame, str]) -> DataFrame:
    """Rows of several detectors in one table, class names lower-cased, origin kept."""
    out = None
    for df, origin in parts:
        df = df.withColumn("cls", F.lower(F.trim("cls"))).withColumn("det_source", F.lit(origin))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def eligible_hosts(dets: DataFrame, min_px: float = 26.0, size_share: float = 0.18) -> DataFrame:
    """People fit to host a synthetic object: standing, 60 px to 55 % of the frame, no close-up in view."""
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    people = dets.filter(F.col("cls") == "person").withColumn("height", h)
    tallest = people.groupBy(*FRAME).agg(F.max("height").alias("tallest"))
    return (people.join(tallest, FRAME)
            .filter((F.col("tallest") <= 0.55 * F.col("frame_h")) & (F.col("height") >= 60) & (F.col("height") <= 0.55 * F.col("frame_h"))
                    & (h > 1.4 * w) & (F.col("height") * size_share >= min_px)))


# ── sampling and windows ─────────────────────────────────────────────────────

def sample_frames(frames: DataFrame, stride: int = 3, start_s: float = 0.0, max_s: float | None = None) -> DataFrame:
    """Every ``stride``-th frame of a span; plain filters, so they reach the scan."""
    out = frames.filter((F.col("frame_no") % max(1, stride) == 0) & (F.col("t") > start_s))
    return out if max_s is None else out.filter(F.col("t") <= start_s + max_s)


def evenly_spaced(n: Column, k: int) -> Column:
    """k indices over 0..n-1 with both ends, truncated; all of them when there are no more than k."""
    step = (n - 1).cast("double") / (k - 1)
    return (F.when(n <= 0, F.array().cast("array<bigint>"))
            .when(n <= k, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
            .otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == k - 1, n - 1).otherwise(F.floor(i * step)).cast("long"))))


def sample_indices(spans: DataFrame, k: int = 5) -> DataFrame:
    """Evenly spaced frame picks of each span (``n_frames``)."""
    return spans.select("*", F.posexplode(evenly_spaced(F.col("n_frames"), k)).alias("pick", "idx"))


def clip_windows_of_length(spans: DataFrame, clip_len: int, n_clips: int) -> DataFrame:
    """``n_clips`` windows of ``clip_len`` frame indices; short spans are looped, not padded."""
    n = F.col("n_frames")
    last = (n - clip_len).cast("double")
    start = (F.when(F.lit(n_clips) == 1, F.lit(0)).when(F.col("clip") == n_clips - 1, last).otherwise(F.floor(F.col("clip") * last / max(n_clips - 1, 1)))).cast("long")
    clips = spans.filter(n > 0).withColumn("clip", F.explode(F.sequence(F.lit(0), F.lit(max(1, n_clips) - 1))))
    idx = F.when(n <= clip_len, F.transform(F.sequence(F.lit(0), F.lit(clip_len - 1)), lambda i: (i % n).cast("long"))) \
           .otherwise(F.transform(F.sequence(F.lit(0), F.lit(clip_len - 1)), lambda i: (i + start).cast("long")))
    return clips.select("*", F.posexplode(idx).alias("pos", "idx"))


def clip_windows(spans: DataFrame, frames: int = 16, stride_s: float = 1.0) -> DataFrame:
    """Starts of fixed-length windows that fit into each span (``start``, ``end``, ``fps``)."""
    fit = F.floor((F.col("end") - F.col("start") - F.lit(frames) / F.col("fps")) / stride_s + 1e-9)
    return (spans.withColumn("_n", fit.cast("long")).filter(F.col("_n") >= 0)
            .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
            .withColumn("t_start", F.col("start") + F.col("k") * stride_s).drop("_n"))


def scale_windows(buffers: DataFrame, scales: Sequence[int] = (100, 45, 20), stride: int = 25, cap: int | None = None) -> DataFrame:
    """Windows searched per temporal scale of a buffer of ``n`` frames.

    The shortest scale is tried at every alignment, longer ones every sixth of
    their length, reaching back at most ``stride`` frames. Scales that do not fit
    are skipped; if none fits the whole buffer is one window. ``cap`` keeps the first windows of a scale.
    """
    parts = []
    short = min(scales)
    window = lambda s: lambda b: F.struct(F.lit(s).alias("scale"), b.alias("back"))
    for s in sorted(scales, reverse=True):
        step = 1 if s == short else max(1, s // 6)
        back = F.greatest(F.lit(0), F.least(F.lit(stride), F.col("n") - s))
        steps = F.sequence(F.lit(0).cast("long"), back.cast("long"), F.lit(step).cast("long"))
        steps = steps if cap is None else F.slice(steps, 1, cap)
        parts.append(F.when(F.col("n") >= s, F.transform(steps, window(s)))
                     .otherwise(F.array().cast("array<struct<scale:int,back:bigint>>")))
    whole = F.when((F.col("n") < short) & (F.col("n") > 0), F.array(F.struct(F.col("n").cast("int").alias("scale"), F.lit(0).cast("long").alias("back")))) \
             .otherwise(F.array().cast("array<struct<scale:int,back:bigint>>"))
    return (buffers.withColumn("_w", F.explode(F.concat(*parts, whole))).select(*buffers.columns, "_w.scale", "_w.back")
            .withColumn("end", F.col("n") - F.col("back")).withColumn("start", F.col("end") - F.col("scale")))


def fit_length(clips: DataFrame, n: int, crop: Column | None = None) -> DataFrame:
    """Clips of exactly ``n`` frames: cropped in the middle (or at ``crop``), looped if short.

    ``clips``: clip_id, length, frames (array). The random crop of training is a
    hash draw: pass ``crop=F.pmod(F.xxhash64(seed, clip_id), length - n + 1)``.
    """
    length = F.size("frames")
    start = F.floor((length - n) / 2) if crop is None else crop
    looped = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("frames", (i % length).cast("int")))
    return clips.withColumn("frames", F.when(length > n, F.slice("frames", start.cast("int") + 1, n)).when(length == n, F.col("frames")).otherwise(looped))


# ── poses ────────────────────────────────────────────────────────────────────

def select_top_persons(poses: DataFrame, m: int = 2, by: Column | None = None) -> DataFrame:
    """The m strongest persons per frame, padded with absent ones (null keypoints become zeros)."""
    score = by if by is not None else F.col("confidence")
    w = Window.partitionBy(*FRAME).orderBy(F.desc("_s"), "person_idx")
    top = poses.withColumn("_s", score).withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= m)
    slots = poses.select(*FRAME).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(m))))
    zero = F.transform(F.sequence(F.lit(1), F.lit(17)), lambda _: F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("c")))
    return (slots.join(top.select(*FRAME, "slot", "person_idx", "keypoints"), [*FRAME, "slot"], "left")
            .withColumn("keypoints", F.coalesce("keypoints", zero)))


def joint_confidence(keypoints: Column) -> Column:
    return F.aggregate(keypoints, F.lit(0.0), lambda s, k: s + k["c"])


def repair_confidence(poses: DataFrame, joints: int = 17) -> DataFrame:
    """Unknown confidence becomes 1 where the joint has a position, else 0; unknown coordinates become 0."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    def fix(k):
        placed = ~bad(k["x"]) & ~bad(k["y"]) & ((k["x"] != 0) | (k["y"] != 0))
        return F.struct(F.when(bad(k["x"]), 0.0).otherwise(k["x"]).alias("x"), F.when(bad(k["y"]), 0.0).otherwise(k["y"]).alias("y"),
                        F.when(bad(k["c"]), placed.cast("double")).otherwise(k["c"]).alias("c"))
    return poses.filter(F.size("keypoints") == joints).withColumn("keypoints", F.transform("keypoints", fix))


def normalize_pose(joints: DataFrame, mode: str = "frame", conf: float = 0.3) -> DataFrame:
    """Keypoints to about [-1, 1]; absent persons stay exactly zero.

    ``joints``: clip_id, frame_no, person, joint, x, y, c, frame_w, frame_h. Frame
    mode divides by half the frame; clip mode uses one centroid and one scale for
    all persons of a clip, computed as two aggregates and joined back.
    """
    present = F.max((F.col("c") > conf).cast("int")).over(Window.partitionBy("clip_id", "frame_no", "person")) == 1
    j = joints.withColumn("present", present)
    if mode == "frame":
        nx, ny = (F.col("x") - F.col("frame_w") / 2) / (F.col("frame_w") / 2), (F.col("y") - F.col("frame_h") / 2) / (F.col("frame_h") / 2)
        return j.withColumn("x", F.when(F.col("present"), nx).otherwise(0.0)).withColumn("y", F.when(F.col("present"), ny).otherwise(0.0))
    valid = j.filter(F.col("c") > conf)
    centre = valid.groupBy("clip_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.max("x").alias("hx"), F.min("x").alias("lx"),
                                          F.max("y").alias("hy"), F.min("y").alias("ly"))
    span = F.greatest(F.col("hx") - F.col("mx"), F.col("mx") - F.col("lx"), F.col("hy") - F.col("my"), F.col("my") - F.col("ly"))
    centre = centre.select("clip_id", "mx", "my", F.when(span > 1e-6, span).otherwise(1.0).alias("span"))
    out = j.join(centre, "clip_id", "left")
    return (out.withColumn("x", F.when(F.col("present"), (F.col("x") - F.col("mx")) / F.col("span")).otherwise(0.0))
            .withColumn("y", F.when(F.col("present"), (F.col("y") - F.col("my")) / F.col("span")).otherwise(0.0)).drop("mx", "my", "span"))


def draw(seed: int, *keys: str) -> Column:
    """A uniform draw in [0, 1) fixed by the keys, the same on any partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def augment_clips(joints: DataFrame, seed: int = 0, flip: float = 0.5, rotate_deg: float = 12.0, scale: float = 0.15, drop: float = 0.05) -> DataFrame:
    """Mirror (with left and right joints swapped), rotate and scale about the frame centre, drop joints.

    One draw per clip and transform; one per joint for dropout.
    """
    cx, cy = F.col("frame_w") / 2, F.col("frame_h") / 2
    swap = {**{a: b for a, b in dims.MIRROR_PAIRS}, **{b: a for a, b in dims.MIRROR_PAIRS}}
    flipped = draw(seed, "clip_id") < flip
    theta = (draw(seed + 1, "clip_id") * 2 - 1) * math.radians(rotate_deg)
    factor = 1 + (draw(seed + 2, "clip_id") * 2 - 1) * scale
    valid = F.col("c") > 0
    j = (joints.withColumn("x", F.when(flipped, 2 * cx - F.col("x")).otherwise(F.col("x")))
         .withColumn("joint", F.when(flipped, F.coalesce(expr.lookup(swap, F.col("joint")), F.col("joint"))).otherwise(F.col("joint"))))
    dx, dy = F.col("x") - cx, F.col("y") - cy
    j = (j.withColumn("_x", (dx * F.cos(theta) - dy * F.sin(theta)) * factor + cx).withColumn("_y", (dx * F.sin(theta) + dy * F.cos(theta)) * factor + cy))
    lost = draw(seed + 3, "clip_id", "frame_no", "person", "joint") < drop
    zero = lambda c: F.when(valid & ~lost, F.col(c)).otherwise(0.0)
    return j.withColumn("x", zero("_x")).withColumn("y", zero("_y")).withColumn("c", F.when(lost, 0.0).otherwise(F.col("c"))).drop("_x", "_y")


# ── interaction features ─────────────────────────────────────────────────────

def sample_motion(joints: DataFrame, conf: float = 0.3) -> DataFrame:
    """Mean displacement of joints seen in two consecutive samples, over the frame diagonal.

    ``joints``: source, sample_no, t, person, joint, x, y, c, frame_w, frame_h,
    where ``sample_no`` counts samples without holes; each joint meets its own
    previous sample through an equal join, so no source is ordered in one task.
    """
    key = ["source", "person", "joint"]
    seen = joints.filter(F.col("c") > conf)
    before = seen.select(*key, (F.col("sample_no") + 1).alias("sample_no"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    step = F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2) / expr.diagonal(F.col("frame_w"), F.col("frame_h"))
    return seen.join(before, [*key, "sample_no"]).groupBy("source", "sample_no").agg(F.avg(step).alias("motion"))


CROWD = 16  # people of a sample, or of a grid cell, whose pairs are simply compared


def closest_pairs(points: DataFrame, keys: Sequence[str], x: str = "px", y: str = "py") -> DataFrame:
    """The smallest distance (``gap``) between two points of each key; keys of one point are left out.

    A few points are compared with each other. More are laid in a grid whose cells are as wide as
    a distance that some pair is known to keep: of n points in a box, two share one of fewer
    than n equal parts of it. Where a cell is still crowded the same holds inside it, which
    makes the cells smaller by a factor of 2.8 at least; once none is, every point
    meets the points of its own and the eight cells around it.
    """
    rows = points.groupBy(*keys, x, y).agg(F.count("*").alias("_times"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_times").alias("_most"), F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    sizes = materialise(sizes, "sizes")
    same = sizes.filter("_most > 1").select(*keys, F.lit(0.0).alias("gap"))
    sizes = sizes.filter("_most = 1 and _n > 1")
    dist = lambda ax, ay, bx, by: F.sqrt((ax - bx) ** 2 + (ay - by) ** 2)
    few = rows.join(sizes.filter(F.col("_n") <= CROWD).select(*keys), list(keys)).groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("_c"))
    gap = F.array_min(F.flatten(F.transform("_c", lambda a, i: F.transform(F.slice("_c", i + 2, F.size("_c")), lambda b: dist(a["x"], a["y"], b["x"], b["y"])))))
    found = same.unionByName(few.select(*keys, gap.alias("gap")))
    parts = lambda n: F.floor(F.sqrt(F.col(n) - 1))
    many = sizes.filter(F.col("_n") > CROWD)
    if many.isEmpty():
        return found
    wide = dist(F.col("_x1"), F.col("_y1"), F.col("_x0"), F.col("_y0")) / parts("_n")
    known = materialise(many.select(*keys, wide.alias("_d")), "known")
    crowd = materialise(rows.join(known.select(*keys), list(keys), "left_semi").select(*keys, x, y), "crowd")
    cell = lambda c: F.floor(F.col(c) / F.col("_d")).cast("long")
    while True:
        placed = crowd.join(known, list(keys)).withColumn("_cx", cell(x)).withColumn("_cy", cell(y))
        full = placed.groupBy(*keys, "_d", "_cx", "_cy").agg(F.count("*").alias("_in")).filter(F.col("_in") > CROWD)
        finer = materialise(full.groupBy(*keys).agg(F.min(F.col("_d") * 2 ** 0.5 / parts("_in")).alias("_finer")), "finer")
        if finer.isEmpty():
            break
        known = materialise(known.join(finer, list(keys), "left").select(*keys, F.coalesce("_finer", "_d").alias("_d")), "known")
    around = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    near = placed.withColumn("_cx", F.explode(F.transform(around, lambda k: F.col("_cx") + k))).withColumn("_cy", F.explode(F.transform(around, lambda k: F.col("_cy") + k)))
    other = placed.select(*keys, "_cx", "_cy", F.col(x).alias("_ox"), F.col(y).alias("_oy"))
    met = near.join(other, [*keys, "_cx", "_cy"]).filter((F.col(x) < F.col("_ox")) | ((F.col(x) == F.col("_ox")) & (F.col(y) < F.col("_oy"))))
    return found.unionByName(met.groupBy(*keys).agg(F.min(dist(F.col(x), F.col(y), F.col("_ox"), F.col("_oy"))).alias("gap")))


def interaction_features(joints: DataFrame, conf: float = 0.3) -> DataFrame:
    """Per sample: people, smallest gap between two of them (over the diagonal), motion since the last sample."""
    samples = joints.groupBy("source", "sample_no", "t").agg(expr.diagonal(F.first("frame_w"), F.first("frame_h")).alias("diag"))
    centre = materialise(joints.filter(F.col("c") > conf).groupBy("source", "sample_no", "person").agg(F.avg("x").alias("px"), F.avg("y").alias("py")), "centres")
    people = centre.groupBy("source", "sample_no").agg(F.count("*").alias("people"))
    gaps = closest_pairs(centre, ["source", "sample_no"]).withColumnRenamed("gap", "_gap")
    people = people.join(gaps, ["source", "sample_no"], "left")
    return (samples.join(people, ["source", "sample_no"], "left").join(sample_motion(joints, conf), ["source", "sample_no"], "left")
            .select("source", "sample_no", "t", F.coalesce("people", F.lit(0)).alias("people"), (F.col("_gap") / F.col("diag")).alias("gap"),
                    F.coalesce("motion", F.lit(0.0)).alias("motion")))


# ── action evidence ──────────────────────────────────────────────────────────

def action_evidence(preds: DataFrame, k: int = 5) -> DataFrame:
    """Strongest probability per class over all windows and the scale that gave it; the top k of a buffer.

    ``preds``: buffer_id, scale, back, class_id, label, prob. Longer scales and
    shorter look-backs win ties, as they are searched first.
    """
    best = preds.groupBy("buffer_id", "class_id", "label").agg(
        F.max("prob").alias("confidence"), F.min_by("scale", F.struct(-F.col("prob"), -F.col("scale"), F.col("back"))).alias("scale"))
    w = Window.partitionBy("buffer_id").orderBy(F.desc("confidence"), "class_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_label_per_scale(preds: DataFrame) -> DataFrame:
    """The label of the single strongest probability at each scale."""
    return preds.groupBy("buffer_id", "scale").agg(F.min_by("label", F.struct(-F.col("prob"), F.col("back"), F.col("class_id"))).alias("label"))


def banded_signature(pixels: DataFrame, bands: int = 3, min_v: int = 25, min_s: int = 20, min_chroma: int = 16, digits: int | None = 6) -> DataFrame:
    """Colour signature per object: histograms of hue, saturation and value over horizontal bands.

    ``pixels``: object_id, band, h (0-179), s, v (0-255). Counts are combined
    map-side; an object contributes at most 96 counters to the shuffle. Shares are rounded
    to ``digits`` places; None leaves them as divided.
    """
    bins = dims.BLOCK_BINS
    chroma = (F.col("v") >= min_v) & (F.col("s") >= min_s)
    obs = F.array(F.when(chroma, F.struct(F.lit("hue").alias("channel"), F.least(F.floor(F.col("h") * bins["hue"] / 180), F.lit(bins["hue"] - 1)).cast("int").alias("bin"))),
                  F.struct(F.lit("sat").alias("channel"), F.floor(F.col("s") * bins["sat"] / 256).cast("int").alias("bin")),
                  F.struct(F.lit("val").alias("channel"), F.floor(F.col("v") * bins["val"] / 256).cast("int").alias("bin")))
    n = (pixels.select("object_id", "band", F.explode(F.array_compact(obs)).alias("o"))
         .groupBy("object_id", "band", "o.channel", "o.bin").agg(F.count("*").alias("n")))
    block = (n.groupBy("object_id", "band", "channel").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")))
    cut = lambda c: c if digits is None else F.round(c, digits)
    share = lambda size: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: cut(F.coalesce(F.element_at("m", b), F.lit(0)) / F.col("total")))
    none = lambda size: F.array_repeat(F.lit(0.0), size)
    vec = (F.when(F.col("channel") == "hue", F.when(F.col("total") >= min_chroma, share(bins["hue"])).otherwise(none(bins["hue"])))
           .when(F.col("channel") == "sat", share(bins["sat"])).otherwise(share(bins["val"])))
    blocks = block.groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("band").cast("string"), F.lit(":"), "channel"), vec))).alias("b"))
    parts = [F.coalesce(F.element_at("b", F.lit(f"{i}:{c}")), none(size)) for i in range(bands) for c, size in bins.items()]
    return blocks.select("object_id", F.concat(*parts).alias("signature"))


def describe_colour(pixels: DataFrame) -> DataFrame:
    """A short colour name per object from its middle pixels (object_id, h, s, v)."""
    strong = (F.col("s") >= 60) & (F.col("v") >= 40)
    hues = pixels.filter(strong).groupBy("object_id", "h").agg(F.count("*").alias("n"))
    mode = hues.groupBy("object_id").agg(F.min_by("h", F.struct(-F.col("n"), F.col("h"))).alias("hue"))
    stats = pixels.groupBy("object_id").agg(F.avg("v").alias("mean_v"), F.avg(strong.cast("double")).alias("chroma"),
                                            F.avg(F.when(strong, F.col("s"))).alias("mean_s"))
    name = F.lit(None).cast("string")
    for lo, hi, label in dims.HUE_NAMES:
        name = F.when((F.col("hue") >= lo) & (F.col("hue") < hi), label).otherwise(name)
    grey = F.when(F.col("mean_v") < 60, "black/dark").when(F.col("mean_v") < 120, "dark grey").when(F.col("mean_v") < 190, "silver/grey").otherwise("white")
    tone = (F.when(F.col("mean_v") < 80, F.concat(F.lit("dark "), F.col("name"))).when((F.col("mean_v") > 200) & (F.col("mean_s") < 120), F.concat(F.lit("light "), F.col("name")))
            .otherwise(F.col("name")))
    return (stats.join(mode, "object_id", "left").withColumn("name", F.coalesce(name, F.lit("unknown")))
            .select("object_id", F.when(F.col("chroma") < 0.18, grey).otherwise(tone).alias("colour")))
