"""Spatial relations between boxes of one frame.

Every operator joins on ``(source, frame_no)`` and a grid cell first, so its cost
follows the pairs that touch, not the pairs of a frame.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from framelore import dims
from framelore.functions import expr
from framelore.operators.slices import grid_join

FRAME = ["source", "frame_no"]
HANDS = [("left", 9, 7), ("right", 10, 8)]   # name, wrist joint, elbow joint


def prefixed(df: DataFrame, p: str, keep: list[str] = FRAME) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(p + c) for c in df.columns if c not in keep])


def pbox(p: str):
    return tuple(F.col(p + c) for c in expr.BOX)


def hand_points(poses: DataFrame, kp_conf: float = 0.3) -> DataFrame:
    """One row per visible hand: the wrist, or the elbow where the wrist is hidden."""
    options = []
    for no, (hand, wrist, elbow) in enumerate(HANDS):
        w, e = F.get("keypoints", F.lit(wrist)), F.get("keypoints", F.lit(elbow))
        point = lambda name, k: F.struct(F.lit(no).alias("hand_no"), F.lit(name).alias("hand"),
                                         k["x"].alias("hx"), k["y"].alias("hy"))
        options.append(F.when(w["c"] >= kp_conf, point(hand, w)).when(e["c"] >= kp_conf, point(f"{hand} (elbow)", e)))
    return (poses.filter(F.size("keypoints") >= 17)
            .withColumn("_h", F.explode(F.array_compact(F.array(*options)))).select(*poses.columns, "_h.*"))


def grip_matches(tools: DataFrame, poses: DataFrame, tol: float = 0.18, kp_conf: float = 0.3) -> DataFrame:
    """The best hand for each object: distance to the object within ``tol`` of the person's diagonal."""
    hands = prefixed(hand_points(poses, kp_conf).withColumn("limit", expr.person_scale(expr.box()) * F.lit(tol))
                     .select(*FRAME, "person_idx", "hand_no", "hand", "hx", "hy", "limit", *expr.BOX), "p_")
    reach = (F.col("p_hx") - F.col("p_limit"), F.col("p_hy") - F.col("p_limit"),
             F.col("p_hx") + F.col("p_limit"), F.col("p_hy") + F.col("p_limit"))
    near = grid_join(tools.select(*FRAME, "det_id", *expr.BOX), hands, FRAME, expr.box(), reach)
    d = expr.point_box_distance((F.col("p_hx"), F.col("p_hy")), expr.box())
    hit = near.withColumn("_d", d).filter(F.col("_d") <= F.col("p_limit")).withColumn("_g", 1 - F.col("_d") / F.col("p_limit"))
    best = F.min_by(F.struct(F.col("p_person_idx").alias("person_idx"), F.col("p_hand").alias("hand"),
                             F.round("_d", 1).alias("distance_px"), F.round("_g", 3).alias("grip"),
                             F.struct(*[F.col("p_" + c).alias(c) for c in expr.BOX]).alias("person_box")),
                    F.struct(-F.col("_g"), F.col("p_person_idx"), F.col("p_hand_no")))
    return hit.groupBy(*FRAME, "det_id").agg(best.alias("m")).select(*FRAME, "det_id", "m.*")


def carried(tools: DataFrame, persons: DataFrame, grips: DataFrame | None = None, overlap: float = 0.55) -> DataFrame:
    """Objects without a grip that lie mostly inside a person; the first such person."""
    loose = tools.join(grips.select("det_id"), "det_id", "left_anti") if grips is not None else tools
    who = prefixed(persons.select(*FRAME, "det_id", *expr.BOX), "p_")
    pairs = grid_join(loose.select(*FRAME, "det_id", *expr.BOX), who, FRAME, expr.box(), pbox("p_"))
    frac = expr.overlap_area(expr.box(), pbox("p_")) / expr.area(expr.box(), 1.0)
    best = F.min_by(F.struct(F.col("p_det_id").alias("person_id"), F.round("_f", 3).alias("containment"),
                             F.struct(*[F.col("p_" + c).alias(c) for c in expr.BOX]).alias("person_box")), "p_det_id")
    return (pairs.withColumn("_f", frac).filter(F.col("_f") >= overlap).groupBy(*FRAME, "det_id").agg(best.alias("m"))
            .select(*FRAME, "det_id", "m.*"))


def nearest_person(things: DataFrame, persons: DataFrame, max_frac: float = 0.25) -> DataFrame:
    """Distance to the closest person centre, as a fraction of the frame diagonal, if within ``max_frac``."""
    diag = expr.diagonal(F.col("frame_w"), F.col("frame_h"))
    cx, cy = expr.centroid(expr.box())
    left = things.select(*FRAME, "det_id", cx.alias("cx"), cy.alias("cy"), diag.alias("diag"))
    px, py = expr.centroid(expr.box())
    right = persons.select(*FRAME, px.alias("p_cx"), py.alias("p_cy"))
    r = F.col("diag") * F.lit(max_frac)
    # One pixel of slack: the grid only preselects, the distance decides.
    pairs = grid_join(left, right, FRAME, (F.col("cx") - r - 1, F.col("cy") - r - 1, F.col("cx") + r + 1, F.col("cy") + r + 1),
                      (F.col("p_cx"), F.col("p_cy"), F.col("p_cx"), F.col("p_cy")))
    frac = expr.distance((F.col("cx"), F.col("cy")), (F.col("p_cx"), F.col("p_cy"))) / F.col("diag")
    return (pairs.withColumn("person_distance", frac).filter(F.col("person_distance") <= max_frac)
            .groupBy(*FRAME, "det_id").agg(F.min("person_distance").alias("person_distance")))


def box_contacts(tracks: DataFrame, min_iou: float = 0.08) -> DataFrame:
    """Vehicle–vehicle pairs, and striking vehicle–person pairs, that overlap in a frame."""
    t = tracks.select(*FRAME, "t", "track_id", "cls", *expr.BOX)
    vehicles = t.filter(F.col("cls").isin(dims.VEHICLES))
    a, b = prefixed(vehicles, "a_", [*FRAME, "t"]), prefixed(vehicles, "b_")
    vv = (grid_join(a, b, FRAME, pbox("a_"), pbox("b_")).filter(F.col("a_track_id") < F.col("b_track_id"))
          .withColumn("contact", F.lit("vehicle")))
    strikers = prefixed(t.filter(F.col("cls").isin(dims.STRIKING_VEHICLES)), "a_", [*FRAME, "t"])
    people = prefixed(t.filter(F.col("cls") == "person"), "b_")
    vp = grid_join(strikers, people, FRAME, pbox("a_"), pbox("b_")).withColumn("contact", F.lit("pedestrian"))
    return (vv.drop("b_t").unionByName(vp.drop("b_t")).withColumn("iou", expr.iou(pbox("a_"), pbox("b_")))
            .filter(F.col("iou") >= min_iou))


def inside_polygon(x, y, polygon):
    """Ray casting over a constant polygon (a list of (x, y) column pairs): odd crossings are inside."""
    crossings = F.lit(0)
    for i, (xi, yi) in enumerate(polygon):
        xj, yj = polygon[i - 1]
        spans = (yi > y) != (yj > y)
        run = F.when(yj - yi == 0, F.lit(1e-9)).otherwise(yj - yi)
        crossings = crossings + F.when(spans & (x < (xj - xi) * (y - yi) / run + xi), 1).otherwise(0)
    return crossings % 2 == 1


def in_zones(persons: DataFrame, zones: list[dict]) -> DataFrame:
    """People whose feet are inside a zone; the first one per zone and frame.

    Zones are configuration: a constant list of ``{"name", "polygon", "severity"}``
    in frame fractions, so they become an array column, not a join.
    """
    x, y = (F.col("x1") + F.col("x2")) / 2, F.col("y2")
    hits = []
    for z in zones:
        if len(z.get("polygon") or []) < 3:
            continue
        poly = [(F.lit(float(px)) * F.col("frame_w"), F.lit(float(py)) * F.col("frame_h")) for px, py in z["polygon"]]
        hits.append(F.when(inside_polygon(x, y, poly), F.struct(F.lit(z.get("name", "restricted zone")).alias("zone"),
                                                                F.lit(z.get("severity")).cast("string").alias("zone_severity"))))
    if not hits:
        return persons.select(*FRAME, F.lit("").alias("zone"), F.lit("").alias("zone_severity"), "t", "det_id", *expr.BOX).limit(0)
    found = persons.withColumn("_z", F.explode(F.array_compact(F.array(*hits))))
    return (found.groupBy(*FRAME, F.col("_z.zone").alias("zone"), F.col("_z.zone_severity").alias("zone_severity"))
            .agg(F.min_by(F.struct("t", "det_id", *expr.BOX), "det_id").alias("m"))
            .select(*FRAME, "zone", "zone_severity", "m.*"))


def event_subjects(events: DataFrame, detections: DataFrame, n: int = 4) -> DataFrame:
    """Who an event is about: its named subject is involved; the largest people or
    vehicles of the frame are merely present."""
    named = (events.filter(F.col("subject").isNotNull())
             .select("event_id", *FRAME, F.col("subject.cls").alias("cls"), F.lit("involved").alias("role"),
                     *[F.col(f"subject.{c}").alias(c) for c in expr.BOX], F.lit(0).alias("place")))

    def present(types: list[str], classes: list[str]) -> DataFrame:
        found = (events.filter(F.col("type").isin(types)).select("event_id", *FRAME)
                 .join(detections.filter(F.col("cls").isin(classes)), FRAME)
                 .withColumn("_a", expr.area(expr.box())))
        w = Window.partitionBy("event_id").orderBy(F.desc("_a"), "det_id")
        return (found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
                .select("event_id", *FRAME, "cls", F.lit("present").alias("role"), *expr.BOX, "place"))

    return (named.unionByName(present(dims.PERSON_SUBJECT_TYPES, ["person"]))
            .unionByName(present(dims.VEHICLE_SUBJECT_TYPES, dims.VEHICLES)))
