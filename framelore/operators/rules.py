"""Rules that turn perception rows into scored events.

Every rule returns the columns of ``EVENT``; ``all_events`` unions them and adds
the timecode and a repeatable event id. An event is a prompt for human review.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from framelore import dims
from framelore.config import DEFAULTS, RuleConfig
from framelore.functions import expr
from framelore.operators import relate, slices
from framelore.operators.relate import FRAME

EVENT = ["source", "frame_no", "t", "type", "label", "category", "severity", "score", "rule", "detail", "evidence",
         "subject", "cooldown_key"]
SUBJECT_TYPE = "struct<cls:string,x1:double,y1:double,x2:double,y2:double,track_id:bigint>"


def percent(v: Column) -> Column:
    return F.concat(F.bround(v * 100, 0).cast("long").cast("string"), F.lit("%"))


def whole(v: Column) -> Column:
    return F.bround(v, 0).cast("long").cast("string")


def subject(cls: Column, box_struct: Column | None, track_id: Column | None = None) -> Column:
    if box_struct is None:
        return F.lit(None).cast(SUBJECT_TYPE)
    return F.when(box_struct.isNotNull(), F.struct(
        cls.alias("cls"), *[box_struct[c].cast("double").alias(c) for c in expr.BOX],
        (track_id if track_id is not None else F.lit(None)).cast("long").alias("track_id")))


def evidence(**values: Column) -> Column:
    """Free-form facts of an event; unknown ones are left out."""
    entries = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")))
                        for k, v in values.items()])
    return F.map_from_entries(F.array_compact(entries))


def as_events(df: DataFrame, *, label: Column, category: Column, severity: Column, score: Column, rule: str,
              detail: Column, type: Column | None = None, ev: Column | None = None, subj: Column | None = None,
              cooldown_key: Column | None = None) -> DataFrame:
    etype = type if type is not None else F.col("type")
    return df.select("source", "frame_no", "t", etype.alias("type"), label.alias("label"), category.alias("category"),
                     severity.alias("severity"), expr.round_score(score).alias("score"), F.lit(rule).alias("rule"),
                     detail.alias("detail"), (ev if ev is not None else F.create_map().cast("map<string,string>")).alias("evidence"),
                     (subj if subj is not None else F.lit(None).cast(SUBJECT_TYPE)).alias("subject"),
                     (cooldown_key if cooldown_key is not None else etype).alias("cooldown_key"))


def weapon_events(dets: DataFrame, poses: DataFrame | None = None, cfg: RuleConfig = DEFAULTS) -> DataFrame:
    """Crime tools ranked by how strongly they are tied to a person: held, carried, near, loose."""
    spark = dets.sparkSession
    persons = dets.filter(F.col("cls") == "person")
    vocab = F.broadcast(dims.tools(spark))
    tools = dets.withColumn("cls_key", expr.class_key(F.col("cls"))).join(vocab, "cls_key")
    pose_on = poses is not None and cfg.grip_enabled
    # The floor comes before the joins: a tool below it raises nothing either way.
    floor = F.when(F.col("tool_category") == "weapon", cfg.weapon_conf).otherwise(cfg.tool_conf)
    tools = tools.filter(F.col("confidence") >= floor)
    near = relate.nearest_person(tools, persons, cfg.weapon_proximity).select("det_id", "person_distance")
    joined = tools.join(near, "det_id", "left")
    if pose_on:
        grips = relate.grip_matches(tools, poses, cfg.grip_tolerance, cfg.grip_kp_conf)
        kept = relate.carried(tools, persons, grips, cfg.carried_overlap)
        # Carrying is only judged in frames where pose saw someone.
        posed = poses.select(*FRAME).distinct().withColumn("have_pose", F.lit(True))
        joined = (joined.join(grips.select("det_id", "hand", "distance_px", "grip", F.col("person_box").alias("grip_box")), "det_id", "left")
                  .join(kept.select("det_id", "containment", F.col("person_box").alias("carry_box")), "det_id", "left")
                  .join(posed, FRAME, "left").fillna(False, ["have_pose"]))
    else:
        box = "struct<x1:double,y1:double,x2:double,y2:double>"
        joined = joined.select("*", F.lit(None).cast("string").alias("hand"), F.lit(None).cast("double").alias("distance_px"),
                               F.lit(None).cast("double").alias("grip"), F.lit(None).cast(box).alias("grip_box"),
                               F.lit(None).cast("double").alias("containment"), F.lit(None).cast(box).alias("carry_box"),
                               F.lit(False).alias("have_pose"))
    held = F.col("grip").isNotNull()
    carry = ~held & F.col("containment").isNotNull() & F.col("have_pose")
    close = ~held & ~carry & F.col("person_distance").isNotNull()
    weapon = F.col("tool_category") == "weapon"
    found = joined.filter(weapon | held | carry | close)
    base = F.col("weight") * F.col("confidence")
    full = expr.lookup(dims.CATEGORY_SEVERITY, F.col("tool_category"), "high")
    name, d = F.col("tool_label"), F.col("person_distance")
    blind = ~F.col("have_pose")
    etype = (F.when(held, F.when(weapon, "weapon_brandished").otherwise("crime_tool_held"))
             .when(carry, F.when(weapon, "weapon_carried").otherwise("crime_tool_carried"))
             .when(close & blind, "weapon_brandished").when(close, "weapon_near_person").otherwise("weapon_visible"))
    severity = (F.when(held, full).when(carry, expr.severity_step(full, -1))
                .when(close & blind, "critical").otherwise("high"))
    score = (F.when(held, base + 0.10 + 0.20 * F.col("grip")).when(carry, base * cfg.carried_factor + 0.05)
             .when(close & blind, base + 0.15).when(close, base * 0.85).otherwise(base * 0.8))
    detail = (F.when(held, F.concat(name, F.lit(" at a person's "), F.col("hand"), F.lit(" hand ("), whole(F.col("distance_px")), F.lit("px from the wrist)")))
              .when(carry, F.concat(name, F.lit(" on a person but not at a hand ("), percent(F.col("containment")), F.lit(" inside their outline)")))
              .when(close & blind, F.concat(name, F.lit(" within "), percent(d), F.lit(" of frame diagonal of a person (no pose data — proximity only)")))
              .when(close, F.concat(name, F.lit(" near a person but not matched to a hand ("), percent(d), F.lit(" of frame diagonal away)")))
              .otherwise(F.concat(name, F.lit(" detected, no person in close proximity"))))
    person_box = F.when(held, F.col("grip_box")).when(carry, F.col("carry_box"))
    box_text = lambda b: F.to_json(F.array(*[b[c] for c in expr.BOX]))
    facts = evidence(**{
        "class": F.lower("cls"), "confidence": F.col("confidence"), "box": F.to_json(F.array(*expr.BOX)),
        "attachment": F.when(held, "held").when(carry, "carried").when(close, "proximate").otherwise("none"),
        "hand": F.when(held, F.col("hand")), "grip_confidence": F.col("grip"),
        "containment": F.when(carry, F.col("containment")), "person_distance": F.when(~held & ~carry, d),
        "person_box": F.when(person_box.isNotNull(), box_text(person_box))})
    return as_events(found, type=etype, label=F.concat(name, F.lit(" detected")),
                     category=F.when(weapon, "weapon").otherwise("crime_tool"), severity=severity, score=score,
                     rule="crime_tool_detection", detail=detail, ev=facts, subj=subject(F.lit("person"), person_box))


def people_counts(dets: DataFrame, poses: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    """Persons per frame: what the detector saw, and the larger of detector and pose.

    ``frames`` (source, frame_no, t) lists every processed frame, so that one where
    nothing was found counts 0. Without it, frames are those of ``dets`` and, if they
    carry ``t``, of ``poses``.
    """
    seen = dets.groupBy(*FRAME).agg(F.count_if(F.col("cls") == "person").alias("_d"))
    if frames is None:
        frames = dets.select(*FRAME, "t")
        if poses is not None and "t" in poses.columns:
            frames = frames.unionByName(poses.select(*FRAME, "t"))
    every = frames.groupBy(*FRAME).agg(F.min("t").alias("t")).join(seen, FRAME, "left")
    detector = F.coalesce("_d", F.lit(0)).alias("detector_people")
    if poses is None:
        return every.select(*FRAME, "t", detector).withColumn("people", F.col("detector_people"))
    posed = poses.groupBy(*FRAME).agg(F.count("*").alias("_p"))
    return (every.join(posed, FRAME, "left")
            .select(*FRAME, "t", detector, F.greatest(F.coalesce("_d", F.lit(0)), F.coalesce("_p", F.lit(0))).alias("people")))


def action_events(preds: DataFrame, people: DataFrame, cfg: RuleConfig = DEFAULTS) -> DataFrame:
    """Crime and violence from action labels: every candidate counts, the best weighted one fires.

    ``preds`` has one row per (frame, rank); ``people`` comes from ``people_counts``.
    """
    spark = preds.sparkSession
    known = preds.join(F.broadcast(dims.crime_actions(spark)), "label")
    bar = F.when(F.col("brief"), cfg.action_conf_brief).otherwise(cfg.action_conf)
    best = (known.filter(F.col("confidence") >= bar).withColumn("_w", F.col("base") * F.col("confidence"))
            .groupBy(*FRAME, "t")
            .agg(F.min_by(F.struct("label", "confidence", "type", "category", "base", "needs_two", "type_severity", "event_label"),
                          F.struct(-F.col("_w"), F.col("rank"))).alias("m")).select(*FRAME, "t", "m.*"))
    seen = best.join(people.drop("t"), FRAME, "left").fillna(0, ["people", "detector_people"])
    if cfg.violence_needs_two:
        seen = seen.filter(~F.col("needs_two") | (F.col("people") >= 2))
    score = F.least(F.lit(1.0), F.col("base") * (0.5 + F.col("confidence") / 2))
    severity = F.when((F.col("type_severity") == "critical") & (score < 0.7), "high").otherwise(F.col("type_severity"))
    return as_events(seen, label=F.col("event_label"), category=F.col("category"), severity=severity, score=score,
                     rule="action_recognition",
                     detail=F.concat(F.lit("Action '"), F.col("label"), F.lit("' at "), percent(F.col("confidence")),
                                     F.lit(" confidence with "), F.col("people").cast("string"), F.lit(" people in frame")),
                     ev=evidence(action=F.col("label"), confidence=F.col("confidence"), person_count=F.col("people"),
                                 detector_person_count=F.col("detector_people")))


def distress_events(preds: DataFrame, cfg: RuleConfig = DEFAULTS) -> DataFrame:
    spark = preds.sparkSession
    best = (preds.filter(F.col("confidence") >= cfg.action_conf)
            .join(F.broadcast(dims.distress_actions(spark)), "label").groupBy(*FRAME, "t")
            .agg(F.min_by(F.struct("label", "confidence", "base"), F.struct(-F.col("confidence"), F.col("rank"))).alias("m"))
            .select(*FRAME, "t", "m.*"))
    return as_events(best, type=F.lit("person_down"), label=F.lit("Person in distress"), category=F.lit("medical"),
                     severity=F.when(F.col("label").isin("falling", "staggering"), "high").otherwise("medium"),
                     score=F.least(F.lit(1.0), F.col("base") * (0.5 + F.col("confidence") / 2)), rule="action_recognition",
                     detail=F.concat(F.lit("Action '"), F.col("label"), F.lit("' at "), percent(F.col("confidence")), F.lit(" confidence")),
                     ev=evidence(action=F.col("label"), confidence=F.col("confidence")))


def crowd_events(counts: DataFrame, cfg: RuleConfig = DEFAULTS, slice_s: float = 600.0) -> DataFrame:
    """Surge, dispersal and density over a sliding window of the person count.

    ``counts`` has one row per frame: source, frame_no, t, people. A frame needs
    four earlier frames in its source and three frames in its window.
    """
    span = cfg.crowd_window_s
    w = slices.within(["source"], "t", -span, 0)
    seen = slices.running_total(counts, ["source"], "t", slice_s, F.lit(1), "history")
    x = (slices.sliced(seen, "t", slice_s, back=span)
         .withColumn("first", F.first("people").over(w)).withColumn("peak", F.max("people").over(w))
         .withColumn("in_window", F.count("*").over(w)).withColumn("last", F.col("people")))
    return crowd_changes(slices.home(x).filter((F.col("history") >= 5) & (F.col("in_window") >= 3)), cfg)


def crowd_changes(frames: DataFrame, cfg: RuleConfig = DEFAULTS) -> DataFrame:
    """Crowd events of frames (source, frame_no, t, first, peak, last): counts at the window's start, its highest and now."""
    span = cfg.crowd_window_s
    s = lambda c: F.col(c).cast("string")
    within = F.lit(f" in {span:.0f}s")

    def option(cond, etype, label, severity, score, detail, a, b):
        return F.when(cond, F.struct(F.lit(etype).alias("type"), F.lit(label).alias("label"), F.lit(severity).alias("severity"),
                                     F.lit(score).alias("score"), detail.alias("detail"), a.cast("long").alias("a"), b.cast("long").alias("b")))

    fired = F.array_compact(F.array(
        option(F.col("last") - F.col("first") >= cfg.crowd_surge, "crowd_surge", "Sudden crowd build-up", "medium", 0.55,
               F.concat(F.lit("Person count rose "), s("first"), F.lit(" → "), s("last"), within), F.col("first"), F.col("last")),
        option((F.col("peak") - F.col("last") >= cfg.crowd_dispersal) & (F.col("peak") >= cfg.crowd_surge), "crowd_dispersal",
               "Sudden dispersal", "high", 0.60,
               F.concat(F.lit("Person count fell "), s("peak"), F.lit(" → "), s("last"), within), F.col("peak"), F.col("last")),
        option(F.col("last") >= cfg.crowd_density, "crowd_density", "High crowd density", "low", 0.35,
               F.concat(s("last"), F.lit(" people in frame")), F.lit(None), F.col("last"))))
    e = frames.select("source", "frame_no", "t", F.explode(fired).alias("e")).select("source", "frame_no", "t", "e.*")
    return as_events(e, label=F.col("label"), category=F.lit("crowd"), severity=F.col("severity"), score=F.col("score"),
                     rule="crowd_dynamics", detail=F.col("detail"), ev=evidence(**{"from": F.col("a"), "to": F.col("b")}))


def zone_events(dets: DataFrame, zones: list[dict], cfg: RuleConfig = DEFAULTS, parity: bool = False) -> DataFrame:
    """A person inside a zone. Cooldown is per zone; ``parity`` shares one key among all zones."""
    hits = relate.in_zones(dets.filter(F.col("cls") == "person"), zones)
    return as_events(hits, type=F.lit("zone_intrusion"), label=F.concat(F.lit("Intrusion: "), F.col("zone")),
                     category=F.lit("perimeter"), severity=F.coalesce("zone_severity", F.lit(cfg.zone_severity)),
                     score=F.lit(0.65), rule="zone_intrusion",
                     detail=F.concat(F.lit("Person inside '"), F.col("zone"), F.lit("'")),
                     ev=evidence(zone=F.col("zone"), box=F.to_json(F.array(*expr.BOX))),
                     cooldown_key=None if parity else F.concat(F.lit("zone_intrusion:"), F.col("zone")))


def after_hours_events(counts: DataFrame, cfg: RuleConfig = DEFAULTS) -> DataFrame:
    """People present outside permitted hours, by the event's own clock (``event_ts``)."""
    start, end = cfg.after_hours_start, cfg.after_hours_end
    hour = F.hour("event_ts")
    active = ((hour >= start) | (hour < end)) if start > end else ((hour >= start) & (hour < end))
    hit = counts.filter((F.col("people") > 0) & active)
    return as_events(hit, type=F.lit("after_hours_presence"), label=F.lit("After-hours presence"), category=F.lit("perimeter"),
                     severity=F.lit("medium"), score=F.lit(0.50), rule="after_hours",
                     detail=F.concat(F.col("people").cast("string"), F.lit(" person(s) detected at "), F.format_string("%02d", hour), F.lit(":00")),
                     ev=evidence(count=F.col("people"), hour=hour))


def persist_detections(dets: DataFrame, sustain: float = 0.30, frames: int = 3, confirm: float = 0.45,
                       slice_frames: int = 20000) -> DataFrame:
    """Debounce a noisy detector per class.

    A strong hit fires at once; a weaker one must hold for ``frames`` consecutive
    processed frames and then fires with the window's peak. ``tick`` numbers the
    processed frames of a source; a frame without the class breaks the run, so
    equal class rows must lie exactly one tick apart.
    """
    keys = ["source", "cls"]
    best = (dets.groupBy(*keys, "tick").agg(
        F.min_by(F.struct("det_id", "frame_no", "t", "confidence", *expr.BOX), F.struct(-F.col("confidence"), F.col("det_id"))).alias("b")))
    held = best.withColumn("ok", F.col("b.confidence") >= sustain)
    w = Window.partitionBy(*keys, slices.SLICE).orderBy("tick").rangeBetween(-(frames - 1), 0)
    x = slices.home(slices.sliced(held, "tick", slice_frames, back=frames - 1)
                    .withColumn("_n", F.count_if("ok").over(w))
                    .withColumn("_peak", F.min_by("b", F.struct(-F.col("b.confidence"), F.col("tick"))).over(w)))
    confirmed = F.col("b.confidence") >= confirm
    sustained = ~confirmed & (F.col("_n") == frames)
    return (x.filter(confirmed | sustained)
            .select(*keys, "tick", F.when(confirmed, F.lit("confirmed")).otherwise("sustained").alias("reason"),
                    F.when(confirmed, F.col("b")).otherwise(F.col("_peak")).alias("hit"))
            .select(*keys, "tick", "reason", "hit.*"))


def all_events(*parts: DataFrame) -> DataFrame:
    """Union of rule outputs, with timecode and an id that is the same on every run."""
    every = reduce(lambda a, b: a.unionByName(b), [p.select(*EVENT) for p in parts])
    ident = F.xxhash64("source", "t", "rule", "cooldown_key", "type", "detail", F.to_json("evidence"))
    return (every.withColumn("event_id", ident).withColumn("timecode", expr.timecode(F.col("t")))
            .withColumn("snapshot", F.lit(None).cast("string")).withColumn("acknowledged", F.lit(False)))
