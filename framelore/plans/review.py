"""End-to-end plans: recorded footage to events, incidents and a report."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from framelore.config import DEFAULTS, RuleConfig
from framelore.operators import captions as cap, incidents as inc, rules, tracks as tr
from framelore.session import materialise


def detect_events(dets: DataFrame, poses: DataFrame | None = None, preds: DataFrame | None = None, captions: DataFrame | None = None,
                  zones: list[dict] = (), cfg: RuleConfig = DEFAULTS, frames: DataFrame | None = None,
                  starts: DataFrame | None = None) -> DataFrame:
    """All rules over one set of perception tables, floors and cooldown applied.

    Tracks and speeds are written once and shared by the rules that need motion.
    ``frames`` (source, frame_no, t) lists every processed frame. ``starts`` (source,
    started) gives the wall clock of t = 0; with it the after-hours rule runs too.
    """
    tracks = tr.track(dets, cfg.track_iou, cfg.track_max_misses, frames)
    speeds = materialise(tr.track_speed(tracks), "speeds")
    hits = materialise(tr.collisions(tracks, cfg, speeds), "collisions")
    every = tracks.select("source", "tick", "t") if frames is None else tr.with_ticks(frames).select("source", "tick", "t")
    people = rules.people_counts(dets, poses, frames)
    parts = [rules.weapon_events(dets, poses, cfg), tr.collision_events(hits), tr.left_scene(tr.lost_tracks(tracks, every, cfg.track_max_misses), hits, speeds, cfg),
             tr.snatch_trajectory(tracks, cfg, speeds), rules.crowd_events(people.withColumn("people", F.col("detector_people")), cfg),
             rules.zone_events(dets, list(zones), cfg), tr.loitering(tracks, cfg), tr.unattended(tracks, cfg)]
    if preds is not None:
        parts += [rules.action_events(preds, people, cfg), rules.distress_events(preds, cfg)]
    if captions is not None:
        parts.append(cap.caption_events(captions, cap.signals(dets, preds, frames), cfg))
    if starts is not None:
        clock = F.timestamp_micros((F.unix_micros("started") + F.round(F.col("t") * 1_000_000)).cast("long"))
        parts.append(rules.after_hours_events(people.join(starts, "source").withColumn("event_ts", clock), cfg))
    # Each rule's output is small beside its input; written on its own it plans and fails on its own.
    events = rules.all_events(*[materialise(p, "rule") for p in parts])
    return materialise(inc.finalise(events, cfg), "kept")


def build_report(events: DataFrame, captions: DataFrame | None = None, facts: DataFrame | None = None, gap_s: float = 20.0, *, top: int, appearances: int = 0,
                 entities: DataFrame | None = None, sightings: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """The report in long form: source, section, place, body (JSON).

    With entities (their ``source``, kind and label), sightings and incident links, the
    report has the sections of persons, vehicles and repeat subjects. ``top`` is how many dominant
    types a summary names, ``appearances`` how many last appearances a subject has.

    Nothing is gathered per source: a source with a third of all events simply has
    more rows. Order by (source, section, place) to read it.
    """
    incidents = materialise(inc.cluster_events(events, gap_s), "incidents")

    def section(df: DataFrame, name: str, *order) -> DataFrame:
        cols = [c for c in df.columns if c != "source"]
        place = F.struct(*order) if order else F.struct(F.lit(0).alias("o"))
        return df.select("source", F.lit(name).alias("section"), F.to_json(place).alias("place"), F.to_json(F.struct(*cols)).alias("body"))

    parts = [section(inc.summary(incidents, events, top=top), "summary"),
             section(incidents.withColumn("order", 4 - F.col("severity_rank")), "incidents", "order", "first_time_s"),
             section(inc.recommended_actions(incidents), "recommended_actions", "video_time_s"),
             section(events.groupBy("source", "severity", "type").agg(F.count("*").alias("n")), "counts", "severity", "type")]
    if captions is not None:
        said = captions.filter(~F.lower("text").startswith("no incident observed"))
        parts.append(section(said.select("source", "t", "caption_id", "text"), "observations", "t", "caption_id"))
    if facts is not None:
        parts.append(section(inc.caveats(facts, incidents).select("source", F.posexplode("caveats").alias("n", "caveat")), "caveats", "n"))
    if entities is not None:
        of = entities.select("entity_id", "source")
        for name, rows in (("persons", inc.people_section(entities, sightings, links, appearances)), ("vehicles", inc.vehicle_section(entities, sightings, links, appearances)),
                           ("repeat_subjects", inc.repeat_subjects(entities, links))):
            parts.append(section(rows.join(of, "entity_id"), name, "entity_id"))
    return reduce(DataFrame.unionByName, parts)


def session_report(alerts: DataFrame, captions: DataFrame | None = None, gap_s: float = 20.0, *, top: int) -> DataFrame:
    """The same report for a live session: times count from its start."""
    start = alerts.groupBy("source").agg(F.min("t").alias("_t0"))
    shift = lambda df: df.join(start, "source").withColumn("t", F.col("t") - F.col("_t0")).drop("_t0")
    return build_report(shift(alerts), captions if captions is None else shift(captions), None, gap_s, top=top)
