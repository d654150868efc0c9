"""Dataset preparation and audit."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from framelore import dims
from framelore.functions import expr
from framelore.operators import slices
from framelore.operators.frames import draw
from framelore.session import materialise


# ── labels and spans ─────────────────────────────────────────────────────────

def map_taxonomy(df: DataFrame, mapping: dict, col: str = "category") -> tuple[DataFrame, DataFrame]:
    """Rows with their target label (those without one dropped), and the categories nobody mapped."""
    spark = df.sparkSession
    dim = F.broadcast(dims.rows_df(spark, list(mapping.items()), f"{col} string, target string"))
    return (df.join(dim, col).filter(F.col("target").isNotNull()), df.select(col).distinct().join(dim, col, "left_anti"))


def provisional_spans(videos: DataFrame, anomaly_s: float = 4.0, normal_s: float = 20.0) -> DataFrame:
    """A guessed span per video: the middle for anomalies, the head for normal footage; a second or less is dropped."""
    d, normal = F.col("duration"), F.col("target") == "normal"
    mid = d / 2
    return (videos.filter(d > 1.0)
            .withColumn("start", F.when(normal, 0.0).otherwise(F.greatest(F.lit(0.0), mid - anomaly_s / 2)))
            .withColumn("end", F.when(normal, F.least(d, F.lit(float(normal_s)))).otherwise(F.least(d, mid + anomaly_s / 2))))


def video_key(name: Column) -> Column:
    """Copies of a video differ by a suffix; the key is what they share."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")
    cut = lambda c, at: F.element_at(F.split(c, at, 2), 1)
    return cut(cut(cut(stem, r" \("), "_1"), "_2")


def incident_spans(annotations: DataFrame) -> DataFrame:
    """Labelled spans other than normal, by video key."""
    label = F.lower(F.trim("label"))
    return (annotations.filter((label != "") & (label != "normal") & F.col("start").isNotNull() & F.col("end").isNotNull())
            .select(video_key(F.trim("video")).alias("video_key"), "start", "end", label.alias("label")))


def annotation_summary(spans: DataFrame) -> DataFrame:
    """Spans, videos and minutes per split and overall; classes are counted by ``class_counts``."""
    return (spans.rollup("split").agg(F.count("*").alias("spans"), F.count_distinct("video").alias("videos"),
                                      F.sum((F.col("end") - F.col("start")) / 60).alias("minutes"))
            .withColumn("split", F.coalesce("split", F.lit("all"))))


def class_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("label").agg(F.count("*").alias("n"))


def exclude_incident_time(samples: DataFrame, spans: DataFrame, pad: float = 1.0, keys: Sequence[str] = ("video_key",), width: float = 60.0) -> DataFrame:
    """Samples not within ``pad`` seconds of a labelled incident of their video."""
    s = spans.select(*keys, (F.col("start") - pad).alias("lo"), (F.col("end") + pad).alias("hi"))
    return slices.range_join(samples, s, list(keys), "t", "lo", "hi", width, "left_anti")


def leakage(negatives: DataFrame, positives: DataFrame, width: float = 60.0) -> DataFrame:
    """Videos in both sets, and whether any of their spans overlap."""
    both = negatives.select("video").intersect(positives.select("video"))
    n = negatives.select("video", F.col("start").alias("_a"), F.col("end").alias("_b")).distinct()
    p = positives.select("video", F.col("start").alias("_c"), F.col("end").alias("_d")).distinct()
    bad = slices.overlap_join(n, p, ["video"], ("_a", "_b"), ("_c", "_d"), width, "left_semi").select("video").distinct().withColumn("overlaps", F.lit(True))
    return both.join(bad, "video", "left").fillna(False, ["overlaps"])


def mask_runs(mask: DataFrame, slice_frames: int = 100_000) -> DataFrame:
    """Runs of equal values in a 0/1 mask (video, frame_no, value) as [start, end)."""
    w = Window.partitionBy("video", slices.SLICE).orderBy("frame_no")
    x = slices.sliced(mask, "frame_no", slice_frames, back=1)
    x = slices.home(x.withColumn("_new", F.coalesce((F.lag("value").over(w) != F.col("value")) | (F.lag("frame_no").over(w) < F.col("frame_no") - 1), F.lit(True)).cast("long")))
    run = slices.running_total(x, ["video"], "frame_no", slice_frames, F.col("_new"), "run")
    return (run.groupBy("video", "run", "value").agg(F.min("frame_no").alias("start"), (F.max("frame_no") + 1).alias("end")))


def pose_coverage(frames: DataFrame, minimum: float = 0.25) -> DataFrame:
    """Spans in which pose saw somebody often enough. ``frames``: span_id, label, people."""
    return (frames.groupBy("span_id", "label").agg(F.count("*").alias("frames"), F.count_if(F.col("people") > 0).alias("detected"))
            .withColumn("coverage", F.col("detected") / F.col("frames")).filter(F.col("coverage") >= minimum))


def clip_balance(clips: DataFrame) -> DataFrame:
    """Clips per class, classes too thin to learn, and whether normal footage is under-represented."""
    n = clips.groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.coalesce(F.sum(F.when(F.col("label") == "normal", F.col("n"))), F.lit(0)).alias("_normal"))
    return slices.with_one_row(n, total).select("label", "n", (F.col("n") < 30).alias("thin"), (F.col("_normal") < F.col("_all") * 0.3).alias("few_normals"))


# ── box labels ───────────────────────────────────────────────────────────────

def with_area(labels: DataFrame) -> DataFrame:
    """Object area as a share of the frame in percent: width x height, or the polygon's own area."""
    n = F.size("coords")
    a = (F.when(n == 4, F.get("coords", F.lit(2)) * F.get("coords", F.lit(3)))
         .when((n >= 6) & (n % 2 == 0), expr.polygon_area(F.col("coords"))))
    return labels.withColumn("area_pct", a * 100.0).filter(F.col("area_pct").isNotNull())


def audit_labels(labels: DataFrame, target_pct: float = 0.4) -> DataFrame:
    """Per class: instances, images, p10/median/p90 of object size, and how that compares with deployment."""
    a = with_area(labels)
    q = slices.quantile_at(a, ["class_id"], "area_pct", {"p10": 0.1, "median": 0.5, "p90": 0.9}, nearest=True)
    n = a.groupBy("class_id").agg(F.count("*").alias("instances"), F.count_distinct("image").alias("images"),
                                  F.count_if(F.size("coords") == 4).alias("boxes"))
    r = F.col("ratio")
    text = (F.when(r > 10, F.concat(F.bround(r, 0).cast("long").cast("string"), F.lit("x TOO LARGE")))
            .when(r < 0.1, F.concat(F.bround(1 / r, 0).cast("long").cast("string"), F.lit("x too small")))
            .when(r > 3, F.concat(F.format_string("%.1f", r), F.lit("x large"))).otherwise("ok"))
    return n.join(q, "class_id").withColumn("ratio", F.col("median") / target_pct).withColumn("verdict", text)


def audit_summary(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images, labelled, empty (negatives), missing; class imbalance. ``images``: image, has_file."""
    per = labels.groupBy("image").agg(F.count("*").alias("lines"))
    i = images.join(per, "image", "left").agg(
        F.count("*").alias("images"), F.count_if(F.col("has_file") & (F.coalesce("lines", F.lit(0)) > 0)).alias("labelled"),
        F.count_if(F.col("has_file") & F.col("lines").isNull()).alias("negatives"), F.count_if(~F.col("has_file")).alias("missing"))
    c = with_area(labels).groupBy("class_id").agg(F.count("*").alias("n")).agg((F.max("n") / F.min("n")).alias("imbalance"))
    return slices.with_one_row(i, c).withColumn("imbalanced", F.coalesce(F.col("imbalance") > 3, F.lit(False)))


def filter_by_scale(labels: DataFrame, images: DataFrame, max_pct: float = 5.0, min_pct: float = 0.0) -> DataFrame:
    """Whether to keep each image: every object small (and large) enough; images without objects are kept."""
    size = with_area(labels).groupBy("image").agg(F.max("area_pct").alias("biggest"), F.min("area_pct").alias("smallest"), F.count("*").alias("instances"))
    small = (F.col("smallest") < min_pct) if min_pct else F.lit(False)
    why = F.when(F.col("biggest").isNull(), "negative").when(F.col("biggest") > max_pct, "too_big").when(small, "too_small").otherwise("fits")
    return (images.select("image").join(size, "image", "left").withColumn("reason", why)
            .withColumn("keep", F.col("reason").isin("negative", "fits")).fillna(0, ["instances"]))


def mix_ratio(records: DataFrame, normal: Column) -> DataFrame:
    """Share of normal (or negative) records and whether it is below 30 %, or outside 10–30 %."""
    m = records.agg(F.count("*").alias("records"), F.count_if(normal).alias("normals"))
    share = F.col("normals") / F.col("records")
    return m.withColumn("share", share).withColumn("too_few_normals", share < 0.30).withColumn("negatives_in_band", (share >= 0.10) & (share <= 0.30))


# ── candidates ───────────────────────────────────────────────────────────────

def rank_windows(samples: DataFrame, window_s: float = 4.0, stride_s: float = 1.0) -> DataFrame:
    """Interaction score of sliding windows.

    ``samples``: source, t, people, gap (null when fewer than two people), motion.
    Windows start at the first sample of a source and step by ``stride_s``; a
    sample is copied into the few windows that hold it.
    """
    ends = samples.groupBy("source").agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    s = samples.join(ends, "source")
    off = F.col("t") - F.col("_t0")
    lo = F.greatest(F.lit(0).cast("long"), (F.floor((off - window_s) / stride_s) + 1).cast("long"))
    hi = F.least(F.floor(off / stride_s).cast("long"), F.floor((F.col("_t1") + 1e-6 - F.col("_t0") - window_s) / stride_s).cast("long"))
    s = s.withColumn("_k", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    g = F.coalesce("gap", F.lit(1.0))
    w = (s.groupBy("source", (F.col("_t0") + F.col("_k") * stride_s).alias("start")).agg(
        F.count("*").alias("_n"), F.avg((F.col("people") >= 2).cast("double")).alias("multi"), F.avg((g < 0.18).cast("double")).alias("close"),
        F.percentile("motion", 0.9).alias("peak_motion"), (F.max(g) - F.min(g)).alias("gap_swing"), F.max("people").alias("people_max")))
    return (w.filter(F.col("_n") >= 2).drop("_n").withColumn("end", F.col("start") + window_s)
            .withColumn("score", 2.0 * F.col("multi") * F.col("close") + 40.0 * F.col("peak_motion") + 4.0 * F.col("gap_swing")))


def merge_windows(windows: DataFrame, gap_s: float = 0.5, max_span: float = 12.0, slice_s: float = 3600.0) -> DataFrame:
    """Join overlapping windows into spans of at most ``max_span`` seconds, per source, in time order."""
    cols = ["source", "start", "end", "score", "people_max"]
    windows = materialise(windows, "windows")
    schema = T.StructType([windows.schema[c] for c in ("source", "start")] + [T.StructField("span_start", T.DoubleType())])

    def fold(rows: slices.Columns, span):
        out = []
        for source, start, end in zip(rows["source"], rows["start"], rows["end"]):
            if span is not None and start <= span[1] + gap_s and end - span[0] <= max_span:
                span = [span[0], max(span[1], float(end))]
            else:
                span = [float(start), float(end)]
            out.append((source, start, span[0]))
        return dict(zip(schema.names, zip(*out))) if out else dict.fromkeys(schema.names, ()), span

    settle = lambda span, start: None if span is None or start - span[0] > max_span else span
    at = slices.carry_scan(windows.select(*cols), ["source"], "start", slice_s, 4 * max_span, fold, schema, ["end"], settle=settle)
    return (windows.join(at, ["source", "start"]).groupBy("source", F.col("span_start").alias("start"))
            .agg(F.max("end").alias("end"), F.max("score").alias("score"), F.max("people_max").alias("people_max")))


def pick_candidates(windows: DataFrame, top: int, normals: int, pct: float = 90.0, max_span: float = 12.0) -> DataFrame:
    """The best spans of each source to look at, and quiet spans with people as ready-made negatives."""
    windows = materialise(windows, "windows")
    cut = slices.quantile_at(windows, ["source"], "score", {"cutoff": pct / 100.0})
    w = windows.join(cut, "source")
    strong = merge_windows(w.filter(F.col("score") >= F.col("cutoff")).drop("cutoff"), max_span=max_span)
    quiet = merge_windows(w.filter((F.col("people_max") >= 1) & (F.col("score") < F.col("cutoff"))).drop("cutoff"), max_span=max_span)

    def best(df, n, label):
        r = Window.partitionBy("source").orderBy(F.desc("score"), "start")
        return df.withColumn("place", F.row_number().over(r)).filter(F.col("place") <= n).withColumn("label", F.lit(label))

    return best(strong, top, "").unionByName(best(quiet, normals, "normal"))


# ── near duplicates and mining ───────────────────────────────────────────────

def drop_near_duplicates(frames: DataFrame, thr: float = 6.0, keys: Sequence[str] = ("source",), ts: str = "t", key: str = "frame_id",
                         slice_s: float = 3600.0) -> DataFrame:
    """Drop a frame whose thumbnail is within ``thr`` of the last *kept* one (mean absolute difference)."""
    schema = T.StructType([frames.schema[key]])

    def fold(rows: slices.Columns, last):
        keep = []
        last = None if last is None else np.array(last, dtype=float)
        for i, v in zip(rows[key], rows["vec"]):
            v = np.asarray(v, dtype=float)
            if last is None or np.abs(v - last).mean() >= thr:
                keep.append(i)
                last = v
        return {key: keep}, None if last is None else last.tolist()

    def summary(rows: slices.Columns):
        m = np.stack(rows["vec"]).astype(float)
        return {"lo": m.min(0).tolist(), "hi": m.max(0).tolist()}

    def advance(last, s):
        if last is None:
            return None
        last, lo, hi = np.array(last), np.array(s["lo"]), np.array(s["hi"])
        worst = np.maximum(np.abs(lo - last), np.abs(hi - last)).mean()
        return last.tolist() if worst < thr else None

    kept = slices.carry_scan(frames.select(*keys, ts, key, "vec"), list(keys), ts, slice_s, slice_s / 20, fold, schema, [key],
                             summary=summary, advance=advance)
    return frames.join(kept, key, "left_semi")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows per key; limited per input partition before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def mine_negatives(frames: DataFrame, trusted: DataFrame, spans: DataFrame, every: float = 2.0, cap: int | None = None, thr: float = 6.0) -> DataFrame:
    """Clean frames for training: sampled from trusted stretches, away from incidents, without near copies.

    ``frames``: source, frame_id, t, vec; ``trusted``: source, from_t, to_t;
    ``spans``: source, start, end of labelled incidents. Negatives only ever go
    into the training split.
    """
    at = slices.range_join(frames, trusted, ["source"], "t", "from_t", "to_t", 60.0).filter(F.col("t") < F.col("to_t"))
    # One frame per sampling step: the first at or after it.
    step = F.floor((F.col("t") - F.col("from_t")) / every + 1e-9)
    sampled = at.groupBy("source", "from_t", step.alias("_k")).agg(F.min_by(F.struct(*frames.columns), F.struct("t", "frame_id")).alias("f")).select("f.*").dropDuplicates(["frame_id"])
    clean = exclude_incident_time(sampled, spans, 1.0, ["source"])
    kept = drop_near_duplicates(clean, thr)
    if cap is not None:
        kept = first_n(kept, ["source"], ["t", "frame_id"], cap)
    return kept.withColumn("split", F.lit("train")).withColumn("label_text", F.lit(""))


# ── sampling and splits ──────────────────────────────────────────────────────

def cap_per_category(df: DataFrame, cap: int, normal_cap: int | None = None, seed: int = 0, key: str = "item_id", normal: Column | None = None) -> DataFrame:
    """At most ``cap`` items per category in a fixed random order, with its own cap for normal ones."""
    limit = F.lit(cap) if normal is None or normal_cap is None else F.when(normal, normal_cap).otherwise(cap)
    w = Window.partitionBy("category").orderBy(F.xxhash64(F.lit(seed), key), key)
    top = max(cap, normal_cap or cap)
    return (df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top).filter(F.col("_n") <= limit).drop("_n"))


def split(df: DataFrame, fracs: dict[str, float], seed: int = 0, key: str = "item_id", rest: str = "train") -> DataFrame:
    """Assign splits by a hash of the key: stable under re-runs, growth and repartitioning."""
    u, name, upto = draw(seed, key), F.lit(rest), 0.0
    bounds = []
    for s, f in fracs.items():
        upto += f
        bounds.append((s, upto))
    for s, b in reversed(bounds):
        name = F.when(u < b, s).otherwise(name)
    return df.withColumn("split", name)


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int = 0, key: str = "item_id", draws: DataFrame | None = None, share: int = 100_000) -> DataFrame:
    """n draws with replacement, in proportion to ``weight``; rows of null or no weight are never drawn.

    Rows are laid end to end, in the order of ``key``, on a line as long as the total
    weight (prefix sums over range partitions). A draw is a place on this line: a seeded hash
    of its number, or ``draws`` (draw_no, u) with u in [0, 1). Draws are sent to partitions by binary
    search in the partitions' ends, one number each; inside, another search finds the row. A
    partition that gets more than ``share`` draws, as one of a very heavy row does, is
    copied for every further ``share``.
    """
    spark = df.sparkSession
    line = df.select(key, F.col(weight).cast("double").alias("_w")).filter("_w > 0").groupBy(key).agg(F.sum("_w").alias("_w"))
    line = materialise(slices.ordered_total(line, [], [key], "_w", "hi"), "line")
    # Long as in the draws: cogrouped sides whose keys differ in type are hashed to different tasks.
    line = materialise(line.repartitionByRange("hi").withColumn("_part", F.spark_partition_id().cast("long")), "line")
    ends = line.groupBy("_part").agg(F.max("hi").alias("hi"), F.max("hi_all").alias("total")).orderBy("hi").collect()  # a row a partition
    if not ends:
        return df.withColumn("draw_no", F.lit(None).cast("long")).filter(F.lit(False))
    total, bounds, names = ends[-1]["hi"], np.array([r["hi"] for r in ends]), np.array([r["_part"] for r in ends], np.int64)
    if draws is None:
        draws = spark.range(n).select(F.col("id").alias("draw_no")).withColumn("u", draw(seed + 1, "draw_no"))
    draws = draws.select(F.col("draw_no").cast("long").alias("draw_no"), (F.col("u") * total).alias("at"))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(_part=names[np.minimum(np.searchsorted(bounds, f["at"].to_numpy(), side="right"), len(bounds) - 1)])

    sent = materialise(draws.mapInPandas(send, "draw_no long, at double, _part long"), "draws")
    copies = materialise(sent.groupBy("_part").agg(F.ceil(F.count("*") / share).cast("long").alias("_copies")), "copies")
    copies = {r["_part"]: r["_copies"] for r in copies.collect()}  # a number a partition
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for part, c in copies.items() for x in (part, c)]), F.col("_part")), F.lit(0)) if copies else F.lit(0)
    some = sent.withColumn("_copy", F.pmod(F.xxhash64("draw_no"), many))
    rows = line.filter(many > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    schema = T.StructType([T.StructField("draw_no", T.LongType()), df.schema[key]])

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("hi")
        at = np.minimum(np.searchsorted(right["hi"].to_numpy(), left["at"].to_numpy(), side="right"), len(right) - 1)
        return pd.DataFrame({"draw_no": left["draw_no"].to_numpy(), key: right[key].to_numpy()[at]} if len(left) else {"draw_no": [], key: []})

    hit = some.groupBy("_part", "_copy").cogroup(rows.groupBy("_part", "_copy")).applyInPandas(find, schema)
    return df.join(hit, key)


def top_k(df: DataFrame, by: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *tie).limit(k)


def build_sft_records(images: DataFrame, cap: int | None = None, normal_cap: int | None = None, holdout: float = 0.15, seed: int = 0) -> DataFrame:
    """Fine-tuning records: category → prompt and two-line target, split, and capped per category if asked.

    ``images``: item_id, category. Spelling variants map to their category;
    unknown categories are treated as normal and marked.
    """
    spark = images.sparkSession
    variant = expr.lookup(dims.CATEGORY_ALIASES, F.translate(F.lower("category"), " ", "_"))
    known = F.col("category").isin(list(dims.CATEGORY_TARGETS))
    named = images.withColumn("_known", known | variant.isNotNull()).withColumn(
        "target_category", F.when(known, F.col("category")).otherwise(F.coalesce(variant, F.lit("Normal"))))
    t = named.join(F.broadcast(dims.category_targets(spark)), "target_category")
    capped = t if cap is None else cap_per_category(t, cap, normal_cap, seed, normal=F.col("is_normal"))
    return (split(capped, {"holdout": holdout}, seed + 1).withColumn("prompt", F.lit(dims.FRAME_PROMPT))
            .select("item_id", "category", "target_category", "prompt", "response", "split", "is_normal", (~F.col("_known")).alias("unrecognised")))
