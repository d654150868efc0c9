"""Evaluation metrics: confusion, sweeps, neighbour distances, rank statistics."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from framelore import dims
from framelore.functions import expr
from framelore.operators import slices
from framelore.session import materialise


def confusion(preds: DataFrame) -> DataFrame:
    return preds.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def class_metrics(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs as truth."""
    cm = confusion(preds)
    rows = cm.groupBy(F.col("y_true").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = cm.groupBy(F.col("y_pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = rows.join(cols, "cls", "left").fillna(0, ["predicted"])
    m = m.withColumn("precision", safe(F.col("tp"), F.col("predicted"))).withColumn("recall", safe(F.col("tp"), F.col("support")))
    return m.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("tp", "predicted")


def overall_metrics(preds: DataFrame) -> DataFrame:
    """Accuracy, mean loss and macro-F1 over the classes present."""
    one = preds.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"), F.avg("loss").alias("loss"))
    return slices.with_one_row(one, class_metrics(preds).agg(F.avg("f1").alias("macro_f1")))


def false_crime_rate(preds: DataFrame, normal, non_crime: Sequence) -> DataFrame:
    """Share of normal clips taken for a crime class that occurs in the truth; flagged above 5 %."""
    crimes = preds.filter(~F.col("y_true").isin(list(non_crime))).select(F.col("y_true").alias("y_pred"), F.lit(True).alias("crime")).distinct()
    cm = confusion(preds.filter(F.col("y_true") == normal)).join(F.broadcast(crimes), "y_pred", "left")
    out = cm.agg(F.sum("n").alias("normal_clips"), F.sum(F.when(F.col("crime"), F.col("n")).otherwise(0)).alias("misflagged"))
    return out.withColumn("rate", F.col("misflagged") / F.col("normal_clips")).withColumn("too_high", F.col("rate") > 0.05)


def class_weights(clips: DataFrame) -> DataFrame:
    """Inverse-frequency weight of every class present."""
    counts = clips.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return slices.with_one_row(counts, total).select("label", "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def sample_weights(clips: DataFrame) -> DataFrame:
    """The weight of each clip's class on the clip; the weight table has one row per class."""
    return clips.join(class_weights(clips).select("label", "weight"), "label")


def misclassified(preds: DataFrame, n: int) -> DataFrame:
    """The first ``n`` wrong predictions, for a look at them."""
    return preds.filter(F.col("y_true") != F.col("y_pred")).orderBy("clip_id", "y_true", "y_pred").limit(n)


# ── threshold sweeps ─────────────────────────────────────────────────────────

def at_thresholds(scores: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Each score under every threshold it reaches."""
    t = F.array(*[F.lit(float(x)) for x in thresholds])
    return scores.withColumn("threshold", F.explode(F.filter(t, lambda x: x <= F.col("score"))))


def sweep_negatives(scores: DataFrame, frames: DataFrame, thresholds: Sequence[float] = dims.SWEEP_THRESHOLDS, max_rate: float = 1.0) -> DataFrame:
    """False alarms on clean frames per threshold, with the noisiest class.

    ``scores``: frame_id, class_id, score. ``frames``: every clean frame, also
    those without a detection. ``usable`` marks the lowest quiet enough threshold.
    """
    spark = scores.sparkSession
    hits = at_thresholds(scores, thresholds)
    # First per frame and class, so a crowded frame is one row in the second shuffle.
    per = hits.groupBy("threshold", "frame_id", "class_id").agg(F.count("*").alias("n"))
    frames_hit = per.groupBy("threshold", "frame_id").agg(F.sum("n").alias("n")).groupBy("threshold").agg(
        F.count("*").alias("frames_hit"), F.sum("n").alias("detections"))
    worst = per.groupBy("threshold", "class_id").agg(F.sum("n").alias("n")).groupBy("threshold").agg(
        F.min_by(F.struct("class_id", "n"), F.struct(-F.col("n"), F.col("class_id"))).alias("w"))
    base = slices.with_one_row(dims.rows_df(spark, [(float(t),) for t in thresholds], "threshold double"), frames.agg(F.count("*").alias("frames")))
    out = base.join(frames_hit, "threshold", "left").join(worst, "threshold", "left").fillna(0, ["frames_hit", "detections"])
    out = out.select("threshold", "frames", "frames_hit", "detections", (100.0 * F.col("frames_hit") / F.greatest("frames", F.lit(1))).alias("rate"),
                     F.col("w.class_id").alias("worst_class"), F.col("w.n").alias("worst_n"))
    low = F.min(F.when(F.col("rate") <= max_rate, F.col("threshold"))).over(Window.partitionBy(F.lit(0)))   # seven rows
    return out.withColumn("usable", F.col("threshold") == F.coalesce(low, F.lit(-1.0)))


def samples_in_spans(scores: DataFrame, spans: DataFrame, width: float = 60.0) -> DataFrame:
    """Best score of every sample time that falls into a labelled span.

    ``scores``: source, t, score (score null where nothing was seen); ``spans``:
    source, span_id, span_start, span_end (end exclusive).
    """
    j = slices.range_join(scores, spans, ["source"], "t", "span_start", "span_end", width).filter(F.col("t") < F.col("span_end"))
    return j.groupBy("span_id", "source", "t").agg(F.max("score").alias("best"))


def sweep_positives(scores: DataFrame, spans: DataFrame, thresholds: Sequence[float] = dims.SWEEP_THRESHOLDS) -> DataFrame:
    """Sample hits per span and threshold."""
    t = F.array(*[F.lit(float(x)) for x in thresholds])
    s = samples_in_spans(scores, spans).withColumn("threshold", F.explode(t))
    return s.groupBy("span_id", "threshold").agg(F.count("*").alias("frames"), F.count_if(F.col("best") >= F.col("threshold")).alias("hits"))


def sweep_verdict(negatives: DataFrame, positives: DataFrame) -> DataFrame:
    """usable, blind (quiet but sees nothing) or unusable, in one row."""
    n = negatives.agg(F.max(F.when(F.col("usable"), F.col("threshold"))).alias("usable_conf"))
    at = positives.join(F.broadcast(n), F.col("threshold") == F.col("usable_conf"), "inner").groupBy("usable_conf").agg(
        F.count_if(F.col("hits") > 0).alias("spans_hit"), F.count("*").alias("spans"))
    return n.join(at, "usable_conf", "left").select("usable_conf", F.coalesce("spans_hit", F.lit(0)).alias("spans_hit"), F.coalesce("spans", F.lit(0)).alias("spans"),
        F.when(F.col("usable_conf").isNull(), "unusable").when((F.coalesce("spans", F.lit(0)) > 0) & (F.col("spans_hit") == 0), "blind").otherwise("usable").alias("verdict"))


# ── verdicts against known times ─────────────────────────────────────────────

def match_truth(verdicts: DataFrame, truth: DataFrame, tol: float = 2.0, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Verdict windows with whether a true time lies within ``tol`` of their centre, and truth with whether it was found.

    ``verdicts``: source, window_id, centre, verdict, score; ``truth``: source,
    truth_id, truth_t.
    """
    shown = verdicts.filter(F.col("verdict").isNotNull() & (F.col("score") >= threshold))
    spans = truth.select("source", "truth_id", "truth_t", (F.col("truth_t") - tol).alias("lo"), (F.col("truth_t") + tol).alias("hi"))
    near = slices.range_join(shown.select("source", "window_id", "centre"), spans, ["source"], "centre", "lo", "hi", max(tol * 4, 1.0))
    hit = near.select("window_id").distinct().withColumn("hit", F.lit(True))
    found = near.select("truth_id").distinct().withColumn("found", F.lit(True))
    return (shown.join(hit, "window_id", "left").fillna(False, ["hit"]), truth.join(found, "truth_id", "left").fillna(False, ["found"]))


def sweep_prf(verdicts: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 from the two tables of ``match_truth``."""
    v = verdicts.agg(F.count_if(~F.col("hit")).alias("false_positives"))
    t = truth.agg(F.count("*").alias("incidents"), F.count_if("found").alias("detected"), F.count_if(~F.col("found")).alias("missed"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    m = slices.with_one_row(t, v)
    m = m.withColumn("precision", safe(F.col("detected"), F.col("detected") + F.col("false_positives"))).withColumn("recall", safe(F.col("detected"), F.col("incidents")))
    return m.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


# ── neighbour distance ───────────────────────────────────────────────────────

BANK_CAP = 4000   # fixed value: a bank never holds more windows than this


def cap_bank(bank: DataFrame, n: int = BANK_CAP, seed: int = 0, key: str = "vec_id") -> DataFrame:
    """A fixed random subset of at most n windows: the smallest hashes, so the same on every run."""
    return bank.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def hold_out(bank: DataFrame, spans: DataFrame, width: float = 60.0) -> DataFrame:
    """The bank windows that must not score a span: those of its video whose range overlaps it (a missing end: the whole file).

    ``bank``: video, a, b, ...; ``spans``: span_id, video, start, end. Returns the
    pairs to *exclude*: a bank window is only ever near spans of its own video.
    """
    whole = F.col("a").isNull() | F.col("b").isNull()
    w = bank.withColumn("_lo", F.when(~whole, F.col("a"))).withColumn("_hi", F.when(~whole, F.col("b")))
    s = spans.select("span_id", "video", F.col("start").alias("_start"), F.col("end").alias("_end"))
    return slices.overlap_join(w, s, ["video"], ("_lo", "_hi"), ("_start", "_end"), width).select("span_id", *bank.columns)


STRIP = 1 << 23   # similarities a task holds at once: 64 MB
SMALL_BANK = 1 << 20   # numbers of a bank (rows by dimension) that may be sent to every task: 8 MB


def knn_distance(x: DataFrame, bank: DataFrame, k: int = 8, excluded: DataFrame | None = None, key: str = "vec_id",
                 group: str = "span_id", block: int = 8000) -> DataFrame:
    """Mean cosine distance of each vector to its k nearest bank vectors, at any size of the bank.

    A bank of at most ``SMALL_BANK`` numbers goes to every task, and the vectors stay where they
    are. A larger one is dealt into blocks of about ``block`` vectors and the vectors into
    blocks of as many; every pair of blocks is one task's work, done in strips of matrix products that keep the k nearest
    of each vector, and the best of these are merged per vector. How often a vector or a
    bank block is copied depends on both counts alone, not on the session. ``excluded`` lists (group, key)
    pairs that must not score: as many more candidates as a group has of them are kept
    for its rows, and the pairs are then removed by a join.
    """
    first, total = bank.select(F.size("embedding").alias("d")).first(), bank.count()
    none = float("nan")
    if excluded is None and (first is None or total * first["d"] <= SMALL_BANK):
        return near_small(x, bank, k)
    rows = materialise(x.withColumn("_row", F.monotonically_increasing_id()), "knn-rows")
    count, deals = max(1, -(-total // block)), max(1, -(-rows.count() // block))
    dealt = bank.select(F.pmod(F.xxhash64(key), F.lit(count)).alias("_b"), F.struct(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).alias("_m"))
    blocks = dealt.groupBy("_b").agg(F.collect_list("_m").alias("_m"))  # ``block`` vectors a row
    wanted = F.lit(k)
    asked = rows.select("_row", *([group] if excluded is not None else []), F.col("embedding").cast("array<double>").alias("_v"))
    if excluded is not None:
        barred = excluded.select(group, F.col(key).cast("long").alias("near")).distinct()
        asked = asked.join(barred.groupBy(group).agg(F.count(F.lit(1)).alias("_more")), group, "left")
        wanted = F.lit(k) + F.coalesce("_more", F.lit(0))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    met = asked.select("_row", "_v", wanted.cast("long").alias("_want"), F.pmod(F.xxhash64("_row"), F.lit(deals)).alias("_p"), every(count).alias("_b"))
    spread = blocks.withColumn("_p", every(deals))

    def nearest(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"_row": [], "near": [], "sim": []})
        m, ids = unit_rows([r["v"] for r in right["_m"].iloc[0]]), np.array([r["id"] for r in right["_m"].iloc[0]])
        asked_, most = unit_rows(left["_v"]), min(int(left["_want"].max()), len(ids))
        strips = [best_of(asked_[i:i + STRIP // len(ids) + 1] @ m.T, most) for i in range(0, len(left), STRIP // len(ids) + 1)]
        at, sim = (np.concatenate(part) for part in zip(*strips))
        return pd.DataFrame({"_row": np.repeat(left["_row"].to_numpy(), at.shape[1]), "near": ids[at].ravel(), "sim": sim.ravel()})

    found = met.groupBy("_b", "_p").cogroup(spread.groupBy("_b", "_p")).applyInPandas(nearest, "_row long, near long, sim double")
    if excluded is not None:
        found = found.join(rows.select("_row", group), "_row").join(barred, [group, "near"], "left_anti").select("_row", "near", "sim")
    order = Window.partitionBy("_row").orderBy(F.desc("sim"), "near")
    best = found.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).groupBy("_row").agg((1 - F.avg("sim")).alias("distance"))
    return (rows.join(best, "_row", "left").withColumn("distance", F.coalesce("distance", F.lit(none)))
            .select(*[c for c in x.columns if c != "embedding"], "distance"))


def unit_rows(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, float) for v in vectors])
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


def best_of(sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and values of the ``most`` largest of each row."""
    at = np.argpartition(-sim, most - 1, axis=1)[:, :most]
    return at, np.take_along_axis(sim, at, axis=1)


def near_small(x: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """``knn_distance`` against a bank of bounded size."""
    held = [r["v"] for r in bank.select(F.col("embedding").cast("array<double>").alias("v")).collect()]  # at most ``SMALL_BANK`` numbers
    shared = x.sparkSession.sparkContext.broadcast(unit_rows(held) if held else None)
    kept = [c for c in x.columns if c != "embedding"]
    schema = T.StructType([*[x.schema[c] for c in kept], T.StructField("distance", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = shared.value
            if m is None or not len(f):
                yield f[kept].assign(distance=float("nan"))
                continue
            _, sim = best_of(unit_rows(f["embedding"]) @ m.T, min(k, len(m)))
            yield f[kept].assign(distance=1 - sim.mean(axis=1))

    return x.mapInPandas(run, schema).withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))


def auc(scores: DataFrame, value: str = "score", label: str = "positive") -> DataFrame:
    """Probability that a positive outranks a negative; equal scores count half.

    Scores are counted first, then ranked over range partitions: no global sort in one task.
    """
    per = scores.groupBy(value).agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("n"))
    cum = slices.ordered_total(per, [], [value], "n", "below")
    wins = F.sum(F.col("p") * (F.col("below") - F.col("n")) + F.col("p") * F.col("n") / 2)
    return cum.agg((wins / (F.sum("p") * F.sum("n"))).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def span_scores(distances: DataFrame) -> DataFrame:
    """Median and maximum distance per span, and whether an incident span lies above the normal median.

    ``distances``: span_id, incident, distance. They are read three times, so they are written once first.
    """
    distances = materialise(distances, "distances")
    med = slices.quantile_at(distances, ["span_id", "incident"], "distance", {"median": 0.5})
    top = distances.groupBy("span_id", "incident").agg(F.max("distance").alias("max"), F.count("*").alias("windows"))
    normal = slices.quantile_at(distances.filter(~F.col("incident")), [], "distance", {"normal_median": 0.5})
    return (slices.with_one_row(top.join(med, ["span_id", "incident"]), normal)
            .withColumn("above_normal", F.col("incident") & (F.col("median") > F.col("normal_median"))))
