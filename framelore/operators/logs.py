"""Listings, searches, counters and exports over the stored logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from framelore import dims
from framelore.functions import expr


def at_least(df: DataFrame, min_severity: str | None) -> DataFrame:
    return df if min_severity is None else df.filter(expr.severity_rank(F.col("severity")) >= dims.SEVERITY_RANK.get(min_severity, 0))


def list_alerts(alerts: DataFrame, limit: int, min_severity: str | None = None, unacknowledged_only: bool = False) -> DataFrame:
    """Newest first; the filters come before the limit."""
    out = at_least(alerts, min_severity)
    if unacknowledged_only:
        out = out.filter(~F.col("acknowledged"))
    return out.orderBy(F.desc("t"), F.desc("event_id")).limit(limit)


def recent(events: DataFrame, limit: int, min_severity: str | None = None) -> DataFrame:
    """The last events, then filtered: a floor can leave fewer than ``limit``."""
    return at_least(events.orderBy(F.desc("t"), F.desc("event_id")).limit(limit), min_severity)


def list_events(events: DataFrame, limit: int, min_severity: str | None = None) -> DataFrame:
    return at_least(events, min_severity).orderBy("t", "event_id").limit(limit)


def search_log(log: DataFrame, term: str, col: str = "text", order: str = "log_id") -> DataFrame:
    """Case-insensitive substring search, newest first. The order is the caller's view; all hits are kept."""
    return log.filter(F.lower(col).contains(term.lower())).orderBy(F.desc(order))


def unacked_critical(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(~F.col("acknowledged") & F.col("severity").isin("critical", "high")).alias("n"))


def apply_ack(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Acknowledge alerts by id with a time; the first acknowledgement stays."""
    a = acks.groupBy("event_id").agg(F.min("acknowledged_at").alias("_at"))
    return (alerts.join(a, "event_id", "left").withColumn("acknowledged", F.col("acknowledged") | F.col("_at").isNotNull())
            .withColumn("acknowledged_at", F.col("_at")).drop("_at"))


def class_frequency(dets: DataFrame) -> DataFrame:
    return dets.groupBy("cls").agg(F.count("*").alias("n"))


def top_classes(dets: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent classes and one row for how many more there are."""
    n = class_frequency(dets)   # one row per class
    w = Window.orderBy(F.desc("n"), "cls")
    r = n.withColumn("_r", F.row_number().over(w))
    head = r.filter(F.col("_r") <= k).select("cls", "n")
    more = r.filter(F.col("_r") > k).agg(F.count("*").alias("n")).filter(F.col("n") > 0).select(F.lit("(more)").alias("cls"), "n")
    return head.unionByName(more)


def last_n(log: DataFrame, n: int, order: str = "log_id") -> DataFrame:
    return log.orderBy(F.desc(order)).limit(n)


def export_log(df: DataFrame, kind: str) -> DataFrame:
    """Rows as JSON lines with their kind; union several for a combined export."""
    return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("row"))


def export_counts(export: DataFrame) -> DataFrame:
    return export.groupBy("kind").agg(F.count("*").alias("count"))


def log_counts(**logs: DataFrame) -> DataFrame:
    """One row with the size of every log."""
    out = None
    for name, df in logs.items():
        c = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("log"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def dedupe_by_hash(df: DataFrame, col: str, existing: DataFrame | None = None, key: str = "blob_id") -> DataFrame:
    """One row per distinct content, named by its hash; contents already stored are skipped."""
    h = df.withColumn("hash", F.md5(col))
    first = h.groupBy("hash").agg(F.min(key).alias(key))
    if existing is not None:
        first = first.join(existing.select("hash"), "hash", "left_anti")
    return first


def prompt_context(detections: DataFrame, captions: DataFrame, alerts: DataFrame, n_det: int = 20, n_cap: int = 10, n_alert: int = 15) -> DataFrame:
    """The latest log lines of each kind, formatted as context for a report.

    ``detections``: log_id, ts, objects (array of struct cls, confidence);
    ``captions``: log_id, ts, text; ``alerts``: log_id, ts, severity, label,
    score, rule, detail. At most 45 lines are ever gathered.
    """
    objs = F.array_join(F.transform("objects", lambda o: F.concat(o["cls"], F.lit(" ("), o["confidence"].cast("string"), F.lit(")"))), ", ")
    det = last_n(detections, n_det).select(F.lit("detections").alias("kind"), "log_id",
          F.concat(F.lit("["), "ts", F.lit("] "), objs, F.lit(" — "), F.size("objects").cast("string"), F.lit(" total")).alias("line"))
    cap = last_n(captions, n_cap).select(F.lit("captions").alias("kind"), "log_id", F.concat(F.lit("- ["), "ts", F.lit("] "), "text").alias("line"))
    al = last_n(alerts, n_alert).select(F.lit("alerts").alias("kind"), "log_id",
         F.concat(F.lit("- ["), "ts", F.lit("] "), F.upper("severity"), F.lit(" · "), "label", F.lit(" (score "), F.col("score").cast("string"), F.lit(", rule "), "rule",
                  F.lit(") — "), "detail").alias("line"))
    lines = det.unionByName(cap).unionByName(al)
    return lines.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("log_id", "line"))), lambda x: x["line"]), "\n").alias("context"))
