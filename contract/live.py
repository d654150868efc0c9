"""Streams over the driver's tables, each run to its end, against the oracles of the batch rules."""
import uuid

from pyspark.sql import DataFrame, functions as F

from contract import incidents, perception, text
from contract.base import TABLES, Registry, Tables, with_views
from framelore.operators import captions as cap, rules
from framelore.session import run_folder
from framelore.streaming import live

R = Registry()
END = 4_000_000_000.0
DAY = 86400.0  # the video clock starts at 0, where a watermark starts too; the feed a day later


class Feeds(Tables):
    """The same tables and views, read as streams of files."""

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
            return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")
        return super().__getattr__(name)


def timed(feeds: Feeds, rows: DataFrame) -> DataFrame:
    """A watermark, and one row of a source of its own that comes last, so that the stream's end is reached."""
    end = {"source": F.lit(-1), "t": F.lit(END)}
    closing = feeds.region.filter("r_regionkey = 0").select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    return rows.unionByName(closing).withColumn("event_ts", F.timestamp_seconds(F.col("t") + DAY)).withWatermark("event_ts", "10 seconds")


def finished(T: Tables, stream: DataFrame) -> DataFrame:
    """The rows that a stream has written once all its files are read."""
    path = f"{run_folder(T.spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return T.spark.read.schema(stream.schema).parquet(f"{path}/rows").filter("source >= 0")


def feeds(T: Tables) -> Feeds:
    return Feeds(T.spark, T.folder)


R.query("stream_cooldown", with_views(incidents.kept("ev", "source, type", 60.0) + "SELECT event_id, source, type, t FROM kept", "ev", recursive=True))(
    lambda T: finished(T, live.cooldown_stream(timed(feeds(T), feeds(T).ev.select("event_id", "source", "type", "t")), 60.0, ["source", "type"])).select("event_id", "source", "type", "t"))
R.query("stream_incidents", with_views("WITH " + incidents.clusters("ev", 45.0) + "SELECT source, type, count, peak_score, severity, first_t, last_t FROM incidents", "ev"))(
    lambda T: finished(T, live.incident_stream(timed(feeds(T), feeds(T).ev.select("source", "type", "t", "severity", "score")), 45.0)))


def written(T: Tables, rows: DataFrame) -> DataFrame:
    """A stream of a batch result, as the job before would leave it."""
    path = f"{run_folder(T.spark)}/feed-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return T.spark.readStream.schema(rows.schema).parquet(path)


R.query("stream_crowd", perception.R.oracles["crowd_events"])(
    lambda T: finished(T, live.crowd_stream(timed(feeds(T), written(T, rules.people_counts(T.det))), perception.CROWD)).select("source", "frame_no", "type", "severity", "detail"))


def corroborated(T: Tables) -> DataFrame:
    hits = cap.screen_captions(feeds(T).cap.select("caption_id", "source", "t", "text")).drop("text")
    return finished(T, live.corroborate_stream(timed(feeds(T), hits), timed(feeds(T), written(T, cap.signals(T.det))))).select("caption_id", "pattern_no", "type", "corroborated", F.round("score", 6).alias("score"))


R.query("stream_corroborate", text.CORROBORATED)(corroborated)
