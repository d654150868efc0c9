"""Views over the driver's tables, written once and read by both engines.

Every view keeps all rows of its table. ``Tables`` builds them in Spark;
``with_views`` puts the same text in front of an oracle query.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

# @us(x) is microseconds since the epoch in either dialect.
VIEWS = {
    # Detections: 8 sources at 2 Hz, integer boxes. Users ending in 9 show up as a
    # chair instead, so that people and cars flicker as they do in real footage.
    "det": """
WITH b AS (
  SELECT event_id AS det_id, event_id % 8 AS source_id, CAST(floor(event_id / 64) AS BIGINT) AS frame_no,
         CAST(floor((event_id % 64) / 8) AS BIGINT) AS obj_idx, user_id,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)
SELECT det_id, source_id AS source, frame_no, obj_idx, CAST(frame_no AS DOUBLE) / 2 AS t,
       CASE WHEN user_id % 10 = 9 THEN 'chair' WHEN obj_idx < 4 THEN 'person' WHEN obj_idx = 4 THEN 'car'
            WHEN obj_idx = 5 THEN 'motorcycle' WHEN obj_idx = 6 THEN 'backpack' ELSE 'knife' END AS cls,
       CAST(25 + cents % 75 AS DOUBLE) / 100 AS confidence,
       CAST(x AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, CAST(x + w AS DOUBLE) AS x2, CAST(y + h AS DOUBLE) AS y2,
       CAST(1280 AS DOUBLE) AS frame_w, CAST(720 AS DOUBLE) AS frame_h
FROM (SELECT *,
       CASE WHEN obj_idx IN (0, 2) THEN 100 + obj_idx * 200
            WHEN obj_idx IN (1, 3) THEN 100 + obj_idx * 200 + (frame_no * 7) % 160
            WHEN obj_idx = 4 THEN (frame_no * 25 + source_id * 40) % 1100
            WHEN obj_idx = 5 THEN 1100 - (frame_no * 35) % 1000
            WHEN obj_idx = 6 THEN 820
            ELSE CASE WHEN CAST(floor(frame_no / 16) AS BIGINT) % 2 = 0 THEN 560 ELSE 1180 END END AS x,
       CASE WHEN obj_idx < 4 THEN 300 WHEN obj_idx IN (4, 5) THEN 380 ELSE 420 END AS y,
       CASE WHEN obj_idx < 4 THEN 80 WHEN obj_idx = 4 THEN 140 WHEN obj_idx = 5 THEN 90 ELSE 40 END AS w,
       CASE WHEN obj_idx < 4 THEN 200 WHEN obj_idx IN (4, 5) THEN 90 ELSE 40 END AS h
      FROM b) z""",
    # Scored events on a video clock 200 times faster than the wall clock, in whole milliseconds.
    "ev": """
SELECT event_id, event_id % 8 AS source,
       CAST(CAST(floor((@us(ts) - 1704067200000000) / 200000) AS BIGINT) AS DOUBLE) / 1000 AS t,
       'kind_' || event_type AS type, 'Kind ' || event_type AS label, 'test' AS category,
       CASE user_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low'
            ELSE 'info' END AS severity,
       CAST(30 + CAST(round(value * 100) AS BIGINT) % 70 AS DOUBLE) / 100 AS score, 'rule_' || event_type AS rule,
       'user ' || CAST(user_id AS VARCHAR(20)) AS detail,
       CASE WHEN user_id % 3 = 0 THEN 'alerts/' || CAST(event_id AS VARCHAR(20)) || '.jpg' END AS snapshot,
       user_id % 7 = 0 AS repeat_subject, event_id % 5 = 0 AS acknowledged, user_id, ts
FROM events""",
    # Day-grained alerts with an area; t is in days.
    "alerts": """
SELECT o_orderkey AS event_id, CAST(c_nationkey AS BIGINT) AS source,
       CAST(CAST(floor(@us(o_orderdate) / 86400000000) AS BIGINT) AS DOUBLE) AS t,
       'type_' || CAST(o_custkey % 6 AS VARCHAR(10)) AS type, 'Type ' || CAST(o_custkey % 6 AS VARCHAR(10)) AS label,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium'
            WHEN '4' THEN 'low' ELSE 'info' END AS severity,
       CAST(40 + o_orderkey % 61 AS DOUBLE) / 100 AS score,
       'order ' || CAST(o_orderkey AS VARCHAR(20)) AS detail, 'area_' || CAST(c_nationkey AS VARCHAR(10)) AS area,
       o_custkey AS entity_id, o_orderstatus
FROM orders JOIN customer ON o_custkey = c_custkey""",
}
NEEDS: dict[str, list[str]] = {"det": ["events"], "ev": ["events"], "alerts": ["orders", "customer"]}


def add_view(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = sql
    NEEDS[name] = needs


def dialect(sql: str, engine: str) -> str:
    us = r"unix_micros(CAST(\1 AS TIMESTAMP))" if engine == "spark" else r"epoch_us(\1)"
    return re.sub(r"@us\(([^()]*)\)", us, sql)


class Tables:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self.sql(VIEWS[name], *NEEDS[name])
        raise AttributeError(name)

    def sql(self, text: str, *needs: str) -> DataFrame:
        text = dialect(text, "spark")
        for n in needs:
            text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in needs})


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """An oracle query with its views (and theirs) in front."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in NEEDS.get(n, []):
            if d in VIEWS:
                visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    body = body.strip()
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in order]
    if body.upper().startswith("WITH "):
        ctes.append(body[5:])
        text = ",\n".join(ctes)
    else:
        text = ",\n".join(ctes) + "\n" + body
    return dialect(("WITH RECURSIVE " if recursive else "WITH ") + text, "duckdb")


class Registry:
    """Collects queries and their oracles."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        def add(fn):
            assert name not in self.queries, name
            self.queries[name] = lambda spark, folder: fn(Tables(spark, folder))
            if oracle is not None:
                self.oracles[name] = oracle
            return fn
        return add
