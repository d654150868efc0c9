"""Cases that only showed on larger tables."""
import math
import random
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from framelore.operators import datasets as ds, frames, identity, instruct, metrics, routing, slices


@pytest.fixture
def spread(spark):
    """Shuffles whose partitions are not merged into one, as larger tables have them."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, "true")


def test_weighted_draws_meet_their_rows_in_spread_partitions(spread):
    items = [(i, float(i % 4)) for i in range(400)]
    draws = [(d, (d * 7919 % 1000) / 1000) for d in range(1000)]
    got = ds.weighted_sample(spread.createDataFrame(items, "item_id long, w double"), "w", 0, draws=spread.createDataFrame(draws, "draw_no long, u double"), share=50)
    used = [(i, w) for i, w in items if w]
    ends = list(accumulate(w for _, w in used))
    assert sorted((r.draw_no, r.item_id) for r in got.collect()) == [(d, used[bisect_right(ends, u * ends[-1])][0]) for d, u in draws]


def test_shares_may_be_left_unrounded(spark):
    px = spark.range(30001).select(F.lit(1).alias("object_id"), F.lit(0).alias("band"), F.lit(0).alias("h"), F.when(F.col("id") < 10000, 0).otherwise(255).alias("s"), F.lit(255).alias("v"))
    exact, rounded = (frames.banded_signature(px, digits=d).first()["signature"] for d in (None, 6))
    assert exact[16] == 10000 / 30001 and rounded[16] == round(10000 / 30001, 6) != exact[16]


def test_routes_of_one_area_are_dealt_over_tasks_and_come_in_runs(spark):
    alerts = spark.range(0, 20000, 1, 1).select(F.col("id").alias("event_id"), F.lit("Gate").alias("area"), F.lit("high").alias("severity"))
    i = F.col("id")
    rec = spark.range(0, 33, 1, 1).select(F.when(i < 32, i).alias("recipient"), F.array(F.when(i == 30, "yard").when(i >= 31, "").when(i % 2 == 1, "all").otherwise("gate")).alias("areas"),
                                          F.when(i < 31, "low").when(i == 31, "critical").alias("min_severity"))
    got = routing.route_alerts(alerts, rec).select("event_id", "recipient", F.spark_partition_id().alias("task")).toPandas()
    assert len(got) == 20000 * 31 and not got.duplicated(["event_id", "recipient"]).any()
    assert set(got["recipient"].dropna()) == set(range(30)) and got["recipient"].isna().sum() == 20000
    assert got["task"].value_counts().iloc[0] < len(got) / 2
    assert (got["recipient"].fillna(-1).diff() != 0).sum() < len(got) / 100


def test_outbox_counts_equal_the_rows_of_the_outbox(spark):
    alerts = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate([(x, y) for x in ("Gate", "yard", None) for y in ("critical", "low", None)] * 3)], "event_id long, area string, severity string")
    rec = spark.createDataFrame([("a", ["gate"], "low", "a@x", "+1"), ("b", ["all"], "high", "", "07"), ("c", [], "medium", "c@x", ""), ("d", ["yard", "gate"], None, "", "")],
                                "recipient string, areas array<string>, min_severity string, email string, whatsapp string")
    rows = routing.outbox(routing.route_alerts(alerts, rec).select("event_id", "recipient"), rec).groupBy("recipient", "channel", "status").agg(F.count("*").alias("n"))
    got = routing.outbox_counts(alerts, rec)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect())) and got.count() == 4


def test_pairs_of_any_blocks_score_as_one_plain_pass(spark):
    rng, sizes = random.Random(2), [16, 8, 8] * 2
    sign = lambda: [round(x / sum(v), 6) for v in ([rng.random() for _ in range(n)] for n in sizes) for x in v]
    row = lambda i: (i, "vehicle" if i % 3 else "person", ["person", "car", "Truck"][i % 3], sign() if i % 11 else None, (1 + i % 5) / 3)
    s, e = [row(i) for i in range(0, 30)], [row(i) for i in range(30, 70)]

    def plain(a, b):
        if a[3] is None or b[3] is None:
            return 0.0
        num, at = 0.0, 0
        for n, w in zip(sizes, [2.0, 1.0, 0.5] * 2):
            block = 0.0
            for x, y in zip(a[3][at:at + n], b[3][at:at + n]):
                block += min(x, y)
            num, at = num + w * block, at + n
        steps = num / 7.0 * 10000
        return (math.floor(steps) + (steps - math.floor(steps) >= 0.5)) / 10000 * (0.80 + 0.20 * min(a[4], b[4]) / max(a[4], b[4])) * (1.0 if a[2] == b[2] else 0.85)

    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, kind string, cls string, signature array<double>, aspect double")
    left, right = frame(s, "sighting_id"), frame(e, "entity_id")
    want = {(a[0], b[0]): plain(a, b) for a in s for b in e if a[1] == b[1]}
    assert {(r.sighting_id, r.entity_id): r.similarity for r in identity.scored_pairs(left, right, 2, side=7).collect()} == want
    best = {r.sighting_id: (r.entity_id, r.score) for r in identity.best_match(left, right, 2).collect()}
    assert best == {i: min(((b, v) for (a, b), v in want.items() if a == i and v > 0), key=lambda m: (-m[1], m[0])) for i in range(30) if s[i][3]}


def test_pairs_of_blocks_copy_few_rows_and_come_in_runs(spark):
    # 2,000 rows a block: 13 and 154 copies of each row of tables like these.
    for n, most in ((25_000, 6), (300_000, 8)):
        of_left, of_right = identity._dealt(n, n, 32)
        assert of_left * of_right >= 30 and max(of_left, of_right) <= most and n / min(of_left, of_right) <= identity.WIDE * 1.6
    assert identity._dealt(0, 0, 32) == (1, 1) and identity._dealt(1_000_000, 50, 32)[1] == 1
    make = lambda n, key: spark.range(0, n, 1, 1).select(F.col("id").alias(key), F.lit("vehicle").alias("kind"), F.lit("car").alias("cls"), F.array_repeat(F.lit(0.25), 64).alias("signature"), F.lit(1.0).alias("aspect"))
    got = identity.scored_pairs(make(12, "sighting_id"), make(1300, "entity_id"), 2).toPandas()
    assert len(got) == 12 * 1300 and not got.duplicated(["sighting_id", "entity_id"]).any()
    runs = got["entity_id"].to_numpy()[:12 * identity.RUN].reshape(12, identity.RUN)
    assert (runs == runs[0]).all() and (got["sighting_id"].to_numpy()[:12 * identity.RUN].reshape(12, -1).std(axis=1) == 0).all()


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_a_crowded_key_is_dealt_over_tasks(spark, how):
    rng = random.Random(9)
    x, y = ([(i, None if i % 17 == 0 else "hot" if i % 5 else f"k{i % 3}", rng.randrange(50)) for i in range(n)] for n in (230, 170))
    left, right = spark.createDataFrame(x, "i long, k string, v int"), spark.createDataFrame(y, "j long, k string, w int")
    got = slices.dealt_join(left, right, ["k"], F.col("v") < F.col("w"), how, ["i", "j"] if how == "inner" else ["i"], share=40)
    pairs = [(a, b) for a, k, v in x for b, l, w in y if k is not None and k == l and v < w]
    if how == "inner":
        assert sorted((r.i, r.j) for r in got.collect()) == sorted(pairs)
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4   # one task before, where merged
    else:
        assert {r.i for r in got.collect()} == {a for a, _ in pairs}


def test_prompts_of_all_templates_come_from_one_pass(spark, tmp_path):
    turns = spark.createDataFrame([(c, p, "human" if p % 2 == 0 else "gpt", f"v{c}.{p}") for c in range(5) for p in range(4)], "conv_id long, pos long, role string, value string")
    styles = {"a": instruct.Template("single", "Sys."), "b": instruct.Template("two", "S", sep=" ", sep2="</s>"), "c": instruct.Template("llama_2", "Be kind.", sep="<s>", sep2="</s>")}
    turns.write.parquet(str(tmp_path / "turns"))
    got = instruct.render_prompts(spark.read.parquet(str(tmp_path / "turns")), styles)
    want = {(r.conv_id, k): r.prompt for k, t in styles.items() for r in instruct.render_prompt(turns, t).collect()}
    assert {(r.conv_id, r.style): r.prompt for r in got.collect()} == want and len(want) == 15
    assert want[1, "b"] == "S USER: v1.0 ASSISTANT: v1.1</s>USER: v1.2 ASSISTANT: v1.3</s>"
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1   # one scan a template before


def test_span_scores_reads_its_distances_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.createDataFrame([(i % 4, i % 4 < 2, i / 100) for i in range(80)], "span_id long, incident boolean, distance double")
    got = {r.span_id: (r.windows, r.max) for r in metrics.span_scores(rows.mapInPandas(count, rows.schema)).collect()}
    assert got == {k: (20, (76 + k) / 100) for k in range(4)} and seen.value == 80


def test_neighbours_in_strips_equal_a_plain_pass(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v, b = rng.normal(size=(50, 6)), rng.normal(size=(90, 6))
    monkeypatch.setattr(metrics, "SMALL_BANK", 0)
    monkeypatch.setattr(metrics, "STRIP", 100)
    frame = lambda m: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.distance for r in metrics.knn_distance(frame(v), frame(b), k=5, block=40).collect()}
    unit = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
    assert [got[i] for i in range(50)] == pytest.approx((1 - np.sort(unit(v) @ unit(b).T, axis=1)[:, -5:].mean(axis=1)).tolist(), abs=1e-12)


def test_many_short_keys_are_folded_in_many_tasks(spark, monkeypatch):
    """rows of few bytes in many short keys were folded in one task, each key as a frame of its own."""
    from framelore.operators import slices
    files, real = {}, slices.materialise

    def written(df, name="step", *rest):
        files[name] = len((out := real(df, name, *rest)).inputFiles())
        return out

    monkeypatch.setattr(slices, "materialise", written)
    rows = spark.range(24_000).select(F.when(F.col("id") % 4000 != 7, F.col("id") % 4000).alias("k"), F.floor(F.col("id") / 4000).cast("double").alias("t"), F.col("id").alias("v"))

    def fold(rows, state):
        sums = (rows["v"].cumsum() + (state or 0)).tolist()
        return {"v": rows["v"], "total": sums}, int(sums[-1]) if sums else state

    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("total", T.LongType())])
    got = {r.v: r.total for r in slices.carry_scan(rows, ["k"], "t", 3.0, 0.0, fold, schema).collect()}
    assert got == {v: sum(range(v % 4000, v + 1, 4000)) for v in range(24_000)}
    assert files["scan"] > 4
