"""Interval overlap, exact ranks and weighted draws against brute force, on bunched and lopsided data."""
import random
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelore.operators import datasets as ds, metrics as me, slices


def spans(rng, n, open_ends):
    out = []
    for i in range(n):
        lo = rng.choice([rng.uniform(0, 300), float(rng.randrange(0, 60))])
        hi = lo + rng.choice([0.0, 1.0, rng.uniform(0, 5), 200.0])
        out.append((i, rng.choice(["v", "v", "v", "w"]), None if open_ends and rng.random() < 0.1 else lo, None if open_ends and rng.random() < 0.1 else hi))
    return out


@pytest.mark.parametrize("open_ends", [False, True])
def test_overlaps_equal_all_pairs(spark, open_ends):
    rng = random.Random(4)
    a, b = spans(rng, 150, open_ends), spans(rng, 120, open_ends)
    low, high = lambda x: -1e18 if x is None else x, lambda x: 1e18 if x is None else x
    want = sorted((i, j) for i, v, lo, hi in a for j, w, lo2, hi2 in b
                  if v == w and (lo is None or hi2 is None or lo < hi2) and (lo2 is None or hi is None or lo2 < hi)
                  and (lo is None or hi is None or lo <= hi) and (lo2 is None or hi2 is None or lo2 <= hi2))
    left = spark.createDataFrame(a, "i long, video string, alo double, ahi double")
    right = spark.createDataFrame(b, "j long, video string, blo double, bhi double")
    got = slices.overlap_join(left, right, ["video"], ("alo", "ahi"), ("blo", "bhi"), 7.0)
    assert got.columns == ["i", "video", "alo", "ahi", "j", "blo", "bhi"]
    assert sorted((r.i, r.j) for r in got.collect()) == want
    semi = slices.overlap_join(left, right, ["video"], ("alo", "ahi"), ("blo", "bhi"), 7.0, "left_semi")
    assert sorted(r.i for r in semi.collect()) == sorted({i for i, _ in want})


def test_one_long_video_meets_few_pairs(spark):
    """Work on one video of short spans is in proportion to its spans, not to their pairs."""
    n = 4000
    a = spark.range(n).select(F.col("id").alias("i"), F.lit("v").alias("video"), (F.col("id") * 10.0).alias("alo"), (F.col("id") * 10.0 + 4).alias("ahi"))
    b = spark.range(n).select(F.col("id").alias("j"), F.lit("v").alias("video"), (F.col("id") * 10.0 + 3).alias("blo"), (F.col("id") * 10.0 + 6).alias("bhi"))
    joined = slices.overlap_join(a, b, ["video"], ("alo", "ahi"), ("blo", "bhi"), 60.0)
    assert joined.count() == n
    plan = joined._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_leakage_and_hold_out(spark):
    neg = spark.createDataFrame([("a", 0.0, 5.0), ("a", 50.0, 60.0), ("b", 0.0, 5.0), ("c", 0.0, 1.0)], "video string, start double, end double")
    pos = spark.createDataFrame([("a", 59.0, 70.0), ("b", 5.0, 9.0), ("d", 0.0, 9.0)], "video string, start double, end double")
    assert {tuple(r) for r in ds.leakage(neg, pos).collect()} == {("a", True), ("b", False)}
    bank = spark.createDataFrame([(1, "a", 58.0, 59.5), (2, "a", None, 3.0), (3, "a", 0.0, 10.0), (4, "b", 0.0, 9.0)], "vec_id long, video string, a double, b double")
    got = me.hold_out(bank, pos.withColumn("span_id", F.lit(7)))
    assert got.columns == ["span_id", "vec_id", "video", "a", "b"]
    assert sorted(r.vec_id for r in got.collect()) == [1, 2, 4]


def bunched(n, rng):
    """Most values within 0.001 of each other, many ties, a few far away."""
    return [rng.choice([0.5 + rng.randrange(50) * 1e-6, 0.5 + rng.random() * 1e-3, 1e6 * rng.random()]) if rng.random() < 0.99 else -1e9 for _ in range(n)]


def test_quantiles_and_ranks_of_bunched_values(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "rare", None]), v) for v in bunched(3000, rng)] + [("rare", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r["k"]: r for r in slices.quantile_at(df, ["k"], "v", {"p10": 0.1, "mid": 0.5, "p90": 0.9}).collect()}
    for k in {k for k, _ in rows}:
        vals = np.array([v for kk, v in rows if kk == k and v is not None])
        assert got[k]["p10"] == pytest.approx(np.quantile(vals, 0.1), rel=1e-12) and got[k]["mid"] == pytest.approx(np.quantile(vals, 0.5), rel=1e-12) and got[k]["p90"] == pytest.approx(np.quantile(vals, 0.9), rel=1e-12)
    ranked = slices.value_ranks(df.filter("k = 'hot'"), [], "v").collect()
    vals = sorted(v for k, v in rows if k == "hot")
    assert all(r["upto"] == bisect_right(vals, r["v"]) and r["upto_all"] == len(vals) for r in ranked)


def test_auc_of_bunched_scores(spark):
    rng = random.Random(2)
    rows = [(v, rng.random() < 0.4) for v in bunched(1500, rng)]
    p, n = [v for v, y in rows if y], [v for v, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))
    r = me.auc(spark.createDataFrame(rows, "score double, positive boolean").repartition(5)).first()
    assert r["auc"] == pytest.approx(want, abs=1e-12) and (r["positives"], r["negatives"]) == (len(p), len(n))


@pytest.mark.parametrize("heavy", [False, True])
def test_weighted_draws_follow_their_line(spark, heavy):
    rng = random.Random(6)
    items = [(i, float(rng.choice([0, 1, 2, 3])) if i != 40 or not heavy else 1e6, "x") for i in range(100)] + [(200, None, "x")]
    draws = [(d, rng.random()) for d in range(2000)]
    df = spark.createDataFrame(items, "item_id long, w double, draw string")
    got = ds.weighted_sample(df, "w", 0, draws=spark.createDataFrame(draws, "draw_no long, u double").repartition(4), share=150)
    used = [(i, w) for i, w, _ in items if w]
    ends = list(accumulate(w for _, w in used))
    want = sorted((d, used[bisect_right(ends, u * ends[-1])][0]) for d, u in draws)
    assert sorted((r.draw_no, r.item_id) for r in got.collect()) == want
    assert set(got.columns) == {*df.columns, "draw_no"}
    seeded = ds.weighted_sample(df, "w", 300, seed=3)
    assert sorted(r.draw_no for r in seeded.collect()) == list(range(300))
    assert ds.weighted_sample(df.filter("w > 1e9"), "w", 5).count() == 0
