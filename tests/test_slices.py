"""The sliced primitives against plain Python, with one key holding most rows and slices far shorter than the data."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelore.operators import datasets as ds, incidents as inc, metrics, slices

RNG = random.Random(11)
ROWS = [(i, 0 if RNG.random() < 0.7 else RNG.randrange(1, 4), float(RNG.randrange(0, 1500)) / 2) for i in range(600)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "event_id long, k long, t double").repartition(5).cache()


def by_key():
    out = {}
    for i, k, t in sorted(ROWS, key=lambda r: (r[2], r[0])):
        out.setdefault(k, []).append((t, i))
    return out


def test_min_gap(rows):
    want = set()
    for seq in by_key().values():
        last = None
        for t, i in seq:
            if last is None or t - last >= 7.0:
                want.add(i)
                last = t
    for width in (9.0, 5000.0):
        assert {r.event_id for r in inc.min_gap(rows, ["k"], "t", 7.0, "event_id", width).collect()} == want


@pytest.mark.parametrize("n", [2400, 38400])
def test_min_gap_of_a_steady_source_takes_few_rounds(spark, monkeypatch, n):
    written = []
    plain = slices.materialise
    monkeypatch.setattr(slices, "materialise", lambda df, name="step": written.append(name) or plain(df, name))
    steady = spark.range(n).select(F.col("id").alias("event_id"), F.lit("a").alias("k"), F.col("id").cast("double").alias("t"))
    silent = steady.filter("event_id < 5 or event_id % 700 in (1, 3) or event_id > 2390")
    for rows in (steady, silent):
        ids = [r.event_id for r in rows.orderBy("t").collect()]
        want = []
        for i in ids:
            if not want or i - want[-1] >= 12.0:
                want.append(i)
        assert sorted(r.event_id for r in inc.min_gap(rows, ["k"], "t", 12.0, "event_id", 120.0).collect()) == want
    assert written.count("jump") + written.count("reached") <= 4 * (2 + np.log2(n / 120))


def test_sessions_totals_and_asof(rows, spark):
    want, totals = {}, {}
    for k, seq in by_key().items():
        no, prev = 0, None
        for n, (t, i) in enumerate(seq):
            no += prev is None or t - prev > 3.0
            prev, want[i], totals[i] = t, no, n + 1
    got = slices.sessionize(rows, ["k"], "t", 3.0, "s", 10.0, ["event_id"])
    assert {r.event_id: r.s for r in got.collect()} == want
    got = slices.running_total(rows, ["k"], "t", 10.0, F.lit(1), "n", ["event_id"])
    assert {r.event_id: r.n for r in got.collect()} == totals
    asked = spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate([(0, -1.0), (0, 200.3), (0, 9000.0), (2, 400.0), (9, 5.0)])], "ask long, k long, at double")
    for forward in (False, True):
        r = {x.ask: (x.hit.t if x.hit else None) for x in slices.asof(asked, rows, ["k"], "at", "t", 25.0, "hit", forward=forward).collect()}
        for n, (k, at) in enumerate([(0, -1.0), (0, 200.3), (0, 9000.0), (2, 400.0), (9, 5.0)]):
            ts = [t for t, _ in by_key().get(k, [])]
            cand = [t for t in ts if (t >= at if forward else t <= at)]
            assert r[n] == (None if not cand else min(cand) if forward else max(cand))


def test_quantiles_and_auc(rows, spark):
    q = {r.k: r for r in slices.quantile_at(rows, ["k"], "t", {"lo": 0.1, "mid": 0.5, "hi": 0.9}).collect()}
    for k, seq in by_key().items():
        v = [t for t, _ in seq]
        assert [q[k].lo, q[k].mid, q[k].hi] == pytest.approx(np.percentile(v, [10, 50, 90]))
    s = [(round(RNG.random(), 2), RNG.random() < 0.4) for _ in range(300)]
    pos, neg = [a for a, p in s if p], [a for a, p in s if not p]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert metrics.auc(spark.createDataFrame(s, "score double, positive boolean")).first().auc == pytest.approx(want)


def test_near_duplicates(spark):
    vecs = [[float(100 + (i // 5) * 4 + (i % 3)), 50.0] for i in range(60)]
    df = spark.createDataFrame([(i, 1, float(i), v) for i, v in enumerate(vecs)], "frame_id long, source long, t double, vec array<double>")
    want, last = [], None
    for i, v in enumerate(vecs):
        if last is None or np.abs(np.array(v) - last).mean() >= 3.0:
            want.append(i)
            last = np.array(v)
    assert sorted(r.frame_id for r in ds.drop_near_duplicates(df, 3.0, slice_s=8.0).collect()) == want
