import random

from pyspark.sql import functions as F

from framelore.functions import expr
from framelore.operators import frames, identity as idn, routing

HSV = {"red": (0, 217, 200), "red2": (1, 219, 205), "blue": (118, 217, 200), "grey": (0, 0, 240)}


def pixels(spark, colours):
    rows = [(i, b, *HSV[c]) for i, c in enumerate(colours) for b in range(3) for _ in range(20)]
    return spark.createDataFrame(rows, "object_id long, band int, h int, s int, v int")


def test_signatures_and_colour_names(spark):
    sig = {r.object_id: r.signature for r in frames.banded_signature(pixels(spark, ["red", "red2", "blue", "grey"])).collect()}
    assert len(sig[0]) == 96
    pair = spark.createDataFrame([(sig[0], sig[1], sig[2], sig[3])], "a array<double>, b array<double>, c array<double>, d array<double>")
    same = lambda x, y: expr.signature_similarity(F.col(x), F.col(y))
    fast = lambda x, y: expr.weighted_similarity(expr.weighted_signature(F.col(x)), expr.block_use(F.col(x)), expr.weighted_signature(F.col(y)), expr.block_use(F.col(y)))
    r = pair.select(same("a", "b").alias("ab"), same("a", "c").alias("ac"), fast("a", "b").alias("fab"), fast("a", "c").alias("fac"), same("d", "d").alias("dd"), fast("d", "d").alias("fdd")).first()
    assert r.ab > 0.9 and r.ac < 0.6 and r.dd == 1.0
    assert (r.fab, r.fac, r.fdd) == (r.ab, r.ac, r.dd)
    names = {r.object_id: r.colour for r in frames.describe_colour(pixels(spark, ["red", "blue", "grey"])).collect()}
    assert names == {0: "red", 1: "blue", 2: "white"}


def sequential(rows, thr, cap=20):
    """One pass in time order, as a single registry would do it."""
    import numpy as np
    ents, out = [], {}
    for sid, kind, cls, sig, asp in rows:
        sig, best, top = np.array(sig), None, 0.0
        for e in ents:
            if e["kind"] != kind or e["grp"] != ("road" if cls in ("car", "bus") else cls):
                continue
            look = float(idn._similarity(sig, e["sig"][None, :], 3)[0])
            s = look * (0.8 + 0.2 * min(e["asp"], asp) / max(e["asp"], asp)) * (1.0 if e["cls"] == cls else 0.85)
            if s > top:
                best, top = e, s
        if best is not None and round(top, 4) >= thr:
            n = min(best["n"], cap)
            best["sig"] = np.round((best["sig"] * n + sig) / (n + 1), 6)
            best["n"] += 1
            out[sid] = best["id"]
        else:
            ents.append({"id": f"{kind[:3]}_{sid}", "kind": kind, "cls": cls, "grp": "road" if cls in ("car", "bus") else cls, "sig": sig, "asp": asp, "n": 1})
            out[sid] = ents[-1]["id"]
    return out


def test_resolution_equals_one_sequential_pass_in_chunks_of_any_size(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        sig = []
        for _ in range(3):
            for n in (16, 8, 8):
                v = [0.0] * n
                v[rng.randrange(3)] = 0.7
                v[rng.randrange(n)] += 0.3
                sig += v
        cls = rng.choice(["car", "bus", "person"])
        rows.append((i, "person" if cls == "person" else "vehicle", cls, sig, rng.choice([0.5, 1.0])))
    df = spark.createDataFrame([(i, float(i), k, c, c, s, a) for i, k, c, s, a in rows],
                               "sighting_id long, t double, kind string, cls string, label string, signature array<double>, aspect double")
    want = sequential(rows, 0.62)
    assert len(set(want.values())) < 60
    for chunk in (7, 1000):
        links, reg = idn.resolve_entities(df, chunk=chunk)
        assert {r.sighting_id: r.entity_id for r in links.collect()} == want
        assert reg.count() == len(set(want.values()))


def test_resolution_goes_on_where_the_closest_entities_have_all_changed(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for i in range(90):
        sig = []
        for _ in range(3):
            for n in (16, 8, 8):
                v = [0.0] * n
                v[rng.randrange(2)] += 0.6
                v[rng.randrange(4)] += 0.4
                sig += v if rng.random() > 0.05 else [0.0] * n
        cls = rng.choice(["car", "bus", "person"])
        rows.append((i, "person" if cls == "person" else "vehicle", cls, sig, rng.choice([0.5, 1.0, 1.5])))
    frame = lambda part: spark.createDataFrame([(i, float(i), k, c, c, s, a) for i, k, c, s, a in part],
                                               "sighting_id long, t double, kind string, cls string, label string, signature array<double>, aspect double")
    for threshold in (0.62, 0.8):
        want = sequential(rows, threshold)
        for kept, chunk in ((1, 12), (2, 40)):
            monkeypatch.setattr(idn, "KEPT", kept)
            links, reg = idn.resolve_entities(frame(rows), threshold=threshold, chunk=chunk)
            assert {r.sighting_id: r.entity_id for r in links.collect()} == want and links.count() == 90
            assert reg.count() == reg.select("entity_id").distinct().count() == len(set(want.values()))


def test_ties_go_to_the_remembered_entity_in_chunks_of_any_size(spark):
    sig = ([0.5, 0.5] + [0.0] * 14 + ([1.0] + [0.0] * 7) * 2) * 3
    reg = spark.createDataFrame([(f"old_{i}", "vehicle", f"kind{i}", "x", sig, 1.0, 1) for i in range(8)], "entity_id string, kind string, cls string, label string, signature array<double>, aspect double, samples int")
    # 0.85 by the first's shape: a new one; then 0.9 by the shapes of both.
    df = spark.createDataFrame([(10 * i + n, float(n), "vehicle", f"kind{i}", "x", sig, a) for i in range(8) for n, a in enumerate([0.25, 0.5])],
                               "sighting_id long, t double, kind string, cls string, label string, signature array<double>, aspect double")
    for chunk in (1, 10):
        links, after = idn.resolve_entities(df, reg, threshold=0.88, chunk=chunk)
        got = {r.sighting_id: (r.entity_id, r.similarity, r.is_new) for r in links.collect()}
        assert got == {10 * i: (f"veh_{10 * i}", 1.0, True) for i in range(8)} | {10 * i + 1: (f"old_{i}", 0.9, False) for i in range(8)}
        assert sorted((r.entity_id, r.samples) for r in after.collect()) == sorted([(f"old_{i}", 2) for i in range(8)] + [(f"veh_{10 * i}", 1) for i in range(8)])


def test_forget_and_routing(spark):
    e = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    assert [r.entity_id for r in idn.forget(e, spark.createDataFrame([("a",)], "entity_id string")).collect()] == ["b"]
    alerts = spark.createDataFrame([(1, "North", "high"), (2, "South", "low"), (3, None, "critical")], "event_id long, area string, severity string")
    rec = spark.createDataFrame([("n", [" north "], "medium"), ("all", ["ALL"], "high"), ("blank", [], "low"), ("odd", ["south"], "urgent")],
                                "recipient string, areas array<string>, min_severity string")
    got = sorted((r.event_id, r.recipient) for r in routing.route_alerts(alerts, rec).collect())
    assert got == [(1, "all"), (1, "blank"), (1, "n"), (2, "blank"), (2, "odd"), (3, "all"), (3, "blank")]
