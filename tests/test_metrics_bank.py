"""Neighbour distances of the queries meet the whole bank."""
import numpy as np

from contract.base import Tables
from contract.data import distances
from framelore.operators import metrics as me


def test_query_distances_use_a_bank_of_any_size(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4600, 4)).round(4)
    label = np.where(np.arange(4600) < 40, np.arange(4600) % 2, 2 + np.arange(4600) % 3)
    rows = [(int(k), v.tolist(), int(y)) for k, (v, y) in enumerate(zip(x, label))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["distance"] for r in distances(Tables(spark, str(tmp_path))).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.sort(unit[:40] @ unit[40:].T, axis=1)[:, -8:]
    assert set(got) == set(range(40)) and np.allclose([got[k] for k in range(40)], 1 - near.mean(axis=1), atol=2e-6)


def test_bank_of_any_size_and_excluded_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, bank = rng.standard_normal((60, 6)), rng.standard_normal((500, 6))
    df = spark.createDataFrame([(k, k % 4, v.tolist()) for k, v in enumerate(x)], "vec_id long, span_id int, embedding array<double>").repartition(3)
    held = spark.createDataFrame([(1000 + k, v.tolist()) for k, v in enumerate(bank)], "vec_id long, embedding array<double>").repartition(3)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = unit(x) @ unit(bank).T
    want = 1 - np.sort(sim, axis=1)[:, -8:].mean(axis=1)
    small = {r["vec_id"]: r["distance"] for r in me.knn_distance(df, held).collect()}
    monkeypatch.setattr(me, "SMALL_BANK", 0)
    large = {r["vec_id"]: r["distance"] for r in me.knn_distance(df, held, block=70).collect()}
    assert all(abs(small[k] - want[k]) < 1e-6 and abs(large[k] - want[k]) < 1e-6 for k in range(60))
    pairs = [(s, 1000 + b) for s in range(4) for b in range(0, 500, s + 2)]
    got = {r["vec_id"]: r["distance"] for r in me.knn_distance(df, held, excluded=spark.createDataFrame(pairs, "span_id int, vec_id long"), block=70).collect()}
    for k in range(60):
        left = np.array([sim[k, b] for b in range(500) if b % (k % 4 + 2)])
        assert abs(got[k] - (1 - np.sort(left)[-8:].mean())) < 1e-6
    none = me.knn_distance(df, held.limit(0)).collect()
    assert len(none) == 60 and all(np.isnan(r["distance"]) for r in none)
