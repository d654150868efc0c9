"""SimHash, lexical search and whitening against brute force, on odd rows."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framelore.llm import lexical, simhash, whitening
from framelore.llm.queries import ORACLES, QUERIES


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def frame(spark, rows, parts=3):
    """(doc_id, text) among columns named like those the operators make."""
    wide = [(d, t, "mine", 1, 2, 3, "mine", 4) for d, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, fp string, n int, score int, m int, term string, label int").repartition(parts)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=3):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def simhash_rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)] + ["É", "Ça"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "two words"), (7, "a\x0bb\x1cc"), (None, "one"), (8, "one two three"), (8, "one two three"), (9, "one\ttwo  three "),
            (10, "word " * 400_000), (11, "x" * 1_500_000), (12, "a b c a b c")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([40, 200, 900]))]
        for c in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((100 + 10 * g + c, " ".join(copy)))
    return rows


def test_simhash_equals_brute_force(spark):
    rows = simhash_rows()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted((str(d), format(f, "016x"), least.get(r)) for (d, _), f, r in zip(rows, fps, roots))
    assert len(set(roots)) < len(set(fps))  # different fingerprints were linked
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("distance,kind", [(3, "even"), (3, "crowded"), (1, "even"), (4, "even"), (0, "even"), (3, "all in one block")])
def test_fingerprint_links_miss_none(spark, distance, kind):
    rng = random.Random(7)
    if kind == "even":
        bases = [rng.getrandbits(64) for _ in range(40)]
    elif kind == "crowded":  # the upper half is all but fixed
        bases = [rng.getrandbits(22) | 0xABCDEF << 40 for _ in range(40)]
    else:
        bases = [rng.getrandbits(16) << 48 | rng.getrandbits(3) for _ in range(40)]
    fps = {0, (1 << 64) - 1}
    for b in bases:
        for _ in range(12):
            x = b
            for k in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    labels = dict(simhash.links_of(classes, distance).collect())
    groups = {}
    for f, r in zip(signed, brute_components(fps, distance)):
        groups.setdefault(r, []).append(f)
    want = {f: min(g) for g in groups.values() if len(g) > 1 for f in g}
    assert labels == want


def test_thresholds_share_the_distance():
    """Every allocation is one of the generalised pigeonhole principle, and no other is cheaper."""
    rng = np.random.default_rng(1)
    counts = [np.bincount(rng.integers(0, 1 << 16, 3000) if k else np.full(3000, 77), minlength=1 << 16) for k in range(4)]
    plan = simhash.Plan([list(range(16 * k, 16 * k + 16)) for k in range(4)], np.stack([simhash.shells_of(c, 3) for c in counts]), 3000, 3)
    fps = np.append(rng.integers(0, 1 << 63, 50), 77).astype(np.uint64)
    values = plan.values(fps)
    for layout in simhash.LAYOUTS:
        found, cost = plan.thresholds(values, layout)
        assert (found.sum(axis=0) == 3 - len(layout) + 1).all() and found.min() >= -1
        met = [plan.expected(part, values) for part in layout]
        keys = [[sum(math.comb(16 * len(p), j) for j in range(t + 1)) for t in range(4)] for p in layout]
        price = lambda q, ts: sum(met[k][t][q] + keys[k][t] for k, t in enumerate(ts) if t >= 0)
        every = [ts for ts in np.ndindex(*[5] * len(layout)) if sum(ts) == 4]
        for q in range(len(fps)):
            assert math.isclose(cost[q], min(price(q, [t - 1 for t in ts]) for ts in every), rel_tol=1e-9)
            assert math.isclose(cost[q], price(q, found[:, q]), rel_tol=1e-9)


def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold(t))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for d, c in counted:
            m = 75 + 25 * c.total() * n_docs // n_terms
            s = sum(times * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d, s))
        out += [(item, r, d, s) for r, (_, _, _, d, s) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"t{k}" for k in range(60)] + ["Éa", "É", "x_y", "Z9"]
    docs = [(d, " ".join(rng.choice(words) + rng.choice(["", ",", "-q"]) for _ in range(rng.choice([1, 3, 20, 200])))) for d in range(150)]
    docs += [(500, None), (501, ""), (502, "--- ..."), (None, "t1 t2 t3"), (503, "t1 t2 t3"), (504, "t1 t2 t3"), (504, "t1 t2 t3"), (505, "t9 " * 500_000), (506, "t1\x7ft2"), (507, "ÉA éa")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 15])))) for i in range(40)]
    items += [(100, None), (101, "?"), (102, "nowhere"), (103, "t1 t1 T1"), (None, "t2 t3"), (0, items[0][1])]
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, q int, term string")
    want = sorted(brute_search(docs, items[:-1], 20), key=str)
    index = lexical.build_index(frame(spark, docs))
    assert sorted((tuple(r) for r in lexical.search(index, asked, 20).collect()), key=str) == want
    monkeypatch.setattr(lexical, "BLOCK", 30)  # several passes
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    index = lexical.build_index(frame(spark, docs, 2))
    assert sorted((tuple(r) for r in lexical.search(index, asked, 20).collect()), key=str) == want
    assert lexical.search(lexical.build_index(frame(spark, [])), asked, 20).count() == 0
    assert lexical.search(index, asked.limit(0), 20).count() == 0


def test_strata_group_equal_normalisers(spark):
    index = lexical.build_index(frame(spark, [(d, "a b " * (1 + d % 3)) for d in range(9)], 1))
    rows = {bytes(r["term"]): r for r in index.postings.collect()}
    top = rows[b""]
    assert top["ms"] == sorted(set(top["ms"])) and top["counts"] == [3, 3, 3]
    assert [d % 3 for d in top["docs"]] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert rows[b"a"]["ms"] == top["ms"] and rows[b"a"]["tfs"] == [1, 2, 3] and rows[b"a"]["docs"] == list(range(9))


def vectors(n=400, d=9, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.linspace(0.2, 3, d) + rng.normal(size=(1, d)) * 5
    x[:, 3] = 2 * x[:, 2] + 0.01 * rng.normal(size=n)
    x[50:200] = x[7]
    return x.astype(np.float32)


def check_whitening(rows, got, k):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], np.int64)
    n, d = x.shape
    exact = n * x - x.sum(axis=0)
    centred = exact / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    deviation = {i: int((e.astype(object) ** 2).sum()) for (i, _), e in zip(good, exact)}
    assert len(got) == n * min(k, d)
    table = {}
    for r in got:
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]]
        table.setdefault(r["component"], []).append(r)
    for c, some in table.items():
        if values[c - 1] > 1e-9 * values[0]:
            assert all(abs(r["explained"] - values[c - 1] / values.sum()) < 1e-9 for r in some)
            want = {}
            for (i, _), w in zip(good, centred @ vecs[:, c - 1] / math.sqrt(values[c - 1])):
                want.setdefault(i, []).append(w)
            mine = np.array(sorted((r["vec_id"], r["whitened"]) for r in some))[:, 1]
            his = np.array([w for i in sorted(want) for w in sorted(want[i])])
            other = np.array([w for i in sorted(want) for w in sorted(-np.array(want[i]))])
            assert min(np.abs(mine - his).max(), np.abs(mine - other).max()) < 1e-6
            assert all(r["identity_error"] < 1e-9 for r in some)
        else:
            assert all(r["whitened"] is None and r["explained"] < 1e-12 for r in some)


def test_whitening_equals_an_eigendecomposition(spark):
    x = vectors()
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [1.0, None] + [0.0] * 7), (903, [float("nan")] * 9), (904, [float("inf")] + [0.0] * 8), (5, rows[5][1])]
    for rows, k in ((rows, 32), (rows, 4), ([(i, v[:1] if v else v) for i, v in rows[:300]], 32), ([(i, [c, c, 7.0]) for i, (c, *_) in enumerate(r[1] for r in rows[:300])], 32)):
        df = spark.createDataFrame([(i, v, "mine", 1) for i, v in rows], "vec_id long, embedding array<float>, part string, n int").repartition(5)
        df = df.withColumn("x", whitening.quantised(F.col("embedding"))).filter("x is not null")
        check_whitening(rows, whitening.whiten(df, "vec_id", "x", k).collect(), k)


def test_whitening_of_odd_tables(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "vec_id long, x array<long>")
        return whitening.whiten(df, "vec_id", "x", 32).collect()

    assert run([]) == [] and run([(1, None), (2, []), (3, [None])]) == []
    alone = run([(1, [4, 5])])
    assert len(alone) == 2 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in alone)
    assert {r["vec_id"] for r in run([(1, [4, 5]), (2, [1]), (3, [7, 9]), (None, [0, 1]), (4, [1, 2, 3])])} == {1, 3, None}
    huge = run([(1, [1 << 41]), (2, [-(1 << 41)]), (3, [0])])
    assert [r["deviation"] for r in huge] == [None, None, 0]


@pytest.mark.parametrize("d", [2, 7, 40])
def test_spectra_follow_rank_one_updates(d):
    rng = np.random.default_rng(d)
    rows = (rng.normal(size=(300, d)) * rng.uniform(0.5, 60, d) + 1e6).astype(np.int64)
    rows[40:90] = rows[0]
    rows[:, 1] = 7
    one, other = whitening.Spectrum.empty(d), whitening.Spectrum.empty(d)
    for r in rows[:200]:
        one.add(r, 1)
    for r in rows[200:]:
        other.add(r, 2)
    one.join(other)
    every = np.concatenate([rows[:200], rows[200:], rows[200:]])
    away = every - every.mean(axis=0)
    assert one.n == 400 and (one.sums == every.sum(axis=0)).all()
    assert np.abs(one.vectors @ np.diag(one.values) @ one.vectors.T - away.T @ away).max() < 1e-9 * np.abs(away.T @ away).max()
    assert np.abs(one.vectors.T @ one.vectors - np.eye(d)).max() < 1e-11


def test_every_oracle_is_sql_of_a_registered_query():
    assert all(isinstance(sql, str) for sql in ORACLES.values()) and set(ORACLES) <= set(QUERIES)
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
