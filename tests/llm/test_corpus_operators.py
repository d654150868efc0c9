"""Dedup, packing, sharding, search and the pipeline against brute force, on odd rows."""
import os
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelore.llm import bitmap, exactdup, hilbert, lshforest, nndescent, packing
from framelore.llm.bpe import tokenizer_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "mine", "mine") for d, t in rows], SCHEMA).repartition(parts)


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


ODD = [(1, None), (2, ""), (3, "Éa"), (4, "éa"), (5, "ÉA"), (6, "same text " * 30), (7, "SAME text " * 30), (8, "same text " * 29 + "other one"), (8, "same text " * 30),
       (8, "same text " * 30), (9, "x" * 300_000), (10, "x" * 299_999 + "y"), (None, "null id"), (None, "NULL id"), (11, "null id"), (12, "İstanbul"), (13, "ß\x00"), (14, "ß\x00")]


def test_exact_dedup_equals_grouping(spark):
    got = exactdup.exact_dedup(frame(spark, ODD).withColumnRenamed("kept", "theirs"), carry=["text", "theirs"]).collect()
    groups = {}
    for d, t in ODD:
        groups.setdefault(fold(t), []).append(d)
    assert len(got) == len(ODD) and all(r["theirs"] == "mine" for r in got)
    for r in got:
        g = groups[fold(r["text"])]
        assert r["group_size"] == len(g) and r["keep_id"] == max((d for d in g if d is not None), default=None)
    for t, g in groups.items():
        kept = [r for r in got if fold(r["text"]) == t and r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == kept[0]["keep_id"]
    assert exactdup.exact_dedup(frame(spark, [])).count() == 0


def test_bitmap_joins_are_exact(spark):
    rows = spark.range(0, 5000).select(F.when(F.col("id") > 10, F.col("id")).alias("k"), F.lit("wide").alias("w"))
    keys = spark.range(2000, 3000).select(F.col("id").alias("k")).union(spark.createDataFrame([(None,)], "k long"))
    assert bitmap.keep_matching(rows, keys, "k").count() == 1011
    assert bitmap.drop_matching(rows, keys, "k").count() == 5000 - 1011
    assert bitmap.drop_matching(rows, keys.limit(0), "k").count() == 5000


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return frozenset(tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))) if w else frozenset()


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return sets, [root(i) for i in range(len(rows))]


def near_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 120]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(copy) if rng.random() < 0.7 else "\n".join(copy).upper()))
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, width):
    rows = near_rows() + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "two words"), (None, "null id row with some words"), (906, "null id row with some words"),
                          (907, "word " * 50_000), (908, "word " * 60_000), (1, "a repeated id with words of its own here"), (1, "a repeated id with words of its own here")]
    sets, roots = brute_components(rows, width, 80)
    got = lshforest.near_duplicates(frame(spark, rows), width=width).collect()
    assert len(got) == len(rows)
    names = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            names[r] = min(names.get(r, d), d)
    want = sorted((d or -1, len(s), names[r] if s else d) for (d, _), s, r in zip(rows, sets, roots))
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sum(r["stays"] for r in got) == len({r for r, s in zip(roots, sets) if s}) + sum(not s for s in sets)


def test_near_duplicates_of_an_empty_table(spark):
    assert lshforest.near_duplicates(frame(spark, [])).count() == 0


def test_near_copies_in_a_crowded_template(spark):
    rng = random.Random(11)
    word = iter(range(10 ** 9))
    fresh = lambda n: [f"t{next(word)}" for _ in range(n)]
    template, rows = fresh(140), []
    for _ in range(30):
        both = fresh(4)
        rows += [" ".join(template + both + fresh(17)) for _ in range(2)]
    rows += [" ".join(template + fresh(21)) for _ in range(340)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    _, roots = brute_components(rows, 4, 80)
    assert len(set(roots)) == len(rows) - 30
    names = {}
    for (d, _), r in zip(rows, roots):
        names[r] = min(names.get(r, d), d)
    got = {r["doc_id"]: r["component_id"] for r in lshforest.near_duplicates(frame(spark, rows), width=4).collect()}
    assert got == {d: names[r] for (d, _), r in zip(rows, roots)}


def test_links_of_a_group_are_looked_at_once(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"g{k}" for k in range(200)]
    rows = [(d, " ".join(base[:k] + [f"own{d}"] + base[k + 1:])) for d, k in enumerate(rng.randrange(200) for _ in range(300))]
    looked, plain = [], lshforest.components
    monkeypatch.setattr(lshforest, "components", lambda links: looked.append(links.count()) or plain(links))
    got = lshforest.near_duplicates(frame(spark, rows), width=4).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 300
    assert sum(looked) < 2 * len(rows)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 8), (300, 200), (200, 250)]
    got = {r["node"]: r["label"] for r in lshforest.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160)) and {got[k] for k in (200, 250, 300)} == {200}


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_holds_every_constraint(score):
    rng = random.Random(3)
    counts = {}
    for _ in range(3000):
        n = min(64, int(rng.expovariate(0.08)) + 1)
        counts[n] = counts.get(n, 0) + 1
    for cap in (packing.Capacity(64, 64, 64 ** 2, score=score), packing.Capacity(64, 3, 64 ** 2, score=score), packing.Capacity(64, 64, 64 ** 2, (1, 1, 1), score)):
        bins = packing.best_fit(counts, cap)
        back = {}
        for n, lengths in bins:
            assert sum(lengths) <= cap.tokens and len(lengths) <= cap.documents and sum(x * x for x in lengths) <= cap.attention
            for x in lengths:
                back[x] = back.get(x, 0) + n
        assert back == counts
        if cap.documents == 64:
            assert sum(n for n, _ in bins) <= -(-sum(k * v for k, v in counts.items()) // 64) + 1
    assert packing.best_fit({}, packing.Capacity()) == []
    with pytest.raises(ValueError):
        packing.best_fit({65: 1}, packing.Capacity(64))


def test_packing_equals_the_library(spark):
    from tokenizers import Tokenizer
    other = Tokenizer.from_file(tokenizer_path())
    rows = [(1, None), (2, ""), (3, "a b " * 5000), (4, "word " * 2047), (5, "word " * 2048), (6, "tiny"), (7, "tiny"), (8, "tiny")] + [(k, "some words " * (k % 37)) for k in range(10, 200)]
    got = packing.pack_best_fit(frame(spark, rows), tokenizer_path()).toPandas()
    total = 0
    for d, t in rows:
        ids = np.array(other.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        mine = got[got.doc_id == d].sort_values("piece")
        assert mine.piece.tolist() == list(range(-(-len(ids) // 2048))) and mine.start.tolist() == [2048 * p for p in mine.piece]
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s:s + 2048].tobytes()) for s in mine.start] and mine.length.sum() == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-total // 2048) + 1
    assert packing.pack_best_fit(frame(spark, []), tokenizer_path()).count() == 0
    twice = packing.pack_best_fit(frame(spark, [(1, "same"), (1, "same")]), tokenizer_path()).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2


def test_hilbert_curve_visits_neighbours():
    for d, b in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(product(range(1 << b), repeat=d)))
        index = hilbert.hilbert_index(cells, b)
        assert sorted(index) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [0, 5, 24, 1000])
def test_shards_are_even_and_gapless(spark, n):
    rows = [(k if k % 7 else None, "text" * (k % 50), None if k % 5 == 0 else f"l{k % 3}", "src0" if k % 3 else f"src{k % 20}") for k in range(n)]
    table = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, lang string, source string, size string")
    table = table.withColumn("n", F.length("text"))
    got = hilbert.shard_hilbert(table, ["lang", "source", "n", "doc_id"], ["text", "doc_id"], 24).collect()
    assert len(got) == n and all(r["size"] == "mine" for r in got)
    counts = [sum(r["shard"] == s for r in got) for s in range(24)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))


def test_shards_prune_several_dimensions(spark):
    docs = hilbert.op8_hilbert_shards(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "source"), "doc_id")
    spread = docs.groupBy("shard").agg(F.countDistinct("lang").alias("lang"), F.countDistinct("source").alias("source")).agg(F.avg("lang"), F.avg("source")).first()
    assert spread[0] < 3 and spread[1] < 18  # of 4 and 20


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16))
    x[100:400] = x[100]  # a hot vector
    x[500:600] *= 3
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] + [0.0] * 14), (2080, [1.0] * 3), (2100, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    queries = table.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    got = nndescent.Graph(table).search(queries).toPandas()
    assert sorted(set(got.query_id)) == list(range(0, 900, 20))
    hit = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id) and np.allclose(g.score, x[g.vec_id] @ x[q], atol=1e-12, rtol=0)
        assert g.score.is_monotonic_decreasing
        best = sorted((v for v in range(900) if v != q), key=lambda v: (-round(x[v] @ x[q], 9), v))[:20]
        if 100 <= q < 400:
            assert g.vec_id.tolist() == best  # the members of the hot vector, by id, beside the longer vectors
        hit += len(set(best) & set(g.vec_id)) / 20
    assert hit / got.query_id.nunique() >= 0.95
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert nndescent.Graph(few).search(few.select(F.col("vec_id").alias("query_id"))).count() == 6
    none = few.limit(0)
    assert nndescent.Graph(none).search(none.select(F.col("vec_id").alias("query_id"))).count() == 0


@pytest.mark.parametrize("norms", ["one of 200", "one of 30", "lognormal", "unit"])
def test_recall_with_uneven_norms(spark, norms):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "lognormal":
        x *= rng.lognormal(0, 1.2, (1500, 1))
    elif norms != "unit":
        x[777] *= float(norms.split()[-1])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    graph = nndescent.Graph(table)
    got = graph.search(spark.range(0, 1500, 20).withColumnRenamed("id", "query_id")).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(g.vec_id)) / 20
    assert hit / 75 >= 0.95


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = nndescent.op10_nn_descent(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(table.embedding).astype(float), table.vec_id.to_numpy()
    hit = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(ids[np.argsort(-s)[:20]]) & set(got[got.query_id == ids[q]].vec_id)) / 20
    assert hit / (ids % 20 == 0).sum() >= 0.95


# --- the pipeline ---

def test_stages_handle_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    texts = [(k, ("a calm line about rivers and hills " if k % 2 else "BUY!! NOW!! $$$ ") * (3 + k % 4) + str(k)) for k in range(1, 40)]
    for rows in (texts + [(99, None), (98, ""), (97, "1234 !!"), (None, "a calm line about rivers and hills"), (1, texts[0][1])], []):
        docs = frame(spark, rows).withColumn("score", F.lit("clash"))
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, str(tmp_path))
            path = f"{tmp_path}/{name}-{len(rows)}"
            after.write.parquet(path)
            if name != "packing":
                assert after.columns == docs.columns
                docs = spark.read.parquet(path)
        assert (after.count() > 0) == bool(rows)


def test_pipeline_equals_brute_force_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    quality_, language, exact, near, pack = [f for _, f in corpus_pipeline.STAGES]
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = {r["doc_id"] for r in quality_(spark, docs, sf).select("doc_id").collect()}
    assert np.mean([(d in good) == bool(q) for d, q in label.items()]) > 0.95
    spoken = {r["doc_id"] for r in language(spark, docs, sf).select("doc_id").collect()}
    assert len(spoken) > 0.97 * sum(any(map(str.isalpha, t or "")) for t in rows.values())
    best = {}
    for d, t in rows.items():
        best[fold(t)] = max(best.get(fold(t), d), d)
    assert {r["doc_id"] for r in exact(spark, docs, sf).select("doc_id").collect()} == set(best.values())
    sets, roots = brute_components(list(rows.items()), 5, 80)
    first = {}
    for d, s, r in zip(rows, sets, roots):
        key = r if s else ("alone", d)
        first[key] = min(first.get(key, d), d)
    assert {r["doc_id"] for r in near(spark, docs, sf).select("doc_id").collect()} == set(first.values())
    packed = corpus_pipeline.run(spark, sf)
    assert set(packed.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and packed.count() > 0


def test_language_stage_drops_what_no_language_explains(spark):
    sf, rng = "/root/testdata/sf0.001", random.Random(4)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gibberish = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (20, 200, 20_000, 100_000)]
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1200))
    other = ["Быстрая лиса прыгает через ленивую собаку и убегает в тёмный лес, где её никто не найдёт.",
             "Suomi on Pohjois-Euroopassa sijaitseva valtio, jonka naapurimaita ovat Ruotsi, Norja ja Venäjä. Talvella lumi peittää metsät ja järvien rannat."]
    planted = spark.createDataFrame([(10 ** 9 + k, t) for k, t in enumerate([*gibberish, blob, *other])], "doc_id long, text string")
    long = docs.filter("lang = 'en' and length(text) > 500").orderBy("doc_id").limit(200).agg((F.lit(10 ** 8)).cast("long").alias("doc_id"), F.concat_ws(" ", F.collect_list("text")).alias("text"))
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs.unionByName(planted, True).unionByName(long, True), sf).select("doc_id").collect()}
    assert not any(d >= 10 ** 9 for d in kept) and 10 ** 8 in kept
    assert len(kept) > 0.97 * docs.filter("text rlike '[A-Za-z]'").count()


CLASHES = ("_good", "_quality", "_language", "_sure", "_reads", "_key", "_slot", "_bucket", "_bits", "_hit", "stays", "column0", "kept", "keep_id", "group_size", "mark", "n", "row", "_len", "_full")


def test_stages_keep_clashing_columns_and_one_of_repeated_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 400").orderBy("doc_id").limit(40).cache()
    first = docs.orderBy("doc_id").limit(2)
    rows = docs.unionByName(first).unionByName(first)
    for c in CLASHES:
        rows = rows.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    repeated = {r["doc_id"] for r in first.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, sf)
        assert after.columns == rows.columns
        got = after.collect()
        assert all(r[c] == c + str(r["doc_id"]) for r in got for c in CLASHES)
        times = [r["doc_id"] for r in got]
        for d in repeated & set(times):
            assert times.count(d) == (1 if name in ("exact_dedup", "near_dedup") else 3)
        if name == "near_dedup":
            assert repeated <= set(times) or len(set(times)) < 40
    packed = corpus_pipeline.packing_stage(spark, rows, sf).groupBy("doc_id", "piece").count()
    assert packed.filter(f"doc_id in ({', '.join(map(str, repeated))}) and piece = 0 and count <> 3").isEmpty()


def test_near_stage_keeps_one_of_equal_rows(spark):
    text = "a calm line about rivers and hills that nobody has written before today"
    other = "quite another document that speaks of ships and harbours and of the weather"
    for rows in ([(1, text), (1, text), (2, other)], [(1, text), (1, text), (2, text + " again"), (3, other)], [(None, text), (None, text)], [(1, None), (1, None), (2, "")]):
        got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, frame(spark, rows), "").collect()]
        sets, roots = brute_components(rows, 5, 80)
        groups = {r if s else ("alone", i) for i, (s, r) in enumerate(zip(sets, roots))}
        assert len(got) == len(groups) and set(got) <= set(rows)


def test_beams_that_are_over_leave_the_search(spark, monkeypatch):
    m = np.random.default_rng(4).standard_normal((400, 24))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>")
    graph = nndescent.Graph(table, settings=nndescent.Settings(width=8, trees=2, leaf=128, first=6, steps=2))
    starts = graph.nodes.select(F.col("node").alias("q"), nndescent.packed(None)("vec").alias("qv"))
    plain, rounds = nndescent.write, []

    def write(df, name):
        done = plain(df, name)
        rounds.append(done.select("q").distinct().count())
        return done
    monkeypatch.setattr(nndescent, "write", write)
    beams = graph._walk(starts, 24).toPandas()
    assert rounds[0] == 400 and rounds[-1] < 400
    assert beams.q.nunique() == 400 and beams.done.all() and not beams.duplicated(["q", "node"]).any() and beams.groupby("q").size().max() <= 24
