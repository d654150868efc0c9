"""Encoding, chat formatting, classifiers and licence scans against brute force, on odd rows."""
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from framelore.llm import bpe, chat, hilbert, langid, licenses, quality

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "don't I'LL STOP", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "a\x1cb\x1d c", "ΑΣ Σας İstanbul ǅ ﬁ é Å", "aaaa aaaaa aaaaaa",
       "12345 ½ ⅷ ² _x_ 'sss", "日本語 🎉👩‍👩‍👧 ​ x　y﻿", "nul\x00s\x00 here", "hello" * 3000, "the " * 40000, "x", "x"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("ids", T.StringType()), T.StructField("score", T.StringType()), T.StructField("licenses", T.StringType())])


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, a repeated row, and columns whose names clash with results."""
    rows = [(k if k else None, t, None if k % 3 else "en", "mine", "mine", "mine") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer
    path = bpe.tokenizer_path()
    other = Tokenizer.from_file(path)
    got = bpe.bpe_decode(bpe.bpe_encode(odd, path, keep_text=True), path).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        want = other.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded"] == other.decode(want, skip_special_tokens=False)
        assert r["score"] == "mine"
    both = bpe.bpe_encode(odd, path, decoded="decoded")
    assert sorted(both.select("decoded").toPandas()["decoded"]) == sorted(r["decoded"] for r in got)
    assert bpe.bpe_decode(bpe.bpe_encode(empty(spark), path), path).count() == 0


def test_op1_on_real_rows(spark):
    from tokenizers import Tokenizer
    other = Tokenizer.from_file(bpe.tokenizer_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op1_bpe_round_trip(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = other.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(other.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_template_folding_and_sandbox():
    t = chat.Template("{% set x = 'a' + 'b' %}{% if 1 == 2 %}no{% elif true %}{{ x }}{% endif %}{{ 'q' | upper }}"
                      "{% for m in messages %}{% if not loop.first %},{% endif %}{% generation %}{{ m.t }}{% endgeneration %}{% endfor %}")
    assert ("print", ("const", "Q")) in t.tree[1] and not any(n[0] == "if" for n in t.tree[1])
    assert t.render([{"t": "x"}, {"t": ""}, {"t": "yz"}]) == ("abQx,,yz", [(3, 4), (6, 8)])
    assert t.render([]) == ("abQ", [])
    assert chat.Template("{{ a.b.c }}|{{ a.items }}").render([], a={"b": 1}) == ("|", [])
    for bad in ("{% for x in y %}", "{{ a.__class__ }}", "{{ f(1) }}", "{{ x | nothing }}", "{% import os %}", "{{ 1 + }}", "{% else %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)


def test_chats_read_back(spark):
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "<s>[INST] \\ </s> <|end|> [/INST]"), (1, 1, "assistant", "tie"), (2, 5, None, None), (2, 4, "tool <|text|>", " [/INST]"),
            (None, 0, "user", "ends in \\"), (3, None, "system", "be\nkind"), (3, 0, "assistant", None), (3, 1, "assistant", "x " * 50000), (4, 0, "user", "same"), (4, 0, "user", "same")]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digest_chats(chat.format_chats(frame)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    low = lambda r: tuple((v is not None, v) if v is not None else (False, 0 if k == 1 else "") for k, v in enumerate(r))
    for conv in got:
        turns = sorted([r for r in said if r[0] == conv], key=lambda r: low(r[1:2]) + low(r[2:]))
        text = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in turns)
        loss = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_op2_on_real_rows(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = {r["conv_id"]: r for r in chat.op2_chat_format(spark, SF).collect()}
    assert set(got) == {r["conv_id"] for r in rows} | {-1} and got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == 21
    for conv, r in got.items():
        if conv >= 0:
            turns = sorted((x["turn"], x["role"], x["text"] or "") for x in rows if x["conv_id"] == conv)
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{b}\n{c}\n" for _, b, c in turns).encode()).hexdigest()
            assert r["loss_sha256"] == hashlib.sha256("".join(c for _, b, c in turns if b == "assistant").encode()).hexdigest()


def test_language_kernel_equals_sets():
    rows = [("en", "the cat and the dog"), ("de", "der hund und die katze"), ("en", "this is that"), ("de", "das ist nicht so")]
    m = langid.fit(rows, landmarks=2)
    seen = np.zeros(1 << langid.BITS, bool)
    sets = [set(langid.presence(t, seen)) for _, t in [rows[1], rows[3], rows[0], rows[2]]]  # languages in order
    mine = set(langid.presence("the hund 12", seen))
    want = [len(mine & s) / np.sqrt(len(mine) * len(s)) for s in sets]
    assert np.allclose(m.kernel(["the hund 12"])[0], want, atol=1e-5) and not seen.any()
    long = "ab cd " * 100_000
    assert set(langid.presence(long, seen)) == set(langid.presence("ab cd " * 10, seen))


def test_language_of_odd_rows(spark, odd):
    m = langid.fit([("en", "the cat and the dog"), ("fr", "le chat et le chien")])
    got = langid.identify(odd, m).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in got)
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit([])).collect()} == {"und"}
    assert langid.training_rows(empty(spark), F.lit(True)) == [] and langid.identify(empty(spark), m).count() == 0


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op3_language_id(spark, sf).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_training_rows_are_a_bounded_sample(spark):
    docs = spark.createDataFrame([(k, "ab", "en" if k % 3 else "fr") for k in range(3000)], "doc_id long, text string, lang string")
    rows = langid.training_rows(docs, F.col("doc_id") > 10, per_language=50)
    assert sorted(rows) == [("en", "ab")] * 50 + [("fr", "ab")] * 50


def test_quality_of_odd_rows(spark, odd):
    m = quality.fit([(1, "a good plain sentence about cats"), (0, "BUY!! NOW!! $$$ CHEAP!!"), (1, "another plain sentence"), (0, "WOW!! FREE!! $$$")])
    got = quality.score_quality(odd, m).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert m.score(quality.Hasher(), "a plain sentence") > 0.5 > m.score(quality.Hasher(), "FREE!! NOW!!")
    assert {r["score"] for r in quality.score_quality(odd, quality.fit([(1, "one class only")])).collect()} == {0.5}
    no = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.training_rows(odd, no) == [] and quality.score_quality(empty(spark), m).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op4_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in label]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in rows]) > 0.95


def test_license_rules(spark, odd):
    full = licenses.SENTENCES
    mit = "\n".join(full[k] for k in ("mit-title", "mit-grant")) + "\nsomething else\n" + full["mit-keep"]
    texts = [mit, full["bsd-grant"] + "\n" + full["bsd-names"], full["bsd-grant"], "LICENSED under the apache license, version 2.0!\r\nReleased under the MIT License.", full["mit-keep"], None, "", "no licence. " * 20000]
    frame = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id int, text string, licenses string")
    got = [(r["licenses"], r["unmatched"]) for r in licenses.scan_licenses(frame).orderBy("doc_id").collect()]
    assert got == [(["MIT"], []), (["BSD-3-Clause"], []), (["BSD-2-Clause"], []), (["Apache-2.0", "MIT"], []), ([], ["mit-keep"]), ([], []), ([], []), ([], [])]
    assert licenses.scan_licenses(odd).count() == len(ODD) + 1 and licenses.scan_licenses(empty(spark)).count() == 0


@pytest.mark.parametrize("source", ["{{ '%50000000d' % 1 }}", "{{ 1 + 'a' }}", "{{ 'a' - 'b' }}", "{{ 1 % 0 }}", "{{ 1 < 'a' }}", "{{ true + true }}", "{{ 3 | length }}", "{{ messages + messages }}", "{{ m - 1 }}"])
def test_template_operators_take_numbers_or_texts_only(source):
    with pytest.raises(chat.TemplateError):
        chat.value_of(chat.fold(chat.parse(source))[1][0][1])({"messages": [1], "m": None})


def test_ridge_regression_equals_a_direct_solution():
    """Margins of the fitted model against kernels of sets of strings, an explicit feature map and a solver of its own."""
    rng = random.Random(2)
    words = {"aa": ["abba", "cadabra", "labda"], "bb": ["xylox", "zyx", "quux"], "cc": ["mnemo", "ono", "lemon"]}
    rows = [(lang, " ".join(rng.choice(words[lang] + words["aa"][:1]) for _ in range(12))) for _ in range(14) for lang in words]
    model = langid.fit(rows, landmarks=5)
    grams = lambda t: {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    marks = [t for lang in sorted(words) for t in [x for of, x in rows if of == lang][:5]]
    small = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(small)
    keep = values > 1e-6 * values.max()
    feature = lambda t: np.array([kernel(t, m) for m in marks]) @ vectors[:, keep] / np.sqrt(values[keep])
    x = np.array([feature(t) for _, t in rows])
    for k, lang in enumerate(sorted(words)):
        y = np.array([1.0 if of == lang else -1.0 for of, _ in rows])
        # Equal classes of equal size: plain centred ridge, as one least-squares problem with the penalty as rows.
        xc, yc = x - x.mean(0), y - y.mean()
        ridge = 1e-3 * np.trace(xc.T @ xc) / xc.shape[1]
        solved = np.linalg.lstsq(np.vstack([xc, math.sqrt(ridge) * np.eye(xc.shape[1])]), np.concatenate([yc, np.zeros(xc.shape[1])]), rcond=None)[0]
        want = np.array([(feature(t) - x.mean(0)) @ solved + y.mean() for t in ("abba zyx", "lemon ono", "quux abba")])
        got = (model.kernel(["abba zyx", "lemon ono", "quux abba"]) @ model.weights + model.bias)[:, k]
        assert np.allclose(got, want, atol=1e-3)


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(4)
    data = [([rng.randrange(40) for _ in range(6)], [rng.uniform(0.1, 2) for _ in range(6)], rng.randrange(2), rng.choice([0.5, 1.0, 2.0])) for _ in range(200)]
    ftrl, z, n = quality.Ftrl(), {}, {}
    for at, value, label, weight in data:
        at, value = zip(*sorted(dict(zip(at, value)).items()))
        ftrl.update(np.array(at), np.array(value), label, weight)
        w = {}
        for i in at:
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= ftrl.l1 else -(zi - math.copysign(ftrl.l1, zi)) / ((ftrl.beta + math.sqrt(ni)) / ftrl.alpha + ftrl.l2)
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, value))))
        for i, v in zip(at, value):
            g = weight * (p - label) * v
            step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / ftrl.alpha
            z[i], n[i] = z.get(i, 0.0) + g - step * w[i], n.get(i, 0.0) + g * g
    assert all(abs(ftrl.z[i] - z[i]) < 1e-9 and abs(ftrl.n[i] - n[i]) < 1e-9 for i in z)


def test_shards_of_the_query_equal_a_plain_count(spark):
    """Sizes, checksums and the law of the query, and its order: slots follow the curve index of cells between exact quantiles."""
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = hilbert.op8_hilbert_shards(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(docs) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    for r in got.itertuples():
        raw = docs[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    counts = got.groupby("shard").size()
    assert sorted(counts.index) == list(range(24)) and counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_shards_prune_by_quantised_dimensions(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random(), f"s{rng.randrange(20):02d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string").repartition(5)
    got = hilbert.shard_hilbert(df, ["a", "b"], ["id"], 16).toPandas()
    # 16 runs of a curve over two dimensions: a range of a quarter of one dimension touches about half of them, not all.
    for c in ("a", "b"):
        ends = got.groupby("shard")[c].agg(["min", "max"])
        touched = [((ends["min"] < lo + 0.25) & (ends["max"] > lo)).sum() for lo in (0.0, 0.25, 0.5, 0.75)]
        assert np.mean(touched) <= 10
