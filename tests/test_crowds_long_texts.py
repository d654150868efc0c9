"""Closest pairs in crowded frames and the screening of long captions."""
import re
import time

import numpy as np
from pyspark.sql import functions as F

from framelore import dims
from framelore.operators import captions as cap, frames as fr


def test_closest_pair_of_small_crowded_and_clustered_frames(spark):
    rng = np.random.default_rng(3)
    frames = {0: rng.uniform(0, 100, (1, 2)), 1: rng.uniform(0, 100, (2, 2)), 2: rng.uniform(0, 1920, (4, 2)), 3: rng.uniform(0, 1920, (10_000, 2)),
              4: np.concatenate([rng.normal(500, 0.01, (3000, 2)), rng.uniform(0, 1920, (500, 2))]), 5: np.stack([np.full(400, 7.0), np.arange(400) ** 1.5], axis=1),
              6: np.array([[3.0, 4.0]] * 50 + [[9.0, 9.0]]), 7: np.array([[i * 3.0, j * 4.0] for i in range(30) for j in range(30)])}
    rows = [(k, i, float(x), float(y)) for k, pts in frames.items() for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "sample_no long, person long, px double, py double").repartition(6)
    got = {r.sample_no: r.gap for r in fr.closest_pairs(df, ["sample_no"]).collect()}
    for k, pts in frames.items():
        if len(pts) < 2:
            assert k not in got
            continue
        best = min(float(np.sqrt(((pts[i + 1:] - pts[i]) ** 2).sum(axis=1)).min()) for i in range(len(pts) - 1))
        assert abs(got[k] - best) <= 1e-9 * max(best, 1e-12) or got[k] == best


def screened(text):
    """Each pattern's first match in the whole text, unless a negation stands before it in its sentence, after the last contrast word."""
    out = set()
    text = text.lower()
    for i, (pattern, *_) in enumerate(dims.LEXICON):
        m = re.search(pattern, text)
        if m:
            sentence = re.split(r"[.!?;\n]", text[:m.start()])[-1]
            scope = re.split(dims.CONTRAST, sentence)[-1]
            if not re.search(dims.NEGATION + "|" + dims.NEGATION_CONTRACTED, scope):
                out.add((i, m[0]))
    return out


def test_long_captions_are_screened_in_linear_time(spark):
    calm = "people walk along the quay, no one hurries and the shops are open. "
    texts = [calm * 15_000 + "then a man is stealing a bicycle! " + calm * 10,
             "the harbour lies calm and grey " * 30_000 + "until a fight breaks out",     # one sentence of a million signs
             "not a single " + "thing is wrong here " * 30_000 + "and no knife is seen",
             calm + "he has no knife; but a knife lies there. a gun, however not a rifle\nfire"]
    df = spark.createDataFrame(list(enumerate(texts)), "caption_id long, text string")
    start = time.time()
    got = {i: set() for i in range(len(texts))}
    for r in cap.screen_captions(df).collect():
        got[r.caption_id].add((r.pattern_no, r.match))
    assert time.time() - start < 60
    assert got == {i: screened(t) for i, t in enumerate(texts)} and got[0] and got[1]
