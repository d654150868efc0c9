"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A document's features are its word unigrams and bigrams (words are
runs without white space, case kept) and those of the words' shapes, hashed to
``1 << BITS`` weights, each with its share of the document's n-grams as value, so a
score is one sparse dot product. Training makes a few passes of FTRL-proximal
updates (per-coordinate rates, L1 and L2) over a bounded sample of labelled rows,
each class with equal weight; a last step sets scale and offset so that 0.5
separates the labels of the sample best.

Defined cases: null and empty texts have the offset alone and get its score; texts
are read whole; without any labelled row of both classes every score is 0.5.
Repeated rows get equal results; extra columns are handed through, those of a
result's name replaced.
"""
from __future__ import annotations

import gc
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from framelore.llm.bpe import blocks, schema_with, with_columns

BITS = 18
MEMO = 300_000
MASK = np.uint64((1 << BITS) - 1)
LETTERS = re.compile(r"[^\W\d_]+")


def shape(word: str) -> str:
    """Case, length and signs of a word without its letters, e.g. ``a+***`` or ``Aa``."""
    kinds = LETTERS.sub(lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa", word)
    return re.sub(r"\d+", "0", kinds)[:12] + "+" * (len(word) > 14)


class Hasher:
    """Word and shape codes, remembered for a bounded number of words."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        words = text.split()
        if len(self.codes) > MEMO:
            self.codes = {}
        known = self.codes.get
        got = list(map(known, words))
        if None in got:
            for k, c in enumerate(got):
                if c is None:
                    w = words[k]
                    got[k] = self.codes[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape(w).encode("utf-8", "surrogatepass"))
        return np.array(got, np.uint64)

    def features(self, text: str) -> np.ndarray:
        """Weight cells of all n-grams, with repeats."""
        code = self.words(text)
        word, form = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
        mix = np.uint64(0x9E3779B97F4A7C15)
        pairs = (word[:-1] * np.uint64(0xBF58476D1CE4E5B9) + word[1:]) * mix
        repeat = (word[:-1] == word[1:]).sum()
        forms = (form[:-1] * np.uint64(0x94D049BB133111EB) + form[1:]) * mix
        return np.concatenate([word * mix, pairs, (form + np.uint64(1 << 40)) * mix, forms, np.full(repeat, np.uint64(77)) * mix]) >> np.uint64(64 - BITS)


@dataclass
class Ftrl:
    """FTRL-proximal for logistic loss."""
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    z: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, value: np.ndarray, label: int, importance: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ value)))))
        g = importance * (p - label) * value
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


@dataclass
class QualityModel:
    weights: np.ndarray  # the last one is the offset
    scale: float = 1.0
    shift: float = 0.0

    def score(self, hasher: Hasher, text: str | None) -> float:
        margin = self.weights[-1]
        if text:
            found = hasher.features(text)
            if len(found):
                margin += SPREAD * self.weights[found].mean()
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.scale * (margin - self.shift)))))


SPREAD = 20.0  # the features' values are shares of 1; this brings them to the offset's order


def fit(rows: list[tuple[int, str]], passes: int = 4, seed: int = 11) -> QualityModel:
    """A model from (label, text) rows."""
    ftrl, hasher = Ftrl(), Hasher()
    data = []
    for label, text in rows:
        at, n = np.unique(hasher.features(text or ""), return_counts=True)
        data.append((label, np.append(at.astype(np.int64), 1 << BITS), np.append(SPREAD * n / max(n.sum(), 1), 1.0)))
    counts = [sum(label == k for label, _, _ in data) for k in (0, 1)]
    if not all(counts):
        return QualityModel(np.zeros((1 << BITS) + 1, np.float32))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for k in rng.permutation(len(data)):
            label, at, value = data[k]
            ftrl.update(at, value, label, len(data) / (2 * counts[label]))
    weights = ftrl.weights()
    margins = np.array([float(weights[at] @ value) for _, at, value in data])
    labels = np.array([label for label, _, _ in data])
    # Where to cut: the offset with the fewest wrong rows, both classes weighing the same.
    order = np.argsort(margins)
    wrong = np.cumsum(np.where(labels[order] == 1, 1 / counts[1], -1 / counts[0]))
    k = int(np.argmin(wrong))
    shift = (margins[order][k] + margins[order][min(k + 1, len(order) - 1)]) / 2
    return QualityModel(weights.astype(np.float32), 1.0, float(shift))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = 6000) -> list[tuple[int, str]]:
    """(quality, text) of at most ``most`` labelled rows outside the held-out fold, by the smallest hash of the id."""
    usable = labels.filter(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    picked = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").collect()  # ``most`` ids and texts
    return [(r["quality"], r["text"]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"] or ""))]


def score_quality(docs: DataFrame, model: QualityModel, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds ``score`` and ``predicted``; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_with(docs, **{score: T.DoubleType(), predicted: T.IntegerType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        hasher = Hasher()
        for whole in batches:
            for batch in blocks(whole, "text"):
                scores = np.array([shared.value.score(hasher, t) for t in batch.column("text").to_pylist()], float)
                made = {score: pa.array(scores), predicted: pa.array((scores >= 0.5).astype(np.int32))}
                yield with_columns(batch, **made).select([f.name for f in schema])

    return docs.mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_quality(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
