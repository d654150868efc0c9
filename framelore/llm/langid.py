"""Language identification with a blended-spectrum string kernel.

k(x, y) is the number of character n-grams (all orders from 1 to ``order``) that
occur in both texts, over the geometric mean of how many each has: presence, not
counts. Landmark texts span a Nyström feature space; a kernel ridge regression per
language (one against the rest) is solved in it; texts are scored by batched
matrix products of presence rows with the landmarks.

n-grams are hashed to ``1 << BITS`` cells. Training reads a bounded sample: the
``per_language`` rows of smallest id hash in each language, of which the first
``landmarks`` are landmarks.

Defined cases: a text that is null or has no letter is ``und`` with score 0; texts
are read whole; languages with no training rows are never predicted; without any
training row every text is ``und``. Repeated rows get equal results; of languages that
fit equally the first by name is taken; extra columns are handed through, those of a result's name replaced.
"""
from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from framelore.llm.bpe import blocks, schema_with, with_columns

BITS = 18
ORDER = 3
UND = "und"


def cells(text: str, order: int = ORDER) -> np.ndarray:
    """Hash cells of all n-grams of the lower-cased text, with repeats; white space runs and digits are one sign each."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    gram = code.copy()
    out = [gram * np.uint64(0x9E3779B97F4A7C15)]
    for _ in range(1, order):
        gram = gram[:-1] * np.uint64(0xBF58476D1CE4E5B9) + code[len(code) - len(gram) + 1:]
        gram ^= gram >> np.uint64(29)
        out.append(gram * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def presence(text: str, seen: np.ndarray) -> np.ndarray:
    """The distinct cells of a text; ``seen`` is a clean mask of 1 << BITS and stays clean. Long texts go in pieces that overlap."""
    step = 1 << 18
    for at in range(0, max(len(text), 1), step):
        seen[cells(text[at:at + step + ORDER - 1])] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def share_known(text: str, known: np.ndarray) -> float:
    """The share of a text's longest n-grams, with repeats, whose cell is set in ``known``; it does not fall with the text's length.

    Digits and signs, as in numbers and addresses, say nothing of a language and count as one space.
    """
    text = re.sub(r"[\W\d_]+", " ", text)
    step, hit, total = 1 << 18, 0, 0
    for at in range(0, max(len(text), 1), step):
        found = cells(text[at:at + step + ORDER - 1])
        size = (len(found) + ORDER * (ORDER - 1) // 2) // ORDER  # of the piece in lower case
        if size >= ORDER:
            found = found[-(size - ORDER + 1):]
        elif at:
            continue  # the last piece lies within the overlap
        hit, total = hit + int(known[found].sum()), total + len(found)
    return hit / max(total, 1)


@dataclass
class LanguageModel:
    languages: list[str]
    slot: np.ndarray  # hash cell -> column of the landmark vocabulary, or -1
    marks: np.ndarray  # vocabulary x landmarks, presence over the root of each landmark's size
    weights: np.ndarray  # landmarks x languages, the Nyström map folded in
    bias: np.ndarray
    known: np.ndarray  # languages x hash cells, those of the language's landmarks
    least: np.ndarray  # the least share of known n-grams of a text of each language

    def reads(self, text: str | None, language: str) -> bool:
        """Whether the text has as many n-grams of the language as its training rows have, with allowance."""
        if language not in self.languages:
            return False
        k = self.languages.index(language)
        return share_known(text or "", self.known[k]) >= self.least[k]

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts and landmarks."""
        seen = np.zeros(1 << BITS, bool)
        rows = np.zeros((len(texts), len(self.marks)), np.float32)
        sizes = np.ones(len(texts), np.float32)
        for k, text in enumerate(texts):
            found = presence(text, seen)
            sizes[k] = max(len(found), 1)
            at = self.slot[found]
            rows[k, at[at >= 0]] = 1
        return (rows @ self.marks) / np.sqrt(sizes)[:, None]

    def predict(self, texts: list[str | None], batch: int = 256) -> tuple[list[str], np.ndarray]:
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        read = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for s in range(0, len(read), batch):
            part = read[s:s + batch]
            margin = self.kernel([texts[k] for k in part]) @ self.weights + self.bias
            best = margin.argmax(axis=1)
            # Targets are -1 and 1: the regression's value maps to a share of [0, 1].
            value = np.clip((margin[np.arange(len(part)), best] + 1) / 2, 0, 1)
            for k, b, v in zip(part, best, value):
                names[k], scores[k] = self.languages[b], float(v)
        return names, scores


ALLOWANCE, LOW = 0.65, 0.01  # of the share that all but LOW of a language's training rows reach


def shares(rows: list[tuple[str, str]], languages: list[str], landmarks: int) -> tuple[np.ndarray, np.ndarray]:
    """``known`` and ``least`` of a model; a landmark is measured by the other landmarks of its language."""
    known, least = np.zeros((len(languages), 1 << BITS), bool), np.zeros(len(languages))
    seen = np.zeros(1 << BITS, bool)
    for k, lang in enumerate(languages):
        texts = [text for of, text in rows if of == lang]
        count = np.zeros(1 << BITS, np.int32)
        for text in texts[:landmarks]:
            count[presence(text, seen)] += 1
        known[k] = count > 0
        reached = [share_known(text, count > 1 if j < landmarks else known[k]) for j, text in enumerate(texts)]
        least[k] = ALLOWANCE * np.quantile(reached, LOW)
    return known, least


def fit(rows: list[tuple[str, str]], landmarks: int = 40, ridge: float = 1e-3) -> LanguageModel:
    """A model from (language, text) rows; the first ``landmarks`` texts of each language become landmarks."""
    rows = [(lang, text) for lang, text in rows if text and any(map(str.isalpha, text))]
    languages = sorted({lang for lang, _ in rows})
    chosen: list[str] = []
    for lang in languages:
        chosen += [text for of, text in rows if of == lang][:landmarks]
    seen = np.zeros(1 << BITS, bool)
    sets = [presence(t, seen) for t in chosen]
    # Cells of one landmark alone are kept too: they are part of the kernel.
    vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
    slot = np.full(1 << BITS, -1, np.int32)
    slot[vocabulary] = np.arange(len(vocabulary))
    marks = np.zeros((len(vocabulary), len(sets)), np.float32)
    for k, found in enumerate(sets):
        marks[slot[found], k] = 1 / np.sqrt(max(len(found), 1))
    model = LanguageModel(languages, slot, marks, np.zeros((len(sets), len(languages))), np.zeros(len(languages)), *shares(rows, languages, landmarks))
    if not languages:
        return model
    values, vectors = np.linalg.eigh(model.kernel(chosen).astype(float))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm ** -1/2: the Nyström map
    features = np.concatenate([model.kernel([t for _, t in rows[s:s + 256]]) for s in range(0, len(rows), 256)]).astype(float) @ root
    targets = np.array([[1.0 if lang == of else -1.0 for of in languages] for lang, _ in rows])
    # Each language weighs the same, however many rows it has.
    weight = np.array([1 / sum(lang == of for of, _ in rows) for lang, _ in rows])[:, None]
    weight /= weight.sum()
    mean_x, mean_y = (weight * features).sum(0), (weight * targets).sum(0)
    x, y = features - mean_x, targets - mean_y
    solved = np.linalg.solve(x.T @ (weight * x) + ridge * np.trace(x.T @ (weight * x)) / x.shape[1] * np.eye(x.shape[1]), x.T @ (weight * y))
    model.weights, model.bias = root @ solved, mean_y - mean_x @ solved
    return model


def training_rows(docs: DataFrame, allowed: Column, per_language: int = 400) -> list[tuple[str, str]]:
    """(lang, text) of ``per_language`` rows a language (all, if it has fewer), by the smallest hash of the id.

    A first pass counts the languages; only rows under a hash threshold that leaves
    about twice as many as needed are ranked, so no task ranks a whole language.
    """
    usable = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return []
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2 * per_language + 100) / n))]), F.col("lang"))
    hashed = F.xxhash64(F.lit(7), "doc_id")
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    picked = (usable.select("doc_id", "lang").filter(F.pmod(hashed, F.lit(1 << 30)) < rate * (1 << 30)).withColumn("_k", F.row_number().over(order))
              .filter(F.col("_k") <= per_language).select("doc_id", "lang").distinct())
    # At most ``per_language`` ids a language are broadcast and as many texts collected.
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"]).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))]


def identify(docs: DataFrame, model: LanguageModel, lang_pred: str = "lang_pred", score: str = "score", reads: str | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, and as ``reads`` whether the text passes for that language at all; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_with(docs, **{lang_pred: T.StringType(), score: T.DoubleType()}, **({reads: T.BooleanType()} if reads else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.freeze()
        for whole in batches:
            for batch in blocks(whole, "text"):
                texts = batch.column("text").to_pylist()
                names, scores = shared.value.predict(texts)
                more = {reads: pa.array([shared.value.reads(t, n) for t, n in zip(texts, names)], pa.bool_())} if reads else {}
                yield with_columns(batch, **{lang_pred: pa.array(names, pa.string()), score: pa.array(scores)}, **more).select([f.name for f in schema])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    model = fit(training_rows(docs, ~held_out()))
    # The text is read whole, and dropped once it is scored.
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
