"""Vector best-fit packing of token sequences.

Every item (a document, or a 2,048-token piece of a longer one) takes a vector of
capacities in its bin: tokens, documents and attention cost (the square of its
length). Items of equal length are interchangeable, so best-fit decreasing runs on
the histogram of lengths, which has at most ``capacity`` entries at any input size:
classes of bins with equal residuals take classes of equal items. Each item class
goes to the bin class of the best score under every constraint: the weighted dot
product of demand and residual, or the norm of what would remain. The pieces then
find their bins by their rank among those of equal length, counted in parallel.

Null and empty texts have the closing id alone. Repeated rows are packed each by
itself. An empty table gives an empty result. Extra columns are dropped.
"""
from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from framelore.llm.bpe import blocks, model, tokenizer_path
from framelore.session import materialise

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                       T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("_part", T.IntegerType()),
                       T.StructField("_nth", T.LongType())])


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. The defaults for documents and attention cost never bind beside the tokens."""
    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 ** 2
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"  # or "dot"


def best_fit(counts: dict[int, int], cap: Capacity) -> list[tuple[int, list[int]]]:
    """Bins as (how many, lengths in them), longest items first, each into the class of bins that scores best.

    Only residuals where the item fits are looked at: bin classes are kept in the
    order of their residual tokens.
    """
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights, float)
    classes: dict[tuple[int, int, int], list[list]] = {}  # residual -> [[how many, lengths], ...]
    keys: list[tuple[int, int, int]] = []  # sorted

    def put(residual: tuple[int, int, int], n: int, lengths: tuple) -> None:
        if residual not in classes:
            classes[residual] = []
            bisect.insort(keys, residual)
        classes[residual].append([n, lengths])

    done: list[tuple[int, tuple]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        demand = (length, 1, length * length)
        if any(d > c for d, c in zip(demand, full)):
            raise ValueError(f"an item of {length} tokens fits no bin")
        while left:
            first = bisect.bisect_left(keys, (length, 0, 0))
            best = None
            if first < len(keys):
                room = np.array(keys[first:], float)
                fits = (room >= demand).all(axis=1)
                if fits.any():
                    if cap.score == "dot":  # the fullest bins have the smallest product
                        value = (room / full * weights) @ (np.array(demand) / full)
                    else:
                        value = (((room - demand) / full) ** 2) @ weights
                    best = keys[first + int(np.argmin(np.where(fits, value, np.inf)))]
            if best is None:
                # New bins hold as many of these items as fit, so that a class of bins is opened at once.
                each = int(min(cap.tokens // length, cap.documents, cap.attention // (length * length), left))
                n = left // each
                rest, lengths = (cap.tokens - each * length, cap.documents - each, cap.attention - each * length * length), ((length, each),)
                put(rest, n, lengths) if rest[0] else done.append((n, lengths))
                left -= n * each
                continue
            stack = classes[best]
            n, lengths = stack[-1]
            each = int(min(best[0] // length, best[1], best[2] // (length * length)))
            if left < each:
                each, take = left, 1
            else:
                take = min(n, left // each)
            if take == n:
                stack.pop()
                if not stack:
                    del classes[best]
                    keys.pop(bisect.bisect_left(keys, best))
            else:
                stack[-1][0] = n - take
            left -= take * each
            rest = (best[0] - each * length, best[1] - each, best[2] - each * length * length)
            lengths = (*lengths, (length, each))
            put(rest, take, lengths) if rest[0] else done.append((take, lengths))
    done += [(n, lengths) for stack in classes.values() for n, lengths in stack]
    return [(n, [x for length, each in lengths for x in [length] * each]) for n, lengths in done]


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """The pieces of every document: where they start, their length and checksum, and their place among equal lengths of the task."""
    close = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part, seen, step = model(path), TaskContext.get().partitionId(), {}, 4 * capacity
        for whole in batches:
            for batch in blocks(whole, "text"):
                rows = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), m.encode(batch.column("text").to_pylist())):
                    ids += close
                    for k, at in enumerate(range(0, len(ids), step)):
                        cut = ids[at:at + step]
                        n = len(cut) // 4
                        nth = seen[n] = seen.get(n, -1) + 1
                        rows.append((doc, k, at // 4, n, zlib.crc32(cut), part, nth))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("_part", pa.int32()), ("_nth", pa.int64())])


class Slots:
    """For each length, where its items in order of rank lie: runs of bins of one kind hold ``each`` of them from an offset on."""

    def __init__(self, bins: list[tuple[int, list[int]]]):
        runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for n, lengths in bins:
            at = 0
            while at < len(lengths):
                length, offset = lengths[at], sum(lengths[:at])
                each = 1
                while at + each < len(lengths) and lengths[at + each] == length:
                    each += 1
                first = ranks.get(length, 0)
                runs.setdefault(length, []).append((first, sequence, each, offset))
                ranks[length] = first + n * each
                at += each
            sequence += n
        self.runs = {length: np.array(r, np.int64) for length, r in runs.items()}

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = self.runs[length]
        r = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
        inside = rank - r[:, 0]
        return r[:, 1] + inside // r[:, 2], r[:, 3] + inside % r[:, 2] * length


def pack_best_fit(docs: DataFrame, path: str, cap: Capacity = Capacity()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, path, cap.tokens), "pieces")
    sizes = materialise(pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "piece-sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``cap.tokens`` rows
    slots = spark.sparkContext.broadcast(Slots(best_fit(counts, cap)))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).drop("_n")
    ranked = pieces.join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    schema = T.StructType([f for f in PIECES if f.name[0] != "_"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for length, rows in f.groupby("length").indices.items():
                sequence[rows], offset[rows] = slots.value.find(length, f["_rank"].to_numpy()[rows])
            yield f.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, schema)


def op7_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
