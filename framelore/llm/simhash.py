"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 64 bits, each the majority of that bit over the hashes of its
shingles. Documents of one fingerprint are one class; only classes are compared.

Fingerprints that differ in at most ``distance`` bits are found by parts of their bits. The
bits are dealt into four blocks, correlated ones together, so that what the blocks say is as
independent as can be. Every fingerprint gets thresholds of its own, one a part: if they sum
to ``distance - parts + 1`` (a part may be left out with -1), any fingerprint within
``distance`` differs from it by no more than the threshold in some part. A dynamic programme
over the parts takes the thresholds with the fewest expected keys and candidates. What a
block value meets within each distance is counted over the whole corpus in tables of 2**16
entries a block; two blocks in one part are taken as independent. Whether to use four, three
or two parts is decided by the same costs, summed over all fingerprints.

A fingerprint is filed under its value in each part and probes the values within its
thresholds. A first round tests every probe against three fingerprints of a value; that
joins up most of a group. The second tests all pairs of a value that lie in different
components: what belongs to a value's main component meets only what does not. Candidates
are confirmed on the fingerprints, and no link between components is missed.

Defined cases: fewer words than ``width`` make one shingle of all; null texts, empty ones and
those of white space have the fingerprint zero, linked like any other; a bit set in just half
the hashes is 0; equal fingerprints are linked; repeated rows get equal results; a null id
names a component only if it has no other. Extra columns are dropped. Texts are hashed in
stretches, so very long ones need no more memory than their own size.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from framelore.llm.bpe import blocks
from framelore.llm.lshforest import components
from framelore.session import materialise

WIDE = 16              # bits of a block
LAYOUTS = (((0,), (1,), (2,), (3,)), ((0,), (1,), (2, 3)), ((0, 1), (2, 3)))
STRETCH = 1 << 20
HOT = 1000             # rows of a part value that one salt takes


def fingerprint(text: bytes | None, width: int, seed: int) -> int:
    """The majority of each bit over the XXH64 of the shingles of a UTF-8 text; A-Z count as a-z."""
    ones, n, words, at = np.zeros(64, np.int64), 0, [], 0
    text = text or b""
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words += text[at:end].lower().split()
        at = end
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            cut = [joined[s:e] for s, e in zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())]
            hashed = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), np.uint64, len(cut))
            for some in range(0, len(hashed), 1 << 16):
                ones += np.unpackbits(hashed[some:some + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(cut)
            words = words[len(words) - width + 1:]
    if not n and words:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    return int((2 * ones > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of each row of (doc_id, text); ``fp`` is the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                made = np.array([fingerprint(t, width, seed) for t in batch.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def as_bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def batches_of_fps(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column(0).to_numpy().view(np.uint64)


def correlated_blocks(classes: DataFrame) -> list[list[int]]:
    """The 64 bits in four blocks; each starts with the closest pair left and takes the bit closest to what it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for fps in batches_of_fps(batches):
            bits = as_bits(fps).astype(np.float32)
            both += bits.T @ bits
            n += len(fps)
        at = np.flatnonzero(np.ones(64 * 64, bool))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["at", "c"])

    sums = classes.select("fp").mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toPandas()  # 4,097 rows
    table = dict(zip(sums["at"], sums["c"]))
    n = max(table.get(-1, 0), 1)
    both = np.array([table.get(k, 0) for k in range(64 * 64)], float).reshape(64, 64) / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    close = np.abs(both - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0.0)
    left, made = list(range(64)), []
    while left:
        inside = close[np.ix_(left, left)]
        block = [left[k] for k in np.unravel_index(int(inside.argmax()), inside.shape)]
        block = block if block[0] != block[1] else left[:2]
        while len(block) < WIDE:
            rest = [b for b in left if b not in block]
            block.append(rest[int(close[np.ix_(rest, block)].sum(axis=1).argmax())])
        made.append(sorted(block))
        left = [b for b in left if b not in block]
    return made


@dataclass
class Plan:
    """Blocks, what their values meet, and how the blocks form parts."""
    blocks: list[list[int]]
    shells: np.ndarray  # block, distance, value: fingerprints at that distance in the block
    n: int
    distance: int
    layout: tuple[tuple[int, ...], ...] = LAYOUTS[0]

    def values(self, fps: np.ndarray) -> np.ndarray:
        """The value of each block (block, fingerprint)."""
        out = np.zeros((len(self.blocks), len(fps)), np.int64)
        for k, block in enumerate(self.blocks):
            for place, bit in enumerate(block):
                out[k] |= (fps >> np.uint64(bit) & np.uint64(1)).astype(np.int64) << place
        return out

    def expected(self, part: tuple[int, ...], values: np.ndarray) -> np.ndarray:
        """How many fingerprints lie within 0, 1, ... ``distance`` of each in this part (distance, fingerprint)."""
        shells = self.shells[part[0]][:, values[part[0]]]
        for b in part[1:]:
            other = self.shells[b][:, values[b]]
            shells = np.stack([sum(shells[k] * other[t - k] for k in range(t + 1)) / max(self.n, 1) for t in range(self.distance + 1)])
        return np.cumsum(shells, axis=0)

    def thresholds(self, values: np.ndarray, layout: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray]:
        """(part, fingerprint) thresholds of the least cost, and that cost. A threshold t takes t + 1 of the ``distance + 1`` to share."""
        many = values.shape[1]
        shares = self.distance + 1
        best, picks = np.full((shares + 1, many), np.inf), []
        best[0] = 0.0
        for part in layout:
            met = self.expected(part, values)
            keys = np.cumsum([len(masks_at(WIDE * len(part), t)) for t in range(shares)])
            cost = np.concatenate([np.zeros((1, many)), met + keys[:, None]])
            fresh, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
            for total in range(shares + 1):
                for share in range(total + 1):
                    through = best[total - share] + cost[share]
                    better = through < fresh[total]
                    fresh[total] = np.where(better, through, fresh[total])
                    pick[total] = np.where(better, share, pick[total])
            best = fresh
            picks.append(pick)
        found, total, row = np.zeros((len(layout), many), np.int64), np.full(many, shares), np.arange(many)
        for k in range(len(layout) - 1, -1, -1):
            found[k] = picks[k][total, row]
            total = total - found[k]
        return found - 1, best[shares]

    def keys(self, values: np.ndarray) -> np.ndarray:
        """(part, fingerprint) values of the parts, with the part's number on top."""
        out = []
        for k, part in enumerate(self.layout):
            key = np.zeros(values.shape[1], np.int64)
            for b in part:
                key = key << WIDE | values[b]
            out.append(k << 48 | key)
        return np.stack(out)


_MASKS: dict[tuple[int, int], np.ndarray] = {}


def masks_at(bits: int, distance: int) -> np.ndarray:
    """All masks of ``distance`` of so many bits."""
    if (bits, distance) not in _MASKS:
        _MASKS[bits, distance] = np.array([sum(1 << b for b in some) for some in combinations(range(bits), distance)], np.int64)
    return _MASKS[bits, distance]


def shells_of(counts: np.ndarray, distance: int) -> np.ndarray:
    """How many lie at distance 0, 1, ... of each value: one bit of the value after another."""
    shells = np.zeros((distance + 1, len(counts)))
    shells[0] = counts
    value = np.arange(len(counts))
    for b in range(WIDE):
        flipped = shells[:, value ^ (1 << b)]
        shells[1:] += flipped[:-1]
    return shells


def plan_of(classes: DataFrame, distance: int) -> Plan:
    """Blocks, counts and the layout of parts of the least cost, from all fingerprints."""
    cut = Plan(correlated_blocks(classes), np.zeros(0), 0, distance)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((4, 1 << WIDE), np.int64)
        for fps in batches_of_fps(batches):
            for k, v in enumerate(cut.values(fps)):
                seen[k] += np.bincount(v, minlength=1 << WIDE)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], names=["at", "c"])

    found = classes.select("fp").mapInArrow(count, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toPandas()  # at most 4 * 2**16 rows
    counts = np.zeros(4 << WIDE, np.int64)
    counts[found["at"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
    counts = counts.reshape(4, -1)
    plan = Plan(cut.blocks, np.stack([shells_of(c, distance) for c in counts]).astype(np.float32), int(counts[0].sum()), distance)
    usable = [layout for layout in LAYOUTS if len(layout) <= distance + 1] or [((0, 1, 2, 3),)]
    shared = classes.sparkSession.sparkContext.broadcast(plan)  # 4 * (distance + 1) * 2**16 floats

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(usable))
        for fps in batches_of_fps(batches):
            values = shared.value.values(fps)
            total += [shared.value.thresholds(values, layout)[1].sum() for layout in usable]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(usable))), pa.array(total)], names=["layout", "cost"])

    costs = {r["layout"]: r["cost"] for r in classes.select("fp").mapInArrow(price, "layout long, cost double").groupBy("layout").agg(F.sum("cost").alias("cost")).collect()}
    plan.layout = usable[min(costs, key=costs.get)] if costs else usable[0]
    return plan


def filed(classes: DataFrame, plan: Plan, probing: bool) -> DataFrame:
    """(key, fp): under which part values each fingerprint is filed, or which it probes."""
    shared = classes.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for fps in batches_of_fps(batches):
            values = p.values(fps)
            keys = p.keys(values)
            if not probing:
                pieces = [(k, fps) for k in keys]
            else:
                limits, pieces = p.thresholds(values, p.layout)[0], []
                for part, key, limit in zip(p.layout, keys, limits):
                    for t in range(p.distance + 1):
                        masks = masks_at(WIDE * len(part), t)
                        wanted = np.flatnonzero(limit >= t)
                        for some in range(0, len(wanted), max((1 << 18) // len(masks), 1)):
                            w = wanted[some:some + max((1 << 18) // len(masks), 1)]
                            pieces.append(((key[w][:, None] ^ masks[None, :]).ravel(), np.repeat(fps[w], len(masks))))
            for key, fp in pieces:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], names=["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, fp long")


def apart(x: str, y: str):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def links_of(classes: DataFrame, distance: int) -> DataFrame:
    """(node, label) of the fingerprints that have a link: the least fingerprint each one reaches."""
    plan = plan_of(classes, distance)
    index = materialise(filed(classes, plan, False), "index")
    probes = materialise(filed(classes, plan, True), "probes")
    few = index.groupBy("key").agg(F.min("fp").alias("r0"), F.max("fp").alias("r1"), F.min_by("fp", F.xxhash64("fp")).alias("r2"))
    met = probes.join(few, "key").select("fp", F.explode(F.array("r0", "r1", "r2")).alias("other")).filter((F.col("fp") != F.col("other")) & (apart("fp", "other") <= distance))
    stars = materialise(met.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct(), "stars")
    labels = components(stars)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))

    index, probes = materialise(labelled(index), "index"), labelled(probes)
    per = index.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    values = materialise(per.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("size"))
                         .select("key", F.col("top.label").alias("main"), F.ceil(F.col("size") / HOT).cast("long").alias("salts")), "values")
    probes = materialise(probes.join(values, "key"), "probes")
    index = materialise(index.join(values, "key").withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts"))), "index")
    asks = probes.select("key", F.col("fp").alias("x"), F.col("label").alias("lx"), (F.col("label") == F.col("main")).alias("mx"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    holds = index.select("key", "salt", F.col("fp").alias("y"), F.col("label").alias("ly"), (F.col("label") == F.col("main")).alias("my"))
    near = (F.col("lx") != F.col("ly")) & (apart("x", "y") <= distance)
    pairs = (asks.filter("not mx").join(holds, ["key", "salt"]).filter(near).select("x", "y")
             .unionByName(asks.filter("mx").join(holds.filter("not my"), ["key", "salt"]).filter(near).select("x", "y")))
    more = materialise(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    return labels if more.isEmpty() else components(stars.unionByName(more))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id for each row of (doc_id, text)."""
    rows = materialise(fingerprints(docs, width, seed), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    labels = links_of(classes, distance)
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    names = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = materialise(named.join(names, "label").select("fp", "component_id"), "named")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
