"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Equal vectors form one node; its members are ranked by id only when answers are
made. The inner product with a query grows as the distance falls to a vector that a
further component fills up to the largest norm of the table, so the graph links
nodes by this distance. A node is kept as one signed byte a component with its own scale,
and what its fill lacks of the largest norm as a float of its own: one long
vector does not coarsen the others. Answers are
scored by the inner product of the original vectors in double precision.

Build: nodes start with neighbours from the leaves of random projection trees over
range-partitioned runs of the table. A descent step joins every node's neighbours
and reverse neighbours with their vectors, compares those of one node with each
other in a matrix product, and offers each what is better than its worst neighbour:
the neighbours of neighbours. Only pairs with a link that is new since the last step are
compared, and nodes around which nothing is new are left out. Steps end when few links change.
A descent step looks at ``width`` reverse neighbours of a node, new ones first, others each
step; the links themselves stay in the graph.

Search: the beam of a query starts at its own node and at the nodes of largest norm; a round
joins the beam's new nodes with their neighbour lists and keeps the best ``beam`` nodes seen, until no beam
changes; a beam that no longer does leaves the rounds. How wide the beam must be is measured: the answers of ``probes`` nodes are compared with those of
a pass over all vectors, and the beam doubles until they agree to ``recall``.

Defined cases: vectors that are null, all zero, of another length than most, or
that hold a null or non-finite component take no part, neither as query nor as
candidate; with fewer candidates than asked for, all that the graph reaches are
returned; an empty table gives an empty result; ties go to the smaller id.
Repeated rows of one id are members of their own. Extra columns are dropped.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from framelore.session import materialise

LONG, BYTES = T.LongType(), T.BinaryType()
EDGE = T.StructType([T.StructField("node", LONG), T.StructField("near", LONG), T.StructField("sim", T.FloatType())])
EDGE_ARROW = pa.schema([("node", pa.int64()), ("near", pa.int64()), ("sim", pa.float32())])
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Settings:
    width: int = 32  # neighbours of a node
    trees: int = 8
    leaf: int = 512
    first: int = 16  # neighbours from one leaf
    offers: int = 12  # what one node's comparison offers each row
    steps: int = 6
    settled: float = 0.01  # share of links that change in the last step
    beam: int = 128
    widest: int = 1024
    entries: int = 8  # nodes of largest norm at which every search starts too
    probes: int = 100
    recall: float = 0.97


LEAST = -3e38  # below any similarity


def write(df: DataFrame, name: str) -> DataFrame:
    """Writes a step's table; its shuffle files go at once, as later steps read the table."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return materialise(df, name)
    finally:
        conf.set(CLEANUP, before)


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec as doubles) of the rows that take part."""
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(
        v.isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vec") == (sizes["d"] if sizes else 0))


def top(rows: DataFrame, k: int, by: str, other: str, score: str = "sim") -> DataFrame:
    """The ``k`` best of each ``by``; Spark's group limit keeps ``k`` a task before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(score), other)
    return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).drop("_k")


# --- vectors as bytes ---

def packed(largest: float | None) -> Callable:
    """A UDF: a vector as its scale and its fill (two 32-bit floats) and a signed byte a component.

    The fill is what the filling component lacks of the ``largest`` norm of the table; 0 for queries.
    """
    def pack(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        m = np.stack(vec.to_numpy())
        norm = np.linalg.norm(m, axis=1)
        fill = np.zeros(len(m)) if largest is None else norm ** 2 / (largest + np.sqrt(np.maximum(0, largest ** 2 - norm ** 2)))
        levels = np.rint(m / np.abs(m).max(axis=1, keepdims=True) * 127).astype(np.int8)
        scale = norm / np.linalg.norm(levels.astype(np.float32), axis=1)
        heads = np.column_stack([scale, fill]).astype("<f4")
        return pd.Series([h.tobytes() + row.tobytes() for h, row in zip(heads, levels)])
    return F.pandas_udf(pack, T.BinaryType())


def unpacked(raw: bytes | pa.Buffer, n: int) -> np.ndarray:
    """Vectors (n rows) of n packed ones, the fill as their last component."""
    rows = np.frombuffer(raw, np.uint8).reshape(n, -1)
    heads = np.ascontiguousarray(rows[:, :8]).view("<f4")
    return np.column_stack([rows[:, 8:].view(np.int8).astype(np.float32) * heads[:, :1], heads[:, 1]])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return unpacked(b"".join(column.to_pylist()), len(column)) if len(column) else np.zeros((0, 1), np.float32)


# --- groups of a sorted partition ---

def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables with the starts (and end) of their groups; a group that goes on in the next batch waits for it."""
    rest = None
    for batch in chain(batches, [None]):
        parts = [b for b in (rest, batch) if b is not None and b.num_rows]
        if not parts:
            continue
        held = pa.Table.from_batches(parts).combine_chunks()
        starts = [0, *(np.flatnonzero(np.diff(held[key].to_numpy())) + 1).tolist(), held.num_rows]
        if batch is not None:
            rest = held.slice(starts[-2]).to_batches()[0]
            starts = starts[:-1]
        else:
            rest = None
        if len(starts) > 1:
            yield held, starts


def best_pairs(m: np.ndarray, ids: np.ndarray, most: int, bar: np.ndarray | None = None, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row id, other id, similarity): for each row its ``most`` most similar other rows, if better than its bar.

    Similar is what has a small distance. With ``fresh``, pairs of two rows that are not fresh are left out.
    """
    half = (m * m).sum(axis=1) / 2
    if fresh is None or fresh.all():
        return best_of(m @ m.T - half[:, None] - half[None, :], ids, ids, most, bar)
    x, h = m[fresh], half[fresh]
    sim = x @ m.T - h[:, None] - half[None, :]  # fresh rows with all
    own = None if bar is None else bar[fresh]
    old = None if bar is None else bar[~fresh]
    return tuple(map(np.concatenate, zip(best_of(sim, ids[fresh], ids, most, own), best_of(sim[:, ~fresh].T, ids[~fresh], ids[fresh], most, old))))


def best_of(sim: np.ndarray, rows: np.ndarray, others: np.ndarray, most: int, bar: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = min(most, len(others))
    if not len(rows) or not k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    sim = np.where(rows[:, None] == others[None, :], np.float32(LEAST), sim)
    at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sim, at, axis=1)
    row, col = np.nonzero(value > (LEAST if bar is None else bar[:, None]))
    return rows[row], others[at[row, col]], value[row, col].astype(np.float32)


def edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=EDGE_ARROW)


def split(m: np.ndarray, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Leaves of at most ``size`` rows of a random projection tree."""
    leaves, todo = [], [np.arange(len(m))]
    while todo:
        a = todo.pop()
        if len(a) <= size:
            leaves.append(a)
            continue
        i, j = rng.choice(len(a), 2, replace=False)
        order = np.argsort(m[a] @ (m[a[i]] - m[a[j]]), kind="stable")
        todo += [a[order[:len(a) // 2]], a[order[len(a) // 2:]]]
    return leaves


def along(seed: int) -> Callable:
    """A UDF: the vector's place along a random direction."""
    def project(vec: pd.Series) -> pd.Series:
        m = unpacked(b"".join(vec), len(vec)) if len(vec) else np.zeros((0, 1))
        return pd.Series(m @ np.random.default_rng(seed).standard_normal(m.shape[1]))
    return F.pandas_udf(project, T.DoubleType())


def leaf_pairs(seed: int, s: Settings) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m, ids = matrix(batch.column("vec")), batch.column("node").to_numpy()
                yield edges([best_pairs(m[a], ids[a], s.first) for a in split(m, s.leaf, np.random.default_rng(seed))])
    return run


def compare_groups(offers: int) -> Callable:
    """Compares the rows around each node with each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, starts in groups(batches, "node"):
            near, bar, fresh, vec = held["near"].to_numpy(), held["bar"].to_numpy(), held["fresh"].to_numpy(), held["vec"].to_pylist()
            parts = []
            for s, e in zip(starts, starts[1:]):
                order = s + np.lexsort((~fresh[s:e], near[s:e]))  # of a row that is there twice, the fresh one
                at = order[np.concatenate([[True], near[order][1:] != near[order][:-1]])]
                if fresh[at].any():
                    parts.append(best_pairs(unpacked(b"".join([vec[k] for k in at]), len(at)), near[at], offers, bar[at], fresh[at]))
            if parts:
                yield edges(parts)
    return run


def merge_links(width: int) -> Callable:
    """The ``width`` best distinct neighbours of each node, whether they are fresh, and the worst similarity of a full list as its bar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, starts in groups(batches, "node"):
            node, near, sim, fresh = (held[c].to_numpy() for c in ("node", "near", "sim", "fresh"))
            out: list[np.ndarray] = []
            bars = np.full(len(node), LEAST, np.float32)
            for s, e in zip(starts, starts[1:]):
                order = s + np.lexsort((fresh[s:e], near[s:e]))  # a link that was there is not fresh
                at = order[np.concatenate([[True], near[order][1:] != near[order][:-1]])]
                best = at[np.lexsort((near[at], -sim[at]))][:width]
                if len(best) == width:
                    bars[best] = sim[best[-1]]
                out.append(best)
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in (node, near, sim, bars, fresh)], names=LINKS.names)
    return run


LINKS = T.StructType([*EDGE.fields, T.StructField("bar", T.FloatType()), T.StructField("fresh", T.BooleanType())])
LIST = T.StructType([T.StructField("node", LONG), T.StructField("near", BYTES), T.StructField("vecs", BYTES)])
BEAM = T.StructType([T.StructField("q", LONG), T.StructField("node", LONG), T.StructField("sim", T.FloatType()), T.StructField("done", T.BooleanType()),
                     T.StructField("bar", T.FloatType()), T.StructField("over", T.BooleanType())])


def pack_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a node: the ids and packed vectors of its neighbours."""
    for held, starts in groups(batches, "node"):
        node, near, vec = held["node"].to_numpy(), held["near"].to_numpy(), held["vec"].to_pylist()
        rows = [(int(node[s]), near[s:e].astype("<i8").tobytes(), b"".join(vec[s:e])) for s, e in zip(starts, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=LIST.names)


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores the neighbours of a beam's node; only those better than the beam's bar go on."""
    for batch in batches:
        parts = []
        for q, qv, bar, near, vecs in zip(*[batch.column(c).to_pylist() for c in ("q", "qv", "bar", "near", "vecs")]):
            ids = np.frombuffer(near, "<i8")
            sim = unpacked(vecs, len(ids)) @ unpacked(qv, 1)[0]
            good = sim > bar
            parts.append((np.full(int(good.sum()), q, np.int64), ids[good], sim[good]))
        if parts:
            q, node, sim = (np.concatenate(c) for c in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(node), pa.array(sim.astype(np.float32)), pa.array(np.zeros(len(q), bool)),
                                              pa.array(np.full(len(q), LEAST, np.float32)), pa.array(np.zeros(len(q), bool))], names=BEAM.names)


def merge_beams(beam: int) -> Callable:
    """The ``beam`` best distinct nodes of each query, and whether its beam is over: all of them were expanded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, starts in groups(batches, "q"):
            q, node, sim, done = (held[c].to_numpy() for c in ("q", "node", "sim", "done"))
            out, bars, over = [], np.full(len(q), LEAST, np.float32), np.zeros(len(q), bool)
            for s, e in zip(starts, starts[1:]):
                order = np.lexsort((~done[s:e], node[s:e]))  # a node that was expanded stays so
                own = node[s:e][order]
                at = order[np.concatenate([[True], own[1:] != own[:-1]])]
                best = at[np.lexsort((node[s:e][at], -sim[s:e][at]))][:beam] + s
                if len(best) == beam:
                    bars[best] = sim[best[-1]]
                over[best] = done[best].all()
                out.append(best)
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in (q, node, sim, done, bars, over)], names=BEAM.names)
    return run


def begin(entries: list[tuple[int, bytes]]) -> Callable:
    """The first beam of each query: its own node, above all others, and the entries."""
    ids = np.array([i for i, _ in entries], np.int64)
    m = unpacked(b"".join(v for _, v in entries), len(entries)) if entries else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = b.column("q").to_numpy()
                sim = matrix(b.column("qv")) @ m.T
                other = q[:, None] != ids[None, :]
                node = np.concatenate([q, np.broadcast_to(ids, other.shape)[other]])
                n = len(node)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([q, np.repeat(q, other.sum(axis=1))])), pa.array(node), pa.array(np.concatenate([np.full(len(q), -LEAST), sim[other]]).astype(np.float32)),
                    pa.array(np.zeros(n, bool)), pa.array(np.full(n, LEAST, np.float32)), pa.array(np.zeros(n, bool))], names=BEAM.names)
    return run


class Graph:
    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()):
        s = self.s = settings
        rows = write(clean(vectors, id_col, vec_col), "vectors")
        # Equal vectors are one node, named by its smallest id.
        self.nodes = write(rows.groupBy("vec").agg(F.min("vec_id").alias("node")), "nodes")
        self.members = write(rows.join(self.nodes.withColumnRenamed("vec", "v"), F.col("vec") == F.col("v")).select("node", "vec_id"), "members")
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x))
        count, largest = self.nodes.agg(F.count(F.lit(1)), F.max(norm)).first()
        far = self.nodes.select("node", "vec", norm.alias("n")).orderBy(F.desc("n"), "node").limit(s.entries)
        self.entries = [(r["node"], bytes(r["v"])) for r in far.select("node", packed(largest)("vec").alias("v")).collect()]
        self.unit = write(self.nodes.select("node", packed(largest)("vec").alias("vec")), "unit")
        found = None
        for tree in range(s.trees):
            ordered = self.unit.withColumn("p", along(tree)("vec")).repartitionByRange("p").sortWithinPartitions("p").select("node", "vec")
            near = ordered.mapInArrow(leaf_pairs(tree, s), EDGE)
            found = near if found is None else found.unionByName(near)
        self.links = self._merge(found.withColumn("fresh", F.lit(True)))
        for step in range(s.steps):
            self.links = self._descend(step)
            if self.links.filter("fresh").count() <= s.settled * count * s.width:
                break
        self.lists = write(self._around(-1).select("node", "near").distinct().join(self.unit.withColumnRenamed("node", "near"), "near").select("node", "near", "vec")
                           .repartition("node").sortWithinPartitions("node").mapInArrow(pack_lists, LIST), "lists")
        self.beam = None

    def _merge(self, rows: DataFrame) -> DataFrame:
        by_node = rows.select("node", "near", "sim", "fresh").repartition("node").sortWithinPartitions("node")
        return write(by_node.mapInArrow(merge_links(self.s.width), LINKS), "graph")

    def _around(self, step: int) -> DataFrame:
        """(node, near, fresh): links and, for every node, ``width`` of those that link to it, fresh ones first."""
        back = self.links.select(F.col("near").alias("node"), F.col("node").alias("near"), "fresh",
                                 (F.xxhash64("node", "near", F.lit(step)) / F.lit(2.0 ** 64) + F.col("fresh").cast("int")).alias("sim"))
        return self.links.select("node", "near", "fresh").unionByName(top(back, self.s.width, "node", "near").select("node", "near", "fresh"))

    def _descend(self, step: int) -> DataFrame:
        bars = self.links.groupBy(F.col("node").alias("near")).agg(F.first("bar").alias("bar"))
        held = self.unit.withColumnRenamed("node", "near").join(bars, "near", "left").fillna(LEAST, ["bar"])
        around = write(self._around(step), "around")
        active = around.filter("fresh").select("node").distinct()
        around = around.unionByName(self.unit.select("node", F.col("node").alias("near"), F.lit(False).alias("fresh"))).join(active, "node", "left_semi")
        # At most 2 * width + 1 rows a node, which lie together in a sorted partition.
        gathered = around.join(held, "near").select("node", "near", "vec", "bar", "fresh").repartition("node").sortWithinPartitions("node")
        offers = gathered.mapInArrow(compare_groups(self.s.offers), EDGE)
        return self._merge(self.links.select("node", "near", "sim", F.lit(False).alias("fresh")).unionByName(offers.withColumn("fresh", F.lit(True))))

    def _walk(self, starts: DataFrame, beam: int) -> DataFrame:
        """The beams of (q, qv) once none of them changes. A beam that is over is set aside, the rounds after it do without it."""
        beams = write(starts.mapInArrow(begin(self.entries), BEAM), "beam")
        ended = beams.filter("over")
        while not beams.filter("not over").isEmpty():
            going = beams.filter("not over")
            todo = going.filter("not done").select("q", "node", "bar").join(starts, "q").join(self.lists, "node").select("q", "qv", "bar", "near", "vecs")
            every = going.withColumn("done", F.lit(True)).unionByName(todo.mapInArrow(expand, BEAM))
            beams = write(every.repartition("q").sortWithinPartitions("q").mapInArrow(merge_beams(beam), BEAM), "beam")
            ended = ended.unionByName(beams.filter("over"))
        return ended

    def _measure(self, k: int) -> int:
        """The beam at which the answers of some nodes agree with those of a pass over all vectors."""
        s = self.s
        probes = self.nodes.orderBy(F.xxhash64(F.lit(5), "node"), "node").limit(s.probes).select("node", "vec").collect()  # ``probes`` vectors
        if not probes:
            return s.beam
        names, m = np.array([r["node"] for r in probes]), np.array([r["vec"] for r in probes])
        shared = self.nodes.sparkSession.sparkContext.broadcast((names, m))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, m = shared.value
            for b in batches:
                if b.num_rows:
                    ids = b.column("node").to_numpy()
                    yield edges([best_of(m @ b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).T, names, ids, k, None)])

        truth = write(top(self.nodes.select("node", "vec").mapInArrow(nearest, EDGE), k, "node", "near").select("node", "near"), "truth")
        total = truth.count()
        starts = write(self.nodes.filter(F.col("node").isin(names.tolist())).select(F.col("node").alias("q"), packed(None)("vec").alias("qv")), "probes")
        beam = max(s.beam, k + 1)
        while beam < s.widest:
            hit = self._walk(starts, beam).select(F.col("q").alias("node"), F.col("node").alias("near")).join(truth, ["node", "near"], "left_semi").count()
            if hit >= s.recall * total:
                break
            beam *= 2
        return beam

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, rank, vec_id, score) for ``queries`` of (query_id), ids of rows of the graph."""
        self.beam = self._measure(k)
        asked = write(queries.join(self.members.withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "node").distinct(), "asked")
        # Queries of equal vectors share one search.
        starts = write(asked.select(F.col("node").alias("q")).distinct().join(self.nodes.select(F.col("node").alias("q"), packed(None)("vec").alias("qv")), "q"), "starts")
        return self._answers(asked, self._walk(starts, self.beam), k)

    def _answers(self, asked: DataFrame, beams: DataFrame, k: int) -> DataFrame:
        """The best of each beam by the exact score, then nodes as their members: ``k`` + 1 of a node are enough, as one may be the query."""
        near = beams.select("q", F.col("node").alias("found"))
        exact = near.join(self.nodes.select(F.col("node").alias("q"), F.col("vec").alias("qv")), "q").join(
            self.nodes.select(F.col("node").alias("found"), "vec"), "found")
        schema = T.StructType([T.StructField("q", LONG), T.StructField("found", LONG), T.StructField("score", T.DoubleType())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("qv", "vec"))
                    yield pa.RecordBatch.from_arrays([b.column("q"), b.column("found"), pa.array(np.einsum("ij,ij->i", x, y))], names=schema.names)

        scored = write(exact.select("q", "found", "qv", "vec").mapInArrow(score, schema), "scored")
        first = write(top(self.members.withColumn("sim", F.lit(0)), k + 1, "node", "vec_id").select(F.col("node").alias("found"), "vec_id"), "first")
        listed = (top(scored, k + 1, "q", "found", "score").join(asked.withColumnRenamed("node", "q"), "q").join(first, "found")
                  .filter("vec_id <> query_id"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").cast("long").alias("query_id"))
    return Graph(vectors).search(queries)
