"""Embedding whitening by incremental eigendecomposition.

Vectors are lists of whole numbers, so their count and sums are exact. Every partition
keeps the spectrum of its scatter matrix and applies one centred rank-one update a
distinct row: the new eigenvalues are the roots of a secular equation, found all at once;
entries with no share in the update and equal eigenvalues are deflated first. Spectra of
partitions are combined in a tree: the scatter of two is the scatter of one plus a rank-one
update for every eigenpair of the other and one for the difference of their means. A last
pass over the rows projects the exact covariance on that basis (Rayleigh-Ritz), and the
projected matrix, whose size is the dimension alone, gives the components in double precision.

Rows are never shuffled; what is shuffled are states of dimension squared, one a partition.

Defined cases: rows whose vector is null, empty, or holds a null, or has another length than
most take no part (of equally frequent lengths the longest counts); an empty table gives an
empty result; repeated rows count as often as they occur; an equal eigenvalue may have any
basis of its space; of a component's two signs the one whose largest entry is positive is
taken; components without variance, at most all but rounding, have a null ``whitened`` and no
part in ``identity_error``, and ``explained`` is null if nothing varies at all; a ``deviation``
beyond a 64-bit integer is null. Null ids are handed through. Extra columns are dropped.
``quantised`` holds entries within 2**40, so that sums are exact.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from framelore.session import materialise

EPS = np.finfo(float).eps
FAN = 8  # states that one task combines
LIMIT = 2.0 ** 40


def quantised(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift for each entry, as a list of longs; null if the vector is null or holds null or non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(LIMIT)), F.lit(-LIMIT))).cast("long") + F.lit(shift).cast("long"))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z2 / (d - x)), as (d - nearest pole, x - nearest pole) by column; ``d`` rises strictly.

    A root lies between neighbouring poles, the last within ``rho * sum(z2)`` of the last pole.
    Each step fits the equation by its two neighbouring poles and falls back on bisection.
    """
    m = len(d)
    k = np.arange(m)
    gap = np.append(np.diff(d), rho * z2.sum())
    middle = 1 + rho * (z2[:, None] / (d[:, None] - (d + gap / 2)[None, :])).sum(axis=0)
    right = (middle < 0) & (k < m - 1)
    delta = d[:, None] - d[k + right][None, :]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    high[-1] = gap[-1]
    if middle[-1] < 0:
        low[-1] = gap[-1] / 2
    x = (low + high) / 2
    below = k[:, None] <= k[None, :]
    last = np.zeros(m, bool)
    last[-1] = True
    nearest, after = delta[k, k], delta[np.minimum(k + 1, m - 1), k]
    for _ in range(80):
        away = delta - x
        part = rho * z2[:, None] / away
        value = 1 + part.sum(axis=0)
        slopes = part / away
        slope = slopes.sum(axis=0)
        slope_low = np.where(below, slopes, 0.0).sum(axis=0)
        low, high = np.where(value < 0, x, low), np.where(value > 0, x, high)
        a, b = nearest - x, after - x
        p = (a + b) * value - a * b * slope
        q = a * b * value
        c = value - a * slope_low - b * (slope - slope_low)
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):  # steps that are no numbers fall outside and are halved
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step = np.where(last, a + a * a * slope / (value - a * slope), step)
        settled = (np.abs(value) <= 4 * EPS * (1 + np.abs(part).sum(axis=0))) | (np.abs(step) <= EPS * np.abs(x)) | (high - low <= EPS * np.abs(x))
        fresh = x + step
        x = np.where(settled, x, np.where((fresh > low) & (fresh < high), fresh, (low + high) / 2))
        if settled.all():
            break
    return delta, x


def rank_one(values: np.ndarray, vectors: np.ndarray, update: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``vectors diag(values) vectors' + rho update update'``; values rise, ``rho`` > 0."""
    z = vectors.T @ update
    norm2 = float(z @ z)
    if rho * norm2 <= 0:
        return values, vectors
    z, rho = z / np.sqrt(norm2), rho * norm2
    tol = 8 * EPS * max(abs(values[-1]), abs(values[0]), rho)
    vectors = vectors.copy()
    # Equal eigenvalues: a reflection of their space leaves one of them the whole share of the update.
    start = 0
    for end in [*np.flatnonzero(np.diff(values) > tol) + 1, len(values)]:
        if end - start > 1:
            share = z[start:end]
            size = np.sqrt(share @ share)
            if size > 0:
                mirror = share.copy()
                mirror[-1] += np.copysign(size, share[-1])
                space = vectors[:, start:end]
                vectors[:, start:end] = space - np.outer(space @ mirror, mirror * (2 / (mirror @ mirror)))
                z[start:end - 1], z[end - 1] = 0.0, -np.copysign(size, share[-1])
        start = end
    live = np.flatnonzero(rho * np.abs(z) > tol)
    if len(live):
        d, zl = values[live], z[live]
        delta, x = secular_roots(d, zl * zl, rho) if len(live) > 1 else (np.zeros((1, 1)), np.array([rho * zl[0] ** 2]))
        m = len(live)
        ahead = x[None, :] - delta  # root - pole
        # The update that has exactly these roots, so that the vectors are orthogonal.
        poles = d[None, :] - d[:, None]
        k = np.arange(m)
        shifted = np.where(k[None, :] < k[:, None], poles, np.concatenate([poles[:, 1:], np.ones((m, 1))], axis=1))
        with np.errstate(divide="ignore"):
            exact = np.exp(0.5 * np.log(np.abs(ahead / shifted)).sum(axis=1)) * np.sign(zl)
        turn = exact[:, None] / np.where(ahead == 0, EPS * tol, ahead)
        turn /= np.sqrt((turn * turn).sum(axis=0))
        vectors[:, live] = vectors[:, live] @ turn
        values = values.copy()
        nearest = d[np.argmin(np.abs(delta), axis=0)]
        values[live] = nearest + x
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """How many rows, their exact sums and the eigenpairs of their scatter matrix."""
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(size: int) -> "Spectrum":
        return Spectrum(0, np.zeros(size, np.int64), np.zeros(size), np.eye(size))

    def add(self, row: np.ndarray, times: int) -> None:
        if self.n:
            away = (self.n * row - self.sums) / self.n
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * times / (self.n + times))
        self.n += times
        self.sums = self.sums + times * row

    def join(self, other: "Spectrum") -> None:
        for value, vector in zip(other.values, other.vectors.T):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, max(value, 0.0))
        away = np.array([(int(a) * other.n - int(b) * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / (self.n + other.n))
        self.n += other.n
        self.sums = self.sums + other.sums


@dataclass
class Moments:
    """How many rows, their mean and their scatter about it."""
    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> "Moments":
        mean = rows.mean(axis=0)
        return Moments(len(rows), mean, (rows - mean).T @ (rows - mean))

    def join(self, other: "Moments") -> None:
        away = other.mean - self.mean
        every = self.n + other.n
        self.scatter = self.scatter + other.scatter + np.outer(away, away) * (self.n * other.n / every)
        self.mean = self.mean + away * (other.n / every)
        self.n = every


STATE = "part long, n long, first binary, second binary, third binary"


def packed(part: int, state: Spectrum | Moments) -> tuple:
    if isinstance(state, Spectrum):
        return part, state.n, state.sums.tobytes(), state.values.tobytes(), state.vectors.tobytes()
    return part, state.n, state.mean.tobytes(), state.scatter.tobytes(), None


def unpacked(row: tuple) -> Spectrum | Moments:
    _, n, first, second, third = row
    if third is not None:
        size = len(first) // 8
        return Spectrum(int(n), np.frombuffer(first, np.int64), np.frombuffer(second), np.frombuffer(third).reshape(size, size))
    mean = np.frombuffer(first)
    return Moments(int(n), mean, np.frombuffer(second).reshape(len(mean), len(mean)))


def each_partition(rows: DataFrame, start: Callable[[], object], add: Callable[[object, np.ndarray], object]) -> DataFrame:
    """One state for each partition of ``rows`` (one column, lists of longs of one length)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for some in range(0, batch.num_rows, 4096):
                block = matrix(batch.slice(some, 4096).column(0))
                if len(block):
                    state = add(start() if state is None else state, block)
        if state is not None:
            row = packed(TaskContext.get().partitionId(), state)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                             names=["part", "n", "first", "second", "third"])

    return rows.mapInArrow(run, STATE)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def combined(states: DataFrame) -> Spectrum | Moments | None:
    """All states in one, by a tree of tasks that take FAN states each."""
    states = materialise(states, "states")
    top = states.agg(F.max("part")).first()[0]
    if top is None:
        return None

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        every = [unpacked(r) for r in group.itertuples(index=False, name=None)]
        for other in every[1:]:
            every[0].join(other)
        return pd.DataFrame([packed(int(group["part"].iloc[0]) // FAN, every[0])], columns=group.columns)

    while top > 0:
        states = states.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(merge, STATE)
        top //= FAN
    return unpacked(tuple(states.first()))


@dataclass
class Whitening:
    """What the rows of a table are projected on."""
    n: int
    sums: np.ndarray
    values: np.ndarray   # of the components, falling
    vectors: np.ndarray  # a column a component
    trace: float

    def centred(self, rows: np.ndarray) -> np.ndarray:
        return (self.n * rows - self.sums) / self.n

    def live(self) -> np.ndarray:
        return self.values > len(self.sums) * EPS * max(self.values[0], 0.0) if len(self.values) else np.zeros(0, bool)

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        """The projections over the standard deviations; components without variance are not a number."""
        live = self.live()
        out = np.full((len(rows), len(self.values)), np.nan)
        out[:, live] = self.centred(rows) @ (self.vectors[:, live] / np.sqrt(self.values[live]))
        return out

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        """sum((n * x - sums)^2), exact."""
        rough = ((self.n * rows.astype(float) - self.sums.astype(float)) ** 2).sum(axis=1)
        if self.n * float(np.abs(rows).max(initial=0)) < 2 ** 62 and rough.max(initial=0) < 2 ** 62:
            away = self.n * rows - self.sums
            return (away * away).sum(axis=1).tolist()
        sums = [int(s) for s in self.sums]
        exact = [sum((self.n * x - s) ** 2 for x, s in zip(row, sums)) for row in rows.tolist()]
        return [e if e < 2 ** 63 else None for e in exact]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has the usual length and no null."""
    lengths = df.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.agg(F.max_by("size", F.struct("n", "size"))).first()[0]
    return df.filter(F.lit(False)) if usual is None else df.filter((F.size(vector) == usual) & F.forall(vector, lambda c: c.isNotNull()))


def fit(df: DataFrame, vector: str, components: int | None = None) -> Whitening | None:
    """The whitening of a column of lists of longs, from all rows; None if no row is usable."""
    rows = usable(df, vector).select(vector)

    def add(state: Spectrum | None, block: np.ndarray) -> Spectrum:
        state = state or Spectrum.empty(block.shape[1])
        distinct, times = np.unique(block, axis=0, return_counts=True)
        for row, n in zip(distinct, times.tolist()):
            state.add(row, n)
        return state

    found = combined(each_partition(rows, lambda: None, add))
    if found is None:
        return None
    basis = np.linalg.qr(found.vectors[:, ::-1])[0]
    rough = Whitening(found.n, found.sums, np.zeros(0), basis, 0.0)

    def project(state: Moments | None, block: np.ndarray) -> Moments:
        fresh = Moments.of(rough.centred(block) @ rough.vectors)
        if state is None:
            return fresh
        state.join(fresh)
        return state

    projected = combined(each_partition(rows, lambda: None, project)).scatter / found.n
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), basis @ turn[:, ::-1]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    vectors = vectors * np.where(largest < 0, -1.0, 1.0)
    keep = components or len(values)
    return Whitening(found.n, found.sums, values[:keep], vectors[:, :keep], float(np.trace(projected)))


def identity_error(df: DataFrame, vector: str, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    live = model.live()
    if not live.any():
        return None

    def add(state: Moments | None, block: np.ndarray) -> Moments:
        fresh = Moments.of(model.whiten(block)[:, live])
        if state is None:
            return fresh
        state.join(fresh)
        return state

    found = combined(each_partition(usable(df, vector).select(vector), lambda: None, add))
    return float(np.abs(found.scatter / found.n - np.eye(int(live.sum()))).max())


def whiten(df: DataFrame, id_col: str, vector: str, components: int | None = None) -> DataFrame:
    """One row for each usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                           T.StructField("identity_error", T.DoubleType())])
    model = fit(df, vector, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(df, vector, model)
    shared = df.sparkSession.sparkContext.broadcast(model)  # dimension by components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        explained = pa.array(np.tile(m.values / m.trace, 1) if m.trace > 0 else [None] * k, pa.float64())
        for whole in batches:
            for some in range(0, whole.num_rows, 4096):
                batch = whole.slice(some, 4096)
                rows, n = matrix(batch.column(1)), batch.num_rows
                each = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, m.n), pa.int64()),
                    pa.array(m.deviation(rows), pa.int64()).take(each), pa.array(m.whiten(rows).ravel(), pa.float64(), from_pandas=True),
                    explained.take(pa.array(np.tile(np.arange(k), n))), pa.array([error] * (n * k), pa.float64())], names=schema.names)

    return usable(df, vector).select(id_col, vector).mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised(F.col("embedding")).alias("x")).filter("x is not null")
    return whiten(vectors, "vec_id", "x", 32)
