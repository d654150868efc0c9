"""Ordered work on hot keys, split over time.

A window partitioned by camera would put a third of the data into one task if
one camera holds a third of the rows. Everything ordered in this package is
therefore partitioned by ``(key, time slice)``:

* ``sliced``        — bounded look-back or look-ahead: rows near a slice edge are
                      copied into the neighbouring slice as context
* ``carried``       — unbounded "last value so far": one row per slice is carried
                      forward through a table of slice ends
* ``running_total`` — unbounded prefix sums: slice totals are summed first
* ``sessionize``    — gap-based sessions, from the two above
* ``range_join``    — point-in-interval joins on equal time buckets
* ``overlap_join``  — interval-interval joins: the later start is a point in the other interval
* ``ordered_total`` — prefix sums in value order over range partitions, however bunched the values
* ``quantile_at``   — exact quantiles from value counts
* ``spaced``        — a minimum gap between kept rows, by pointer doubling over slices
* ``carry_scan``    — any deterministic sequential fold (see its docstring)

Slice tables hold one row per key and slice, so they grow with the time covered,
never with the number of rows.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framelore.session import materialise

SLICE = "_slice"
HOME = "_home"


def slice_no(ts: Column, width: float) -> Column:
    return F.floor(ts / F.lit(float(width))).cast("long")


def micros(ts: str) -> Column:
    """Seconds as whole microseconds, for range frames."""
    return F.round(F.col(ts) * 1_000_000).cast("long")


def within(keys: Sequence[str], ts: str, lo: float | None, hi: float) -> Window:
    """A window over one key and slice whose frame spans ``[ts + lo, ts + hi]`` seconds."""
    start = Window.unboundedPreceding if lo is None else round(lo * 1_000_000)
    return Window.partitionBy(*keys, SLICE).orderBy(micros(ts)).rangeBetween(start, round(hi * 1_000_000))


def sliced(df: DataFrame, ts: str, width: float, back: float = 0.0, ahead: float = 0.0) -> DataFrame:
    """Copy each row into every slice whose rows may need to see it.

    ``back`` is how far a row may look into the past, ``ahead`` into the future.
    ``_home`` marks the one copy that belongs to the slice.
    """
    t = F.col(ts).cast("double")
    if back == 0 and ahead == 0:
        return df.withColumn(SLICE, slice_no(t, width)).withColumn(HOME, F.lit(True))
    spread = F.sequence(slice_no(t - F.lit(float(ahead)), width), slice_no(t + F.lit(float(back)), width))
    return (df.withColumn(SLICE, F.explode(spread))
              .withColumn(HOME, F.col(SLICE) == slice_no(t, width)))


def home(df: DataFrame) -> DataFrame:
    """Drop the context copies again."""
    return df.filter(HOME).drop(SLICE, HOME)


def carried(df: DataFrame, keys: Sequence[str], ts: str, width: float, back: float = 0.0,
            tie: Sequence[str] = (), wanted: DataFrame | None = None) -> DataFrame:
    """``sliced`` plus, per slice, the newest row older than its look-back.

    With that row present, "the latest row at least x seconds ago" is exact
    however long the key was silent. ``wanted`` lists further ``(keys, _slice)``
    that need the carried row, for instance those of another table.
    """
    cols = df.columns
    base = sliced(df, ts, width, back=back)
    order = F.struct(F.col(ts), *[F.col(c) for c in tie])
    # A row is "old" for slice s once t + back < s * width, i.e. for s > floor((t + back) / width).
    ends = (df.groupBy(*keys, slice_no(F.col(ts).cast("double") + F.lit(float(back)), width).alias(SLICE))
              .agg(F.max_by(F.struct(*cols), order).alias("_last")))
    own = df.select(*keys, slice_no(F.col(ts).cast("double"), width).alias(SLICE))
    wanted = (own if wanted is None else own.unionByName(wanted.select(*keys, SLICE))).distinct()
    # One row per key and slice: ends sort after requests of the same slice, so a
    # request sees only ends of earlier slices.
    stream = (ends.select(*keys, SLICE, F.lit(1).alias("_kind"), "_last")
              .unionByName(wanted.select(*keys, SLICE, F.lit(0).alias("_kind"),
                                         F.lit(None).cast(ends.schema["_last"].dataType).alias("_last"))))
    w = (Window.partitionBy(*keys).orderBy(SLICE, "_kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    context = (stream.withColumn("_prev", F.last("_last", ignorenulls=True).over(w))
               .filter((F.col("_kind") == 0) & F.col("_prev").isNotNull())
               .select(*[F.col("_prev")[c].alias(c) for c in cols], SLICE, F.lit(False).alias(HOME)))
    return base.unionByName(context)


def running_total(df: DataFrame, keys: Sequence[str], ts: str, width: float, value: Column, out: str,
                  tie: Sequence[str] = ()) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including this one."""
    base = df.withColumn("_v", value).withColumn(SLICE, slice_no(F.col(ts).cast("double"), width))
    totals = base.groupBy(*keys, SLICE).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, SLICE, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    local = (Window.partitionBy(*keys, SLICE).orderBy(ts, *tie)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, SLICE]]
    joined = (base.withColumn("_local", F.sum("_v").over(local)).alias("a")
              .join(carry.alias("b"), reduce(lambda p, q: p & q, on)))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns],
                         (F.col("a._local") + F.col("b._carry")).alias(out))


def sessionize(df: DataFrame, keys: Sequence[str], ts: str, gap: float, out: str = "session_no",
               width: float | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Number the runs of rows whose neighbours are at most ``gap`` apart (1, 2, ...)."""
    width = width or max(gap * 50.0, 1.0)
    w = Window.partitionBy(*keys, SLICE).orderBy(ts, *tie)
    prev = F.lag(ts).over(w)
    flagged = home(sliced(df, ts, width, back=gap)
                   .withColumn("_first", (prev.isNull() | (F.col(ts) - prev > F.lit(gap))).cast("long")))
    return running_total(flagged, keys, ts, width, F.col("_first"), out, tie).drop("_first")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str, width: float,
         out: str, tie: Sequence[str] = (), forward: bool = False) -> DataFrame:
    """Give each left row the last right row with ``rt <= lt`` as struct ``out``.

    ``forward`` gives the first right row with ``rt >= lt`` instead. Right rows
    at the same instant count; of several the one with the largest ``tie`` wins.
    """
    sign = F.lit(-1.0 if forward else 1.0)
    rcols, lcols = right.columns, left.columns
    r = right.select(*keys, (F.col(rt).cast("double") * sign).alias("_t"), F.struct(*rcols).alias("_r"),
                     F.struct(*[F.col(c) for c in tie]).alias("_tie") if tie else F.lit(0).alias("_tie"))
    l = left.select(*keys, (F.col(lt).cast("double") * sign).alias("_t"), F.struct(*lcols).alias("_l"))
    l = l.withColumn(SLICE, slice_no(F.col("_t"), width))
    r = carried(r, keys, "_t", width, tie=["_tie"], wanted=l)
    both = (r.drop(HOME).withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)).withColumn("_side", F.lit(0))
            .unionByName(l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType))
                         .withColumn("_tie", F.lit(None).cast(r.schema["_tie"].dataType)).withColumn("_side", F.lit(1))))
    w = (Window.partitionBy(*keys, SLICE).orderBy("_t", "_side", "_tie")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (both.withColumn(out, F.last("_r", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
            .select("_l.*", out))


def grid_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_box, b_box, cell: float = 256.0) -> DataFrame:
    """Pairs with equal keys whose boxes touch, found through a grid of cells.

    ``a_box`` and ``b_box`` are (x1, y1, x2, y2) expressions; other columns must
    differ. A pair is produced only in the cell that holds the lower corner of
    its overlap, hence once. Far-apart boxes of a crowded frame never meet.
    """
    def spread(df, b4, p):
        x1, y1, x2, y2 = [c.cast("double") for c in b4]
        return (df.withColumn(f"{p}lx", x1).withColumn(f"{p}ly", y1).withColumn(f"{p}hx", x2).withColumn(f"{p}hy", y2)
                .withColumn("_gx", F.explode(F.sequence(slice_no(x1, cell), slice_no(x2, cell))))
                .withColumn("_gy", F.explode(F.sequence(slice_no(y1, cell), slice_no(y2, cell)))))
    j = spread(a, a_box, "_a").join(spread(b, b_box, "_b"), [*keys, "_gx", "_gy"])
    lx, ly = F.greatest("_alx", "_blx"), F.greatest("_aly", "_bly")
    hit = ((lx <= F.least("_ahx", "_bhx")) & (ly <= F.least("_ahy", "_bhy"))
           & (slice_no(lx, cell) == F.col("_gx")) & (slice_no(ly, cell) == F.col("_gy")))
    return j.filter(hit).drop("_gx", "_gy", "_alx", "_aly", "_ahx", "_ahy", "_blx", "_bly", "_bhx", "_bhy")


def range_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], t: str, lo: str, hi: str,
               width: float, how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Join points to intervals with ``lo <= t <= hi`` on equal keys and time buckets.

    Interval columns must not repeat point columns other than the keys. ``how``
    is inner, left, left_semi or left_anti as seen from the points.
    """
    b = "_bucket"
    p = points.withColumn(b, slice_no(F.col(t).cast("double"), width))
    r = ranges.withColumn(b, F.explode(F.sequence(slice_no(F.col(lo).cast("double"), width),
                                                  slice_no(F.col(hi).cast("double"), width))))
    cond = (F.col(f"p.{t}") >= F.col(f"r.{lo}")) & (F.col(f"p.{t}") <= F.col(f"r.{hi}"))
    for k in [*keys, b]:
        cond = cond & (F.col(f"p.{k}") == F.col(f"r.{k}"))
    if extra is not None:
        cond = cond & extra
    j = p.alias("p").join(r.alias("r"), cond, how)
    cols = [F.col(f"p.{c}") for c in points.columns]
    if how not in ("left_semi", "left_anti"):
        cols += [F.col(f"r.{c}") for c in ranges.columns if c not in keys]
    return j.select(*cols)


def with_one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Every row with the columns of a global aggregate, which has exactly one row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def dealt_join(x: DataFrame, y: DataFrame, keys: Sequence[str], cond: Column, how: str, cols: Sequence[str], share: int = 2000) -> DataFrame:
    """Join on equal keys and ``cond``, with the pairs of a key that many rows share dealt over tasks.

    A key with more than ``share`` rows on a side is cut there into blocks of about ``share`` rows, and
    the other side's rows are copied to each: no task meets more than a block by a block, whatever
    the key. ``how`` is inner, or left_semi: then a row of ``x`` comes once for each block with a partner.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / share).cast("long").alias(name)).filter(F.col(name) > 1)

    on = lambda l, r: reduce(lambda p, q: p & q, [F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}")) for k in keys])
    hot = blocks(x, "_nx").alias("p").join(blocks(y, "_ny").alias("q"), on("p", "q"), "full").select(
        *[F.coalesce(f"p.{k}", f"q.{k}").alias(k) for k in keys], F.coalesce("_nx", F.lit(1)).alias("_nx"), F.coalesce("_ny", F.lit(1)).alias("_ny"))
    hot = materialise(hot, "hot")  # a row for each key in more than one block

    def deal(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        d = df.alias("d").join(hot.alias("h"), on("d", "h"), "left").select("d.*", F.coalesce(own, F.lit(1)).alias("_own"), F.coalesce(other, F.lit(1)).alias("_other"))
        return (d.withColumn(mine, F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col("_own")))
                .withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_other") - 1))).drop("_own", "_other"))

    left, right = deal(x, "_nx", "_ny", "_bx", "_by"), deal(y, "_ny", "_nx", "_by", "_bx")
    on_all = [*keys, "_bx", "_by"]
    cells = hot.agg(F.sum(F.col("_nx") * F.col("_ny"))).first()[0]
    if cells:  # a given number, since tasks merged by their bytes would hold many blocks again
        tasks = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(cells, 4000))
        left, right = left.repartition(tasks, *on_all), right.repartition(tasks, *on_all)
    right = right.select(*[F.col(k).alias(f"_k_{k}") if k in on_all else F.col(k) for k in right.columns])
    for k in on_all:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return left.join(right, cond, how).select(*cols)


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float, how: str = "inner") -> DataFrame:
    """Pairs of equal keys whose intervals overlap: ``a.lo < b.hi and a.hi > b.lo``; a null end is open.

    Of two overlapping intervals the later start lies in the other one (of equal starts,
    b's counts as the later). Starts are points, in one time bucket each, so a pair is found
    once, in the bucket of its later start; only the other interval is copied into the
    buckets it covers. Intervals with an open end would cover all buckets: they are kept
    apart and meet the other side by key. Pairs of a crowded key or bucket are dealt over
    tasks (``dealt_join``). Column names must differ but for the keys.
    ``how`` is inner, or left_semi: then distinct rows of ``a`` with a partner.
    """
    (alo, ahi), (blo, bhi) = a_span, b_span
    c = lambda x: F.col(x).cast("double")
    shut = lambda lo, hi: F.col(lo).isNotNull() & F.col(hi).isNotNull()
    after = lambda lo, hi: F.col(lo).isNull() | F.col(hi).isNull() | (F.col(lo) < F.col(hi))
    hit = after(alo, bhi) & after(blo, ahi)
    place = lambda df, at: df.withColumn("_bucket", slice_no(c(at), width))
    spread = lambda df, lo, hi: df.filter(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(slice_no(c(lo), width), slice_no(c(hi), width))))
    a_shut, b_shut = a.filter(shut(alo, ahi)), b.filter(shut(blo, bhi))
    a_open, b_open = a.filter(~shut(alo, ahi)), b.filter(~shut(blo, bhi))
    parts = [(spread(a_shut, alo, ahi), place(b_shut, blo), hit & (F.col(blo) >= F.col(alo)), [*keys, "_bucket"]),
             (place(a_shut, alo), spread(b_shut, blo, bhi), hit & (F.col(blo) < F.col(alo)), [*keys, "_bucket"]),
             (a_open, b, hit, list(keys)), (a_shut, b_open, hit, list(keys))]
    cols = a.columns if how == "left_semi" else [*a.columns, *[x for x in b.columns if x not in keys]]
    found = []
    for x, y, cond, on in parts:
        found.append(dealt_join(x, y, on, cond, how, cols))
    every = reduce(DataFrame.unionByName, found)
    return every.distinct() if how == "left_semi" else every


def ordered_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row (``out``) and over its key (``out`` + "_all"), in the order of ``order``.

    Rows are range partitioned by key and order, so a partition's share does not depend on
    how the values are spread; partition totals, one row a key and partition, are summed
    first. Rows must differ in ``keys`` and ``order``.
    """
    ranged = materialise(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*keys, "_p").agg(F.sum(value).alias("_t"))
    along = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])  # a key's partitions
    before = along.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"), F.sum("_t").over(along).alias(f"{out}_all"))
    totals = materialise(totals, "totals")
    local = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_p"]]
    joined = ranged.withColumn("_local", F.sum(value).over(local)).alias("a").join(totals.alias("b"), reduce(lambda p, q: p & q, on))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_local") + F.col("_before")).alias(out), F.col(f"b.{out}_all"))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key, how often, the rows up to each and all rows: ``value, n, upto, upto_all``."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return ordered_total(counts, keys, [value], "n", "upto")


def quantile_at(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], nearest: bool = False) -> DataFrame:
    """Exact quantiles without sorting a group in one task.

    Linear interpolation by default; ``nearest`` takes the half-even rounded
    rank instead. Values are counted first, so ties cost nothing.
    """
    ranked = value_ranks(df.filter(F.col(value).isNotNull()), keys, value)
    aggs = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("upto_all") - 1)
        if nearest:
            pos = F.bround(pos, 0)
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col(value)))
        frac = F.max(pos - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


# ── spacing ──

def spaced(instants: DataFrame, keys: Sequence[str], ts: str, gap: float, tie: str, width: float) -> DataFrame:
    """The ``tie`` of the instants that a pass keeping a row only ``gap`` after the last kept one would keep.

    ``instants`` are distinct per key. In every slice only a few rows can be the first
    that is kept there: those of its first ``gap`` seconds and the next one. For
    each of these entries (and for "none in this slice") one task finds the last row
    its chain keeps, which names the entry of the next slice. The entries that the
    chain from the key's first row reaches are found by pointer doubling, in as many
    rounds as the logarithm of the number of slices; then each slice is folded
    once from its entry.
    """
    width = max(width, gap)
    rows = instants.select(F.to_json(F.struct(*keys)).alias("_g"), F.col(ts).cast("double").alias("_t"), F.col(tie).alias("_id"),
                           slice_no(F.col(ts).cast("double"), width).alias(SLICE))
    rows = materialise(rows, "spaced")
    node = T.StructType([T.StructField("_g", T.StringType()), T.StructField(SLICE, T.LongType()), T.StructField("pos", T.LongType()),
                         T.StructField("entry", T.DoubleType()), T.StructField("last", T.DoubleType())])

    def nexts(t: np.ndarray) -> np.ndarray:
        """For each row the next one that is kept after it (the number of rows if none)."""
        at = np.maximum(np.searchsorted(t, t + gap) - 1, 0)
        while True:
            early = (at < len(t)) & (t[np.minimum(at, len(t) - 1)] - t < gap)
            if not early.any():
                return at
            at = at + early

    def entries(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(f["_t"].to_numpy())
        at = nexts(t).tolist()
        last = t.tolist()
        for i in range(len(t) - 1, -1, -1):
            if at[i] < len(t):
                last[i] = last[at[i]]
        n = min(int(np.searchsorted(t, key[1] * width + gap)) + 1, len(t))
        return pd.DataFrame({"_g": key[0], SLICE: key[1], "pos": [-1, *range(n)], "entry": [np.nan, *t[:n]], "last": [-np.inf, *last[:n]]})

    nodes = rows.groupBy("_g", SLICE).applyInPandas(entries, node)
    nodes = materialise(nodes, "entries")
    order = Window.partitionBy("_g").orderBy(SLICE)  # one row a slice
    following = materialise(nodes.filter("pos = -1").select("_g", SLICE).withColumn("_to", F.lead(SLICE).over(order)), "following")
    link = T.StructType([*node.fields[:3], T.StructField("_to", T.LongType()), T.StructField("to_pos", T.LongType())])

    def connect(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """From what a slice ended with to the entry of the next one."""
        right = right[right["pos_"] >= 0].sort_values("pos_")
        t = right["entry_"].to_numpy()
        last = left["last"].to_numpy()
        at = np.maximum(np.searchsorted(t, last + gap) - 1, 0)
        for _ in range(3):  # rounding of the sum moves the place by one at most
            at = at + ((at < len(t)) & (t[np.minimum(at, len(t) - 1)] - last < gap))
        return left.assign(to_pos=np.where(at < len(t), at, -1))[["_g", SLICE, "pos", "_to", "to_pos"]]

    ahead = nodes.join(following.filter("_to is not null"), ["_g", SLICE]).select("_g", SLICE, "pos", "last", "_to")
    targets = nodes.toDF(*[f"{c}_" for c in nodes.columns])
    jump = materialise(ahead.groupBy("_g", "_to").cogroup(targets.groupBy("_g_", f"{SLICE}_")).applyInPandas(
        lambda a, b: connect(a, b) if len(a) else pd.DataFrame(columns=[f.name for f in link.fields]), link), "jump")
    jumps = []
    while not jump.isEmpty():  # the jumps of step k lead 2 ** k slices on
        jumps.append(jump)
        then = jump.select("_g", F.col(SLICE).alias("_to"), F.col("pos").alias("to_pos"), F.col("_to").alias("_far"), F.col("to_pos").alias("far_pos"))
        jump = materialise(jump.join(then, ["_g", "_to", "to_pos"]).select("_g", SLICE, "pos", F.col("_far").alias("_to"), F.col("far_pos").alias("to_pos")), "jump")
    reached = nodes.filter("pos = 0").join(nodes.groupBy("_g").agg(F.min(SLICE).alias(SLICE)), ["_g", SLICE]).select("_g", SLICE, "pos")
    for jump in reversed(jumps):
        onward = jump.join(reached, ["_g", SLICE, "pos"], "left_semi").select("_g", F.col("_to").alias(SLICE), F.col("to_pos").alias("pos"))
        reached = materialise(reached.unionByName(onward), "reached")
    begins = reached.filter("pos >= 0").join(nodes.select("_g", SLICE, "pos", "entry"), ["_g", SLICE, "pos"]).select("_g", SLICE, "entry")

    def follow(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_t")
        t = f["_t"].to_numpy()
        at, i, kept = nexts(t).tolist(), int(np.searchsorted(t, f["entry"].iloc[0])), []
        while i < len(t):
            kept.append(i)
            i = at[i]
        return f[["_id"]].iloc[kept]

    return (rows.join(begins, ["_g", SLICE]).groupBy("_g", SLICE).applyInPandas(follow, T.StructType([T.StructField("_id", instants.schema[tie].dataType)]))
            .withColumnRenamed("_id", tie))


# ── sequential folds ─────────────────────────────────────────────────────────

Columns = dict[str, np.ndarray]
Fold = Callable[[Columns, object], tuple[dict, object]]


def cuts(table: pa.Table, keys: Sequence[str]) -> list[int]:
    """Where the groups of a table sorted by ``keys`` start, and its end; nulls are equal."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        new |= np.diff(pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices.to_numpy()) != 0
    return [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of a partition sorted by ``keys``, with their starts; a group that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            ongoing = held and len(cuts(pa.Table.from_batches([held[0].slice(0, 1), batch.slice(batch.num_rows - 1)]), keys)) == 2
            held.append(batch)
            if ongoing:
                continue
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            at = cuts(table, keys)
            held = []
            if batch is not None:
                held = table.slice(at[-2]).to_batches()
                at = at[:-1]
            if len(at) > 1:
                yield table, at


def carry_scan(df: DataFrame, keys: Sequence[str], ts: str, width: float, warmup: float, fold: Fold,
               out_schema: T.StructType, order: Sequence[str] = (),
               settle: Callable[[object, float], object] | None = None,
               summary: Callable[[Columns], object] | None = None,
               advance: Callable[[object, object], object] | None = None) -> DataFrame:
    """Run a deterministic sequential fold over each key, split into time slices.

    ``fold(rows, state) -> (output columns, state)`` sees the columns of one slice as arrays in
    ``(ts, *order)`` order; the state must be JSON-able and small. All slices run
    at once from a *guessed* entry state, the state after folding the ``warmup``
    seconds before the slice. Then the guesses are checked against what the
    slice before really ended with, and only slices that guessed wrong are run
    again. The result is that of one sequential pass over the key.

    ``settle(state, slice_start)`` drops what can no longer matter (an expired
    cooldown), so that equal futures compare equal. ``advance(state, summary)``
    may know, from a per-slice ``summary``, the state a slice ends with (or say
    None), so that a long quiet stretch is settled in one round.

    Most keys are short, so a task runs through many groups of its sorted partition. The number of
    partitions follows the rows: by bytes alone the groups would meet in a few tasks.
    Every round is written to the checkpoint folder; slices that were right are
    never recomputed.
    """
    keys = list(keys)
    groups = [*keys, SLICE]
    settle = settle or (lambda state, _start: state)
    key_fields = [df.schema[k] for k in keys]
    packed = T.StructType([
        *key_fields, T.StructField(SLICE, T.LongType()), T.StructField("_round", T.IntegerType()),
        T.StructField("_in", T.StringType()), T.StructField("_out", T.StringType()),
        T.StructField("_summary", T.StringType()), T.StructField("_row", out_schema)])
    plan_schema = T.StructType([*key_fields, T.StructField(SLICE, T.LongType()), T.StructField("_entry", T.StringType())])
    columns, names = df.columns, out_schema.names
    dump = lambda state: json.dumps(state, sort_keys=True)

    def scan(rnd: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema, row_schema = to_arrow_schema(packed), to_arrow_schema(out_schema)
            for table, at in sorted_groups(batches, groups):
                every = {c: table[c].to_pandas().to_numpy() for c in columns}
                mine, slice_at = table[HOME].to_numpy(), table[SLICE].to_numpy()
                entries = table["_e"] if rnd else None
                first, notes, outs = [], [], []
                for s, e in zip(at, at[1:]):
                    own, start = mine[s:e], slice_at[s] * width
                    if not own.any():  # context copies only: nothing to emit
                        continue
                    rows = {c: v[s:e] for c, v in every.items()}
                    body = rows if own.all() else {c: v[own] for c, v in rows.items()}
                    if rnd:
                        state = json.loads(entries[s].as_py())
                    else:
                        state = None if body is rows else fold({c: v[~own] for c, v in rows.items()}, None)[1]
                    state = settle(state, start)
                    seen = dump(state)
                    out, state = fold(body, state)
                    first.append(s)
                    notes.append((seen, dump(state), dump(summary(body)) if summary else None))
                    outs.append(out)
                if not first:
                    continue
                sizes = [len(out[names[0]]) for out in outs]
                of_row = np.repeat(np.array(first), sizes)
                filled = [out for out, n in zip(outs, sizes) if n]
                column = lambda c, t: pa.array(np.concatenate([np.asarray(out[c]) for out in filled]), t) if filled else pa.array([], t)
                row = pa.StructArray.from_arrays([column(f.name, f.type).cast(f.type) for f in row_schema], fields=list(row_schema))
                head = pa.array(np.concatenate([np.array(first), of_row]))
                none = [None] * len(of_row)
                cols = [*[table[k].combine_chunks().take(head) for k in groups], pa.array(np.full(len(head), rnd, np.int32)),
                        *[pa.array([*c, *none], pa.string()) for c in zip(*notes)],
                        pa.concat_arrays([pa.nulls(len(first), row.type), row])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)
        return run

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Walk the slice ends of each key and list the slices to run again."""
        schema = to_arrow_schema(plan_schema)
        for table, at in sorted_groups(batches, keys):
            nos, ins, ends, notes = (table[c].to_pylist() for c in (SLICE, "_in", "_out", "_summary"))
            redo, entry = [], []
            for s, e in zip(at, at[1:]):
                state = None
                for i in range(s, e):
                    actual = settle(state, nos[i] * width)
                    text = dump(actual)
                    state = None
                    if text != ins[i]:
                        redo.append(i)
                        entry.append(text)
                        # Unknown until this slice has run, if no summary tells; assume it converges.
                        state = advance(actual, json.loads(notes[i])) if advance and notes[i] is not None else None
                    if state is None and i + 1 < e:
                        state = json.loads(ends[i])
            if redo:
                yield pa.RecordBatch.from_arrays([*[table[k].combine_chunks().take(pa.array(redo)).cast(schema.field(k).type) for k in groups],
                                                  pa.array(entry, pa.string())], schema=schema)

    rows = materialise(sliced(df, ts, width, back=warmup), "slices")
    count, cores = rows.count(), 2 * df.sparkSession.sparkContext.defaultParallelism
    shares = lambda n: max(min(cores, n // 1000 + 1), n // 250_000)
    dealt = lambda part, n, by, then=(): part.repartition(shares(n), *by).sortWithinPartitions(*by, *[F.col(c).asc_nulls_last() for c in then])
    parts = [materialise(dealt(rows, count, groups, [ts, *order]).mapInArrow(scan(0), packed), "scan")]
    rnd = 0
    while True:  # each round settles at least the first open slice of every key
        rnd += 1
        ends = newest(parts, keys).filter(F.col("_in").isNotNull()).select(*groups, "_in", "_out", "_summary")
        redo = materialise(dealt(ends, count, keys, [SLICE]).mapInArrow(resolve, plan_schema), "redo")
        if redo.isEmpty():
            break
        same = reduce(lambda p, q: p & q, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in groups])
        again = rows.filter(HOME).alias("a").join(redo.alias("b"), same).select("a.*", F.col("b._entry").alias("_e"))
        parts.append(materialise(dealt(again, count, groups, [ts, *order]).mapInArrow(scan(rnd), packed), "scan"))
    return newest(parts, keys).filter(F.col("_row").isNotNull()).select("_row.*")


def newest(parts: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of the last run of every slice."""
    if len(parts) == 1:
        return parts[0]
    every = reduce(DataFrame.unionByName, parts)
    last = (every.filter(F.col("_in").isNotNull()).groupBy(*keys, SLICE).agg(F.max("_round").alias("_round")))
    same = reduce(lambda p, q: p & q, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, SLICE, "_round"]])
    return every.alias("a").join(last.alias("b"), same).select("a.*")
