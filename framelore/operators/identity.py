"""Remembered entities: matching, enrolment, links, retention.

A match is a lead for a human to confirm; its similarity always travels with it.
"""
from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framelore import dims
from framelore.functions import expr
from framelore.session import materialise

REGISTRY = "entity_id string, kind string, cls string, label string, signature array<double>, aspect double, samples int, first_seen timestamp, last_seen timestamp"


SIDE, WIDE = 2000, 40_000   # rows a block has at least, if there are as many, and at most
RUN = 504   # entities listed for one sighting after another: a column file stores the repeated run in few bytes


def _dealt(lefts: int, rights: int, spread: int) -> tuple[int, int]:
    """Blocks of either side: about ``spread`` pairs of blocks with few copies of rows, until ``WIDE`` asks for more."""
    lefts, rights = max(1, lefts), max(1, rights)
    fit = lambda n, want: max(1, min(round(want), -(-n // SIDE)), -(-n // WIDE))
    of_left = fit(lefts, (spread * lefts / rights) ** 0.5)
    return of_left, fit(rights, spread / of_left)


def _met(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str, score, schema: T.StructType, blocks: tuple[int, int] | None = None) -> DataFrame:
    """What ``score`` makes of every row of ``left`` with every row of ``right`` that is equal ``on``.

    Both sides are dealt into blocks by their keys, and each pair of blocks is one task's work, however one group
    dominates. A task has one block of ``right`` in its hands; the rows of ``left`` pass by it, sorted behind it, and
    what ``score(rows of left, block of right)`` yields leaves the task at once. Columns of one side alone must not be null.
    """
    spark = left.sparkSession
    l_blocks, r_blocks = blocks or _dealt(left.count(), right.count(), max(32, 3 * spark.sparkContext.defaultParallelism))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("long")
    # Whole numbers next to nulls would come as floats.
    own = lambda df, other: [F.lit("0").cast(f.dataType).alias(f.name) for f in other.schema if f.name not in df.columns]
    lefts = left.select("*", *own(left, right), deal(left_key, l_blocks).alias("_p"), F.lit(1).alias("_side")).select("*", every(r_blocks).alias("_q"))
    rights = right.select("*", *own(right, left), deal(right_key, r_blocks).alias("_q"), F.lit(0).alias("_side")).select("*", every(l_blocks).alias("_p"))
    keys = [*on, "_p", "_q"]

    def run(batches):
        key, rows, block = None, [], None
        for batch in batches:
            marks = batch[[*keys, "_side"]]
            cuts = np.flatnonzero((marks != marks.shift()).any(axis=1).to_numpy())
            for lo, hi in zip(cuts, [*cuts[1:], len(batch)]):
                part = batch.iloc[lo:hi]
                this = tuple(part[keys].iloc[0])
                if this != key:
                    key, rows, block = this, [], None
                if part["_side"].iloc[0] == 0:
                    rows.append(part)
                elif rows:
                    block = pd.concat(rows) if block is None else block
                    yield from score(part, block)

    both = lefts.unionByName(rights).repartition(4 * l_blocks * r_blocks, *keys).sortWithinPartitions(*keys, "_side", right_key)
    return both.mapInPandas(run, schema)


def _signature(bands: int) -> Column:
    """The signature; a missing one, or one of another length, is like none."""
    width = bands * sum(dims.BLOCK_BINS.values())
    return F.when(F.size("signature") == width, F.col("signature")).otherwise(F.array_repeat(F.lit(0.0), width)).alias("signature")


def scored_pairs(sightings: DataFrame, entities: DataFrame, bands: int = 3, best: bool = False, side: int | None = None) -> DataFrame:
    """Sightings with the entities of their kind and class group and the unrounded similarity; with ``best`` only the closest of each block.

    Appearance decides; shape and class modulate. Every sighting must meet every entity of its
    group (see ``_met``); blocks have about ``side`` rows if it is given. Pairs come in runs: ``RUN`` entities
    for one sighting, and the same for the next.
    """
    sig = _signature(bands)

    def ready(df: DataFrame, key: str) -> DataFrame:
        group = expr.class_group(F.col("cls"))
        return (df.filter(F.col("kind").isNotNull() & group.isNotNull())
                .select(key, F.col("kind").alias("_kind"), group.alias("_g"), F.lower("cls").alias("_cls"), sig, F.coalesce("aspect", F.lit(0.0)).alias("aspect")))

    schema = T.StructType([sightings.schema["sighting_id"], entities.schema["entity_id"], T.StructField("similarity", T.DoubleType())])

    def score(left: pd.DataFrame, right: pd.DataFrame):
        a, b, names = np.stack(left["signature"].to_numpy()), np.stack(right["signature"].to_numpy()), right["_cls"].to_numpy()
        ids, aspects, run = right["entity_id"].to_numpy(), right["aspect"].to_numpy(), len(right) if best else RUN
        strip = max(1, (1 << 17) // min(run, len(right)))
        for lo, at in product(range(0, len(right), run), range(0, len(left), strip)):
            part, some = left.iloc[at:at + strip], slice(lo, lo + run)
            x, y = part["aspect"].to_numpy()[:, None], aspects[None, some]
            both = (x > 0) & (y > 0)
            shape = np.where(both, 0.20 * np.minimum(x, y) / np.where(both, np.maximum(x, y), 1.0), 0.20)
            same = part["_cls"].to_numpy()[:, None] == names[None, some]
            full = _looks(a[at:at + strip], b[some], bands) * (0.80 + shape) * np.where(same, 1.0, 0.85)
            who = part["sighting_id"].to_numpy()
            if best:
                top = full.argmax(axis=1)
                yield pd.DataFrame({"sighting_id": who, "entity_id": ids[top], "similarity": full[np.arange(len(who)), top]})
            else:
                yield pd.DataFrame({"sighting_id": np.repeat(who, full.shape[1]), "entity_id": np.tile(ids[some], len(who)), "similarity": full.ravel()})

    blocks = side and (max(1, -(-sightings.count() // side)), max(1, -(-entities.count() // side)))
    return _met(ready(sightings, "sighting_id"), ready(entities, "entity_id"), ["_kind", "_g"], "sighting_id", "entity_id", score, schema, blocks)


def _looks(a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """Similarity of signatures ``a`` to signatures ``b``, four places, ties up.

    Blocks are summed bin by bin and then weighted, so a tie falls as in one pass over the blocks.
    """
    a_bins, b_bins = np.ascontiguousarray(a.T)[:, :, None], np.ascontiguousarray(b.T)[:, None, :]
    num, den, at = np.zeros((len(a), len(b))), np.zeros((len(a), len(b))), 0
    total, least = np.empty_like(num), np.empty_like(num)
    into = least
    if (a >= 0).all() and (b >= 0).all():   # then their bits are in the same order, and whole numbers compare faster
        a_bins, b_bins, into = a_bins.view(np.int64), b_bins.view(np.int64), least.view(np.int64)
    for _ in range(bands):
        for channel, size in dims.BLOCK_BINS.items():
            total.fill(0.0)
            for j in range(at, at + size):
                np.minimum(a_bins[j], b_bins[j], out=into)
                total += least
            used = (a[:, at:at + size].sum(1) > 0)[:, None] | (b[:, at:at + size].sum(1) > 0)[None, :]
            total *= dims.BLOCK_WEIGHTS[channel]
            num += total
            den += dims.BLOCK_WEIGHTS[channel] * used
            at += size
    steps = np.where(den > 0, num / np.where(den > 0, den, 1.0), 0.0) * 10000.0
    whole = np.floor(steps)
    return (whole + (steps - whole >= 0.5)) / 10000.0


def best_match(sightings: DataFrame, entities: DataFrame, bands: int = 3) -> DataFrame:
    """The closest stored entity of each sighting, the similarity, and the same unrounded (``score``).

    Only entities of the same kind and class group can match (see ``scored_pairs``); each block of
    entities finds its own best and only that is shuffled on.
    """
    scored = scored_pairs(sightings, entities, bands, best=True)
    return (scored.filter(F.col("similarity") > 0).groupBy("sighting_id")
            .agg(F.min_by(F.struct("entity_id", "similarity"), F.struct(-F.col("similarity"), F.col("entity_id"))).alias("m"))
            .select("sighting_id", "m.entity_id", F.round("m.similarity", 4).alias("similarity"), F.col("m.similarity").alias("score")))


def _similarity(a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """Similarity of one signature to many rows, or of rows to rows; mirrors ``expr.signature_similarity``."""
    num, den, at = np.zeros(len(b)), np.zeros(len(b)), 0
    for _ in range(bands):
        for channel, size in dims.BLOCK_BINS.items():
            pa, pb = a[..., at:at + size], b[:, at:at + size]
            used = (pa.sum(-1) > 0) | (pb.sum(1) > 0)
            w = dims.BLOCK_WEIGHTS[channel] * used
            num, den = num + w * np.minimum(pa, pb).sum(1), den + w
            at += size
    return np.where(den > 0, np.round(num / np.where(den > 0, den, 1), 4), 0.0)


def _matched(a: np.ndarray, b: np.ndarray, a_aspect, b_aspect: np.ndarray, same: np.ndarray, bands: int) -> np.ndarray:
    """``_similarity`` with shape and class."""
    both = (b_aspect > 0) & (a_aspect > 0)
    ratio = np.where(both, np.minimum(b_aspect, a_aspect) / np.where(both, np.maximum(b_aspect, a_aspect), 1), 1.0)
    return _similarity(a, b, bands) * (0.80 + 0.20 * ratio) * np.where(same, 1.0, 0.85)


class _Coarse:
    """Signatures in whole numbers of 16 bits, to pass over pairs that cannot be alike.

    Weighted bins are rounded to steps of ``1 / step``, so a sum of minima is off by half a step for each bin at
    most. Where that bound leaves a pair open, or bins are not numbers from 0, the pair stays.
    """

    def __init__(self, bands: int, threshold: float, *signatures: np.ndarray) -> None:
        self.sizes, self.block_weights = list(dims.BLOCK_BINS.values()) * bands, np.array([dims.BLOCK_WEIGHTS[c] for c in dims.BLOCK_BINS] * bands)
        self.weights, self.starts = np.repeat(self.block_weights, self.sizes), np.cumsum([0, *self.sizes[:-1]])
        top = max([float((s * self.weights).sum(1).max()) for s in signatures if len(s)], default=0.0)
        self.sound = all((s >= 0).all() for s in signatures) and 0 < top < 1e12
        self.step = 64000 / top if self.sound else 1.0
        self.least, self.slack = threshold - 0.0002, 0.5 * len(self.weights) + 1

    def bins(self, s: np.ndarray) -> np.ndarray:
        """Bins by rows."""
        return np.ascontiguousarray(np.rint(s * self.weights * self.step).astype(np.uint16).T) if self.sound else np.zeros((len(self.weights), len(s)), np.uint16)

    def empty(self, s: np.ndarray) -> np.ndarray:
        return ~(np.add.reduceat(s, self.starts, axis=1) > 0)

    def open(self, sums: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
        """Which pairs may reach the threshold, by the sums of minima and the blocks either side leaves empty."""
        if not self.sound:
            return np.ones(sums.shape, bool)
        den = self.block_weights.sum()
        if a_empty.any() and b_empty.any():
            den = den - (a_empty * self.block_weights) @ b_empty.T
        return sums >= self.least * den * self.step - self.slack


KEPT = 64   # closest entities of a sighting that its group's task gets to see


def _near(part: DataFrame, reg: DataFrame, threshold: float, bands: int) -> DataFrame:
    """For each sighting (_g, seq) the ``KEPT`` closest of its group's entities that may reach ``threshold``, closest and then oldest first, and how many may."""
    def ready(df: DataFrame, *ids: str) -> DataFrame:
        return df.select("_g", *ids, F.lower(F.coalesce("cls", F.lit(""))).alias("_cls"), _signature(bands), F.coalesce("aspect", F.lit(0.0)).alias("aspect"))

    def score(left: pd.DataFrame, right: pd.DataFrame):
        a, b = np.stack(left["signature"].to_numpy()), np.stack(right["signature"].to_numpy())
        coarse = _Coarse(bands, threshold, a, b)
        x, y, a_empty, b_empty = coarse.bins(a)[:, :, None], coarse.bins(b)[:, None, :], coarse.empty(a), coarse.empty(b)
        names, a_aspect, b_aspect = (left["_cls"].to_numpy(), right["_cls"].to_numpy()), left["aspect"].to_numpy(), right["aspect"].to_numpy()
        strip = max(1, (1 << 17) // len(b))
        for at in range(0, len(a), strip):
            end = min(at + strip, len(a))
            sums, row, least = (np.zeros((end - at, len(b)), np.uint16) for _ in range(3))
            for j in range(len(x) if coarse.sound else 0):
                row[:] = x[j, at:end]
                sums += np.minimum(row, y[j], out=least)
            i, k = np.nonzero(coarse.open(sums, a_empty[at:end], b_empty))
            i += at
            full = _matched(a[i], b[k], a_aspect[i], b_aspect[k], names[0][i] == names[1][k], bands)
            keep = full >= threshold - 0.0001
            i, k, full = i[keep], k[keep], full[keep]
            f = pd.DataFrame({"_g": left["_g"].iloc[0], "seq": left["seq"].to_numpy()[i], "_far": -full, "_fresh": right["_fresh"].to_numpy()[k], "born": right["born"].to_numpy()[k]})
            f = f.sort_values(["seq", "_far", "_fresh", "born"])
            nth = f.groupby("seq").cumcount()
            yield f.assign(_of=np.where(nth == 0, f.groupby("seq")["seq"].transform("size"), 0))[nth < KEPT]

    schema = T.StructType.fromDDL("_g string, seq long, _far double, _fresh int, born long, _of long")
    close = F.slice(F.sort_array(F.collect_list(F.struct("_far", "_fresh", "born"))), 1, KEPT)
    return (_met(ready(part, "seq"), ready(reg, "_fresh", "born"), ["_g"], "seq", "born", score, schema)
            .groupBy("_g", "seq").agg(close.alias("_c"), F.sum("_of").alias("_of"))
            .select("_g", "seq", F.col("_of").alias("many"), F.col("_c._far").alias("far"), F.col("_c._fresh").alias("fresh"), F.col("_c.born").alias("born")))


def resolve_entities(sightings: DataFrame, registry: DataFrame | None = None, threshold: float = 0.62, weight_cap: int = 20,
                     bands: int = 3, chunk: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Match each sighting to a remembered entity or enrol a new one, in time order.

    Matching updates the entity's mean signature, so the outcome depends on order
    and each class group is one sequence by definition. It is worked through in
    chunks of at most ``chunk`` sightings per group. All sightings of a chunk meet the entities there were
    before it at once, over all tasks, and keep the closest (``_near``). What is left is the sequence: one task a group
    takes the chunk's sightings in order, and compares each with the entities this chunk has changed or enrolled, which
    are no more than its sightings. Where all the closest that a sighting kept have changed and it had more,
    the chunk ends before it and goes on in another round. The registry is written to the checkpoint
    folder between chunks. Returns (links, registry). Ties go to the entity enrolled first.
    """
    spark = sightings.sparkSession
    from framelore.operators.slices import running_total
    group = F.concat_ws(":", "kind", expr.class_group(F.col("cls")))
    s = sightings.select("sighting_id", "t", "kind", "cls", "label", "signature", "aspect", group.alias("_g"))
    s = running_total(s, ["_g"], "t", 3600.0, F.lit(1), "_n", ["sighting_id"]).withColumn("_chunk", F.floor((F.col("_n") - 1) / chunk).cast("long"))
    s = materialise(s.withColumn("seq", F.col("_n").cast("long")).drop("_n").withColumn("signature", _signature(bands)), "sightings", ["_chunk"])
    state = "_g string, entity_id string, kind string, cls string, label string, signature array<double>, aspect double, samples int, born long, first_t double, last_t double, _fresh int"
    state_schema = T.StructType.fromDDL(state)
    if registry is None:
        reg = spark.createDataFrame([], state_schema)
    else:   # remembered before any that is enrolled here (_fresh)
        reg = registry.select(group.alias("_g"), "entity_id", "kind", "cls", "label", "signature", "aspect", "samples",
                              F.xxhash64("entity_id").alias("born"), F.lit(None).cast("double").alias("first_t"), F.lit(None).cast("double").alias("last_t"), F.lit(0).alias("_fresh"))
    out_schema = T.StructType.fromDDL("sighting_id long, similarity double, is_new boolean, cut long, " + state)
    ids = ["_g", "_fresh", "born"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, ents = left.sort_values("seq"), right.to_dict("records")
        sigs = np.stack(left["signature"].to_numpy())
        coarse = _Coarse(bands, threshold, sigs, *([np.stack(right["signature"].to_numpy())] if ents else []))
        bins, empty = coarse.bins(sigs), coarse.empty(sigs)
        stored, n = {(e["_fresh"], e["born"]): e for e in ents}, 0
        # The entities changed or enrolled by this chunk: no more than its sightings.
        live, place, size = [], {}, len(left)
        l_sig, l_bins, l_empty, l_asp, l_cls = np.zeros_like(sigs), np.zeros((bins.shape[0], size), np.uint16), np.zeros_like(empty), np.zeros(size), np.empty(size, object)
        links, cut, mine = [], None, left["_g"].iloc[0]
        for i, r in enumerate(left.itertuples()):
            sig, name, found = sigs[i], (r.cls or "").lower(), None
            if r.far is not None:
                found = next(((far, fresh, born) for far, fresh, born in zip(r.far, r.fresh, r.born) if (fresh, born) not in place), None)
                if found is None and r.many > len(r.far):
                    cut = int(r.seq)
                    break
            if n:
                sums = np.minimum(l_bins[:, :n], np.repeat(bins[:, i, None], n, 1)).sum(0, dtype=np.uint16)
                k = np.flatnonzero(coarse.open(sums, empty[i:i + 1], l_empty[:n]))
                if len(k):
                    full = _matched(sig, l_sig[k], r.aspect, l_asp[k], l_cls[k] == name, bands)
                    top = full.max()
                    hit = min((-float(top), live[j]["_fresh"], live[j]["born"]) for j in k[full == top])
                    found = hit if found is None else min(found, hit)
            score = None if found is None else round(-float(found[0]), 4)
            if score is not None and score >= threshold:
                at = place.get(found[1:])
                e = stored[found[1:]] if at is None else live[at]
                m = min(e["samples"], weight_cap)
                new_sig = np.round((np.asarray(e["signature"], dtype=float) * m + sig) / (m + 1), 6)
                e["samples"] += 1
                e["last_t"] = r.t
                links.append((r.sighting_id, e["entity_id"], score, False))
            else:
                at, new_sig = None, sig
                e = {"_g": mine, "entity_id": f"{r.kind[:3]}_{r.sighting_id}", "kind": r.kind, "cls": r.cls, "label": r.label or r.cls,
                     "aspect": float(r.aspect), "samples": 1, "born": int(r.seq), "first_t": r.t, "last_t": r.t, "_fresh": 1}
                links.append((r.sighting_id, e["entity_id"], 1.0, True))
            e["signature"] = new_sig
            if at is None:
                at, n = n, n + 1
                place[(e["_fresh"], e["born"])] = at
                live.append(e)
                l_asp[at], l_cls[at] = e["aspect"], (e["cls"] or "").lower()
            l_sig[at], l_bins[:, at], l_empty[at] = new_sig, coarse.bins(new_sig[None])[:, 0], coarse.empty(new_sig[None])[0]
        whole = {"sighting_id": "Int64", "is_new": "boolean", "cut": "Int64", "samples": "Int32", "born": "Int64", "_fresh": "Int32"}   # before they stand next to nulls
        rows = lambda data, columns=None: pd.DataFrame(data, columns=columns).astype(object).reindex(columns=out_schema.names).astype(whole)
        out = pd.concat([rows(links, ["sighting_id", "entity_id", "similarity", "is_new"]), rows(live), rows([] if cut is None else [(cut, mine)], ["cut", "_g"])], ignore_index=True)
        out["signature"] = pd.Series([x if isinstance(x, np.ndarray) else None for x in out["signature"]], dtype=object)
        return out.astype({c: float for c in ("similarity", "aspect", "first_t", "last_t")})

    links, later = None, None
    last = s.agg(F.max("_chunk")).first()[0]
    c, empty_registry = 0, registry is None
    while last is not None and c <= last:
        part = s.filter(F.col("_chunk") == c).drop("_chunk")
        if later is not None:
            part = part.join(later, "_g").filter(F.col("seq") >= F.col("cut")).drop("cut")
        if empty_registry:
            none = F.lit(None)
            part, close = part.select("*", none.cast("long").alias("many"), none.cast("array<double>").alias("far"), none.cast("array<int>").alias("fresh"), none.cast("array<long>").alias("born")), reg
        else:
            near = materialise(_near(part, reg, threshold, bands), "near")
            part = part.join(near, ["_g", "seq"], "left")
            seen = near.select("_g", F.explode(F.arrays_zip("fresh", "born")).alias("e")).select("_g", F.col("e.fresh").alias("_fresh"), "e.born").distinct()
            close = reg.join(seen, ids, "left_semi").withColumn("signature", _signature(bands))
        res = materialise(part.groupBy("_g").cogroup(close.groupBy("_g")).applyInPandas(run, out_schema), "resolved")
        got = res.filter(F.col("is_new").isNotNull()).select("sighting_id", "entity_id", "similarity", "is_new")
        links = got if links is None else links.unionByName(got)
        changed = res.filter(F.col("born").isNotNull()).select(*state_schema.names)
        reg = materialise(reg.join(changed.select(*ids), ids, "left_anti").unionByName(changed), "registry")
        later, empty_registry = res.filter(F.col("cut").isNotNull()).select("_g", "cut"), False
        if later.isEmpty():
            later, c = None, c + 1
    if links is None:
        links = spark.createDataFrame([], "sighting_id long, entity_id string, similarity double, is_new boolean")
    return links, reg.drop("_g", "born", "_fresh")


def registry_stats(entities: DataFrame, links: DataFrame) -> DataFrame:
    tied = links.select("entity_id").distinct().withColumn("_l", F.lit(True))
    return entities.join(tied, "entity_id", "left").agg(
        F.count("*").alias("total"), F.count_if(F.col("kind") == "vehicle").alias("vehicles"), F.count_if(F.col("kind") == "person").alias("persons"),
        F.count_if(F.col("_l")).alias("with_incidents"))


def list_entities(entities: DataFrame, links: DataFrame, kind: str | None = None, with_incidents_only: bool = False, *, limit: int) -> DataFrame:
    out = entities if kind is None else entities.filter(F.col("kind") == kind)
    if with_incidents_only:
        out = out.join(links.select("entity_id").distinct(), "entity_id", "left_semi")
    return out.orderBy(F.desc("last_seen"), "entity_id").limit(limit)


def linked_entities(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities any event of the job links to. ``events``: event_id, entities (array of struct entity_id, ...)."""
    ids = events.select(F.explode("entities.entity_id").alias("entity_id"))
    return entities.join(ids, "entity_id", "left_semi")


def link_incident(links: DataFrame, events: DataFrame, pairs: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Append (entity_id, event_id, role) pairs with the fields a reviewer needs.

    Pairs of an unknown event are not linked, nor, with ``entities``, those of an unknown entity.
    """
    new = pairs.join(events, "event_id").select(*links.columns)
    if entities is not None:
        new = new.join(entities.select("entity_id"), "entity_id", "left_semi").select(*links.columns)
    return links.unionByName(new)


def add_note(entities: DataFrame, notes: DataFrame) -> DataFrame:
    """Append notes (entity_id, note, note_no) in order; unknown entities are ignored."""
    n = notes.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("note_no", "note"))), lambda x: x["note"]).alias("_n"))
    none = F.array().cast("array<string>")
    return (entities.join(n, "entity_id", "left")
            .withColumn("notes", F.concat(F.coalesce("notes", none), F.coalesce("_n", none))).drop("_n"))


def set_plate(entities: DataFrame, reads: DataFrame) -> DataFrame:
    """The newest plate read per entity (entity_id, plate, plate_confidence, read_no)."""
    r = reads.groupBy("entity_id").agg(F.max_by(F.struct("plate", "plate_confidence"), "read_no").alias("_p"))
    return (entities.join(r, "entity_id", "left").withColumn("plate", F.when(F.col("_p").isNotNull(), F.col("_p.plate")).otherwise(F.col("plate")))
            .withColumn("plate_confidence", F.when(F.col("_p").isNotNull(), F.col("_p.plate_confidence")).otherwise(F.col("plate_confidence"))).drop("_p"))


def forget(table: DataFrame, erased: DataFrame) -> DataFrame:
    """Erase subjects: apply to entities, sightings and links alike."""
    return table.join(erased.select("entity_id"), "entity_id", "left_anti")


def prune(entities: DataFrame, links: DataFrame, cutoff: Column, keep_with_incidents: bool = True) -> DataFrame:
    """Drop entities last seen before ``cutoff``; undated ones stay, and optionally those with incidents."""
    old = F.coalesce(F.col("last_seen") < cutoff, F.lit(False))
    if not keep_with_incidents:
        return entities.filter(~old)
    tied = links.select("entity_id").distinct().withColumn("_l", F.lit(True))
    return entities.join(tied, "entity_id", "left").filter(~old | F.coalesce("_l", F.lit(False))).drop("_l")
