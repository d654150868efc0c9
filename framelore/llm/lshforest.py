"""Near-duplicate detection with MinHash and an LSH forest.

A document's set holds its distinct shingles of ``width`` words. Documents of equal
sets form one class. Each class has a signature of 128 MinHash values; a tree of the
forest orders the classes by a cyclic run of these values, so its regions are the
classes with a common prefix. Depth adapts to the region: it starts at
``BASE`` values, and a region that still holds several components and more than
``CROWD`` classes is cut again by longer prefixes.

Links are confirmed on the full sets. A first round tests every class against the
first of its region in one tree; that joins up most of a group with one test for each member.
In the next trees, and then in all others, only what lies in another component is tested. Components
are kept between rounds, and new links join their names. The later rounds test the pairs of a region that lie in
different components, so no group is ever expanded into all its pairs. In a crowded
region of full depth the test is against its first and last class of another component. With 32 trees of
4 values, a pair of similarity 0.8 has no common region with a chance of 5e-8.

What the crowded regions leave is found exactly, by a prefix-filter join of all their
classes: shingles are put in one order, rare ones first, and two sets of the wanted
similarity share one of the first ``n - least common + 1``. Rarity is counted in a table of
``SLOTS`` slots; shingles that share a slot only make the order less sharp. Sizes and
positions rule out most pairs in the join; the rest are confirmed on the full sets.

Defined cases: null and empty texts, and texts of white space alone, have an empty
set and are linked with nothing; fewer words than ``width`` make one shingle; equal
texts are linked; repeated rows get equal results; a null id is never a
component's name unless it is alone. Extra columns are dropped.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from framelore.llm.bitmap import keep_matching
from framelore.llm.bpe import blocks
from framelore.session import materialise

VALUES, BASE = 128, 4
TREES = VALUES // BASE
DEPTHS = (8, 16, 32)
CROWD = 16
SLOTS = 1 << 20
HOT = 1000
FIRST = (1, 4)  # trees whose regions are joined up before those after them are looked at

ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)
SPIN = _rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


class Powers:
    """Powers of ODD and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, ODD)]))
            self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]))


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word: A-Z in lower case, cut at ASCII white space; by differences of a running polynomial."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    blank = BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, ends = edge[::2], edge[1::2]
    POWERS.reach(len(raw) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[raw] * POWERS.up[:len(raw)], dtype=np.uint64)])
    return mixed((total[ends] - total[starts]) * POWERS.down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    width = min(width, len(words))
    made = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        made = made * np.uint64(0xBF58476D1CE4E5B9) + words[k:len(words) - width + 1 + k]
    return np.unique(mixed(made + np.uint64(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES MinHash values."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(low), 2048):
        np.minimum(least, ((low[s:s + 2048, None] ^ FLIP) * SPIN).min(axis=0), out=least)
    return least


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a set."""
    a = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = (mixed(shingles + np.uint64(0x14057B7EF767814F)) * np.uint64(0xD1342543DE82EF95)).sum(dtype=np.uint64)
    return np.array([a, b], "<u8").tobytes()


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()),
                       T.StructField("sig", T.BinaryType())])
SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("shingles", T.BinaryType())])


def sign(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").cast(pa.int64()), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).astype("<u4").tobytes() if len(s) else None for s in sets], pa.binary())], names=SIGNED.names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, SIGNED)


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()),
                                                  pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=SETS.names)

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


TESTED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("common", T.LongType()), T.StructField("n_all", T.LongType())])


def count_common(pairs: DataFrame) -> DataFrame:
    """(a, b, common, n_all) of rows (a, b, sa, sb) with two sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "sa"):
                common, every = [], []
                for x, y in zip(batch.column("sa"), batch.column("sb")):
                    x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    common.append(shared)
                    every.append(len(both) - shared)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(every, pa.int64())], names=TESTED.names)

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, TESTED)


def count_slots(sets: DataFrame) -> np.ndarray:
    """How many of the sets' shingles fall into each of SLOTS slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column("shingles"):
                np.add.at(seen, np.frombuffer(x.as_buffer(), "<u8") % np.uint64(SLOTS), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["slot", "n"])

    found = sets.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(SLOTS, np.int64)
    table[found["slot"].to_numpy()] = found["n"].to_numpy()
    return table


HEADS = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingle", T.LongType()),
                      T.StructField("rest", T.LongType())])


def heads(sets: DataFrame, percent: int) -> DataFrame:
    """(id, label, n, shingle, rest) of the rarest shingles of each set; ``rest`` counts the set's shingles from there on."""
    often = count_slots(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "shingles"):
                rare, sizes = [], []
                for x in batch.column("shingles"):
                    x = np.frombuffer(x.as_buffer(), "<u8")
                    rare.append(x[np.lexsort((x, often[x % np.uint64(SLOTS)]))[:len(x) - -(-percent * len(x) // 100) + 1]])
                    sizes.append(len(x))
                each = [len(x) for x in rare]
                rest = [n - np.arange(m) for n, m in zip(sizes, each)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(batch.column("id").to_numpy(), each), pa.int64()), pa.array(np.repeat(batch.column("label").to_numpy(), each), pa.int64()),
                    pa.array(np.repeat(sizes, each), pa.int64()), pa.array(np.concatenate([*rare, np.zeros(0, "<u8")]).astype("<u8").view("<i8"), pa.int64()),
                    pa.array(np.concatenate([*rest, np.zeros(0, np.int64)]), pa.int64())], names=HEADS.names)

    return sets.select("id", "label", "shingles").mapInArrow(run, HEADS)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each end of a link reaches.

    Every node points at its smallest neighbour below it, pointers jump to their ends, and links are
    drawn again between these ends until none is left. Two rounds at least halve the nodes that have links.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = materialise(links.select(*ends).distinct(), "links")
    labels = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node"))
    edges = edges.filter("a <> b")
    while not edges.isEmpty():
        roots = materialise(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "roots")
        while True:
            jump = roots.select(F.col("node").alias("label"), F.col("label").alias("m"))
            roots = materialise(roots.select("node", "label").join(jump, "label", "left").select("node", F.coalesce("m", "label").alias("label"), F.col("m").isNotNull().alias("moved")), "roots")
            if roots.filter("moved").isEmpty():
                break
        labels = materialise(renamed(labels, roots), "labels")
        of = lambda end: roots.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
        drawn = edges.join(of("b"), "b").join(of("a"), "a", "left").select(F.coalesce("la", "a").alias("a"), F.col("lb").alias("b")).filter("a <> b")
        edges = materialise(drawn.select(*ends).distinct(), "links")
    return labels


def renamed(labels: DataFrame, names: DataFrame) -> DataFrame:
    """``labels`` with those that are a node of ``names`` replaced by its label."""
    new = names.select(F.col("node").alias("label"), F.col("label").alias("m"))
    return labels.join(new, "label", "left").select("node", F.coalesce("m", "label").alias("label"))


def joined_up(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links (la, lb) between components: only the names of what they join are looked at again."""
    found = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    alone = found.join(labels.select("node"), "node", "left_anti")  # had no link before
    return materialise(renamed(labels, found).unionByName(alone), "labels")


class Forest:
    """The classes of one corpus and what is known of their links."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.rows = materialise(sign(docs, width).withColumn("row", F.monotonically_increasing_id()), "signed")
        full = self.rows.filter("n > 0")
        # ``doc`` comes first in the order of ids, nulls last.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row"))
        self.classes = materialise(full.groupBy("fp").agg(first.alias("f"), F.first("n").alias("n"), F.first("sig").alias("sig"))
                                   .select(F.col("f.row").alias("id"), F.col("f.doc_id").alias("doc_id"), "fp", "n", "sig"), "classes")
        self.links = None
        self.tested = None
        self.labels = None

    def prefix(self, depth: int):
        return F.xxhash64(F.substring(F.concat("sig", "sig"), F.col("tree") * (4 * BASE) + 1, F.lit(4 * depth)))

    def members(self) -> DataFrame:
        """(tree, key, id, n) of the regions of BASE depth that hold two classes or more, the first class of each, and the longer prefixes."""
        trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
        rows = materialise(self.classes.select("id", "n", "sig", trees.alias("tree")).select("tree", self.prefix(BASE).alias("key"), "id", F.col("n").cast("int").alias("n")), "trees")
        regions = materialise(rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "n")).alias("rep")).filter("size > 1"), "regions")
        found = rows.join(regions.select("tree", "key", "rep"), ["tree", "key"]).join(self.classes.select("id", "sig"), "id")
        return materialise(found.select("tree", "key", "id", "n", "rep", *[self.prefix(d).alias(f"key{d}") for d in DEPTHS]), "members")

    def fits(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a < b) whose set sizes allow the similarity."""
        return pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent).select("a", "b").distinct()

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, shingles); texts are read only for the classes in question."""
        wanted = materialise(self.classes.select("id", "doc_id", "fp").join(ids, "id", "left_semi"), "wanted")
        texts = keep_matching(self.docs.select("doc_id", "text"), wanted.select("doc_id").distinct(), "doc_id")
        found = sets_of(texts, self.width).select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), "shingles")
        return materialise(found.join(wanted, (F.col("f") == F.col("fp")) & F.col("d").eqNullSafe(F.col("doc_id"))).select("id", "shingles").dropDuplicates(["id"]), "sets")

    def test(self, pairs: DataFrame) -> None:
        """Confirms pairs on the full sets."""
        pairs = materialise(pairs, "pairs")
        sets = self.sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        joined = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
                  .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"))
        links = materialise(count_common(joined).filter(F.col("common") * 100 >= F.col("n_all") * self.percent).select("a", "b", "common", "n_all"), "links")
        self.links = links if self.links is None else self.links.unionByName(links)
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        self.labels = components(links) if self.labels is None else joined_up(self.labels, self.between(links))

    def labelled(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))

    def between(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) whose ends lie in different components, and these components (la, lb)."""
        of = lambda end: self.labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
        met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("la", F.coalesce("la", "a")).withColumn("lb", F.coalesce("lb", "b"))
        return met.filter("la <> lb")

    def open_pairs(self, members: DataFrame) -> DataFrame:
        """Pairs of a region in different components, by longer prefixes where a region is crowded."""
        rows = self.labelled(members.drop("rep"))
        found = None
        for depth in (*DEPTHS, None):
            regions = (rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1"))
                       .filter("l0 <> l1"))
            rows = materialise(rows.join(regions.select("tree", "key", "size"), ["tree", "key"]), "open")
            small = rows.filter(F.col("size") <= CROWD)
            left = small.select("tree", "key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
            right = small.select("tree", "key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
            pairs = left.join(right, ["tree", "key"]).filter("a < b and la <> lb").select("a", "b", "na", "nb")
            rows = rows.filter(F.col("size") > CROWD).drop("size")
            if depth is None:
                ends = rows.groupBy("tree", "key").agg(F.min(F.struct("label", "id", "n")).alias("lo"), F.max(F.struct("label", "id", "n")).alias("hi"))
                met = rows.join(materialise(ends, "ends"), ["tree", "key"])
                for end in ("lo", "hi"):
                    star = met.filter(F.col("label") != F.col(f"{end}.label"))
                    pairs = pairs.unionByName(star.select(F.least("id", F.col(f"{end}.id")).alias("a"), F.greatest("id", F.col(f"{end}.id")).alias("b"),
                                                          F.col("n").alias("na"), F.col(f"{end}.n").alias("nb")))
            found = pairs if found is None else found.unionByName(pairs)
            if depth is not None:
                rows = rows.withColumn("key", F.col(f"key{depth}")).drop(f"key{depth}")
        return self.fits(found)

    def crowded_pairs(self, members: DataFrame) -> DataFrame | None:
        """All pairs of different components that lie in crowded regions and may have the similarity, by their rarest shingles."""
        rows = self.labelled(members.select("tree", "key", "id"))
        regions = rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter((F.col("size") > CROWD) & (F.col("l0") != F.col("l1")))
        crowd = materialise(rows.join(regions.select("tree", "key"), ["tree", "key"], "left_semi").select("id", "label").distinct(), "crowd")
        if crowd.isEmpty():
            return None
        first = materialise(heads(self.sets(crowd.select("id")).join(crowd, "id"), self.percent), "heads")
        # A shingle's rows of its largest component meet only the rows of others.
        per = first.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c"))
        per = (per.groupBy("shingle").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
               .select("shingle", F.col("top.label").alias("main"), F.ceil(F.col("all") / HOT).cast("long").alias("salts")))
        shared = materialise(first.join(per, "shingle"), "shared")
        left = shared.filter("label <> main").select("shingle", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), F.col("id").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("rest").alias("rx"))
        right = shared.select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("id").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("rest").alias("ry"), (F.col("label") == F.col("main")).alias("top"))
        # common / (nx + ny - common) >= percent / 100, with at most ``rest`` common shingles
        may = F.least("rx", "ry") * (100 + self.percent) >= (F.col("nx") + F.col("ny")) * self.percent
        met = left.join(right, (left["shingle"] == right["shingle"]) & (left["salt"] == right["salt"]) & (F.col("lx") != F.col("ly")) & (F.col("top") | (F.col("x") < F.col("y"))) & may)
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def grow(self) -> "Forest":
        members = self.members()
        stars = members.filter("id <> rep.id").select("tree", F.col("rep.id").alias("a"), F.col("id").alias("b"), F.col("rep.n").alias("na"), F.col("n").alias("nb"))
        self.test(self.fits(stars.filter(F.col("tree") < FIRST[0])))
        # A group is nearly joined up by now; its members meet the first of their other regions only if that lies in another component.
        for low, high in zip(FIRST, [*FIRST[1:], TREES]):
            self.test(self.fits(self.between(stars.filter((F.col("tree") >= low) & (F.col("tree") < high)))))
        while True:
            pairs = materialise(self.open_pairs(members).join(self.tested, ["a", "b"], "left_anti"), "more")
            if pairs.isEmpty():
                break
            self.test(pairs)
        pairs = self.crowded_pairs(members)
        if pairs is not None:
            pairs = materialise(pairs.join(self.tested, ["a", "b"], "left_anti"), "more")
            if not pairs.isEmpty():
                self.test(pairs)
        return self


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of (doc_id, text): doc_id, n_shingles, component_id, kept, stays, mark.

    ``kept`` says that the id names its component; ``stays`` holds for exactly one row
    of a component, even if ids repeat; ``mark`` is xxhash64 of the text.
    """
    forest = Forest(docs, width, percent).grow()
    named = forest.labelled(forest.classes.select("id", "doc_id", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "id"))
    names = materialise(named.groupBy("label").agg(first.alias("f")).select("label", F.col("f.doc_id").alias("component_id"), F.col("f.id").alias("first")), "names")
    classes = materialise(named.join(names, "label").select("fp", "component_id", "first"), "named")
    full = forest.rows.filter("n > 0").join(classes, "fp").select("doc_id", "mark", "n", "component_id", (F.col("row") == F.col("first")).alias("stays"))
    empty = forest.rows.filter("n = 0").select("doc_id", "mark", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return full.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "stays", "mark")


def op9_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


