"""Ranked lexical search over a length-stratified index.

The index is made of shards, runs of documents of bounded size that one task reads.
Inside a shard the documents are grouped by their normaliser m, a whole number that grows
with the length; a term's postings are listed by stratum and, inside it, by how often the
term occurs. A posting's impact depends on (m, tf) alone, so it is computed once for each of
these runs, and the last run of a stratum bounds what the term can add there.

A query adds up the bounds of its terms for each stratum, visits the strata from the highest
bound down and stops at the first that cannot reach the worst of the best documents known; a
task carries them from shard to shard. Queries are given to the tasks in blocks of bounded
size; each task answers with at most ``k`` rows a query, and the best of these are ranked.

All arithmetic but the logarithm is in whole numbers. Equal scores are ranked by id.

Defined cases: null texts, and texts without a term, are in no stratum and are not counted;
items without a term known to the index have no rows; repeated documents are ranked each by
itself; items repeated with the same id and text are asked once, other texts of one id each by
itself; a null id comes last among equal scores. Extra columns are dropped. Very long texts are
counted in stretches. The id 2**63 - 1 is reserved.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from framelore.llm.bpe import blocks
from framelore.session import materialise

#: Bytes that belong to terms, A-Z as a-z; all others part them.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
STRETCH = 1 << 20
SHARD_BYTES, SHARD_DOCS = 8 << 20, 1 << 14
BLOCK = 200_000  # (item, term) entries that a pass takes
NONE = np.iinfo(np.int64).max


def term_counts(text: bytes | None) -> Counter:
    """How often each term occurs in a UTF-8 text."""
    clean = (text or b"").translate(TERM)
    if len(clean) <= STRETCH:
        return Counter(clean.split())
    counts, at = Counter(), 0
    while at < len(clean):
        end = clean.find(b" ", at + STRETCH)
        end = len(clean) if end < 0 else end
        counts.update(clean[at:end].split())
        at = end
    return counts


def raw_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, their terms)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for whole in batches:
            for batch in blocks(whole, "text"):
                for text in batch.column("text").to_pylist():
                    m = len(text.translate(TERM).split()) if text and len(text) <= STRETCH else term_counts(text).total()
                    n, total = n + (m > 0), total + m
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])

    found = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return int(found[0] or 0), int(found[1] or 0)


INDEX = "shard long, term binary, ms array<long>, tfs array<int>, counts array<int>, docs array<long>"
ARROW = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("ms", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("docs", pa.list_(pa.int64()))])


def lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def shard_of(number: int, ids: list[int | None], counts: list[Counter], ms: list[int]) -> pa.RecordBatch:
    """A shard's rows. The one of the empty term lists the strata and their documents; a document's number is its place there."""
    keys = np.array([NONE if i is None else i for i in ids], np.int64)
    m = np.array(ms, np.int64)
    by_stratum = np.lexsort((keys, m))
    place = np.empty(len(keys), np.int64)
    place[by_stratum] = np.arange(len(keys))
    strata, sizes = np.unique(m, return_counts=True)
    known: dict[bytes, int] = {}
    term = np.fromiter((known.setdefault(t, len(known)) for c in counts for t in c), np.int64)
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64)
    each = [len(c) for c in counts]
    doc, stratum = np.repeat(place, each), np.repeat(m, each)
    order = np.lexsort((doc, tf, stratum, term))
    term, stratum, tf, doc = term[order], stratum[order], tf[order], doc[order]
    new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(stratum, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))
    first = np.flatnonzero(np.diff(term, prepend=-1))
    run_first = np.searchsorted(new, first)
    names = [b"", *known]  # numbered as they came, so sorted
    directory = len(strata)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(names), number)), pa.array(names, pa.binary()),
        lists(np.concatenate([strata, stratum[new]]), np.concatenate([[0], run_first + directory]), pa.int64()),
        lists(np.concatenate([np.zeros(directory, np.int64), tf[new]]), np.concatenate([[0], run_first + directory]), pa.int32()),
        lists(np.concatenate([sizes, np.diff(np.append(new, len(term)))]), np.concatenate([[0], run_first + directory]), pa.int32()),
        lists(np.concatenate([keys[by_stratum], doc]), np.concatenate([[0], first + len(keys)]), pa.int64())], schema=ARROW)


@dataclass
class Index:
    """The postings of a corpus, its documents with a term and its terms."""
    postings: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: int = 75, slope: int = 25) -> Index:
    """m = base + (slope * n * documents) div terms for a document of n terms."""
    n_docs, n_terms = corpus_size(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        ids, counts, ms, size = [], [], [], 0
        for whole in batches:
            for batch in blocks(whole, "text"):
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    found = term_counts(text)
                    if not found:
                        continue
                    ids.append(i)
                    counts.append(found)
                    ms.append(base + slope * found.total() * n_docs // n_terms)
                    size += len(text)
                    if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                        yield shard_of(task + made, ids, counts, ms)
                        made, ids, counts, ms, size = made + 1, [], [], [], 0
        if ids:
            yield shard_of(task + made, ids, counts, ms)

    return Index(materialise(raw_texts(docs, id_col, text_col).mapInArrow(run, INDEX), "postings"), n_docs, n_terms)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(q, item, term, times): the terms of each distinct item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                rows = [(q, i, t, n) for q, i, text in zip(*(batch.column(c).to_pylist() for c in ("q", "id", "text"))) for t, n in term_counts(text).items()]
                q, i, t, n = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(t, pa.binary()), pa.array(n, pa.int64())], names=["q", "item", "term", "times"])

    asked = materialise(raw_texts(items, id_col, text_col).distinct().withColumn("q", F.monotonically_increasing_id()), "items")
    return asked.mapInArrow(run, "q long, item long, term binary, times long")


class Best:
    """The best ``k`` (score, id) of each query so far."""

    def __init__(self, k: int, queries: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries

    def least(self, q: int) -> int:
        """The score that a document must reach."""
        return int(self.scores[q][-1]) if len(self.scores[q]) >= self.k else 1

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least(q)
        if good.any():
            scores, ids = np.concatenate([self.scores[q], scores[good]]), np.concatenate([self.ids[q], ids[good]])
            order = np.lexsort((ids, -scores))[:self.k]
            self.scores[q], self.ids[q] = scores[order], ids[order]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one after another."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def visit(rows: list[tuple], queries: list[tuple[np.ndarray, np.ndarray]], vocabulary: dict[bytes, int], best: Best, scale: int, per_tf: int, per_m: int) -> None:
    """Answers all queries, given as (terms, weights), from the rows of one shard."""
    directory = next(r for r in rows if r[0] == b"")
    strata, sizes, ids = directory[1], directory[3], directory[4]
    rows = [r for r in rows if r[0] in vocabulary]
    if not rows:
        return
    m, tf, count = (np.concatenate([r[k] for r in rows]).astype(np.int64) for k in (1, 2, 3))
    docs = np.concatenate([r[4] for r in rows])
    impact = scale * tf // (per_tf * tf + per_m * m)
    runs = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
    term = np.repeat(np.arange(len(rows)), np.diff(runs))
    # The runs of a term's stratum follow each other, the highest tf last.
    edge = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(m, prepend=-1) != 0))
    last = np.append(edge[1:], len(m)) - 1
    stop = np.cumsum(count)
    bound, where, begin, end = impact[last], np.searchsorted(strata, m[edge]), (stop - count)[edge], stop[last]
    posting = np.repeat(impact, count)
    cells = np.searchsorted(term[edge], np.arange(len(rows) + 1))
    place = np.full(len(vocabulary), -1)
    place[[vocabulary[r[0]] for r in rows]] = np.arange(len(rows))
    for q, (terms, weights) in enumerate(queries):
        at = place[terms]
        weights, at = weights[at >= 0], at[at >= 0]
        if not len(at):
            continue
        cell = ranges(cells[at], cells[at + 1])
        weight = np.repeat(weights, cells[at + 1] - cells[at])
        most = np.zeros(len(strata), np.int64)
        np.add.at(most, where[cell], weight * bound[cell])
        order = np.argsort(-most, kind="stable")
        order = order[most[order] >= best.least(q)]
        score = np.zeros(len(ids), np.int64)
        batch = 4 * best.k
        while len(order):
            n = int(np.searchsorted(np.cumsum(sizes[order]), batch)) + 1
            chosen = np.zeros(len(strata), bool)
            chosen[order[:n]] = True
            now = chosen[where[cell]]
            some, w = cell[now], weight[now]
            hit = ranges(begin[some], end[some])
            np.add.at(score, docs[hit], np.repeat(w, end[some] - begin[some]) * posting[hit])
            found = np.unique(docs[hit])
            best.offer(q, score[found], ids[found])
            order = order[n:]
            order = order[most[order] >= best.least(q)]
            batch *= 4


FOUND = "q long, item long, id long, score long"


def search(index: Index, items: DataFrame, k: int, id_col: str = "item_id", text_col: str = "text", scale: int = 1_000_000_000, per_tf: int = 1000, per_m: int = 12) -> DataFrame:
    """(item, rank, id, score) of the ``k`` best documents of each item.

    A term of weight w adds w * ((scale * tf) div (per_tf * tf + per_m * m)); w = floor(1000 ln((2 N + 2) / (2 df + 1))).
    """
    spark = items.sparkSession
    asked = materialise(item_terms(items, id_col, text_col), "asked")
    wanted = materialise(asked.select("term").distinct(), "vocabulary")
    hits = materialise(index.postings.join(wanted, "term", "left_semi").unionByName(index.postings.filter(F.octet_length("term") == 0)), "hits")
    often = hits.filter(F.octet_length("term") > 0).groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = materialise(asked.join(often, "term").select("q", "item", "term", (F.col("times") * weight).alias("weight")).filter("weight > 0"), "weighed")
    n = -(-weighed.count() // BLOCK)
    found = None
    for b in range(n):
        rows = weighed.filter(F.pmod(F.xxhash64("q"), F.lit(n)) == b).collect()  # about BLOCK rows; a pass over the postings each
        vocabulary = {t: j for j, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        by_item: dict[tuple, list] = {}
        for r in rows:
            by_item.setdefault((r["q"], r["item"]), []).append((vocabulary[bytes(r["term"])], r["weight"]))
        names = sorted(by_item, key=lambda x: x[0])
        queries = [tuple(np.array(c, np.int64) for c in zip(*sorted(by_item[x]))) for x in names]
        shared = spark.sparkContext.broadcast((names, queries, vocabulary))
        part = hits.repartition("shard").sortWithinPartitions("shard").mapInArrow(answering(shared, k, scale, per_tf, per_m), FOUND)
        part = materialise(part, "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "id", "score")


def answering(shared, k: int, scale: int, per_tf: int, per_m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, vocabulary = shared.value
        best, held, shard = Best(k, len(queries)), [], None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            for s in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(numbers)) + 1):
                if shard is not None and len(s) and numbers[s[0]] != shard:
                    visit(held, queries, vocabulary, best, scale, per_tf, per_m)
                    held = []
                if len(s):
                    shard = numbers[s[0]]
                    piece = batch.slice(int(s[0]), len(s))
                    columns = [[x.values.to_numpy() for x in piece.column(c)] for c in ("ms", "tfs", "counts", "docs")]
                    held += list(zip(piece.column("term").to_pylist(), *columns))
        if held:
            visit(held, queries, vocabulary, best, scale, per_tf, per_m)
        each = [len(s) for s in best.scores]
        q, item = zip(*names)
        ids = np.concatenate(best.ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(q, np.int64), each)), pa.array(item, pa.int64()).take(pa.array(np.repeat(np.arange(len(item)), each))),
                                          pa.array(ids, pa.int64(), mask=ids == NONE), pa.array(np.concatenate(best.scores))], names=["q", "item", "id", "score"])

    return run


def op12_lexical_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY ALL),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lens),
ms AS (SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM lens, corpus),
dfs AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tfs, corpus GROUP BY term, n_docs),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
times AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM times JOIN dfs USING (term) JOIN tfs USING (term) JOIN ms USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""
