"""BPE encoding and decoding with a pair occurrence index.

The distinct words of an Arrow batch are laid out in one symbol array. An index
maps each merge rank to the positions of its pair; ranks are applied in
ascending order, and every merge adds the pairs it creates to their lists. Words
seen before come from a bounded memo, so the index only holds new words.

Defined cases: null and empty texts have no tokens and decode to the empty
string; texts are never cut; repeated rows give repeated results; every other
column is handed through unless it has the name of a result column, which is
replaced.
"""
from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

# Entries of the word and chunk memos before they are emptied (memory only; results do not depend on it).
MEMO = 200_000
# White space of the Unicode standard; str.split() also cuts at U+001C..U+001F.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else U+0100 onwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BpeModel:
    """A word-end BPE model read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.pieces = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for piece, i in [*vocab.items(), *added.items()]:
            self.pieces[i] = piece
        table = byte_symbols()
        self.inner = np.array([vocab[c] for c in table])
        self.final = np.array([vocab[c + self.end] for c in table])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.made = [vocab[a + b] for a, b in pairs]
        keys = np.array(self.left, np.int64) << 20 | np.array(self.right, np.int64)
        self.keys, self.key_rank = np.unique(keys, return_index=True)
        self.added = {" " + c: np.array([i], "<u4").tobytes() for c, i in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = dict(self.added)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (little-endian unsigned 32-bit), through the pair occurrence index."""
        raw = b"\xff".join(w.encode("utf-8", "surrogatepass") for w in ["", *words, ""])
        flat = np.frombuffer(raw, np.uint8)
        sym = np.where(flat == 255, -1, np.where(np.append(flat[1:], 255) == 255, self.final[flat], self.inner[flat]))
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        where: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(at: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
            """Adds each pair that has a rank to the positions of that rank."""
            ranks = self.rank_of(first, second)
            found = ranks >= 0
            at, ranks = at[found], ranks[found]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            starts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for r, s, e in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)]):
                if r not in where:
                    where[r] = []
                    heapq.heappush(heap, r)
                where[r].append(at[s:e])

        index(np.arange(n - 1), sym[:-1], sym[1:])
        while heap:
            r = heapq.heappop(heap)
            a, b, new = self.left[r], self.right[r], self.made[r]
            lists = where.pop(r)
            i = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            i = i[sym[i] == a]
            j = nxt[i]
            valid = sym[j] == b
            if a == b:  # of overlapping pairs the left one counts, then every second one
                taken = -1
                for x, (here, there) in enumerate(zip(i.tolist(), j.tolist())):
                    valid[x] &= here != taken
                    taken = there if valid[x] else -1
            i, j = i[valid], j[valid]
            k = nxt[j]
            sym[i], sym[j] = new, -2
            nxt[i], prv[k] = k, i
            p = prv[i]
            index(np.concatenate([p, i]), np.concatenate([sym[p], sym[i]]), np.concatenate([sym[i], sym[k]]))
        left = sym[sym != -2]
        ends = (4 * np.flatnonzero(left == -1)).tolist()
        buf = left.astype("<i4").tobytes()
        return [buf[s + 4:e] for s, e in zip(ends, ends[1:])]

    def rank_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        keys = np.where((first >= 0) & (second >= 0), first << 20 | second, -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.key_rank[at], -1)

    def split(self, text: str) -> list[str]:
        """Chunks between white space, normalised; special tokens keep a leading space as their mark."""
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)) if self.special else [(0, text)]:
            if k % 2:
                out.append(" " + part)
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = SPACE.sub(" ", part) if ODD.search(part) else part
                part = part.replace("Σ", "σ").lower()
                out += [c for c in part.split(" ") if c] if ODD.search(part) else part.split()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.chunks) > MEMO or len(self.words) > MEMO:
            self.chunks, self.words = dict(self.added), {}
        split = [self.split(t) if t else [] for t in texts]
        known = self.chunks.get
        rows = [list(map(known, s)) for s in split]
        gaps = [[k for k, g in enumerate(row) if g is None] if None in row else () for row in rows]
        counts = Counter(s[k] for s, gap in zip(split, gaps) for k in gap)
        parts = {}
        for c in counts:
            if c.isalpha():
                parts[c] = (c,)
            elif c[-1] in ".,;:!?" and c[:-1].isalpha():
                parts[c] = (c[:-1], c[-1])
            else:
                parts[c] = self.pattern.findall(c)
        words = list(set().union(*parts.values()).difference(self.words))
        fresh = dict(zip(words, self.merge_words(words)))
        made = {c: b"".join([fresh[w] if w in fresh else self.words[w] for w in ws]) for c, ws in parts.items()}
        for c, n in counts.items():
            if n > 1:  # most words of one occurrence never come again
                self.chunks[c] = made[c]
                self.words.update((w, fresh[w]) for w in parts[c] if w in fresh)
        for s, row, gap in zip(split, rows, gaps):
            for k in gap:
                row[k] = made[s[k]]
        return list(map(b"".join, rows))

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids with one space between; the model file names no decoder."""
        return " ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MODELS: dict[str, BpeModel] = {}


def model(path: str) -> BpeModel:
    """One model for each file and Python worker."""
    if path not in _MODELS:
        _MODELS[path] = BpeModel(path)
        gc.disable()  # the memos hold millions of acyclic objects that each collection would walk
    return _MODELS[path]


def blocks(batch: pa.RecordBatch, column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``budget`` bytes, so that long texts do not pile up."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(sizes) // budget
    starts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
    for s, e in zip(starts, starts[1:]):
        if e > s:
            yield batch.slice(s, e - s)


def with_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    """The batch with columns added, or replaced at their place."""
    names = batch.schema.names
    columns = dict(zip(names, batch.columns)) | new
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def schema_with(df: DataFrame, **new: T.DataType) -> T.StructType:
    kept = [T.StructField(f.name, new.pop(f.name, f.dataType)) for f in df.schema]
    return T.StructType(kept + [T.StructField(n, t) for n, t in new.items()])


def bpe_encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep_text: bool = False, decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``; the text is dropped unless asked for.

    With ``decoded``, also what the ids decode to, in the same pass: one Python worker a task then holds the model.
    """
    kept = docs if keep_text else docs.drop(text)
    more = {decoded: T.StringType()} if decoded else {}
    schema = schema_with(kept, **{ids: T.BinaryType(), "n_tokens": T.LongType()}, **more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for batch in blocks(whole, text):
                got = m.encode(batch.column(text).to_pylist())
                back = {decoded: pa.array([m.decode(g) for g in got], pa.string())} if decoded else {}
                done = with_columns(batch, **{ids: pa.array(got, pa.binary()), "n_tokens": pa.array([len(g) // 4 for g in got], pa.int64())}, **back)
                yield done.select([f.name for f in schema])

    return docs.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``, the text that the ids stand for; null ids decode to the empty string."""
    schema = schema_with(encoded, **{decoded: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for batch in blocks(whole, ids):
                got = [m.decode(b or b"") for b in batch.column(ids).to_pylist()]
                yield with_columns(batch, **{decoded: pa.array(got, pa.string())}).select([f.name for f in schema])

    return encoded.mapInArrow(run, schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = bpe_encode(docs, path, decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
