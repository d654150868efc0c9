"""Exact deduplication by progressive refinement, in DataFrame functions only.

Rows are grouped by length, then by length and prefix hash, then by full hash.
Only rows whose (length, prefix) occurs twice get their whole text hashed: the
first pass leaves a bitmap of the surviving groups, of fixed size, which the
second pass looks up. Texts themselves are never shuffled.

Equality is that of the text after lower-casing A-Z only; null counts as empty.
Of equal texts the row with the largest id stays (a null id is smaller than any
other); of rows repeated with that id exactly one stays. Empty texts form one
group like any other. Extra columns named in ``carry`` are handed through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framelore.llm.bitmap import bitmap, slot, with_hit
from framelore.session import materialise

PREFIX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text in lower case for A-Z alone, null as empty; pure ASCII takes the faster built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def survivors(slim: DataFrame) -> DataFrame:
    """The bitmap of each (length, prefix hash) of two rows or more; lengths that occur once go first."""
    groups = slim.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    lengths = groups.groupBy("_len").agg(F.sum("_n").alias("_of")).filter("_of > 1").select("_len")
    return bitmap(groups.join(lengths, "_len", "left_semi").filter("_n > 1").select(slot("_len", "_prefix").alias("_k")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (or each that stays): the id, the columns of ``carry``, ``keep_id``, ``group_size``, ``kept``.

    A carried column of such a name takes its place.
    """
    carry = [c for c in carry or [] if c != id_col]
    text = folded(F.col(text_col))
    base = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_c_{c}") for c in carry],
                       F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_len"),
                       F.xxhash64(folded(F.substring(F.col(text_col), 1, PREFIX))).alias("_prefix"),
                       text.alias("_text"))
    looked = with_hit(base, survivors(base.select("_len", "_prefix")), slot("_len", "_prefix"))
    written = materialise(looked.select("_id", *[f"_c_{c}" for c in carry], "_len", "_prefix",
                                        F.when(F.col("_hit"), F.sha2(F.col("_text").cast("binary"), 256)).alias("_full"),
                                        F.monotonically_increasing_id().alias("_row")), "exactdup")
    again = written.filter("_full is not null")
    # Written, so that the join below reads two plain exchanges and adaptive execution can split a hot group.
    groups = materialise(again.groupBy("_len", "_full").agg(F.max(F.struct("_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("_size")), "exactdup-groups")
    joined = again.join(groups, ["_len", "_full"])
    out = [f"_c_{c}" for c in carry]
    found = joined.select("_id", *out, F.col("_best._id").alias("keep_id"), F.col("_size").alias("group_size"),
                          (F.col("_best._row") == F.col("_row")).alias("kept"))
    alone = written.filter("_full is null").select("_id", *out, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                   F.lit(True).alias("kept"))
    every = alone.unionByName(found)
    if only_kept:
        every = every.filter("kept")
    names = [c for c in ("keep_id", "group_size", "kept") if c not in carry]
    return every.select(F.col("_id").alias(id_col), *[F.col(f"_c_{c}").alias(c) for c in carry], *names)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = docs.withColumn("text_sha256", F.sha2(folded(F.col("text")).cast("binary"), 256))
    return exact_dedup(digest, carry=["text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""
