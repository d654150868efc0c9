"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised by approximate quantiles of the whole table, the
cells get their index on the Hilbert curve, rows are sorted by (index, text
checksum, id) and the order is cut into runs of equal row counts, so that a shard
covers a compact region of every dimension and min/max statistics prune it.

Law ``rows``: shard sizes in rows differ by one at most. Null dimension values
take the lowest cell; null text has no bytes; rows that agree in everything are
interchangeable; an empty table gives an empty result; columns are handed through, but
``shard`` and ``slot`` are replaced, and names that start with ``_`` are the operator's own.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from framelore.session import materialise


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``cells`` (n rows, d dimensions of ``bits`` bits).

    The coordinates become the transposed index by undoing the exclusive-or of
    the Gray code from the top bit down, exchanging or inverting the lower bits.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for d in range(dims):
            invert = (x[d] & bit) != 0
            swap = np.where(invert, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(invert, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[dims - 1] & np.uint64(1 << level), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index << np.uint64(1) | (x[d] >> np.uint64(level) & np.uint64(1))
    return index.astype(np.int64)


def ordinal(column: Column, kind: T.DataType) -> Column:
    """A number in the order of the column's values; strings by their first seven bytes."""
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
    return column.cast("double")


def shard_hilbert(rows: DataFrame, dims: list[str], tie: list[str], shards: int, bits: int = 6, accuracy: int = 10_000) -> DataFrame:
    """Adds ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``dims`` are the dimensions of the curve (at most 10, ``bits`` bits each, 62 in
    all); ``tie`` orders rows of one cell, so that a crowded cell still splits.
    """
    if len(dims) * bits > 62:
        raise ValueError("too many bits for one long")
    names = [f"_d{i}" for i in range(len(dims))]
    table = materialise(rows.select("*", *[ordinal(F.col(c), rows.schema[c].dataType).alias(n) for c, n in zip(dims, names)]), "hilbert")
    marks = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = table.agg(*[F.percentile_approx(n, marks, accuracy).alias(n) for n in names]).first()  # 63 numbers a dimension
    # Marks may repeat: a frequent value then takes as wide a stretch of the cells as it has rows.
    edges = [np.array(cuts[n] or [], float) for n in names]

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.searchsorted(e, batch.column(n).to_numpy(zero_copy_only=False).astype(float), side="right") for n, e in zip(names, edges)]
            nulls = [batch.column(n).is_null().to_numpy(zero_copy_only=False) for n in names]
            cells = np.stack([np.where(z, 0, c) for z, c in zip(nulls, cells)], axis=1)
            kept = [batch.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hilbert_index(cells, bits))], names=[f.name for f in schema])

    schema = T.StructType([*rows.schema.fields, T.StructField("_h", T.LongType())])
    order = ["_h", *tie]
    runs = materialise(table.mapInArrow(curve, schema).repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_row", F.monotonically_increasing_id()), "hilbert-sorted")
    # Sorted partitions hold consecutive runs: a row's rank is the rows of the partitions before it plus its place.
    part = F.shiftright(F.col("_row"), 33)
    sizes = runs.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    place = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    share, rest = divmod(total, shards)
    edge = rest * (share + 1)  # the first ``rest`` shards hold one row more
    rank = F.col("_rank")
    shard = F.when(rank < edge, F.floor(rank / (share + 1))).otherwise(F.floor((rank - edge) / max(share, 1)) + rest)
    start = F.when(F.col("shard") < rest, F.col("shard") * (share + 1)).otherwise(F.col("shard") * share + rest)
    return (runs.withColumn("_part", part).join(before, "_part").withColumn("_rank", F.col("_before") + place)
            .withColumn("shard", shard.cast("int")).withColumn("slot", rank - start)
            .drop("_part", "_before", "_rank", "_row", "_h"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order."""
    assigned.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    got = shard_hilbert(rows, ["lang", "source", "size", "doc_id"], ["text_crc32", "doc_id"], 24)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
