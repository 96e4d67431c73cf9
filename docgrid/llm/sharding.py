"""Sharding by a Feistel permutation of global row numbers.

Every row gets its rank in a fixed order. A balanced Feistel network over the smallest even
number of bits that holds the row count, walked along its cycle until it lands below the
count, permutes the ranks. Shard and slot are then plain arithmetic on the permuted number,
so either can be computed, or inverted, without looking at any other row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.text import mix64
from docgrid.shared import running_start

ROUNDS = 8
#: Copies of one row are laid out in pieces of so many.
PIECE = 4096


def feistel(x: np.ndarray, n: int, seed: int, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """The image (or the inverse image) of every x in 0..n-1 under a permutation of 0..n-1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**63))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix64(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix64(right ^ k) & mask)
        return (left << h) | right

    y = once(x.astype(np.uint64))
    while (out := y >= n).any():  # the domain is less than four times n, so a few steps do
        y[out] = once(y[out])
    return y.astype(np.int64)


def shard_rows(df: DataFrame, n_shards: int, order_by: list[str], seed: int = 1) -> DataFrame:
    """Add ``row_no``, ``shard`` (0 to n_shards-1) and ``slot`` (gapless from 0 in each shard).

    Ranks follow ``order_by`` (nulls first), which should tell different rows apart; rows that
    agree in all columns are interchangeable and get neighbouring ranks, in whatever order.
    Counts of shards differ by one at most. Any column may be null; an empty table stays empty;
    input columns with the names of the results are replaced. ``df`` should be narrow: equal rows
    are counted before the shuffle and laid out again after it.
    """
    df = df.drop("row_no", "shard", "slot")
    names = df.columns
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    numbered = running_start(counted, [*order_by, *[c for c in names if c not in order_by]], "_copies", "_start")
    n = df.count()
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / PIECE).cast("long")))
    pieces = numbered.select("*", piece.alias("_piece"))
    first = F.col("_piece") * PIECE
    rows = pieces.repartition(*names, "_piece").select(
        *names, F.explode(F.sequence(F.col("_start") + first, F.col("_start") + F.least(first + PIECE, F.col("_copies")) - 1)).alias("row_no")
    )

    @F.arrow_udf("long")
    def permuted(x: pa.Array) -> pa.Array:
        return pa.array(feistel(x.to_numpy(zero_copy_only=False), n, seed))

    return (
        rows.withColumn("_at", permuted("row_no"))
        .withColumn("shard", (F.col("_at") % n_shards).cast("int"))
        .withColumn("slot", F.floor(F.col("_at") / n_shards).cast("long"))
        .drop("_at")
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Narrow rows of documents: id, size in bytes plus 1, checksum and a fingerprint of the text, whatever its length."""
    raw = F.col("text").cast("binary")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("text_crc32"),
        F.xxhash64("text").alias("_text"),
    )


def op1_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_rows(document_rows(docs), 8, ["doc_id", "text_crc32", "size", "_text"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")
