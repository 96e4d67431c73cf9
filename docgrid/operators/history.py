"""What earlier batches have stored, by bucket of the content hash, with a Bloom filter for each bucket and batch.

A batch reads the filters of the buckets of its own hashes, and then only those buckets that may hold
one of them; the exact comparison follows. Each batch writes under its own number, so that a repeated one replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.functions.columns import suffix_of
from docgrid.shared import hinted, is_small

#: Hexadecimal digits of a hash that name its bucket; bits of a filter for each hash, and places that a hash sets.
DIGITS, BITS, PLACES = 2, 16, 4


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def bucket_of(content_hash: Column) -> Column:
    return F.substring(content_hash, 1, DIGITS)


def places(hashes: list[str], size: int) -> np.ndarray:
    """(hash, place) bits of hexadecimal hashes in a filter of ``size`` bits: parts of the hash after its bucket's digits."""
    parts = [[int(h[DIGITS + 12 * k : DIGITS + 12 * k + 12] or "0", 16) % size for k in range(PLACES)] for h in hashes]
    return np.array(parts, np.int64).reshape(len(hashes), PLACES)


def filter_bits(hashes: list[str]) -> bytes:
    size = max(64, 1 << (BITS * len(hashes) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[places(hashes, size).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_hold(filters: list[bytes], hashes: list[str]) -> list[bool]:
    """Whether each filter may hold the hash beside it: true for all that it was made of, and for about one other in four hundred."""
    out = []
    for raw, h in zip(filters, hashes, strict=True):
        at = places([h], len(raw) * 8)[0]
        out.append(all(raw[p >> 3] >> (7 - (p & 7)) & 1 for p in at.tolist()))
    return out


def remember(rows: DataFrame, path: str, batch: int) -> None:
    """Write rows with a ``content_hash`` below ``path`` as those of a batch, and the filters of their buckets. Rows without a hash are left out."""
    rows = rows.filter("content_hash is not null").withColumn("bucket", bucket_of(F.col("content_hash")))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={batch}")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [filter_bits(h) for h in b.column("hashes").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("bucket"), pa.array(made, pa.binary())], names=["bucket", "bits"])

    hashes = rows.groupBy("bucket").agg(F.collect_set("content_hash").alias("hashes"))  # those of one bucket of one batch
    hashes.mapInArrow(build, "bucket string, bits binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/filters/batch={batch}")


def touched(hashes: DataFrame, path: str, batch: int | None = None) -> list[tuple[int, str]]:
    """(batch, bucket) that may hold one of ``hashes`` (content_hash), but those of ``batch``: as many as there are matches, and a few more."""
    spark = hashes.sparkSession
    if not exists(spark, f"{path}/filters"):
        return []
    asked = hashes.filter("content_hash is not null").select("content_hash").distinct().withColumn("bucket", bucket_of(F.col("content_hash")))
    filters = spark.read.parquet(f"{path}/filters").select(F.col("batch").cast("int").alias("batch"), F.col("bucket").cast("string").alias("bucket"), "bits")
    if batch is not None:
        filters = filters.filter(F.col("batch") != batch)

    @F.arrow_udf("boolean")
    def test(bits: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(may_hold(bits.to_pylist(), h.to_pylist()), pa.bool_())

    hits = filters.join(hinted(asked, is_small(asked)), "bucket").filter(test("bits", "content_hash"))
    return sorted((r.batch, r.bucket) for r in hits.select("batch", "bucket").distinct().collect())


def recall(hashes: DataFrame, path: str, schema: str, batch: int | None = None) -> DataFrame:
    """Rows of other batches than ``batch``, with the columns of ``schema``, whose bucket may hold one of ``hashes``; no other bucket is read."""
    spark, found = hashes.sparkSession, touched(hashes, path, batch)
    if not found:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/rows/batch={n}/bucket={b}" for n, b in found]
    return spark.read.schema(schema).parquet(*folders)


def keyed(files: DataFrame) -> DataFrame:
    return files.withColumn("blob_key", F.concat_ws(".", "content_hash", suffix_of(F.col("filename"))))


def store_blobs(files: DataFrame, path: str, batch: int = 0) -> None:
    """Keep the bytes of files (filename, size_bytes, uploaded_at, content, content_hash) below ``path``: once for equal bytes and suffix; what another batch has kept stays."""
    rows = keyed(files.filter("content_hash is not null"))
    first = rows.groupBy("blob_key").agg(F.min_by(F.struct("content_hash", "size_bytes", "content"), F.struct("uploaded_at", "filename")).alias("x")).select("blob_key", "x.*")
    kept = recall(rows.select("content_hash"), path, "blob_key string", batch)
    remember(first.hint("merge").join(kept.hint("merge"), "blob_key", "left_anti"), path, batch)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(blob_key, content_hash, size_bytes, content) of all kept blobs."""
    return spark.read.schema("blob_key string, content_hash string, size_bytes long, content binary").parquet(*[f"{path}/rows/*/*"]) if exists(spark, f"{path}/rows") else spark.createDataFrame([], "blob_key string, content_hash string, size_bytes long, content binary")
