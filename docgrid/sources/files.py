"""Files, blobs, traces and evaluation rows as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.operators.structure import page_texts
from docgrid.shared import small_batches

TRACE_SCHEMA = (
    "traceId string, name string, model string, latencyMs long, usage struct<input:long,output:long,total:long>, "
    "startTime timestamp, endTime timestamp, error string, metadata string, input string, output string"
)


def read_files(spark: SparkSession, path: str, pattern: str = "*.{pdf,docx,PDF,DOCX}") -> DataFrame:
    """(filename, size_bytes, uploaded_at, content, content_hash) of the files in a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return described(raw)


#: What the source ``binaryFile`` gives, and packs hold.
RAW = "path string, modificationTime timestamp, length long, content binary"


def write_packs(raw: DataFrame, path: str) -> None:
    """Append files (path, modificationTime, length, content) to a folder of packs, a pack for each partition: a store need not list and open every small file."""
    raw.select("path", "modificationTime", "length", "content").write.mode("append").parquet(path)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_files``, of a folder of packs."""
    return described(spark.read.schema(RAW).parquet(path))


def described(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("uploaded_at"),
        "content",
        F.sha2("content", 256).alias("content_hash"),
    )


def plain_text(content: bytes, filename: str) -> str:
    """An extractor without a document library: the bytes as UTF-8, form feeds between pages."""
    return content.decode("utf-8")


def extract_texts(files: DataFrame, extractor: Callable[[bytes, str], str] = plain_text) -> DataFrame:
    """(document_id, filename, text, error) of files (document_id, filename, content).

    The extractor turns bytes into text, one file at a time; a file that it cannot read, and one
    without any text, is a row with an error.
    """

    def read(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for d, name, content in zip(*(b.column(c).to_pylist() for c in ("document_id", "filename", "content")), strict=True):
                try:
                    text, error = extractor(content, name), None
                except Exception as e:  # a broken file must not end the job
                    text, error = None, str(e)[:300]
                rows.append((d, name, text, error if error or (text or "").strip() else "no text"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["document_id", "filename", "text", "error"])

    return small_batches(files).select(F.col("document_id").cast("string"), "filename", "content").mapInArrow(read, "document_id string, filename string, text string, error string")


def extract_pages(files: DataFrame, extractor: Callable[[bytes, str], str] = plain_text) -> DataFrame:
    """(document_id, page, page_text, error) of files (document_id, filename, content); a file without text is a row without a page."""
    raw = extract_texts(files, extractor)
    good = page_texts(raw.filter("error is null").select("document_id", "text")).withColumn("error", F.lit(None).cast("string"))
    bad = raw.filter("error is not null").select("document_id", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("page_text"), "error")
    return good.unionByName(bad)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE_SCHEMA).json(path)


def write_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").json(path)


def read_eval_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation chunks with ``key``, document and position joined by two colons."""
    rows = spark.read.schema("doc_id string, position int, page int, section string, text string").json(path)
    return rows.withColumn("key", chunk_key(F.col("doc_id"), F.col("position")))


def chunk_key(document_id: Column, position: Column) -> Column:
    return F.concat_ws("::", document_id, position.cast("string"))


def with_vectors(chunks: DataFrame) -> DataFrame:
    """``chunks``; one whose vector is null ends the query."""
    return chunks.withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.lit("a chunk has no vector"))))


def write_chunks(chunks: DataFrame, path: str, by: str = "document_id") -> None:
    """Append chunks with vectors, sorted by document; a chunk without a vector is an error."""
    with_vectors(chunks).repartitionByRange(by, "position").sortWithinPartitions(by, "position").write.mode("append").parquet(path)
