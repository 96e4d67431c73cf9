"""Documents, chunks, sessions and messages as tables laid out for the joins that they take part in.

Tables are bucketed by join key, so that documents meet their counts, sessions their messages and hits their
neighbours where the rows lie; nothing of them is shuffled when read. A document or session may be of any size: chunks
are bucketed by document and position, messages by session and block of consecutive messages (sessions are written once
for each block), and chunks are counted when they are written, so that no task gets one key whole. Batches are appended.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.config import DEFAULT, Config
from docgrid.operators import catalog, chat, retrieval
from docgrid.shared import cut, new_path
from docgrid.sources.files import with_vectors


class Shape(NamedTuple):
    """Buckets of a table and messages of a block. Batches of a library share them.

    There should be so many buckets that one has some hundred megabytes, and no fewer than a shuffle has partitions; Spark
    may shuffle both sides of a join otherwise.
    """

    buckets: int = 64
    block: int = 4096


class Library(NamedTuple):
    """``counts`` has (document_id, n_chunks) for each batch of a document's chunks, ``sessions`` a row for each block of a session's messages."""

    documents: DataFrame
    counts: DataFrame
    chunks: DataFrame
    sessions: DataFrame
    messages: DataFrame
    shape: Shape


def block_of(sort_order: Column, shape: Shape) -> Column:
    """The block of a message; a null order is in block 0."""
    return F.coalesce(F.floor(sort_order / shape.block).cast("int"), F.lit(0))


def append(df: DataFrame, name: str, by: list[str], order: list[str], buckets: int) -> None:
    """Append to a table bucketed by ``by`` and sorted; each bucket gets one file, from one task."""
    rows = df.repartition(buckets, *by).sortWithinPartitions(*by, *order)
    to = rows.write.mode("append").format("parquet").bucketBy(buckets, *by).sortBy(*by, *order)
    spark = df.sparkSession
    (to if spark.catalog.tableExists(name) else to.option("path", new_path(spark))).saveAsTable(name)


def add_documents(name: str, documents: DataFrame, chunks: DataFrame, shape: Shape = Shape()) -> None:
    """Append documents and their chunks (document_id, position, text and more) to the library ``name``.

    Chunks get ``text_chars``, so that short ones are known without their text; a chunk whose vector is null is an error.
    """
    if "embedding" in chunks.columns:
        chunks = with_vectors(chunks)
    append(chunks.withColumn("text_chars", F.length(F.trim("text"))), f"{name}_chunks", ["document_id", "position"], [], shape.buckets)
    append(catalog.chunk_counts(chunks), f"{name}_counts", ["document_id"], [], shape.buckets)
    append(documents, f"{name}_documents", ["document_id"], [], shape.buckets)


def add_messages(name: str, sessions: DataFrame, messages: DataFrame, shape: Shape = Shape()) -> None:
    """Append messages (session_id, sort_order and more) and the rows of their sessions (session_id, document_id).

    ``sessions`` may hold sessions that are there already; only blocks that are new get a row. A session without messages gets none.
    """
    placed = messages.withColumn("block", block_of(F.col("sort_order"), shape))
    blocks = placed.select("session_id", "block").distinct()
    spark, there = messages.sparkSession, f"{name}_sessions"
    if spark.catalog.tableExists(there):
        blocks = blocks.join(spark.table(there).hint("merge").select("session_id", "block"), ["session_id", "block"], "left_anti")
    rows = cut(blocks.hint("merge").join(sessions.dropDuplicates(["session_id"]), "session_id"))  # read before the table grows
    append(placed, f"{name}_messages", ["session_id", "block"], ["sort_order"], shape.buckets)
    append(rows, there, ["session_id", "block"], [], shape.buckets)


def read_library(spark: SparkSession, name: str, shape: Shape = Shape()) -> Library:
    """The tables of a library; those to which nothing was added are None."""
    found = [spark.table(f"{name}_{t}") if spark.catalog.tableExists(f"{name}_{t}") else None for t in Library._fields[:-1]]
    return Library(*found, shape)


def drop_library(spark: SparkSession, name: str) -> None:
    """Forget the tables; their files stay."""
    for t in Library._fields[:-1]:
        spark.sql(f"DROP TABLE IF EXISTS {name}_{t}")


def document_status(library: Library) -> DataFrame:
    """Each document with its number of chunks over all batches. Nothing is shuffled."""
    counts = library.counts.groupBy("document_id").agg(F.sum("n_chunks").alias("n_chunks"))
    return catalog.document_status(library.documents, counts)


def chat_history(library: Library) -> DataFrame:
    """All messages with their document, without order between tasks. Nothing is shuffled."""
    return chat.document_messages(library.messages, library.sessions.hint("merge"), ["session_id", "block"])


def with_neighbors(hits: DataFrame, library: Library, config: Config = DEFAULT, small: bool | None = None) -> DataFrame:
    """``retrieval.with_neighbors`` from a library: chunks stay where they are and no text is read, only hits travel."""
    return retrieval.with_neighbors(hits, library.chunks, config, small)
