"""The given tables seen as documents, chunks, uploads, users, chats, traces and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.shared import table

#: The view's header lines, as the texts have no legal headings.
HEADER = r"^\s*(The|De|Der|La)[ .,]"

#: Tasks that take the rows of a split of files, which is 128 MB by default.
PER_SPLIT = 8

CHUNKS_SQL = """
chunks AS (
  SELECT d.doc_id AS chunk_id, 'src' || (d.doc_id % 20) AS document_id, (d.doc_id // 20)::INTEGER AS position, (d.doc_id // 100 + 1)::INTEGER AS page,
         d.lang AS section, d.text, e.embedding::DOUBLE[] AS embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

#: The same texts as chunks of documents of constant length, for what goes over whole documents.
PARTS_SQL = """
chunks AS (SELECT doc_id AS chunk_id, 'src' || (doc_id // 50) AS document_id, (doc_id % 50)::INTEGER AS position, text FROM documents)"""

QUESTIONS_SQL = """
questions AS (
  SELECT b.item_id AS question_id, 'src' || (b.item_id % 20) AS document_id, b.text AS question, e.embedding::DOUBLE[] AS embedding
  FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id)"""

UPLOADS_SQL = """
uploads AS (
  SELECT doc_id AS document_id, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE doc_id % 3 END AS user_id,
         'file' || doc_id || '.' || (CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'PDF' WHEN 2 THEN 'pdf' ELSE 'txt' END) AS filename,
         sha256(text) AS content_hash, (strlen(text) * 1500)::BIGINT AS size_bytes,
         CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 13 = 0 THEN 'embedding' ELSE 'ready' END AS status,
         TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * doc_id AS uploaded_at
  FROM documents)"""

LINES_SQL = """
lines AS (
  SELECT doc_id AS document_id, (i // 20 + 1)::INTEGER AS page, (i % 20)::INTEGER AS ln, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, dealt out where they lie in fewer files than the session has tasks: one file may be one task otherwise.

    They go to ``PER_SPLIT`` tasks for each split of the files, so that what a task holds does not grow with the table.
    """
    rows, n = table(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    return rows.repartition(max(n, PER_SPLIT * rows.rdd.getNumPartitions()), "doc_id") if len(rows.inputFiles()) < n else rows


def chunks(spark: SparkSession, sf: str, vectors: bool = False, spread: bool = True) -> DataFrame:
    """Every text as a chunk of one of 20 documents; with ``vectors`` also its embedding, null where it has none.

    Without ``spread`` texts stay where they are read, for searches, which deal out themselves what they split and fetch few texts.
    """
    i = F.col("doc_id")
    rows = (documents(spark, sf) if spread else table(spark, sf, "documents")).select(
        i.alias("chunk_id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("document_id"), F.floor(i / 20).cast("int").alias("position"),
        (F.floor(i / 100) + 1).cast("int").alias("page"), F.col("lang").alias("section"), "text",
    )
    if not vectors:
        return rows
    e = table(spark, sf, "embeddings")
    return rows.join(e, rows["chunk_id"] == e["vec_id"], "left").select(*rows.columns, "embedding")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that have an embedding, without their texts, which hence take no part in the join: (chunk_id, document_id, text_chars, embedding)."""
    i = F.col("doc_id")
    rows = table(spark, sf, "documents").select(i.alias("chunk_id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("document_id"), F.length(F.trim("text")).alias("text_chars"))
    e = table(spark, sf, "embeddings").filter("embedding is not null")
    return rows.join(e, rows["chunk_id"] == e["vec_id"]).select(*rows.columns, "embedding")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as a chunk of a document of 50 chunks, so that the number of documents grows with the input and not their length."""
    i = F.col("doc_id")
    return documents(spark, sf).select(i.alias("chunk_id"), F.concat(F.lit("src"), F.floor(i / 50).cast("string")).alias("document_id"), (i % 50).cast("int").alias("position"), "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    b, e = table(spark, sf, "benchmark"), table(spark, sf, "embeddings")
    return b.join(e, b["item_id"] == e["vec_id"]).select(
        F.col("item_id").alias("question_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("document_id"), F.col("text").alias("question"), "embedding"
    )


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    suffix = F.when(i % 4 == 0, "docx").when(i % 4 == 1, "PDF").when(i % 4 == 2, "pdf").otherwise("txt")
    return table(spark, sf, "documents").select(
        i.alias("document_id"), F.when(i % 29 != 0, i % 3).alias("user_id"), F.concat(F.lit("file"), i.cast("string"), F.lit("."), suffix).alias("filename"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), (F.octet_length("text") * 1500).cast("long").alias("size_bytes"),
        F.when(i % 11 == 0, "failed").when(i % 13 == 0, "embedding").otherwise("ready").alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("uploaded_at"),
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return rows.select("document_id", (F.floor(F.col("i") / 20) + 1).cast("int").alias("page"), (F.col("i") % 20).cast("int").alias("ln"), "line")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of conversations; the session is the conversation, the parts are one text."""
    c = table(spark, sf, "conversations")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("session_id"), "role",
        F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("parts"), F.lit(None).cast("string").alias("metadata"), F.col("turn").cast("int").alias("sort_order"),
    )


def traces(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    start = F.col("ts").cast("timestamp")
    ms = F.round("value").cast("long")
    return e.select(
        F.col("user_id").alias("trace_id"), F.col("event_type").alias("name"), (F.col("user_id") % 3).cast("string").alias("model"), ms.alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("tok_in"), (F.get_json_object("props", "$.k").cast("long") * 2).alias("tok_out"),
        F.when(F.col("event_id") % 17 == 0, "timeout").alias("error"), start.alias("start_time"), F.timestamp_millis(F.unix_millis(start) + ms).alias("end_time"),
    )


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Status events: the five event types, ranked by name, stand for the five states."""
    names = F.array(*[F.lit(s) for s in ("pending", "parsing", "embedding", "ready", "failed")])
    return table(spark, sf, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.element_at(names, (F.pmod(F.ascii("event_type"), F.lit(5)) + 1).cast("int")).alias("status")
    )


def raw_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Judge answers: JSON text, bare, inside prose, or broken."""
    l = table(spark, sf, "labels")
    json = F.concat(F.lit('{"groundedness": '), F.col("quality").cast("string"), F.lit(', "citation_ok": '), (F.col("quality") == 1).cast("string"), F.lit(', "answered": '), (F.col("toxic") == 0).cast("string"), F.lit(', "reason": "r"}'))
    raw = F.when(F.col("doc_id") % 3 == 0, json).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Sure: "), json, F.lit(" done"))).otherwise(F.concat(F.lit("broken "), F.col("doc_id").cast("string")))
    return l.select(F.col("doc_id").alias("query_id"), raw.alias("raw"))
