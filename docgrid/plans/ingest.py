"""Uploads to searchable chunks, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.config import DEFAULT, Config
from docgrid.functions.columns import suffix_of, word_count
from docgrid.operators import catalog, chunking, history, models, structure
from docgrid.shared import cut, few, written
from docgrid.sources.files import extract_texts, plain_text


def accept(files: DataFrame, existing: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """The admitted files of a batch as documents, without content, with ``status`` pending or reused; nothing is extracted.

    Ids are hashes of owner, content, name and time, so a repeated run gives the same rows.
    """
    judged = catalog.dedup(_named(files, config).drop("content"), existing)
    return judged.withColumn("status", F.when(F.col("reused"), "reused").otherwise("pending"))


def _named(files: DataFrame, config: Config) -> DataFrame:
    admitted = catalog.admission(files, config).filter("reject_reason is null")
    identity = F.concat_ws("|", F.coalesce(F.col("user_id").cast("string"), F.lit("")), "content_hash", "filename", F.col("uploaded_at").cast("string"))
    return admitted.withColumn("document_id", F.sha2(identity, 256)).withColumn("status", F.lit("pending"))


def text_blocks(texts: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(blocks, page counts) of texts (document_id, filename, text): pages of lines, or in a Word file one block for each paragraph, without pages."""
    word = F.coalesce(suffix_of(F.col("filename")) == "docx", F.lit(False))
    pages = structure.page_texts(texts.filter(~word).select("document_id", "text"))
    paragraphs = texts.filter(word).select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    blocks = structure.blocks(structure.page_lines(pages), config.header)
    return blocks.unionByName(structure.paragraph_blocks(paragraphs, config.header)), structure.page_counts(pages)


def ingest(
    files: DataFrame,
    existing: DataFrame | None = None,
    extractor=plain_text,
    embed=models.hashed_embedding,
    count=word_count,
    config: Config = DEFAULT,
    on_status: Callable[[str, DataFrame], None] = lambda status, ids: None,
    accepted: DataFrame | None = None,
    blobs: str | None = None,
    batch: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of a batch of files (user_id, filename, size_bytes, uploaded_at, content, content_hash).

    Rejected and repeated files are neither read nor embedded, every other file is read once. A document whose text
    cannot be had, or gives no chunk, is ``failed``, with the reason. ``on_status`` is told the ids (document_id) of
    documents that go on to parsing and then to embedding, before that work is done; ``accepted`` are the documents of
    the batch, where ``accept`` has given them already. The bytes of new files are kept below ``blobs``, before they are
    read, as those of ``batch``; bytes that are there already stay. ``blob_key`` of a document names its bytes.
    """
    judged = history.keyed(accepted if accepted is not None else cut(accept(files, existing, config)))
    new = judged.filter(~F.col("reused")).select("document_id")
    if blobs is not None:
        history.store_blobs(_named(files, config).hint("merge").join(new, "document_id", "left_semi"), blobs, batch)
    on_status("parsing", new)
    texts = written(extract_texts(_named(files, config).hint("merge").join(new, "document_id", "left_semi"), extractor))
    blocks, pages = text_blocks(texts.filter("error is null"), config)
    packed = written(chunking.chunks(blocks, count=count, config=config))
    filled = cut(packed.select("document_id").distinct())
    on_status("embedding", filled)
    chunks = models.embed_chunks(packed, embed, config).withColumn("chunk_id", F.concat_ws("::", "document_id", "position"))
    failed = texts.select("document_id", "error").filter("error is not null")
    empty = texts.filter("error is null").select("document_id").hint("merge").join(filled, "document_id", "left_anti")
    failed = failed.unionByName(empty.withColumn("error", F.lit("no text")))
    documents = (
        judged.hint("merge").join(failed, "document_id", "left").hint("merge").join(pages, "document_id", "left")
        .withColumn("status", F.when(F.col("reused"), F.lit("reused")).when(F.col("error").isNotNull(), F.lit("failed")).otherwise("ready"))
    )
    return documents, chunks


def ask(questions: DataFrame, chunks: DataFrame, planner=None, scorer=None, embed=models.hashed_embedding, config: Config = DEFAULT) -> DataFrame:
    """(question_id, context): each question planned as sub-queries, retrieved, fused by position and written out as a numbered context."""
    from docgrid.operators import chat, retrieval

    parts = models.plan(questions, planner, config)
    subs = parts.select(F.concat_ws("#", "question_id", "sq_index").alias("sub"), "question_id", "document_id", "sq_index", F.col("query").alias("question"))
    asked = models.embed_questions(subs.select(F.col("sub").alias("question_id"), "document_id", "question"), embed, config)
    found = retrieval.retrieve_reranked(asked, chunks, scorer, config.ask_top_k, config)
    named = found.withColumnRenamed("question_id", "sub").join(few(subs.select("sub", "question_id", "sq_index")), "sub")
    merged = retrieval.merge_subqueries(named.select("question_id", "sq_index", F.col("ord").alias("rank"), "position", "chunk_id"), config.ask_max_chunks, config.rrf_k)
    return chat.context_texts(merged, chunks)
