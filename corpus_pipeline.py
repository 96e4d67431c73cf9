"""A training corpus from raw documents, in five stages.

Quality rules, one document of each group of near copies, no benchmark passages, sources mixed
to target weights, shards. Each stage takes what the one before has kept, as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm.decontam import contamination
from docgrid.llm.jaccard import keep_one
from docgrid.llm.mixing import mix_documents
from docgrid.llm.quality import quality_filter
from docgrid.llm.sharding import document_rows, shard_rows
from docgrid.shared import fresh, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines that are too frequent in their source.

    Null and empty texts go; lines of texts of any length count; repeated rows are judged alike; a null source is a source; no row gives none. A column
    ``n_chars``, where there is one, counts the characters that are left; all others stay as they are.
    """
    kept = quality_filter(docs)
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of 5-word shingle similarity of 0.8 or more: the one with the smallest doc_id.

    A null doc_id gives way to any other; of rows that repeat id and text the least stays; texts of any length are compared whole; texts without words all stay; no row gives none.
    Columns may have any names.
    """
    return keep_one(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is near a benchmark item.

    Null and empty texts stay; texts of any length are searched whole; repeated rows fare alike; no row gives none. Columns may have any names.
    """
    (matches,) = fresh(docs, "matches")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), out=matches)
    return found.filter(F.size(matches) == 0).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated or left out so that sources reach their target weights.

    Null and empty texts weigh nothing; texts of any length travel once; rows that repeat id, text and source are laid out as the least of them; a null source is the last one; no row gives
    none. Columns may have any names.
    """
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row.

    Null ids and texts come first; equal rows get neighbouring row numbers; no row gives none. Other columns are left out.
    """
    rows = shard_rows(document_rows(docs), 8, ["doc_id", "text_crc32", "size", "_text"])
    return rows.select("doc_id", "size", "text_crc32", "row_no", "shard", "slot")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs


#: Edit-distance search, balanced sampling and the permutation have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
