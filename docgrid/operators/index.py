"""A written inverted index for prefix search, whose blocks tell the most that they can add to a score.

Texts are split once, when the index is written. Postings lie in blocks of chunks that follow each
other in their document; each term of a block has its greatest weight. A search sums these for each question and block, scores the
most promising blocks, and then only those that may still reach the ``k``-th best score.
"""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgrid.config import DEFAULT, Config
from docgrid.functions.columns import query_terms
from docgrid.shared import hinted, is_small, stored

#: Chunks of a block.
BLOCK = 64
#: What sums of rounded scores may differ by.
_NEAR = 1e-8
#: Counts whose weight is looked up.
_KNOWN = 32


def words(chunks: DataFrame, *keep: str) -> DataFrame:
    """(document_id, chunk_id, ``keep``, term) of each word of two characters and more."""
    found = chunks.select("document_id", "chunk_id", *keep, F.explode(F.regexp_extract_all("text", F.lit("([0-9A-Za-zÀ-ỹ]+)"), 1)).alias("term"))
    return found.withColumn("term", F.lower("term")).filter(F.length("term") >= 2)


def term_weight(n: Column) -> Column:
    """Weight of a term that occurs n times: the sum of 1/j^2 up to n, scaled."""
    series = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, j: s + F.lit(1.0) / (j.cast("double") * j))
    sums = list(accumulate((1.0 / (j * j) for j in range(1, _KNOWN + 1)), initial=0.0))
    known = F.array(*[F.lit(s * 0.1 / 1.64493406685) for s in sums])  # of most words, without a loop for each
    return F.when(n <= _KNOWN, F.get(known, n.cast("int"))).otherwise(series * 0.1 / 1.64493406685)


class Index(NamedTuple):
    """``postings``: (document_id, term, head, block, top, entries: array of (chunk_id, weight)), a row for each term of each block of ``BLOCK`` chunks.
    ``terms``: (document_id, term, head, n_blocks), the dictionary; ``head`` is the first two characters, which every prefix has."""

    postings: DataFrame
    terms: DataFrame


def build_index(chunks: DataFrame, config: Config = DEFAULT, block: int = BLOCK) -> DataFrame:
    """The postings of chunks (document_id, chunk_id, position, text) that are long enough to be text."""
    readable = chunks.filter(F.length(F.trim("text")) >= config.min_chunk_chars).withColumn("block", F.floor(F.coalesce("position", F.lit(0)) / block))
    readable = readable.select("document_id", "chunk_id", "block", "text").repartition("document_id", "block")  # texts travel once, and words not at all
    counts = words(readable, "block").groupBy("document_id", "block", "chunk_id", "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.withColumn("weight", term_weight(F.col("n")))
    entry = F.struct("chunk_id", "weight")
    rows = weighed.groupBy("document_id", "term", "block").agg(F.max("weight").alias("top"), F.collect_list(entry).alias("entries"))  # a block's chunks at most
    return rows.select("document_id", "term", F.substring("term", 1, 2).alias("head"), "block", "top", "entries")


def write_index(chunks: DataFrame, path: str, config: Config = DEFAULT, block: int = BLOCK) -> None:
    """Write postings and dictionary below ``path``; files are ranges of documents and terms, so that readers skip most of them."""
    order = ["document_id", "head", "term", "block"]
    built, drop = stored(build_index(chunks, config, block))  # ranges are found from a sample, for which texts would be split again
    built.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/postings")
    drop()
    postings = chunks.sparkSession.read.parquet(f"{path}/postings")
    terms = postings.groupBy("document_id", "head", "term").agg(F.count(F.lit(1)).alias("n_blocks"))
    terms.repartitionByRange(*order[:3]).sortWithinPartitions(*order[:3]).write.parquet(f"{path}/terms")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"))


def asked_terms(questions: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(question_id, document_id, m, q_term): the m distinct terms of each question."""
    q = questions.select("question_id", "document_id", query_terms(F.col("question"), config).alias("_t")).filter("_t is not null")
    return q.select("question_id", "document_id", F.size("_t").alias("m"), F.explode("_t").alias("q_term"))


def index_scores(questions: DataFrame, index: Index, k: int, config: Config = DEFAULT, small: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores (question_id, chunk_id, score), among which are the ``k`` best chunks of each question, and what was done: (question_id, block, bound, scored).

    Equal to summing over all chunks: a block is left out only if its bound is below the ``k``-th best score of the
    blocks that were scored first, which are those of the greatest bounds, enough to hold ``k`` chunks twice.
    The terms of few questions go to the postings; the terms that match them, as many as the index has, never travel to the driver.
    """
    small = is_small(questions) if small is None else small
    q = asked_terms(questions, config)
    heads = q.select("document_id", F.substring("q_term", 1, 2).alias("head"), "q_term").distinct()
    prefixed = F.col("term").startswith(F.col("q_term"))
    if small:
        hits = index.postings.join(F.broadcast(heads), ["document_id", "head"]).filter(prefixed)
    else:
        match = index.terms.select("document_id", "head", "term").join(heads.hint("merge"), ["document_id", "head"]).filter(prefixed)
        match, _ = stored(match.select("document_id", "q_term", "term"))
        hits = index.postings.join(match.hint("merge"), ["document_id", "term"])
    tops = hits.groupBy("document_id", "q_term", "block").agg(F.sum("top").alias("top"))
    bounds = tops.join(hinted(q, small), ["document_id", "q_term"]).groupBy("question_id", "document_id", "block").agg((F.sum("top") / F.first("m")).alias("bound"))
    w = Window.partitionBy("question_id").orderBy(F.desc("bound"), "block")
    bounds, _ = stored(bounds.withColumn("place", F.row_number().over(w)))
    first = 1 + -(-2 * k // BLOCK)

    def scores(chosen: DataFrame) -> DataFrame:
        """(question_id, chunk_id, score) of all chunks of blocks (question_id, document_id, block)."""
        few = is_small(chosen) if small else False
        blocks = chosen.select("document_id", "block").distinct()
        rows = hits.select("document_id", "block", "q_term", "entries").join(hinted(blocks, few), ["document_id", "block"])
        per = rows.select("document_id", "block", "q_term", F.explode("entries").alias("e")).groupBy("document_id", "block", "q_term", "e.chunk_id").agg(F.sum("e.weight").alias("w"))
        wanted = chosen.select("question_id", "document_id", "block").join(hinted(q, small), ["question_id", "document_id"])
        return per.join(hinted(wanted, few), ["document_id", "block", "q_term"]).groupBy("question_id", "chunk_id").agg(F.round(F.sum("w") / F.first("m"), 9).alias("score"))

    head, _ = stored(scores(bounds.filter(F.col("place") <= first)))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"))
    kth = head.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("question_id", F.col("score").alias("kth"))
    rest = bounds.filter(F.col("place") > first).join(hinted(kth, small), "question_id", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - _NEAR))
    rest, _ = stored(rest.select("question_id", "document_id", "block"))
    done = rest.select("question_id", "block", F.lit(True).alias("_in"))
    told = bounds.join(done.hint("merge"), ["question_id", "block"], "left").select("question_id", "block", "bound", (F.col("_in").isNotNull() | (F.col("place") <= first)).alias("scored"))
    return head.unionByName(scores(rest)), told
