"""Hybrid retrieval of chunks for whole tables of questions.

Questions are scoped to one document, so both arms are equi-joins on the document; per-question
top-k is a window with a group limit. Questions are broadcast only if a count shows that they are
few; otherwise the join shuffles by document.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.config import DEFAULT, Config
from docgrid.functions.columns import query_terms
from docgrid.operators.dense import block_scores
from docgrid.operators.index import Index, asked_terms, index_scores, term_weight, words
from docgrid.operators.models import embed_questions, rewrite
from docgrid.shared import cut, few, hinted, is_small

#: Bytes of the texts whose words are counted in one task.
TASK_BYTES = 8_000_000


def readable(chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Chunks that are long enough to be text; their trimmed length is read where it is a column (``text_chars``)."""
    chars = F.col("text_chars") if "text_chars" in chunks.columns else F.length(F.trim("text"))
    return chunks.filter(chars >= config.min_chunk_chars)


def dense_topk(questions: DataFrame, chunks: DataFrame, k: int, config: Config = DEFAULT, small: bool | None = None) -> DataFrame:
    """(question_id, chunk_id, rank from 0, score) of the nearest chunks of each question's document; chunks without a vector have no place.

    ``small`` says whether questions are few, where that is known already.
    """
    return _ranked(block_scores(questions, readable(chunks, config), k, small), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    ranked = scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return ranked.select("question_id", "chunk_id", (F.col("_n") - 1).cast("int").alias("rank"), "score")


def dealt(chunks: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Texts (document_id, chunk_id, text) dealt by chunk to so many tasks that each has about ``task_bytes`` of them, however many there are.

    What is grouped by chunk afterwards stays in its task, so that words are not shuffled.
    """
    n = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, ceil(n / task_bytes))
    return chunks.select("document_id", "chunk_id", "text").repartition(tasks, "chunk_id")


def term_table(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, term, head, n): how often each term occurs in each chunk. Worth writing once."""
    return words(dealt(chunks)).groupBy("document_id", "chunk_id", "term").agg(F.count(F.lit(1)).alias("n")).withColumn("head", F.substring("term", 1, 2))


def index_topk(questions: DataFrame, index: Index, k: int, config: Config = DEFAULT, small: bool | None = None) -> DataFrame:
    """As ``lexical_topk``, from a written index; texts are not read."""
    return _ranked(index_scores(questions, index, k, config, small)[0], k)


def lexical_topk(questions: DataFrame, chunks: DataFrame, k: int, config: Config = DEFAULT, terms: DataFrame | None = None, small: bool | None = None) -> DataFrame:
    """(question_id, chunk_id, rank from 0, score) by prefix matches of the question's terms.

    Terms have two characters at least, so their first two are a join key that loses nothing. For few questions the texts are
    dealt by chunk, and words are counted, matched and summed where they are; for many, words are matched before they are counted, so only
    those that are asked about travel. A written table of ``terms`` is used as it is.
    """
    small = is_small(questions) if small is None else small
    if small and terms is None:
        terms = term_table(readable(chunks, config))
    q = asked_terms(questions, config).withColumn("head", F.substring("q_term", 1, 2))
    t = words(readable(chunks, config)).withColumn("head", F.substring("term", 1, 2)) if terms is None else terms
    asked = q.select("document_id", "head", "q_term").distinct()  # questions of a document share many terms
    hits = t.join(hinted(asked, small), ["document_id", "head"]).filter(F.col("term").startswith(F.col("q_term")))
    if terms is None:
        hits = hits.groupBy("document_id", "chunk_id", "q_term", "term").agg(F.count(F.lit(1)).alias("n"))
    per = hits.groupBy("document_id", "chunk_id", "q_term").agg(F.sum(term_weight(F.col("n"))).alias("_w"))
    scored = per.join(hinted(q.drop("head"), small), ["document_id", "q_term"])
    scored = scored.groupBy("question_id", "chunk_id").agg(F.round(F.sum("_w") / F.first("m"), 9).alias("score"))
    return _ranked(scored, k)


def rrf(ranked: DataFrame, by: list[str], k: int = DEFAULT.rrf_k) -> DataFrame:
    """Reciprocal-rank fusion of ranked rows: the sum of 1 / (k + rank + 1) by key."""
    return ranked.groupBy(*by).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank") + 1)).alias("score"))


def fused_topk(dense: DataFrame, lexical: DataFrame, k: int, config: Config = DEFAULT) -> DataFrame:
    """(question_id, chunk_id, ord from 0, score): both arms fused; ties follow the dense order, then the lexical one."""
    both = dense.select("question_id", "chunk_id", "rank", F.col("rank").alias("v"), F.lit(None).cast("int").alias("w"))
    both = both.unionByName(lexical.select("question_id", "chunk_id", "rank", F.lit(None).cast("int").alias("v"), F.col("rank").alias("w")))
    fused = both.groupBy("question_id", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(config.rrf_k) + F.col("rank") + 1)), 12).alias("score"), F.max("v").alias("v"), F.max("w").alias("w")
    )
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc_nulls_last("v"), F.asc_nulls_last("w"))
    top = fused.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return top.select("question_id", "chunk_id", (F.col("_n") - 1).cast("int").alias("ord"), F.round("score", 6).alias("score"))


def with_neighbors(hits: DataFrame, chunks: DataFrame, config: Config = DEFAULT, small: bool | None = None) -> DataFrame:
    """``hits`` (question_id, document_id, position, ord, score) and, after them in position order with score 0, the chunks beside the first ones."""
    r = config.neighbor_radius
    small = is_small(hits) if small is None else small
    near = hits.filter(F.col("ord") < config.expand_top)
    near = near.select("question_id", "document_id", F.explode(F.sequence(F.col("position") - r, F.col("position") + r)).alias("position"))
    near = near.filter("position >= 0").distinct().join(hinted(hits.select("question_id", "position"), small), ["question_id", "position"], "left_anti")
    found = readable(chunks, config).select("document_id", "position", "chunk_id").join(hinted(near, small), ["document_id", "position"])
    extra = found.withColumn("score", F.lit(0.0)).withColumn("_after", F.lit(1)).withColumn("_o", F.col("position"))
    rows = hits.select("question_id", "document_id", "position", "chunk_id", "score", F.lit(0).alias("_after"), F.col("ord").alias("_o"))
    rows = rows.unionByName(extra.select(*rows.columns))
    w = Window.partitionBy("question_id").orderBy("_after", "_o")
    return rows.select("question_id", "document_id", "position", "chunk_id", "score", (F.row_number().over(w) - 1).cast("int").alias("ord"))


def hybrid_retrieval(questions: DataFrame, chunks: DataFrame, k: int | None = None, config: Config = DEFAULT, terms: DataFrame | None = None, small: bool | None = None, index: Index | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(question_id, document_id, position, chunk_id, score, ord): k fused hits of each question and their neighbours.

    The hits, a few narrow rows for each question, are checkpointed, since neighbours are taken from them. With a written ``index``
    the keyword arm reads no text. Where vectors lie apart from the texts, ``vectors`` (document_id, chunk_id, text_chars or text, embedding) are
    searched, and ``chunks`` need none, so that no text takes part in a join with them.
    """
    k = k or config.top_k
    pool = max(k * config.over_fetch, k)
    small = is_small(questions) if small is None else small
    dense = dense_topk(questions, chunks if vectors is None else vectors, pool, config, small)
    lexical = lexical_topk(questions, chunks, pool, config, terms, small) if index is None else index_topk(questions, index, pool, config, small)
    top = cut(fused_topk(dense, lexical, k, config))
    hits = chunks.select("chunk_id", "document_id", "position").join(hinted(top, small), "chunk_id")
    return with_neighbors(hits, chunks, config, small)


def merge_subqueries(results: DataFrame, cap: int, k: int = DEFAULT.rrf_k) -> DataFrame:
    """(question_id, position, chunk_id, score, ord): results of sub-queries (sq_index, rank) fused by position, first-seen row kept, capped."""
    seen = F.struct("sq_index", "rank")
    fused = results.groupBy("question_id", "position").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank") + 1)), 12).alias("score"), F.min_by("chunk_id", seen).alias("chunk_id"), F.min(seen).alias("_s")
    )
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "_s")
    top = fused.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    return top.select("question_id", "position", "chunk_id", "score", (F.col("_n") - 1).cast("int").alias("ord"))


def retrieve_reranked(questions: DataFrame, chunks: DataFrame, scorer, k: int | None = None, config: Config = DEFAULT, rewriter=None, embed=None, vectors: DataFrame | None = None) -> DataFrame:
    """Two stages: more candidates than wanted, with neighbours, then the ``k`` best by ``scorer(question, text)``.

    ``rewriter`` (see ``rewrite``) rewrites questions first; what it gives is embedded by ``embed``, searched and scored. Without a
    scorer the first stage fetches ``k`` only. Scores are rounded to 4 places. ``vectors`` as in ``hybrid_retrieval``.
    """
    k = k or config.top_k
    if rewriter is not None:
        if embed is None:
            raise ValueError("rewritten questions have other vectors: give embed")
        questions = cut(rewrite(questions, rewriter, config))  # read by both arms and by the scorer
    if embed is not None:
        questions = cut(embed_questions(questions, embed, config))
    small = is_small(questions)
    if scorer is None:
        return hybrid_retrieval(questions, chunks, k, config, small=small, vectors=vectors).withColumn("score", F.round("score", 4))
    found = hybrid_retrieval(questions, chunks, config.rerank_candidates, config, small=small, vectors=vectors)
    rows = chunks.select("chunk_id", "text").join(hinted(found, small), "chunk_id").join(hinted(questions.select("question_id", "question"), small), "question_id")
    top = rerank(rows, scorer, k)
    return top.select("question_id", "document_id", "position", "chunk_id", F.round("score", 4).alias("score"), "rerank_score", "ord")


def rerank(rows: DataFrame, scorer, k: int) -> DataFrame:
    """The first ``k`` rows of each question by ``scorer`` (a function of the columns question and text), stable.

    If the scorer gives null for any row of a question, as a stage does where its model raises, that question keeps its order.
    """
    w = Window.partitionBy("question_id")
    scored = rows.withColumn("rerank_score", scorer(F.col("question"), F.col("text")).cast("double"))
    scored = scored.withColumn("_bad", F.max(F.col("rerank_score").isNull()).over(w))
    scored = scored.withColumn("rerank_score", F.when(~F.col("_bad"), F.col("rerank_score"))).drop("_bad")
    ranked = scored.withColumn("_n", F.row_number().over(w.orderBy(F.desc_nulls_last("rerank_score"), "ord"))).filter(F.col("_n") <= k)
    return ranked.withColumn("ord", (F.col("_n") - 1).cast("int")).drop("_n")


def term_overlap(question, text):
    """A scorer without a model: the share of the question's terms that the text contains."""
    t = query_terms(question)
    words = F.transform(F.regexp_extract_all(text, F.lit("([0-9A-Za-zÀ-ỹ]+)"), 1), lambda x: F.lower(x))
    return F.coalesce(F.round(F.size(F.array_intersect(t, words)) / F.size(t), 9), F.lit(0.0))


def citations_only(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each question the pages and sections of its results in order, without any text."""
    rows = chunks.select("chunk_id", "page", "section").join(few(cut(results.select("question_id", "chunk_id", "ord"))), "chunk_id")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("ord", "page", "section"))), lambda x: F.struct(x["page"].alias("page"), x["section"].alias("section")))
    return rows.groupBy("question_id").agg(entries.alias("citations"))
