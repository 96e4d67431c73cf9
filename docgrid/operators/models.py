"""Pluggable models: embeddings, planning, rewriting, map-reduce over documents, prep packs.

A model is a function of columns. The defaults are deterministic and need no network: hashed
features, the question itself as the plan, extracts and templates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.config import DEFAULT, Config
from docgrid.operators.stages import Stage
from docgrid.shared import cut, is_small, small_batches, stored_by, written

KINDS = ("summary", "terms", "questions")


def hashed_embedding(text: Column, dim: int = DEFAULT.embedding_dim) -> Column:
    """Hashed words as a unit vector; stands in for an embedding model.

    The first 32 bits of a word's MD5 give its place (modulo ``dim``) and, by bit 16, its sign.
    """

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        from hashlib import md5

        place: dict[str, tuple[int, int]] = {}  # of the words of this batch
        out = []
        for t in texts.to_pylist():
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                if w not in place:
                    h = int(md5(w.encode()).hexdigest()[:8], 16)
                    place[w] = h % dim, 1 - 2 * (h >> 16 & 1)
                at, sign = place[w]
                v[at] += sign
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return pa.array(out, pa.list_(pa.float32()))

    return embed(text)


def embed_chunks(chunks: DataFrame, model: Callable[[Column], Column] = hashed_embedding, config: Config = DEFAULT) -> DataFrame:
    return small_batches(chunks).withColumn("embedding", model(F.concat(F.lit(config.passage_prefix), F.col("text"))))


def embed_questions(questions: DataFrame, model: Callable[[Column], Column] = hashed_embedding, config: Config = DEFAULT) -> DataFrame:
    return questions.withColumn("embedding", model(F.concat(F.lit(config.query_prefix), F.col("question"))))


def accept_rewrite(question: Column, rewritten: Column, config: Config = DEFAULT) -> Column:
    """The rewritten query if it is one line of up to 160 characters, else the question."""
    r = F.trim(rewritten)
    return F.when(F.length(r).between(1, config.rewrite_max_chars) & ~r.contains("\n"), r).otherwise(question)


def rewrite(questions: DataFrame, model: Callable[..., Column] | None = None, config: Config = DEFAULT) -> DataFrame:
    """Questions rewritten by ``model(question)``, or by ``model(question, history)`` where they have a column history (turns of role and content, in order).

    A rewriter that gives null, as a stage does where its model raises, leaves the question as it is.
    """
    if model is None:
        return questions
    given = [F.col(c) for c in ("question", "history") if c in questions.columns]
    return questions.withColumn("question", accept_rewrite(F.col("question"), model(*given), config))


def with_history(questions: DataFrame, turns: DataFrame, by: str = "session_id") -> DataFrame:
    """``questions`` with ``history``: the turns (``by``, sort_order, role, content) of their session in order, empty where there are none."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    told = turns.groupBy(by).agg(listed.alias("history"))  # a few turns of one session
    rows = questions.hint("merge").join(told.hint("merge"), by, "left")
    return rows.withColumn("history", F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")))


SUBQUERIES = "array<struct<query:string,focus:string>>"


def plan(questions: DataFrame, planner: Callable[[Column], Column] | None = None, config: Config = DEFAULT) -> DataFrame:
    """(question_id, document_id, sq_index, query, focus): up to five sub-queries; the question itself where the plan is empty or failed."""
    own = F.array(F.struct(F.col("question").alias("query"), F.lit("").alias("focus")))
    made = F.lit(None).cast(SUBQUERIES) if planner is None else planner(F.col("question"))
    parts = F.slice(F.when(F.size(made) > 0, made).otherwise(own), 1, config.most_subqueries)
    return questions.select("question_id", "document_id", F.posexplode(parts).alias("sq_index", "s")).select("question_id", "document_id", "sq_index", "s.query", "s.focus")


def chunk_groups(chunks: DataFrame, max_chars: int = DEFAULT.map_group_chars) -> DataFrame:
    """``chunks`` (document_id, position, text) with ``grp``: consecutive chunks of up to ``max_chars``; an oversized one stands alone.

    Lengths stream through a task in order and only the size so far and the group's number are
    held, however long a document is. Chunks of one position stay together.
    """

    def number(batches):
        doc, last, size, g = None, None, 0, 0
        for b in batches:
            docs, places, grps = [], [], []
            for d, p, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if d != doc:
                    doc, last, size, g = d, None, 0, 0
                if p == last:
                    size += n
                    continue
                if size > 0 and size + n > max_chars:
                    size, g = 0, g + 1
                last, size = p, size + n
                docs.append(d)
                places.append(p)
                grps.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type), pa.array(places, b.schema.field(1).type), pa.array(grps, pa.int32())], names=["document_id", "position", "grp"])

    lengths = chunks.filter(F.col("document_id").isNotNull() & F.col("position").isNotNull()).select("document_id", "position", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lengths.schema[:2])
    numbered = lengths.repartition("document_id").sortWithinPartitions("document_id", "position", "n").mapInArrow(number, f"{kinds}, grp int")
    return chunks.hint("merge").join(numbered, ["document_id", "position"])


def group_texts(grouped: DataFrame) -> DataFrame:
    """(document_id, grp, text): the texts of a group in order, separated by a blank line."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])  # bounded by the group's characters
    return grouped.groupBy("document_id", "grp").agg(F.array_join(listed, "\n\n").alias("text"))


#: Condensed texts that one row joins, and levels of joining, where a combiner is given.
FAN, LEVELS = 256, 2


def map_reduce(
    chunks: DataFrame,
    condense: Callable[[Column], Column],
    reduce_: Callable[[Column], Column],
    separator: str = "\n\n---\n\n",
    max_chars: int = DEFAULT.map_group_chars,
    combine: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(document_id, value): each group condensed, the results joined in order and reduced. A document without chunks has no row.

    ``combine`` shortens the join of consecutive results to what ``reduce_`` needs of it; results are
    then joined ``FAN`` at a time, level by level. Without it ``reduce_`` gets them all in one row.
    """
    partial = group_texts(chunk_groups(chunks, max_chars)).select("document_id", "grp", condense(F.col("text")).alias("p"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("grp", "p"))), lambda x: x["p"])  # FAN condensed texts, or all of a document
    for _ in range(LEVELS if combine else 0):
        joined = partial.groupBy("document_id", F.floor(F.col("grp") / FAN).cast("int").alias("_run")).agg(F.array_join(listed, separator).alias("_all"))
        partial = joined.select("document_id", F.col("_run").alias("grp"), combine(F.col("_all")).alias("p"))
    return partial.groupBy("document_id").agg(F.array_join(listed, separator).alias("_all")).select("document_id", reduce_(F.col("_all")).alias("value"))


def guarded_map_reduce(chunks: DataFrame, condense: Stage, reduce_: Stage, separator: str = "\n\n---\n\n", max_chars: int = DEFAULT.map_group_chars) -> DataFrame:
    """(document_id, value, error) by stages of models: as ``map_reduce``, but a document of which a group cannot be condensed, or whose
    results cannot be reduced, has the first error of these in place of a value, and other documents are as they would be without it.
    """
    partial = group_texts(chunk_groups(chunks, max_chars)).select("document_id", "grp", condense(F.col("text")).alias("r")).select("document_id", "grp", "r.value", "r.error")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("grp", "value"))), lambda x: x["value"])  # all condensed texts of a document
    joined = partial.groupBy("document_id").agg(F.array_join(listed, separator).alias("_all"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("grp"))).alias("_error"))
    made = joined.select("document_id", "_error", reduce_(F.when(F.col("_error").isNull(), F.col("_all"))).alias("r"))
    return made.select("document_id", "r.value", F.coalesce("_error", "r.error").alias("error"))


def model_computer(condense: Stage, reduce_: Stage, separator: str = "\n\n---\n\n", config: Config = DEFAULT) -> Callable[[DataFrame], DataFrame]:
    """A prep kind that is computed by two model stages, for ``prep_results``."""
    return lambda chunks: guarded_map_reduce(chunks, condense, reduce_, separator, config.map_group_chars)


def first_sentences(text: Column, n: int = 2) -> Column:
    """The first sentences of a text; stands in for a condensing model."""
    s = F.filter(F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?])\s"), lambda x: F.length(F.trim(x)) > 0)
    return F.array_join(F.slice(s, 1, n), " ")


def summarize(chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(document_id, value): context, main content, decision points and impact, extracted."""

    def sentences(all_: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(all_, r"(\n\n---\n\n|\s)+", " "), r"(?<=[.!?])\s"), lambda x: F.length(F.trim(x)) > 0)

    def shape(all_: Column) -> Column:
        s = sentences(all_)
        at = lambda k: F.coalesce(F.get(s, k), F.lit(""))
        return F.struct(at(F.lit(0)).alias("context"), F.array_join(F.slice(s, 1, 5), " ").alias("main_content"), F.slice(s, 2, 3).alias("decision_points"), at(F.size(s) - 1).alias("impact"))

    def ends(all_: Column) -> Column:
        """The first six sentences and the last one: the sixth and the last may go on in what is joined next."""
        s = sentences(all_)
        return F.when(F.size(s) > 7, F.array_join(F.concat(F.slice(s, 1, 6), F.slice(s, -1, 1)), " ")).otherwise(all_)

    return map_reduce(chunks, first_sentences, shape, max_chars=config.map_group_chars, combine=ends)


def key_terms(texts: DataFrame, n: int = 10, most: int = 200_000) -> DataFrame:
    """(document_id, term, tf, df, score, rank): the ``n`` terms of each document with the highest tf * ln((1 + N) / (1 + df)).

    Texts are dealt by document, where their words are counted; these counts do not travel. The ``most`` most frequent terms go to all tasks. All others have
    a df between 1 and that of the last of these, so that only terms of a document that may still be among its first ``n`` are joined with theirs.
    """

    def counted(rows: DataFrame) -> DataFrame:
        words = rows.select("document_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9A-Za-zÀ-ỹ]+)"), 1)).alias("term"))
        return words.withColumn("term", F.lower("term")).filter(F.length("term") >= 4).groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("tf"))

    tf, _ = stored_by(texts.select("document_id", "text"), "document_id", counted)
    df = cut(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # so that a merge has two plain shuffles, whose hot terms adaptive execution splits
    total = texts.select("document_id").distinct().count()
    weight = lambda df: F.round(F.col("tf") * F.log((F.lit(total) + 1.0) / (df + 1.0)), 6)
    if is_small(df, most):
        scored = tf.join(F.broadcast(df), "term")
    else:
        first = cut(df.orderBy(F.desc("df"), "term").limit(most))
        rest = first.agg(F.min("df")).first()[0]
        bounds = tf.join(F.broadcast(first), "term", "left").withColumn("low", weight(F.coalesce("df", F.lit(rest)))).withColumn("high", weight(F.coalesce("df", F.lit(1))))
        nth = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("low")))
        least = bounds.select("document_id", "low").withColumn("nth", nth).filter(F.col("nth") <= n).filter(F.col("nth") == n).select("document_id", F.col("low").alias("least"))
        open_ = bounds.hint("merge").join(least.hint("merge"), "document_id", "left").filter(F.col("least").isNull() | (F.col("high") >= F.col("least") - 1e-6))
        open_ = written(open_.select("document_id", "term", "tf", F.col("df").alias("known")))
        others = open_.filter("known is null").select("document_id", "term", "tf").hint("merge").join(df.hint("merge"), "term")
        scored = open_.filter("known is not null").select("document_id", "term", "tf", F.col("known").alias("df")).unionByName(others)
    scored = scored.withColumn("score", weight(F.col("df")))
    w = Window.partitionBy("document_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= n).select("document_id", "term", "tf", "df", "score", "rank")


def explained_terms(chunks: DataFrame, n: int = 10) -> DataFrame:
    """(document_id, value): terms, each with the start of the first chunk that holds it."""
    terms = key_terms(chunks.select("document_id", "text"), n)
    words = F.transform(F.regexp_extract_all("text", F.lit("([0-9A-Za-zÀ-ỹ]+)"), 1), lambda t: F.lower(t))
    # a document's few terms come to its texts, whose words do not travel
    own = terms.groupBy("document_id").agg(F.collect_list(F.struct("rank", "term")).alias("terms"))  # n at most
    rows = chunks.filter("position is not null").select("document_id", "position", "text").hint("merge").join(own.hint("merge"), "document_id")
    rows = rows.select("document_id", "position", first_sentences(F.col("text"), 1).alias("explanation"), F.array_distinct(words).alias("words"), "terms")
    found = rows.select("document_id", "position", "explanation", F.explode(F.filter("terms", lambda t: F.array_contains("words", t["term"]))).alias("t"))
    first = found.groupBy("document_id", "t.term", "t.rank").agg(F.min(F.struct("position", "explanation"))["explanation"].alias("explanation"))
    entry = F.array_sort(F.collect_list(F.struct("rank", "term", "explanation")))  # n at most
    return first.groupBy("document_id").agg(F.transform(entry, lambda x: F.struct(x["term"].alias("term"), x["explanation"].alias("explanation"))).alias("value"))


def template_questions(chunks: DataFrame, n: int = 5) -> DataFrame:
    """(document_id, value): questions about a document's key terms."""
    entry = F.array_sort(F.collect_list(F.struct("rank", "term")))  # n at most
    return key_terms(chunks.select("document_id", "text"), n).groupBy("document_id").agg(F.transform(entry, lambda x: F.concat(F.lit("What does the document say about "), x["term"], F.lit("?"))).alias("value"))


COMPUTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"summary": summarize, "terms": explained_terms, "questions": template_questions}


def prep_packs(documents: DataFrame, prep: DataFrame) -> DataFrame:
    """Documents with their prep pack; a kind is null until it is computed."""
    return documents.select("document_id", "filename").join(prep.select("document_id", *KINDS), "document_id", "left")


def prep_pending(documents: DataFrame, prep: DataFrame) -> DataFrame:
    """(document_id, kind) still to be computed; an empty value counts as computed."""
    packs = prep_packs(documents, prep)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).isNull().alias("open")) for k in KINDS]))
    return packs.select("document_id", kinds.alias("x")).filter("x.open").select("document_id", "x.kind")


def upsert_prep(prep: DataFrame, updates: DataFrame) -> DataFrame:
    """The prep table (document_id, summary, terms, questions as text) with updates (document_id, kind, value) put in; other kinds stay."""
    bad = updates.filter(~F.col("kind").isin(*KINDS)).limit(1).collect()
    if bad:
        raise ValueError(f"unknown kind: {bad[0]['kind']!r}")
    new = updates.groupBy("document_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"_{k}") for k in KINDS])
    rows = prep.hint("merge").join(new, "document_id", "full_outer")
    return rows.select("document_id", *[F.coalesce(f"_{k}", k).alias(k) for k in KINDS])


def prep_outcomes(results: DataFrame) -> DataFrame:
    """(document_id, summary, terms, questions): fulfilled or rejected, from results (document_id, kind, value, error)."""
    state = F.when(F.col("error").isNull(), "fulfilled").otherwise("rejected")
    return results.groupBy("document_id").agg(*[F.max(F.when(F.col("kind") == k, state)).alias(k) for k in KINDS])


def prep_results(documents: DataFrame, chunks: DataFrame, prep: DataFrame, computers: dict = COMPUTERS) -> DataFrame:
    """(document_id, kind, value, error) of all pending kinds: a value as JSON, or why there is none.

    Kinds are computed apart: one that fails leaves an error for its documents and the others as they are. A computer whose
    result has a column ``error``, as those of ``model_computer``, tells for each document whether it failed, and why. A document
    without text has an error, too.
    """
    out = None
    for kind in KINDS:
        open_ = cut(prep_pending(documents, prep).filter(F.col("kind") == kind).select("document_id"))
        error = "document has no text yet"
        try:
            made = computers[kind](chunks.hint("merge").join(open_, "document_id", "left_semi"))
            own = F.col("error") if "error" in made.columns else F.lit(None).cast("string")
            made = written(made.select("document_id", F.when(own.isNull(), F.to_json(F.struct("value"))).alias("value"), own.alias("own")))
        except Exception as e:  # of a computer, while it plans or runs
            made, error = open_.select("document_id", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("own")), (str(e) or type(e).__name__)[:300]
        rows = open_.hint("merge").join(made, "document_id", "left")
        rows = rows.select("document_id", F.lit(kind).alias("kind"), "value", F.when(F.col("value").isNull(), F.coalesce("own", F.lit(error))).alias("error"))
        out = rows if out is None else out.unionByName(rows)
    return out


def generate_prep(documents: DataFrame, chunks: DataFrame, prep: DataFrame, computers: dict = COMPUTERS) -> DataFrame:
    """The prep table after all pending kinds of all documents have been computed; kinds that failed stay pending."""
    made = prep_results(documents, chunks, prep, computers).filter("error is null")
    return upsert_prep(prep, made.select("document_id", "kind", "value"))


def pack_counts(prep: DataFrame) -> DataFrame:
    """(document_id, n_terms, n_questions) of a prep table with arrays; null while a kind is absent."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("int")
    return prep.select("document_id", size("terms").alias("n_terms"), size("questions").alias("n_questions"))
