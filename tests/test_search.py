"""Blocked vector search and the block-max index against plain sums over all pairs."""

import math
import random

import pytest
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from docgrid.operators import index, retrieval
from docgrid.operators.dense import block_scores


def cosine(a, b):
    if len(a) != len(b) or None in a or None in b:
        return None
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else None


def vectors(r):
    """Of few values, so that scores tie; some without length, of another length, with a null in them, or none at all."""
    kind = r.random()
    if kind < 0.05:
        return None
    v = [float(r.randrange(-1, 3)) for _ in range(3 if kind > 0.15 else 2)]
    return [None, *v[1:]] if 0.05 < kind < 0.1 else [0.0] * 3 if kind > 0.95 else v


@pytest.mark.parametrize("small,part,most_questions", [(True, 1, 1), (False, 7, 3), (False, 32_768, 1024)])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_dense_equals_all_pairs(spark, small, part, most_questions, k):
    r = random.Random(k + part)
    q = [(i, r.choice(["a", "b", "c", "d", None]), vectors(r)) for i in range(25)]
    c = [(r.choice(["a", "a", "b", "c", None, "e"]), i, vectors(r)) for i in range(150)]
    questions = spark.createDataFrame(q, "question_id int, document_id string, embedding array<float>")
    chunks = spark.createDataFrame(c, "document_id string, chunk_id long, embedding array<float>").repartition(3)
    got = {}
    for x in retrieval._ranked(block_scores(questions, chunks, k, small, part, most_questions), k).collect():
        got.setdefault(x.question_id, {})[x.rank] = (x.chunk_id, x.score)
    want = {}
    for i, d, v in q:
        pairs = [(j, cosine(v, u)) for e, j, u in c if d and e == d and v is not None and u is not None]
        pairs.sort(key=lambda p: (p[1] is None, -(p[1] or 0), p[0]))
        if pairs:
            want[i] = {n: p for n, p in enumerate(pairs[:k])}
    assert {i: {n: p[0] for n, p in v.items()} for i, v in got.items()} == {i: {n: p[0] for n, p in v.items()} for i, v in want.items()}
    for i, v in want.items():
        assert all((got[i][n][1] is None) == (s is None) and (s is None or abs(got[i][n][1] - s) < 2e-9) for n, (_, s) in v.items())


def test_dense_of_nothing(spark):
    q = spark.createDataFrame([], "question_id int, document_id string, embedding array<float>")
    c = spark.createDataFrame([("a", 1, [1.0])], "document_id string, chunk_id long, embedding array<float>")
    for small in (True, False):
        assert block_scores(q, c, 3, small).count() == 0
        assert block_scores(q.union(spark.createDataFrame([(1, "a", [1.0])], q.schema)), c.limit(0), 3, small).count() == 0


def test_dense_few_questions_shuffle_no_vectors(spark, sf):
    from docgrid.plans import views as V

    plan = block_scores(V.questions(spark, sf), V.table(spark, sf, "embeddings").selectExpr("'src1' AS document_id", "vec_id AS chunk_id", "embedding"), 5, True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def corpus(spark, seed, n=300):
    r = random.Random(seed)
    stems = ["con", "cont", "contract", "thuế", "thuê", "tax", "taxes", "lawful", "law", "ab", "a"]
    rare = [f"rare{i}" for i in range(30)]
    rows = []
    for i in range(n):
        text = " ".join(r.choices(stems, weights=[1 / (k + 1) for k in range(len(stems))], k=r.randrange(3, 30)) + ([r.choice(rare)] * r.randrange(1, 6) if r.random() < 0.1 else []))
        rows.append((r.choice(["x", "y"]), i, i if r.random() < 0.95 else None, text if r.random() < 0.95 else None))
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id long, position int, text string").repartition(4)
    asked = [(k, r.choice(["x", "y", "z"]), t) for k, t in enumerate(["contract law", "rare1 rare2", "rare", "tax", "thuế", "là gì", None, "", "CON con cont", *rare])]
    return spark.createDataFrame(asked, "question_id int, document_id string, question string"), chunks


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("k,block", [(1, 2), (3, 5), (500, 64)])
def test_index_equals_scan(spark, tmp_path, small, k, block):
    questions, chunks = corpus(spark, k)
    index.write_index(chunks, str(tmp_path / "index"), block=block)
    made = index.read_index(spark, str(tmp_path / "index"))
    want = {tuple(x) for x in retrieval.lexical_topk(questions, chunks, k).collect()}
    assert {tuple(x) for x in retrieval.index_topk(questions, made, k, small=small).collect()} == want and want
    told = index.index_scores(questions, made, k, small=small)[1].collect()
    if k == 1:
        left = [x for x in told if not x.scored]
        assert left, "no block was left out"
        best = {x.question_id: x.score for x in retrieval.lexical_topk(questions, chunks, 1).collect()}
        assert all(x.bound < best[x.question_id] for x in left)


def test_index_search_reads_no_text(spark, tmp_path):
    questions, chunks = corpus(spark, 9)
    index.write_index(chunks, str(tmp_path / "index"))
    made = index.read_index(spark, str(tmp_path / "index"))
    plan = retrieval.index_topk(questions, made, 5)._jdf.queryExecution().toString()
    assert "text" not in plan and set(made.postings.columns) == {"document_id", "term", "head", "block", "top", "entries"}


def test_index_of_nothing(spark, tmp_path):
    questions, chunks = corpus(spark, 9)
    index.write_index(chunks.limit(0), str(tmp_path / "index"))
    assert retrieval.index_topk(questions, index.read_index(spark, str(tmp_path / "index")), 5).count() == 0


def test_hybrid_with_index(spark, tmp_path):
    questions, chunks = corpus(spark, 4)
    r = random.Random(1)
    embed = lambda df, by: spark.createDataFrame([(*x, [r.random(), r.random()]) for x in sorted(df.collect(), key=lambda x: x[by])], StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))]))
    questions, chunks = embed(questions, "question_id"), embed(chunks.filter("position is not null"), "chunk_id")
    index.write_index(chunks, str(tmp_path / "index"))
    made = index.read_index(spark, str(tmp_path / "index"))
    plain = sorted(map(tuple, retrieval.hybrid_retrieval(questions, chunks, 5).collect()))
    assert sorted(map(tuple, retrieval.hybrid_retrieval(questions, chunks, 5, index=made).collect())) == plain and plain


def test_few_questions_do_not_gather_terms(spark, tmp_path):
    """The terms that match prefixes are as many as the index has; few questions are answered without a table of them."""
    from pyspark.sql import functions as F

    questions, chunks = corpus(spark, 5)
    index.write_index(chunks, str(tmp_path / "i"), block=4)
    made = index.read_index(spark, str(tmp_path / "i"))
    unread = made._replace(terms=made.terms.withColumn("term", F.raise_error(F.lit("the dictionary was gathered")).cast("string")))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(retrieval.index_topk(questions, unread, 5, small=True)) == rows(retrieval.index_topk(questions, made, 5, small=False)) != []


def test_index_moves_texts_once_and_no_words(spark):
    plan = index.build_index(corpus(spark, 6)[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_hybrid_with_vectors_apart(spark, sf):
    """Chunks without vectors and vectors without texts give what their join gives; the join with vectors has no text."""
    from docgrid.plans import views as V

    q, apart = V.questions(spark, sf), V.vectors(spark, sf)
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(retrieval.hybrid_retrieval(q, V.chunks(spark, sf), vectors=apart))
    assert got == rows(retrieval.hybrid_retrieval(q, V.chunks(spark, sf, vectors=True))) != []
    assert "text" not in apart.columns


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


def test_few_questions_shuffle_no_words(spark):
    """Texts are dealt by chunk, then only ranks travel; words and their matches stay in the task of their chunk."""
    questions, chunks = corpus(spark, 7)
    found = retrieval.lexical_topk(questions, chunks, 5, small=True)
    moved = [line for line in exchanges(found) if "chunk_id" in line]  # the others deal terms of questions, and ranks
    assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0] and "term" not in moved[0]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found) == rows(retrieval.lexical_topk(questions, chunks, 5, small=False)) != []
    assert len(exchanges(retrieval.term_table(chunks))) == 1


def test_tasks_of_texts_grow_with_them(spark):
    """What a task holds of the texts does not grow with them; repeated rows of a chunk are counted together."""
    chunks = corpus(spark, 8)[1]
    n = spark.sparkContext.defaultParallelism
    tasks = lambda df, size: retrieval.dealt(df, size).rdd.getNumPartitions()
    size = chunks.selectExpr("sum(octet_length(text))").first()[0] // 40
    assert tasks(chunks, 1 << 40) == n and tasks(chunks.limit(0), 1) == n
    assert 40 <= tasks(chunks, size) <= 42 and 80 <= tasks(chunks.union(chunks), size) <= 84
    twice = retrieval.term_table(chunks.union(chunks)).collect()
    assert sorted((x.chunk_id, x.term, x.n) for x in twice) == sorted((x.chunk_id, x.term, 2 * x.n) for x in retrieval.term_table(chunks).collect()) != []
