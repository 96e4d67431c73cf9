"""Model stages: batches, order, errors as values, and map-reduce through them."""

import pytest
from pyspark.sql import functions as F

from docgrid.operators import models, retrieval, stages


def test_answers_in_batches_of_like_size():
    seen = []

    def model(rows):
        seen.append(list(rows))
        return [r.upper() for r in rows]

    rows = ["ccc", "a", "dddd", "bb", "e"]
    assert stages.answers(model, rows, [len(r) for r in rows], 2) == (["CCC", "A", "DDDD", "BB", "E"], [None] * 5)
    assert seen == [["a", "e"], ["bb", "ccc"], ["dddd"]]


def test_answers_keep_errors_to_their_rows():
    def model(rows):
        if "bad" in rows:
            raise ValueError("x" * 1000)
        return rows if "odd" not in rows else rows[:-1]

    values, errors = stages.answers(model, ["a", "bad", "b", "odd"], [1, 1, 1, 1])
    assert values == ["a", None, "b", None] and errors == [None, "x" * 300, None, "the model gave 0 answers to 1 rows"]


def test_stage_columns(spark):
    """Several columns, nested values, nulls, ties, an empty table; a model is loaded once for all rows of a worker."""
    def load():
        state = {"loads": 0, "calls": 0}
        state["loads"] += 1

        def model(rows):
            state["calls"] += 1
            assert len(rows) <= 32
            return [{"n": len(t) + (k or 0), "l": [h["role"] for h in hs]} if t != "bad" else 1 / 0 for t, k, hs in rows]

        return model

    made = stages.stage(load, "struct<n:int,l:array<string>>")
    schema = "id int, t string, k int, h array<struct<role:string,n:int>>"
    rows = [(i, [None, "", "bad", "text"][i % 4], None if i % 3 else i, [("u", 1)] * (i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {r.id: r.x for r in df.select("id", made("t", "k", "h").alias("x")).collect()}
    for i, t, k, h in rows:
        assert got[i].error == ("division by zero" if t == "bad" else None)
        assert (got[i].value is None) == (t in (None, "bad"))
        if got[i].value:
            assert (got[i].value.n, got[i].value.l) == (len(t) + (k or 0), ["u"] * len(h))
    assert df.limit(0).select(made("t", "k", "h")).count() == 0


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}.{uuid.uuid4().hex}", "w").close()
        return lambda rows: rows

    made = stages.stage(load, "string")
    df = spark.range(500).select(F.col("id").cast("string").alias("t")).repartition(20)
    for _ in range(2):
        assert df.select(made("t")["value"].alias("v")).agg(F.sum(F.col("v").cast("int"))).first()[0] == 499 * 250
    workers = [p.name.split(".")[0] for p in tmp_path.iterdir()]
    assert len(workers) == len(set(workers)) <= 20


def test_load_that_raises(spark):
    def load():
        raise OSError("no weights")

    made = stages.stage(load, "double")
    got = spark.createDataFrame([("a",), (None,)], "t string").select(made("t").alias("x")).collect()
    assert [(r.x.value, r.x.error) for r in got] == [(None, "no weights"), (None, None)]


def test_rerank_with_a_scorer_that_raises(spark):
    def load():
        def score(rows):
            if any(t == "bad" for _, t in rows):
                raise ValueError
            return [float(len(t)) for _, t in rows]

        return score

    rows = spark.createDataFrame([(1, "q", "a", 0), (1, "q", "ccc", 1), (2, "q", "a", 0), (2, "q", "bad", 1), (2, "q", "ccc", 2)], "question_id int, question string, text string, ord int")
    got = retrieval.rerank(rows, stages.values_of(stages.stage(load, "double")), 2).orderBy("question_id", "ord").collect()
    assert [(r.question_id, r.text, r.rerank_score) for r in got] == [(1, "ccc", 3.0), (1, "a", 1.0), (2, "a", None), (2, "bad", None)]


def test_map_reduce_with_errors(spark):
    """Errors of the first group that has one, of the reducer, none; groups stay in order."""
    def load():
        return lambda texts: [t[0] if "!" not in t else int(t) for t in texts]

    def load_reducer():
        return lambda texts: [t if "z" not in t else {}[t] for t in texts]

    rows = [(d, k, t * 3) for d, ts in {"a": "bcd", "b": "x!y", "c": "wzv", "d": "e"}.items() for k, t in enumerate(ts)]
    chunks = spark.createDataFrame(rows, "document_id string, position int, text string").repartition(3)
    made = models.guarded_map_reduce(chunks, stages.stage(load, "string"), stages.stage(load_reducer, "string"), "+", 3)
    got = {r.document_id: (r.value, r.error) for r in made.collect()}
    assert got["a"] == ("b+c+d", None) and got["d"] == ("e", None)
    assert got["b"][0] is None and "invalid literal" in got["b"][1] and got["c"] == (None, "'w+z+v'")


def test_rewrites_need_vectors(spark):
    q = spark.createDataFrame([(1, "d", "x")], "question_id int, document_id string, question string")
    with pytest.raises(ValueError, match="embed"):
        retrieval.retrieve_reranked(q, q, None, rewriter=lambda c: c)


def test_rewrite_by_history(spark):
    q = spark.createDataFrame([(1, "and why"), (2, "and why"), (3, "boom")], "session_id int, question string")
    turns = spark.createDataFrame([(1, 1, "assistant", "second"), (1, 0, "user", "first"), (3, 0, "user", "x")], "session_id int, sort_order int, role string, content string")

    def load():
        return lambda rows: [f"{h[0]['content']} {q}" if q != "boom" else 1 / 0 if h else q for q, h in rows if h or q != "x"] if all(h for _, h in rows) else [1 / 0]

    asked = models.with_history(q, turns)
    assert {r.session_id: [(t.role, t.content) for t in r.history] for r in asked.collect()} == {1: [("user", "first"), ("assistant", "second")], 2: [], 3: [("user", "x")]}
    got = models.rewrite(asked, stages.values_of(stages.stage(load, "string"))).collect()
    assert {r.session_id: r.question for r in got} == {1: "first and why", 2: "and why", 3: "boom"}
