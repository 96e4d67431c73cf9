"""Tables laid out by join key: the same rows as plain joins, and no shuffle."""

import uuid

import pytest
from pyspark.errors import PySparkException

from docgrid.operators import catalog, chat, retrieval
from docgrid.sources import library as L

SHAPE = L.Shape(4, 8)


@pytest.fixture
def name(spark):
    n = "t" + uuid.uuid4().hex
    yield n
    L.drop_library(spark, n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def some_chunks(spark, sizes, vector=True):
    text = "t" * 40
    data = [(f"{d}::{p}", d, p, text if p % 5 else "short", [1.0] if vector else None) for d, n in sizes.items() for p in range(n)]
    return spark.createDataFrame(data, "chunk_id string, document_id string, position int, text string, embedding array<double>")


def some_documents(spark, ids):
    return spark.createDataFrame([(d, f"{d}.pdf", "pdf", "ready") for d in ids], "document_id string, filename string, doc_type string, status string")


def test_status_sums_batches_without_a_shuffle(spark, name):
    """A document's chunks in two batches, one document without chunks, one with most of them."""
    sizes = {"a": 3, "hot": 500, "b": 9}
    L.add_documents(name, some_documents(spark, ["a", "hot", "none"]), some_chunks(spark, {"a": 3, "hot": 300}), SHAPE)
    L.add_documents(name, some_documents(spark, ["b"]), some_chunks(spark, sizes).filter("document_id = 'b' or (document_id = 'hot' and position >= 300)"), SHAPE)
    found = L.document_status(L.read_library(spark, name, SHAPE))
    assert "Exchange" not in plan(found)
    want = catalog.document_status(some_documents(spark, ["a", "hot", "none", "b"]), catalog.chunk_counts(some_chunks(spark, sizes)))
    assert rows(found) == rows(want)


def test_history_without_a_shuffle(spark, name):
    """Messages in two batches that share blocks, a session with most of them, a null order, and sessions that never spoke."""
    schema = "id string, session_id string, role string, parts array<struct<type:string,text:string>>, metadata string, sort_order int"
    message = lambda s, k: (f"{s}{k}", s, "user", [("text", str(k))], None, k)
    data = [message(s, k) for s, n in {"x": 2, "hot": 200, "y": 17}.items() for k in range(n)] + [message("x", None)]
    sessions = spark.createDataFrame([("x", "d1"), ("hot", "d2"), ("y", "d3"), ("silent", "d4")], "session_id string, document_id string")
    for k in (0, 1):
        L.add_messages(name, sessions, spark.createDataFrame(data[k::2], schema), SHAPE)
    found = L.chat_history(L.read_library(spark, name, SHAPE))
    assert "Exchange" not in plan(found)
    assert rows(found) == rows(chat.chat_history(spark.createDataFrame(data, schema), sessions))


@pytest.mark.parametrize("small", [True, False])
def test_neighbors_leave_chunks_where_they_are(spark, name, small):
    """Hits at both ends of documents; of the chunks only narrow columns are read, and none of them is shuffled."""
    sizes = {"a": 1, "b": 8, "hot": 100}
    chunks = some_chunks(spark, sizes)
    L.add_documents(name, some_documents(spark, sizes), chunks, SHAPE)
    data = [(q, d, p, f"{d}::{p}", k, 0.5) for q, (d, ps) in enumerate({"a": [0], "b": [0, 7], "hot": [7, 8, 15, 16, 99]}.items()) for k, p in enumerate(ps)]
    hits = spark.createDataFrame(data, "question_id int, document_id string, position int, chunk_id string, ord int, score double")
    found = L.with_neighbors(hits, L.read_library(spark, name, SHAPE), small=small)
    lines = plan(found).splitlines()
    at = next(i for i, line in enumerate(lines) if f"{name}_chunks" in line)
    assert "text:string" not in lines[at] and "embedding" not in lines[at]
    join = max(i for i in range(at) if "Join" in lines[i])
    assert not any("Exchange" in line for line in lines[join:at])
    assert rows(found) == rows(retrieval.with_neighbors(hits, chunks, small=small))


def test_a_chunk_without_a_vector_is_an_error(spark, name):
    with pytest.raises(PySparkException, match="no vector"):
        L.add_documents(name, some_documents(spark, ["a"]), some_chunks(spark, {"a": 2}, vector=False), SHAPE)


def test_empty_tables(spark, name):
    L.add_documents(name, some_documents(spark, ["a"]).limit(0), some_chunks(spark, {"a": 1}).limit(0), SHAPE)
    assert L.document_status(L.read_library(spark, name, SHAPE)).count() == 0
    assert L.read_library(spark, name, SHAPE).messages is None
