"""Files to chunks, in batch and as streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from docgrid.config import Config
from docgrid.plans import ingest as I
from docgrid.sources import files as S
from docgrid.streaming import jobs

SMALL = Config(chunk_max_tokens=8, chunk_overlap_tokens=2, chunk_min_chars=3)


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode())


def test_batch(spark, tmp_path):
    put(tmp_path, "a.pdf", "Điều 1\nfirst page text here.\f\nsecond page text.\f")
    put(tmp_path, "b.pdf", "Điều 1\nfirst page text here.\f\nsecond page text.\f")
    put(tmp_path, "c.docx", " \n ")
    put(tmp_path, "bad.pdf", "x")
    (tmp_path / "bad.pdf").write_bytes(b"\xff\xfe\xff")
    files = S.read_files(spark, str(tmp_path)).withColumn("user_id", F.lit("u"))
    documents, chunks = I.ingest(files, config=SMALL)
    got = {r.filename: r for r in documents.collect()}
    assert sorted(r.status for r in got.values()) == ["failed", "failed", "ready", "reused"]
    assert got["c.docx"].error == "no text"
    ready = next(r for r in got.values() if r.status == "ready")
    assert ready.page_count == 2
    rows = chunks.orderBy("position").collect()
    assert {r.document_id for r in rows} == {ready.document_id} and [r.position for r in rows] == list(range(len(rows)))
    assert {r.section for r in rows} == {"Điều 1"} and {r.page for r in rows} == {1, 2}
    assert all(math.isclose(sum(x * x for x in r.embedding), 1, rel_tol=1e-4) for r in rows)


def test_word_files_have_paragraphs_without_pages(spark, tmp_path):
    put(tmp_path, "a.docx", "Điều 1\n\nfirst paragraph of it.\n second one \fwith a feed\nĐiều 2\nlast paragraph here.")
    put(tmp_path, "b.docx", "a")
    seen = []
    files = S.read_files(spark, str(tmp_path)).withColumn("user_id", F.lit(None).cast("string"))
    documents, chunks = I.ingest(files, config=SMALL, on_status=lambda s, ids: seen.append((s, ids.count())))
    got = {r.filename: r for r in documents.collect()}
    assert got["a.docx"].status == "ready" and got["a.docx"].page_count is None
    assert got["b.docx"].status == "failed" and got["b.docx"].error == "no text"
    assert seen == [("parsing", 2), ("embedding", 1)]
    rows = chunks.orderBy("position").collect()
    assert {r.page for r in rows} == {None} and [r.section for r in rows] == ["Điều 1", "Điều 1", "Điều 2"]


def test_every_file_is_read_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for k in range(4):
        put(tmp_path / "in", f"{k}.pdf", f"text number {k} that is long enough")

    def extractor(content, name):
        import uuid

        (log / f"{name}.{uuid.uuid4().hex}").touch()
        if name == "2.pdf":
            raise ValueError("broken")
        return content.decode()

    files = S.read_files(spark, str(tmp_path / "in")).withColumn("user_id", F.lit("u"))
    documents, chunks = I.ingest(files, config=SMALL, extractor=extractor)
    assert sorted((r.filename, r.status, r.error) for r in documents.collect())[2] == ("2.pdf", "failed", "broken")
    assert chunks.select("document_id").distinct().count() == 3
    assert len(list(log.iterdir())) == 4


def test_write_chunks_needs_vectors(spark, tmp_path):
    df = spark.createDataFrame([("d", 0, [1.0]), ("d", 1, None)], "document_id string, position int, embedding array<double>")
    S.write_chunks(df.filter("position = 0"), str(tmp_path / "ok"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1
    with pytest.raises(Exception, match="vector"):
        S.write_chunks(df, str(tmp_path / "no"))


def test_ask(spark):
    chunks = spark.createDataFrame([("d::0", "d", 0, 1, None, "apples grow on old trees in autumn"), ("d::1", "d", 1, 1, None, "ships sail over the northern sea at night")], "chunk_id string, document_id string, position int, page int, section string, text string")
    from docgrid.operators.models import embed_chunks

    q = spark.createDataFrame([(1, "d", "where do ships sail")], "question_id int, document_id string, question string")
    got = I.ask(q, embed_chunks(chunks)).first()
    assert got.context.startswith("[1] (trang 1)\nships sail")


def test_ingest_stream(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    put(source, "a.pdf", "some text of a document, long enough.")
    run = lambda: jobs.ingest_stream(spark, str(source), target, "u", config=SMALL, prep=True).trigger(availableNow=True).start().awaitTermination()
    run()
    put(source, "b.pdf", "some text of a document, long enough.")
    put(source, "c.pdf", "another text altogether.")
    run()
    docs = {r.filename: r.status for r in spark.read.parquet(f"{target}/documents").collect()}
    assert docs == {"a.pdf": "ready", "b.pdf": "reused", "c.pdf": "ready"}
    assert spark.read.parquet(f"{target}/chunks").select("document_id").distinct().count() == 2
    prep = spark.read.parquet(f"{target}/prep")
    assert prep.filter("kind = 'summary' and error is null").count() == 2 and prep.count() == 6
    events = spark.read.parquet(f"{target}/status")
    from docgrid.operators.catalog import illegal_transitions, latest_status

    assert {r.status for r in latest_status(events).collect()} == {"ready"} and events.count() == 8
    assert illegal_transitions(events).count() == 0


def test_prep_of_a_stream_fails_by_document(spark, tmp_path):
    """Of three documents of a batch one cannot be condensed; one kind has no computer that works."""
    from docgrid.operators import models, stages

    for name, text in (("a", "a good text, long enough."), ("b", "a bad text, long enough."), ("c", "another good text here.")):
        put(tmp_path / "in", f"{name}.pdf", text)

    def load():
        def condense(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [t.upper() for t in texts]

        return condense

    def broken(chunks):
        raise RuntimeError("no model")

    made = stages.stage(load, "string")
    computers = {"summary": models.model_computer(made, stages.stage(lambda: lambda texts: texts, "string")), "terms": models.explained_terms, "questions": broken}
    target = str(tmp_path / "out")
    jobs.ingest_stream(spark, str(tmp_path / "in"), target, config=SMALL, prep=True, computers=computers).trigger(availableNow=True).start().awaitTermination()
    names = {r.document_id: r.filename[0] for r in spark.read.parquet(f"{target}/documents").collect()}
    got = {(names[r.document_id], r.kind): r.error for r in spark.read.parquet(f"{target}/prep").collect()}
    assert got == {(d, k): "no model" if k == "questions" else "bad text" if (d, k) == ("b", "summary") else None for d in "abc" for k in models.KINDS}
    assert spark.read.parquet(f"{target}/documents").filter("status = 'ready'").count() == 3


def test_status_and_trace_streams(spark, tmp_path):
    events, traces = tmp_path / "events", tmp_path / "traces"
    put(events, "1.json", "\n".join(json.dumps({"document_id": d, "seq": s, "status": t}) for d, s, t in [("a", 1, "pending"), ("a", 3, "ready"), ("a", 2, "parsing"), ("b", 1, "failed")]))
    stream = spark.readStream.schema("document_id string, seq long, status string").json(str(events))
    q = jobs.status_stream(stream).writeStream.outputMode("complete").format("memory").queryName("statuses").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.document_id, r.status, r.terminal) for r in spark.table("statuses").collect()} == {("a", "ready", True), ("b", "failed", True)}
    put(traces, "1.json", "\n".join(json.dumps({"name": n, "latencyMs": ms, "usage": {"input": 1, "output": 2}}) for n, ms in [("x", 5), ("x", 9), (None, 7)]))
    q = jobs.trace_stream(spark, str(traces)).writeStream.outputMode("complete").format("memory").queryName("traced").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.name, r.n, r.max_ms, r.tok_out) for r in spark.table("traced").collect()} == {("x", 2, 9, 4), ("llm-call", 1, 7, 2)}
    S.write_traces(S.read_traces(spark, str(traces)), str(tmp_path / "copy"))
    assert S.read_traces(spark, str(tmp_path / "copy")).count() == 3


def test_eval_chunks(spark, tmp_path):
    put(tmp_path, "chunks.jsonl", json.dumps({"doc_id": "d", "position": 4, "page": 1, "section": None, "text": "t"}))
    assert S.read_eval_chunks(spark, str(tmp_path)).first().key == "d::4"


def test_packs_are_ingested_as_files_are(spark, tmp_path):
    """Many small files in packs: what a folder of them gives, in a batch and by a stream of two batches."""
    for k in range(6):
        put(tmp_path / "in", f"{k}.pdf", f"some text of document {k % 4}, long enough.")
    raw = spark.read.format("binaryFile").load(str(tmp_path / "in")).repartition(2, "path")
    S.write_packs(raw, str(tmp_path / "packs"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(S.read_packs(spark, str(tmp_path / "packs"))) == rows(S.read_files(spark, str(tmp_path / "in")))
    target = str(tmp_path / "out")
    jobs.ingest_stream(spark, str(tmp_path / "packs"), target, "u", packed=True, files_per_batch=1, config=SMALL).trigger(availableNow=True).start().awaitTermination()
    documents = spark.read.parquet(f"{target}/documents")
    assert sorted(r.status for r in documents.collect()) == ["ready"] * 4 + ["reused"] * 2
    assert documents.select("batch").distinct().count() == 2


def test_bytes_reach_python_in_small_batches(spark):
    from docgrid.operators import models
    from docgrid.shared import BATCH_ROWS

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    S.extract_texts(spark.createDataFrame([], "document_id string, filename string, content binary"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(BATCH_ROWS)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    models.embed_chunks(spark.createDataFrame([], "text string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(BATCH_ROWS)
