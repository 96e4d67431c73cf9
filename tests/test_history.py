"""The history of earlier batches: filters, buckets, and blobs that are kept once."""

import hashlib

from pyspark.sql import functions as F

from docgrid.operators import history as H

SCHEMA = "content_hash string, document_id string"


def sha(k):
    return hashlib.sha256(str(k).encode()).hexdigest()


def test_filters_know_all_that_they_hold():
    held = [sha(k) for k in range(3000)]
    bits = H.filter_bits(held)
    assert all(H.may_hold([bits] * len(held), held))
    others = [sha(-k) for k in range(1, 20_001)]
    assert sum(H.may_hold([bits] * len(others), others)) < 20_000 / 200
    assert H.may_hold([H.filter_bits([sha(1)])] * 2, [sha(1), sha(2)]) == [True, False]


def batch(spark, ks):
    return spark.createDataFrame([(sha(k) if k is not None else None, f"d{k}") for k in ks], SCHEMA)


def test_recall_reads_what_may_match(spark, tmp_path):
    path = str(tmp_path / "h")
    assert H.recall(batch(spark, [1]), path, SCHEMA).count() == 0
    H.remember(batch(spark, [*range(0, 300), None, 5]), path, 0)
    H.remember(batch(spark, range(300, 600)), path, 1)
    asked = batch(spark, [7, 7, 310, 9999, None])
    got = H.recall(asked, path, SCHEMA)
    names = {f.split("/rows/")[1].rsplit("/", 1)[0] for f in got.inputFiles()}
    must = {f"batch=0/bucket={sha(7)[:2]}", f"batch=1/bucket={sha(310)[:2]}"}
    assert must <= names and len(names) <= 4  # of hundreds of buckets
    found = {r.document_id for r in got.join(asked.select("content_hash"), "content_hash", "left_semi").collect()}
    assert found == {"d7", "d310"}
    # the batch itself is left out, and writing it again replaces it
    assert {n for n, _ in H.touched(asked, path, 1)} == {0}
    H.remember(batch(spark, [310]), path, 0)
    assert H.recall(batch(spark, [7]), path, SCHEMA).join(batch(spark, [7]).select("content_hash"), "content_hash").count() == 0
    assert H.recall(batch(spark, [310]), path, SCHEMA, 0).count() >= 1


def test_nothing_to_remember(spark, tmp_path):
    path = str(tmp_path / "h")
    H.remember(batch(spark, []), path, 0)
    assert H.recall(batch(spark, [1]), path, SCHEMA).count() == 0 and H.touched(batch(spark, []), path) == []


def test_blobs_are_kept_once(spark, tmp_path):
    path = str(tmp_path / "b")
    files = lambda rows: spark.createDataFrame(rows, "filename string, uploaded_at int, content binary").withColumn("size_bytes", F.length("content").cast("long")).withColumn("content_hash", F.sha2("content", 256))
    H.store_blobs(files([("a.pdf", 2, b"x"), ("b.PDF", 1, b"x"), ("c.docx", 1, b"x"), ("d.pdf", 1, b"y")]), path, 0)
    H.store_blobs(files([("e.pdf", 1, b"x"), ("f.pdf", 1, b"z")]), path, 1)
    H.store_blobs(files([("e.pdf", 1, b"x"), ("f.pdf", 1, b"z")]), path, 1)
    h = {c: hashlib.sha256(c).hexdigest() for c in (b"x", b"y", b"z")}
    got = sorted((r.blob_key, bytes(r.content)) for r in H.read_blobs(spark, path).collect())
    assert got == sorted([(f"{h[b'x']}.pdf", b"x"), (f"{h[b'x']}.docx", b"x"), (f"{h[b'y']}.pdf", b"y"), (f"{h[b'z']}.pdf", b"z")])
    assert H.read_blobs(spark, str(tmp_path / "none")).count() == 0
