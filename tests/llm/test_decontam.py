"""Benchmark search against alignment of every item with every text."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgrid.llm import decontam as D


def planted(seed=4, n_items=12):
    r = random.Random(seed)
    common = ["the", "of", "and", "to"]
    word = lambda: r.choice(common) if r.random() < 0.4 else "".join(r.choice("abcdefg") for _ in range(5))
    items = [" ".join(word() for _ in range(r.randint(6, 55))) for _ in range(n_items)]
    docs, where = [], []
    for k, item in enumerate(items):
        for edits in range(0, int(0.1 * len(item.split())) + 1):
            w = item.split()
            for _ in range(edits):
                p, what = r.randrange(len(w)), r.random()
                if what < 0.4:
                    w[p] = "edited"
                elif what < 0.7:
                    del w[p]
                else:
                    w.insert(p, "added")
            text = [word() for _ in range(r.randint(0, 120))] + [x.upper() if r.random() < 0.2 else x for x in w] + [word() for _ in range(r.randint(0, 120))]
            docs.append(" ".join(text))
            where.append(k)
    docs += [" ".join(word() for _ in range(300)) for _ in range(20)]
    return items, docs, where


def distance(item, text):
    """Least number of word edits between an item and any part of a text, column by column."""
    column = list(range(len(item) + 1))
    best = column[-1]
    for w in text:
        corner, column[0] = column[0], 0
        for i, x in enumerate(item, 1):
            corner, column[i] = column[i], min(corner + (x != w), column[i] + 1, column[i - 1] + 1)
        best = min(best, column[-1])
    return best


def brute(items, docs, rate=0.2):
    low = lambda t: [w.lower() for w in t.split()]
    out = {}
    for d, text in enumerate(docs):
        for k, item in enumerate(items):
            edits = distance(low(item), low(text))
            if edits <= int(rate * len(low(item))):
                out[d, k] = edits
    return out


def test_search_against_all_alignments(spark):
    items, docs, where = planted()
    want = brute(items, docs)
    for k, item in enumerate(where):
        assert (k, item) in want
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block_bytes, blocks in ((10**7, 8), (200, 3)):
        rows = D.contamination(df, bench, block_bytes=block_bytes, blocks=blocks).select("doc_id", F.explode("matches").alias("m")).collect()
        got = {(r.doc_id, r.m.item_id): r.m.edits for r in rows}
        assert set(got) <= set(want)
        assert len(got) >= 0.95 * len(want)
        assert all((k, item) in got for k, item in enumerate(where))  # up to a tenth of the words edited: all of them
        assert sum(got[x] == want[x] for x in got) >= 0.95 * len(got)


def test_spans_and_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, None, "m"), (2, "", "m"), (3, "w0", "m"), (None, "x y " + item + " z", "m"), (None, "x y " + item + " z", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    bench = spark.createDataFrame([(7, item), (None, item), (8, None), (9, " ")], "item_id long, text string")
    got = {r.doc_id: r.matches for r in D.contamination(df, bench).collect()}
    assert got[1] == got[2] == got[3] == []
    assert sorted((str(m.item_id), m.start, m.end, m.edits) for m in got[None]) == [("7", 2, 22, 0), ("None", 2, 22, 0)]
    assert D.contamination(df, bench.limit(0)).filter(F.size("matches") > 0).count() == 0
    assert D.contamination(df.limit(0), bench).count() == 0


def test_query_finds_passages(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    flat = lambda t: " " + " ".join(t.lower().split()) + " "
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if flat(x) in flat(t)}
    got = {(r.doc_id, r.item_id): r for r in D.op3_decontamination(spark, sf).collect()}
    assert exact and exact <= set(got)
    for (d, i), r in got.items():
        part = docs[d].lower().split()[r.start_word : r.end_word]
        assert distance(items[i].lower().split(), part) == r.edits


@pytest.mark.parametrize("n", [50, 200, 400])
@pytest.mark.parametrize("rate", [0.1, 0.15, 0.2])
def test_recall_of_long_items(n, rate):
    """Items with words replaced at even rates, placed in other words; alignment is left out, as it decides no less."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items, docs = [[word() for _ in range(n)] for _ in range(60)], []
    for item in items:
        w = list(item)
        for p in r.sample(range(n), int(rate * n)):
            w[p] = word()
        docs.append(" ".join([word() for _ in range(30)] + w + [word() for _ in range(30)]))
    index = D.Index(list(range(60)), [" ".join(x) for x in items])
    index.verify = lambda item, *_: {"item_id": item}
    got = index.search(pa.array(docs, pa.large_string()))
    assert sum({"item_id": k} in hits for k, hits in enumerate(got)) >= 59


def test_long_item_is_verified_whole():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(200)]
    index = D.Index([7], [" ".join(item)])
    # all edits before the last piece, which is the only one left whole
    gone, added = item[38:], [word() for _ in range(38)] + item
    far = [word() for _ in range(5)] + item[:60] + [word() for _ in range(140)]
    texts = [" ".join([word() for _ in range(50)] + w + [word() for _ in range(50)]) for w in (item, gone, added, far)] + [" ".join(item[39:])]
    got = index.search(pa.array(texts, pa.large_string()))
    assert [[h["edits"] for h in hits] for hits in got] == [[0], [38], [0], [], [39]]
    assert got[0][0] == {"item_id": 7, "start": 50, "end": 250, "edits": 0}


def test_very_long_text(spark):
    r = random.Random(6)
    item = [f"i{k}" for k in range(30)]
    text = [f"w{r.randrange(9000)}" for _ in range(400_000)]
    text[250_000:250_030] = [*item[:12], "edited", *item[13:]]
    df = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    (m,) = D.contamination(df, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).first().matches
    assert (m.item_id, m.start, m.end, m.edits) == (5, 250_000, 250_030, 1)


def test_index_of_nothing():
    assert D.Index([], []).search(pa.array(["a b", None])) == [[], []]
