"""Substring dedup against a plain search for equal windows."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from docgrid.llm import substrings as S

SCHEMA = "doc_id long, text string, words string, block int, held string"


def plain(rows, window):
    """(id, n_words, removed runs, kept text) of each row."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = defaultdict(lambda: float("inf"))
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[s : s + window])
                first[key] = min(first[key], i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        edges = [k for k in range(len(w) + 1) if (k < len(w) and gone[k]) != (k > 0 and gone[k - 1])]
        out.append((i, len(w), list(zip(edges[::2], edges[1::2], strict=True)), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA).repartition(3)
    return sorted([(r.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], r.text) for r in S.remove_repeats(df, **more).collect()], key=str)


def cases(seed, n=60):
    """Texts of few words, with copies, shared passages, runs of one word, and odd rows."""
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "é", "日本", "c"])
    passage = [" ".join(word() for _ in range(r.randrange(5, 30))) for _ in range(4)]
    texts = [r.choice(["", " ", "\t"]).join([" ".join(word() for _ in range(r.randrange(0, 40))), " " + r.choice(passage) + "\n", "a " * r.randrange(0, 30)]) for _ in range(n)]
    rows = [(r.randrange(-20, 40) if r.random() < 0.9 else None, t if r.random() < 0.95 else None) for t in texts]
    rows += [(r.randrange(100), rows[k][1]) for k in range(20)] + [rows[0]] * 3 + [(2**63 - 1, texts[1]), (-(2**63), texts[2]), (5, ""), (6, " \x0b\x0c")]
    return rows


@pytest.mark.parametrize("seed,window,m,block,most", [(1, 6, 3, 500, 4096), (2, 6, 3, 500, 1), (3, 5, 5, 10_000_000, 3), (4, 9, 1, 1, 2), (5, 1, 1, 300, 4096), (6, 8, 2, 2000, 0)])
def test_equals_plain_search(spark, seed, window, m, block, most):
    """With few and many strings of a minimiser, with small and large blocks; ``most=0`` has Spark aggregate all windows."""
    rows = cases(seed)
    assert run(spark, rows, window=window, m=m, block_bytes=block, most=most) == plain(rows, window)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_nothing_repeats(spark):
    rows = [(k, " ".join(f"{k}w{i}" for i in range(70))) for k in range(5)]
    assert run(spark, rows) == plain(rows, 50)


def test_hot_text_and_passage(spark):
    """A third of the rows are one text; a passage of over 50 words stands between different words."""
    r = random.Random(7)
    new = lambda n: " ".join(str(r.randrange(10**9)) for _ in range(n))
    one, passage = new(120), new(55)
    rows = [(k, one if k % 3 == 0 else f"{new(20)} {passage} {new(30)}" if k % 3 == 1 else new(80)) for k in range(240)]
    want = plain(rows, 50)
    assert run(spark, rows, block_bytes=4000) == want
    assert run(spark, rows, block_bytes=4000, most=20) == want


def test_long_text(spark):
    """Two million words, of which a part stands in another text, and a long run of one word."""
    r = random.Random(8)
    long = [str(r.randrange(10**6)) for _ in range(1_000_000)]
    rows = [(1, " ".join(long[500_000:500_100])), (2, " ".join(long)), (3, "x " * 400_000), (4, "x " * 60)]
    got = {i: (n, spans, len(t.split())) for i, n, spans, t in run(spark, rows)}
    assert got == {1: (100, [], 100), 2: (1_000_000, [(500_000, 500_100)], 999_900), 3: (400_000, [], 400_000), 4: (60, [(0, 60)], 0)}


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 100, 200)
    for w in (1, 2, 3, 7, 8, 43, 200):
        assert S.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = "doc_id, n_words, n_removed, kept_sha256"
    want = sorted(con.sql(f"SELECT {cols} FROM ({S.OP11_SQL})").fetchall())
    got = sorted(tuple(r) for r in S.op11_substring_dedup(spark, sf).select(*cols.split(", ")).collect())
    assert got == want and sum(r[2] for r in got) > 0
    assert next(r[3] for r in got if r[1] == r[2]) == hashlib.sha256().hexdigest()
