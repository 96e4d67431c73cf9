"""Suffix dedup against a table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrid.llm import suffixes as S


def brute(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        mark = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                mark[i : i + least] = b"\1" * least
        spans, at = [], 0
        while (s := mark.find(1, at)) >= 0:
            e = mark.find(0, s)
            at = e if e >= 0 else len(r)
            spans.append((s, at))
            if e < 0:
                break
        out.append(spans)
    return out


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = {}
    for d, spans in zip(docs, brute([d.text for d in docs], 200), strict=True):
        raw = (d.text or "").encode()
        rest = S.cut_spans(raw, [{"start": s, "end": e} for s, e in spans])
        want[d.doc_id] = (len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(rest).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op7_suffix_dedup(spark, sf).collect()}
    assert got == want
    assert sum(x[1] for x in got.values()) > 10_000


@pytest.mark.parametrize("range_rows", [40_000, 3])
def test_hard_cases(spark, range_rows):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abé\n ") for _ in range(n))
    passage, other = word(300), word(260)
    texts = [None, "", "short", "x" * 1000, passage, word(50) + passage + word(70), passage[:210] + word(40), word(20) + passage[-205:]]
    texts += [word(90) + other + word(3) + passage[40:260], other * 2, word(400), "same" * 80, "same" * 80, "same" * 80, passage[1:]]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "hi long, text string, spans string").repartition(3)
    keys = {S.key_of((t or "").encode()): i for i, t in enumerate(texts)}
    found = S.repeated_spans(docs, range_rows=range_rows).collect()
    got = {keys[x.hi, x.lo]: [(s.start, s.end) for s in x.spans] for x in found}
    want = {keys[S.key_of((t or "").encode())]: s for t, s in zip(texts, brute(texts, 200), strict=True) if s}
    assert got == want
    rest = S.remaining(docs, S.repeated_spans(docs)).collect()
    assert {keys[x.hi, x.lo] for x in rest} == set(want)


@pytest.mark.parametrize("range_rows", [40_000, 5])
def test_one_block_in_many_surroundings(spark, range_rows):
    """A passage that many texts hold in part, so that its block has many surroundings, cut over many ranges."""
    r = random.Random(7)
    letters = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    core = letters(230)
    texts = [letters(r.randint(0, 60)) + core[r.randint(0, 40) : r.randint(180, 230)] + letters(r.randint(0, 60)) for _ in range(120)]
    texts += [letters(30) + core[10:] + "x" * 100, "y" * 100 + core[:215] + letters(9)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    keys = {S.key_of(t.encode()): i for i, t in enumerate(texts)}
    got = {keys[x.hi, x.lo]: [(s.start, s.end) for s in x.spans] for x in S.repeated_spans(docs, range_rows=range_rows).collect()}
    assert got == {i: s for i, s in enumerate(brute(texts, 200)) if s}


def runs(spaces, periods):
    """Texts with a long run of spaces and of a short period, and with short runs of the same."""
    r = random.Random(11)
    noise = lambda n: bytes(r.choices(b"efghijklmnopqrstuvwxyz", k=n)).decode()
    return [noise(500) + " " * spaces + noise(500), noise(300) + "abcabd" * periods + noise(300), noise(50) + " " * 230, "abcabd" * 34 + noise(40), noise(1000)]


def test_long_runs(spark):
    """Ten megabytes of spaces, and of a short period, within other bytes: as a plain search finds where the runs are short."""
    short, texts = runs(1000, 300), runs(10_000_000, 1_700_000)
    more = [len(b) - len(a) for a, b in zip(short, texts)]
    want = {i: [(s, e + more[i] * (e > len(short[i]) // 2)) for s, e in spans] for i, spans in enumerate(brute(short, 200)) if spans}
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    keys = {S.key_of(t.encode()): i for i, t in enumerate(texts)}
    got = {keys[x.hi, x.lo]: [(s.start, s.end) for s in x.spans] for x in S.repeated_spans(docs).collect()}
    assert got == want and want[1] == [(300, 10_200_300)]


@pytest.mark.parametrize("piece", [300, 1000, 10**6])
def test_anchors_by_pieces(piece):
    """Pieces cut between anchors, so their size does not matter."""
    r = random.Random(1)
    raw = bytes(r.choices(b"abc ", k=4000)) + b" " * 900 + bytes(r.choices(b"abc ", k=500))
    whole = [tuple(x) for part in S.anchors(raw, 200, 10**9) for x in zip(*part)]
    assert [tuple(x) for part in S.anchors(raw, 200, piece) for x in zip(*part)] == whole
    assert whole[0][1] == 0 and whole[-1][2] == len(raw) - 200 and all(a[2] + 1 == b[1] for a, b in zip(whole, whole[1:]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeated_spans(docs).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, group = S.multikey_order(rows)
    assert rows[order].tolist() == sorted(rows.tolist())
    same = (rows[order][1:] == rows[order][:-1]).all(axis=1)
    assert ((group[1:] == group[:-1]) == same).all()


def test_text_key(spark):
    got = spark.createDataFrame([("ab",), (None,)], "t string").select(S.text_key(F.col("t")).alias("k")).collect()
    assert [(r.k.hi, r.k.lo) for r in got] == [S.key_of(b"ab"), S.key_of(b"")]
