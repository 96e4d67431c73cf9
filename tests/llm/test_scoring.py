"""Scores against a plain model of the whole training part."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrid.llm import scoring as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def brute(rows):
    """rows: (train, text) -> (n_tokens, n_known, N, base, score) each, by the formulas of the model on plain counters."""
    uni, bi, tri = Counter(), Counter(), Counter()
    n_texts = 0
    for train, text in rows:
        if train:
            t = ["\t", *tokens(text)]
            uni.update(t[1:])
            bi.update(zip(t, t[1:], strict=False))
            tri.update(zip(t, t[1:], t[2:], strict=False))
            n_texts += 1
    n, v = sum(uni.values()), len(uni)
    once, twice = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    discount = min(once / (once + 2 * twice), 0.9) if once else 0.5
    kinds, mass = Counter(), Counter()
    for c in uni.values():
        kinds[c.bit_length() - 1] += 1
        mass[c.bit_length() - 1] += c

    def trusted(c):
        """How much of its probability a context that occurred c times keeps for words it has seen."""
        draws = 2 ** (c.bit_length() - 1) - 1
        new = sum(m / n * (1 - m / kinds[b] / n) ** draws for b, m in mass.items())
        return min(max(1 - new, 0.1), 0.999)

    count = lambda w: n_texts if w == "\t" else uni[w]
    trust = lambda w: trusted(count(w)) if count(w) else 0.0
    p1 = lambda w: ((uni[w] - discount) / n if uni[w] else discount * v / n) if n else 1.0
    out = []
    for _, text in rows:
        t = tokens(text)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = 0.0
        for z, a, b in zip([None, "\t", *t], ["\t", *t], t, strict=False):
            p = (trust(a) * bi[a, b] / count(a) if bi[a, b] else 0.0) + (1 - trust(a)) * p1(b)
            if bi[z, a]:
                half = bi[z, a] / (bi[z, a] + 4)
                p = half * tri[z, a, b] / bi[z, a] + (1 - half) * p
            score += math.log10(p)
        out.append((len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out, uni, p1, trust, bi, count


def close(got, want):
    assert got[:3] == want[:3]
    assert got[3] == pytest.approx(want[3], rel=1e-9) and got[4] == pytest.approx(want[4], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block_bytes,range_bytes", [(8_000_000, 16_000_000), (20_000, 500)])
def test_scores_equal_brute_force(spark, sf, block_bytes, range_bytes):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 3 == 1
    rows = docs.orderBy("doc_id").collect()
    want, *_ = brute([(r.doc_id % 3 != 1, r.text) for r in rows])
    got = {r.doc_id: r for r in S.score_texts(docs, "doc_id", ~held, block_bytes=block_bytes, range_bytes=range_bytes).collect()}
    for r, w in zip(rows, want, strict=True):
        g = got[r.doc_id]
        close((g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score), w)


def test_probabilities_sum_to_one():
    rows = [(True, "a b a c a b"), (True, "b a d"), (True, "")]
    _, uni, p1, trust, bi, count = brute(rows)
    words = list(uni)
    assert sum(p1(w) for w in words) + p1("never") == pytest.approx(1)
    for a in ["\t", "a", "b"]:
        total = sum((trust(a) * bi[a, w] / count(a)) + (1 - trust(a)) * p1(w) for w in words) + (1 - trust(a)) * p1("never")
        assert total == pytest.approx(1)


def test_held_out_beats_base(spark):
    out = S.op2_lm_scores(spark, "/root/testdata/sf0.01")
    r = out.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n"), F.count("*").alias("c")).first()
    assert r.c > 100 and r.s > r.b + 0.02 * r.n


def test_odd_rows(spark):
    rows = [(1, None, True), (2, "", True), (None, "A a\tB", True), (3, "a b", None), (3, "a b", None), (4, "z " * 700 + "a", False)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, learn boolean, score string").repartition(2)
    got = S.score_texts(docs, "doc_id", F.col("learn")).collect()
    want, *_ = brute([(bool(t), x) for _, x, t in rows])
    key = lambda x: (str(x[0]), x[1])
    pairs = zip(sorted(((g.doc_id, g.n_tokens, g) for g in got), key=key), sorted(((r[0], w[0], w) for r, w in zip(rows, want, strict=True)), key=key), strict=True)
    for (i, _, g), (j, _, w) in pairs:
        assert i == j
        close((g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score), w)
    assert S.score_texts(docs.limit(0), "doc_id", F.col("learn")).count() == 0
    none = S.score_texts(docs, "doc_id", F.lit(False)).collect()
    assert {(g.n_known, g.train_tokens) for g in none} == {(0, 0)} and all(g.score == 0 for g in none)


def test_very_long_text(spark):
    r = random.Random(4)
    rows = [(1, " ".join(f"w{r.randrange(3000)}" for _ in range(300_000)), True), (2, "w1 w2 never", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    want, *_ = brute([(t, x) for _, x, t in rows])
    for g, w in zip(sorted(S.score_texts(docs, "doc_id", F.col("learn")).collect(), key=lambda g: g.doc_id), want, strict=True):
        close((g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score), w)


def test_pack():
    for x in ([], [0], [5, 300, 2**40, 2**63 + 7]):
        assert S.unpack(S.pack(np.array(x, np.uint64))).tolist() == x


def test_triples_are_asked_only_of_shared_pairs(spark):
    """Blocks of one text: what one block alone has is its own, what several have is summed, whether training or not."""
    rows = [(1, "a b c d", True), (2, "a b c e", True), (3, "x y z", True), (4, "a b c d", False), (5, "p q r", False), (6, "c d x y", True)]
    blocks = [S.Block([text]) for _, text, _ in rows]
    pairs = [set(b.pair_hashes.tolist()) for b in blocks]
    for i, b in enumerate(blocks):
        others = set().union(*(p for j, p in enumerate(pairs) if j != i))
        shared = np.array([h in others for h in b.pair_hashes.tolist()])
        asked = set(b.asked(3, shared)[0].tolist())
        kept = {h for j, o in enumerate(blocks) if j != i for h in o.triple_hashes.tolist()} & set(b.triple_hashes.tolist())
        assert kept <= asked  # a triple that another block has is never left out
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    want, *_ = brute([(t, x) for _, x, t in rows])
    for g, w in zip(sorted(S.score_texts(docs, "doc_id", F.col("learn"), block_bytes=1, range_bytes=7).collect(), key=lambda g: g.doc_id), want, strict=True):
        close((g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score), w)
