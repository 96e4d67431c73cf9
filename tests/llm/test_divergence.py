"""Source divergence against exact integers over all terms."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from docgrid.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=10):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, ts in own for t in set(ts))
        kept = [t for t in df if df[t] >= least]
        v = len(kept)
        count = {s: Counter(t for _, s2, ts in own if s2 == s for t in ts if df[t] >= least) for s in {d[1] for d in own}}
        total = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        share = {s: {t: p(count[s], t) for t in kept} for s in count}
        whole = {t: p(total, t) for t in kept}
        for s in count:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(f(share[s][t], whole[t]), t) for t in kept if count[s][t] and share[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(3)
    got = [tuple(r) for r in D.source_divergence(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def cases(seed):
    r = random.Random(seed)
    words = ["Ab", "aB", "c", "É", "é", "日本", "x9y", "d-e", "İ", "f g", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for k in range(250):
        text = " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=r.randrange(0, 40)))
        rows.append((r.choice(["en", "de", None, "", "fr"]), r.choice(["s1", "S1", "é", None, "", "s2", "s3", "s4", "z"]), text if r.random() < 0.95 else None))
    return rows + rows[:20] + [("xx", "a", "alone"), ("xx", "b", "other words"), ("yy", "only", ""), ("zz", None, None)]


@pytest.mark.parametrize("seed,least,segment,tile", [(1, 10, 2048, 64), (2, 3, 4, 2), (3, 1, 1, 1), (4, 2, 7, 3)])
def test_equals_plain_arithmetic(spark, seed, least, segment, tile):
    """Nulls, equal counts, languages without kept terms, sources without terms, clashing columns; in one and in many segments and tiles."""
    rows = cases(seed)
    assert run(spark, rows, least_docs=least, segment=segment, tile=tile) == plain(rows, least)


def test_many_groups_are_not_broadcast(spark, monkeypatch):
    import docgrid.shared as shared

    monkeypatch.setattr(shared.is_small, "__defaults__", (1,))
    monkeypatch.setattr(D, "few", lambda df: shared.hinted(df, shared.is_small(df)))
    rows = cases(5)
    assert run(spark, rows, least_docs=3) == plain(rows, 3)


def test_large_counts(spark):
    """Counts of millions in one long text, against small ones."""
    rows = [("en", "a", "big " * 2_000_000 + "small"), ("en", "b", "small big big"), *[("en", "c", "big small tiny")] * 12]
    assert run(spark, rows, least_docs=2) == plain(rows, 2)


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_runs_equal_values():
    """Columns of runs give what values for each number give."""
    r = np.random.default_rng(3)
    for _ in range(50):
        size = int(r.integers(1, 40))
        cols, dense = [], []
        for _ in range(2):
            cuts = np.unique(r.integers(0, size + 1, 8))
            start, end = cuts[:-1:2], cuts[1::2][: len(cuts[:-1:2])]
            start = start[: len(end)]
            p = r.integers(1, 10**9, len(start))
            rest = int(r.integers(1, 10**9))
            v = np.full(size, rest)
            for s, e, x in zip(start, end, p, strict=True):
                v[s:e] = x
            cols.append(D._column(start, end, p, rest, size))
            dense.append(v)
        assert D.pair_value(*cols, size) == int(D.divergence_of(*dense).sum())


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = "lang, source, part, item, value, rank"
    got = sorted(tuple(r) for r in D.op12_source_divergence(spark, sf).select(*cols.split(", ")).collect())
    assert got == sorted(con.sql(f"SELECT {cols} FROM ({D.OP12_SQL})").fetchall())
