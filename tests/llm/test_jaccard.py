"""Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docgrid.llm import jaccard as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def brute(ids, texts, n, percent):
    sets = sets_of(texts, n)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    least = {k: min((ids[i] for i in v if ids[i] is not None), default=None) for k, v in groups.items()}
    return [(ids[i], len(sets[i]), least[find(i)]) for i in range(len(ids))], [find(i) for i in range(len(ids))]


def key(rows):
    return sorted(rows, key=str)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want, _ = brute([d.doc_id for d in docs], [d.text for d in docs], 4, 85)
    got = [tuple(r) for r in J.op10_jaccard_join(spark, sf).collect()]
    assert key(got) == key(want)
    assert any(a != c for a, _, c in got)


def chains(r, families=4, members=14):
    """Chains of near copies: neighbours link, far ones do not, so pivots alone do not find all."""
    words = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(families):
        base = [r.choice(words) for _ in range(60)]
        for _ in range(members):
            base = list(base)
            for _ in range(r.randint(1, 2)):
                base[r.randrange(len(base))] = r.choice(words)
            rows.append(" ".join(base).upper() if r.random() < 0.3 else "\t".join(base))
    return rows


@pytest.mark.parametrize("percent,block_bytes,range_bytes", [(85, 4_000_000, 16_000_000), (50, 700, 100)])
def test_families(spark, percent, block_bytes, range_bytes):
    rows = chains(random.Random(3))
    rows += [None, "", " \n", "one two", "One  two", "one two", rows[0], rows[0], "x"]
    ids = [*range(len(rows) - 3), None, None, 1000]
    docs = spark.createDataFrame([(i, t, "c", 1, "k") for i, t in zip(ids, rows, strict=True)], "doc_id long, text string, sig string, kept long, key string").repartition(3)
    want, group = brute(ids, rows, 4, percent)
    found = J.jaccard_components(docs, percent=percent, block_bytes=block_bytes, range_bytes=range_bytes).collect()
    assert key([(r.doc_id, r.n_shingles, r.component_id) for r in found]) == key(want)
    left = J.keep_one(docs, n=4, percent=percent).collect()
    full = {g for g, s in zip(group, sets_of(rows, 4), strict=True) if s}
    assert sum(1 for r in left if (r.text or "").split()) == len(full)
    assert sum(1 for r in left if not (r.text or "").split()) == 3
    assert left[0].asDict() == {"doc_id": left[0].doc_id, "text": left[0].text, "sig": "c", "kept": 1, "key": "k"}


@pytest.mark.parametrize("swaps", [2, 3, 5, 9])
def test_copies_of_a_text_that_is_not_there(spark, swaps):
    """Variants of one text without the text itself: at some rate hardly any two of them link, and no pivot stands for them all."""
    r = random.Random(swaps)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for _ in range(60):
        w = base[: r.choice([120, 148, 150])]
        for p in r.sample(range(len(w)), swaps):
            w[p] = f"new{r.randrange(10**6)}"
        rows.append(" ".join(w))
    want, _ = brute(list(range(60)), rows, 4, 85)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert key([(x.doc_id, x.n_shingles, x.component_id) for x in J.jaccard_components(docs).collect()]) == key(want)


def test_very_long_texts(spark):
    r = random.Random(2)
    long = [f"v{r.randrange(5000)}" for _ in range(400_000)]
    near = [w if k % 80 else "edited" for k, w in enumerate(long)]
    far = [w if k % 15 else "edited" for k, w in enumerate(long)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((far, long, near, long))], "doc_id long, text string").repartition(2)
    got = {x.doc_id: x.component_id for x in J.jaccard_components(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def test_filters_lose_nothing():
    """Sketches and positions against the sets themselves."""
    r = random.Random(9)
    docs = chains(r, 3, 8)
    sets = J.shingle_sets(pa.array(docs, pa.large_string()), 4)
    for x in sets:
        for y in sets:
            differ = len(np.setxor1d(x, y))
            assert sum(int(v).bit_count() for v in (J.odd_sketch(x) ^ J.odd_sketch(y)).view(np.uint64)) <= differ
            assert J.suffix_bound(x, y) >= len(np.intersect1d(x, y))


def test_levels_keep_order():
    c = np.array([1, 2, 127, 128, 150, 1000, 10**6, 10**9])
    got = J.levels(c).tolist()
    assert got == sorted(got) and got[:4] == [1, 2, 127, 128] and got[4] < got[5]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(docs).count() == 0
    assert J.keep_one(docs).count() == 0


def test_least_of_repeated_rows_stays(spark):
    """Of rows that repeat id and text the least by their other columns, a null before all."""
    text = "one two three four five six seven"
    rows = [(1, text, "z", {"a": 1}), (1, text, "b", {"a": 2}), (1, text, "b", {"a": 1}), (2, text, "a", None), (3, "other words stand here for once", "y", {}), (3, "other words stand here for once", None, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, least string, m map<string,int>")
    for k in (1, 4):
        got = J.keep_one(docs.repartition(k))
        assert got.columns == docs.columns
        assert sorted((r.doc_id, str(r.least), r.m) for r in got.collect()) == [(1, "b", {"a": 1}), (3, "None", {})]


@pytest.mark.parametrize("n", [4, 5])
def test_pieces_of_few_words(n):
    """A batch that holds fewer words than a shingle."""
    for text in ("a", "a b", "a b c", "", None):
        (got,) = J.shingle_sets(pa.array([text], pa.large_string()), n)
        assert len(got) == (1 if text else 0)
        among = J.shingle_sets(pa.array([text, "p q r s t u v w"], pa.large_string()), n)[0]
        assert got.tolist() == among.tolist()


@pytest.mark.parametrize("text", ["a", "a b", "a b c"])
def test_table_of_one_short_text(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for n in (4, 5):
        assert [r.text for r in J.keep_one(df, n=n, percent=80).collect()] == [text]
