"""Packing in pieces against one pass over each run."""

import random

import numpy as np
import pytest

from docgrid.operators import packing


UNITS = "document_id string, run int, section string, page int, t string, n int, row long, total long"


def one_pass(units, most, overlap):
    """(first place, stop) of chunks of token counts."""
    out, held, size, start = [], [], 0, 0
    for k, n in enumerate(units):
        if held and size + n > most:
            out.append((start, k))
            room, size, first = min(overlap, most - n), 0, len(held)
            while first and size + held[first - 1] <= room:
                first -= 1
                size += held[first]
            held, start = held[first:], k - (len(held) - first)
        held.append(n)
        size += n
    return out + ([(start, len(units))] if held else [])


def counts(r, length, most):
    return [r.choice([1, 1, 2, 3, r.randrange(1, most + 4)]) for _ in range(length)]


def test_starts_equal_one_pass():
    r = random.Random(1)
    for _ in range(400):
        most = r.randrange(1, 20)
        overlap, n = r.randrange(0, most + 3), counts(r, r.randrange(1, 60), most)
        want = one_pass(n, most, overlap)
        stop, then = packing.next_starts(np.array(n), most, overlap)
        assert list(packing.starts_from(0, len(n), stop.tolist(), then.tolist())) == want
        assert packing.open_at_end(np.array(n), most, overlap)[0] == want[-1][0]


@pytest.mark.parametrize("seed,piece", [(1, 1), (2, 30), (3, 20_000)])
def test_pieces_equal_one_pass(spark, seed, piece):
    """Runs within a piece, over two, over many and ending with one; null pages and sections; an overlong unit; numbers by document."""
    r = random.Random(seed)
    most, overlap = 5, 2
    lengths = [1, 3, 200, 28, 28, 27, 1, 90, 500, 56, 2]
    rows, want, at = [], {}, {}
    for run, length in enumerate(lengths):
        doc, n = f"d{run // 3}", counts(r, length, most)
        section = None if run % 4 == 0 else f"s{run}"
        pages = [None if run % 3 == 0 else k // 7 for k in range(length)]
        rows += [(doc, run, section, pages[k], f"{run}.{k}", n[k], at.get(doc, 0) + k) for k in range(length)]
        at[doc] = at.get(doc, 0) + length
        want.setdefault(doc, []).extend((pages[a], section, " ".join(f"{run}.{k}" for k in range(a, b))) for a, b in one_pass(n, most, overlap))
    want = {d: [v for v in vs if len(v[2]) >= 4] for d, vs in want.items()}
    units = spark.createDataFrame([(*x, at[x[0]]) for x in rows], UNITS).repartition(5)
    made = packing.packed(units, most, overlap, 4, piece)
    got: dict = {}
    for x in made.orderBy("document_id", "position").collect():
        got.setdefault(x.document_id, []).append((x.position, x.page, x.section, x.text))
    assert got == {d: [(k, *v) for k, v in enumerate(vs)] for d, vs in want.items()}


def test_no_units(spark):
    assert packing.packed(spark.createDataFrame([], UNITS), 5, 2).count() == 0


def test_one_long_document_in_many_tasks(spark):
    """A million units of one run: equal to one pass, and no task has more than a twentieth of them."""
    total = 1_000_000
    units = spark.range(total).selectExpr("'d' AS document_id", "0 AS run", "CAST(NULL AS STRING) AS section", "CAST(id AS INT) AS page", "CAST(id AS STRING) AS t", "CAST(id * 7919 % 23 + 1 AS INT) AS n", "id AS row", f"{total}L AS total")
    want = one_pass([k * 7919 % 23 + 1 for k in range(total)], 100, 15)
    rows = packing.packed(units, 100, 15).select("position", "page").orderBy("position").collect()
    assert [(x.position, x.page) for x in rows] == [(k, a) for k, (a, _) in enumerate(want)]
    assert packing.PIECE < total / 20
