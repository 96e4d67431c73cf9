"""Sections, blocks and chunks against short models of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docgrid.operators import chunking as C
from docgrid.operators import structure as S

HEAD = re.compile(r"^\s*(Điều\s+\d+)", re.IGNORECASE)


def model_blocks(raw):
    pages = raw.split("\f")
    if not pages[-1].strip():
        pages = pages[:-1]
    out, section = [], None
    for number, page in enumerate(pages, 1):
        held, own = [], None
        for line in [*page.split("\n"), ""]:
            if not line.strip():
                if held:
                    out.append((number, own, "\n".join(held).strip()))
                held = []
                continue
            m = HEAD.match(line)
            now = " ".join(m.group(1).split()) if m else section
            if held and now != section:
                out.append((number, own, "\n".join(held).strip()))
                held = []
            section = now
            own = own if held else now
            held.append(line)
    return out


def random_document(r):
    kinds = ["", " ", "text a", "more; words here", "  Điều  5. x", "ĐIỀU 5 y", "Điều 6", "điều", "end.", "\f"]
    return "\n".join(r.choice(kinds) for _ in range(r.randint(1, 25)))


def blocks_of(spark, raws):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(raws)], "document_id string, text string")
    return S.blocks(S.page_lines(S.page_texts(df)))


def test_blocks_equal_model(spark):
    r = random.Random(1)
    raws = [random_document(r) for _ in range(150)]
    got = {}
    for x in blocks_of(spark, raws).orderBy("document_id", "block").collect():
        got.setdefault(int(x.document_id), []).append((x.page, x.section, x.text))
    for i, raw in enumerate(raws):
        assert got.get(i, []) == model_blocks(raw), raw


@pytest.mark.parametrize("line,label", [("Điều 5. Phạm vi", "Điều 5"), ("   Điều   12", "Điều 12"), ("ĐIỀU 3", "ĐIỀU 3"), ("theo Điều 5", None), ("Điều khoản", None)])
def test_headers(spark, line, label):
    assert spark.createDataFrame([(line,)], "l string").select(S.section_header(F.col("l")).alias("h")).first().h == label


def count(t):
    return len(t.split())


def model_chunks(blocks, most, overlap, least):
    runs = []
    for page, section, text in blocks:
        if not runs or runs[-1][0] != section:
            runs.append((section, []))
        for s in re.split(r"(?<=[.;:!?])\s+|\n+", text):
            s = s.strip()
            if s and count(s) <= most:
                runs[-1][1].append((s, page))
            elif s:
                width = max(1, len(s) * most // max(count(s), 1))
                runs[-1][1].extend((s[i : i + width], page) for i in range(0, len(s), width))
    out = []
    for section, units in runs:
        packs, now = [], []
        for u in units:
            if now and sum(count(t) for t, _ in now) + count(u[0]) > most:
                packs.append(now)
                tail, n = [], 0
                for t, p in reversed(now):
                    if n + count(t) > overlap or n + count(t) + count(u[0]) > most:
                        break
                    tail.insert(0, (t, p))
                    n += count(t)
                now = tail
            now = [*now, u]
        packs += [now] if now else []
        for p in packs:
            text = " ".join(t for t, _ in p)
            if len(text.strip()) >= least:
                out.append((len(out), p[0][1], section, text))
    return out


def test_chunks_equal_model(spark):
    r = random.Random(2)
    raws = []
    for _ in range(60):
        lines = []
        for _ in range(r.randint(1, 20)):
            words = " ".join("w" * r.randint(1, 9) + r.choice(["", "", ".", ";"]) for _ in range(r.randint(1, 30)))
            lines.append(r.choice([words, words, "", f"Điều {r.randint(1, 3)}", "\f"]))
        raws.append("\n".join(lines))
    found = C.chunks(blocks_of(spark, raws), 12, 4, 10)
    got = {}
    for x in found.orderBy("document_id", "position").collect():
        got.setdefault(int(x.document_id), []).append((x.position, x.page, x.section, x.text))
    for i, raw in enumerate(raws):
        assert got.get(i, []) == model_chunks(model_blocks(raw), 12, 4, 10)


def test_no_blocks_give_no_chunks(spark):
    empty = spark.createDataFrame([], "document_id string, block int, page int, section string, text string")
    assert C.chunks(empty).count() == 0
    paragraphs = spark.createDataFrame([("d", 0, "Điều 1"), ("d", 1, " "), ("d", 2, "text")], "document_id string, ln int, line string")
    rows = S.paragraph_blocks(paragraphs).orderBy("block").collect()
    assert [(x.block, x.page, x.section, x.text) for x in rows] == [(0, None, "Điều 1", "Điều 1"), (1, None, "Điều 1", "text")]
