"""Conversation repair against enumeration, and against a plain program over whole tables."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from docgrid.llm import repair as R

LEGAL = [""] + [s + "ua" * n for n in range(1, 6) for s in ("", "s")]


def cheapest(rows):
    """(cost, audit, roles or inserted/kept marks) by trying all edits of each row and all insertions; rows are (initial, fault)."""
    best = None
    for goal in LEGAL:
        # (row, place in goal) -> (cost, audit); letters of rows end each audit, so inserts before a row go first
        table = {(0, 0): (0, "")}
        for i in range(len(rows) + 1):
            for j in range(len(goal) + 1):
                ways = [table[i, j]] if (i, j) in table else []
                if j and (i, j - 1) in table and goal[j - 1] in "ua":
                    ways.append((table[i, j - 1][0] + 3, table[i, j - 1][1] + "I"))
                if i:
                    initial, fault = rows[i - 1]
                    if (i - 1, j) in table:
                        c, a = table[i - 1, j]
                        ways.append((c + 4, a + "D"))
                    if j and fault < 2 and (i - 1, j - 1) in table:
                        c, a = table[i - 1, j - 1]
                        if initial == goal[j - 1]:
                            ways.append((c + 3 * fault, a + "K"))
                        if goal[j - 1] in "ua":
                            ways.append((c + 3 + 3 * fault, a + "R"))
                if ways:
                    table[i, j] = min(ways)
        found = table.get((len(rows), len(goal)))
        best = found if best is None or found and found < best else best
    return best


def letters(rows):
    return "".join(chr(65 + "uaso".index(i) * 3 + f) for i, f in rows)


def solve(text):
    edits = R.hirschberg(text, R.START, R._END)
    cost = R.backward(text, R._END)[R.START]
    state = R.START
    for letter, e in zip(text, edits, strict=True):
        for _ in e[:-1]:
            state = R._NEXT[state]
        initial = "uaso"[(ord(letter) - 65) // 3]
        state = R._NEXT[state] if e[-1] == "R" else R._KEPT[state, initial] if e[-1] == "K" else state
    return cost, "".join(edits) + "I" * R._TAIL[state]


def test_every_short_conversation():
    kinds = [(i, f) for i in "uaso" for f in range(3)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert solve(letters(rows)) == cheapest(rows), rows


@pytest.mark.parametrize("seed", range(4))
def test_longer_conversations_whole_and_in_pieces(seed):
    r = random.Random(seed)
    for _ in range(60):
        rows = [(r.choice("uuaaso"), r.choice([0, 0, 0, 1, 2])) for _ in range(r.randrange(4, 9))]
        text = letters(rows)
        want = cheapest(rows)
        assert solve(text) == want
        for size in (1, 2, 3):
            parts = [text[k : k + size] for k in range(0, len(text), size)]
            costs = [dict(zip(("cost", "rank"), R.piece_costs(p)[:2], strict=True)) for p in parts]
            total, states = R.chain(costs)
            audit = "".join("".join(R.piece_edits(p, a, b)[0]) for p, a, b in zip(parts, states, states[1:], strict=False))
            assert (total, audit + "I" * R._TAIL[states[-1]]) == want


def plain(rows):
    """The report and repaired text of each conversation, from (conv_id, turn, role, text) rows; null ids are conversation None."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, ro if ro is not None else " ", x if x is not None else " ") for c, t, ro, x in rows if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        seen, marks = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            marks.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        inits = [ro[:1] for _, ro, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(inits, inits[1:], strict=False))
        coded = [(ro[:1] if ro[:1] in tuple("uas") else "o", {"blank": 2, "duplicate": 2, "truncated": 1, "": 0}[m]) for (_, ro, _), m in zip(own, marks, strict=True)]
        cost, audit = solve(letters(coded))
        state, k, lines = "0", 0, []
        for e in audit:
            go = "assistant" if state == "u" else "user"
            if e in "IR":
                lines.append((go, "" if e == "I" else own[k][2]))
                state = go[0]
            elif e == "K":
                lines.append(own[k][1:])
                state = own[k][1][0]
            k += e != "I"
        assert "".join(x[0][0] for x in lines) in LEGAL or len(lines) > 10
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(f"{a}:{b}" for a, b in lines))
    return out


def run(spark, rows, piece):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn int, role string, text string, piece string, row_no string").repartition(3)
    report, fixed = R.repair(df, piece)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    lines: dict = {}
    for r in sorted(fixed.collect(), key=lambda r: (r.row_no, r.n)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    digests = {r.conv_id: r.repaired_sha256 for r in R.digests(fixed).collect()}
    assert digests == {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()}
    return {c: (*v, "\n".join(lines.get(c, []))) for c, v in got.items()}


def conversations(seed):
    r = random.Random(seed)
    text = lambda: r.choice(["Hi.", "Hi. \n", "What", "", None, " \t", "né?", "ü" * 3, "日本!", f"{r.random()}."])
    role = lambda: r.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "u", "Üser"])
    rows = [(c if c else None, r.choice([t, t, t, None, 3]), role(), text()) for c in range(12) for t in range(r.randrange(1, 12))]
    return rows + rows[:7] + [(50, k, ["user", "assistant"][k % 2], f"{k}.") for k in range(40)]


@pytest.mark.parametrize("seed,piece", [(1, 4096), (2, 2), (3, 5)])
def test_tables(spark, seed, piece):
    """Nulls, ties, repeated rows, odd roles, clashing columns; conversations in one piece and in many."""
    rows = conversations(seed)
    assert run(spark, rows, piece) == plain(rows)


def test_empty_table_and_long_text(spark):
    assert run(spark, [], 10) == {}
    rows = [(1, 0, "user", "a b " * 2_000_000 + "."), (1, 1, "assistant", "c " * 1_000_000)]
    assert run(spark, rows, 10) == plain(rows)


def test_one_long_conversation(spark):
    """Twenty thousand rows of one conversation, in pieces of 512."""
    r = random.Random(5)
    rows = [(1, k, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", f"{k}.", ""])) for k in range(20_000)]
    assert run(spark, rows, 512) == plain(rows)


def test_damage(spark):
    rows = [(k % 7 if k % 5 else None, k if k % 4 else None, None if k % 6 == 0 else "assistant", None if k % 9 == 0 else f"T{k}. a!b?") for k in range(200)]
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if k:
            one = (c, t, "user" if k == 4 else role, "" if k == 1 else text.translate({ord(x): None for x in ".!?"}) if k == 2 else text)
            want += [one, one] if k == 3 else [one]
    got = R.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = R.op13_structure_repair(spark, sf)
    cols = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {cols} FROM ({R.OP13_SQL})").fetchall())
