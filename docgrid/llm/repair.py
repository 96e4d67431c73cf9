"""Repair of the structure of logged conversations at least cost.

A conversation is to be an optional system turn, then user and assistant turns in pairs. Rows are
kept, given another role, or deleted, and empty turns are inserted; a conversation read so far is
in one of four states (nothing, after system, after user, after assistant), and each row moves
between states at a cost. Hirschberg's divide and conquer finds the cheapest edits in linear
space: costs to the middle from the left and from the middle to the right meet, the crossing
state is the one of least audit among the cheapest, and both halves are solved in turn.

Rows are numbered in one distributed sort and cut into pieces of ``PIECE`` row numbers. Each piece gives the
costs between its first and last states (4 x 4); these are chained for each conversation, which
settles the states at the ends of pieces; then every piece is solved by itself. A conversation of any length is
thereby spread over tasks: only a few numbers for each of its pieces meet.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.text import small_batches
from docgrid.shared import running_start, stored

#: Row numbers of a piece.
PIECE = 4096
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40
#: The state after an inserted or reroled turn, and its role.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Inserted turns, and their cost, that end a conversation from each state.
_TAIL = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_END = [_TAIL[s] * INSERT for s in range(4)]
_LEGAL = {"su", "ua", "au"}
#: A row is a letter: its role's initial (u, a, s, other) and its fault (none, truncated, to be deleted).
_INITIALS, _FAULTS = "uaso", 3
_SPACE = " \t\n\x0b\f\r"


@lru_cache(None)
def _steps(letter: str) -> list[list[tuple[int, str]]]:
    """For a row, from each state to each: least cost and, of the edits of that cost, the ASCII-least (``_FAR`` where there is none)."""
    initial, fault = _INITIALS[(ord(letter) - 65) // _FAULTS], (ord(letter) - 65) % _FAULTS
    out = [[(_FAR, "")] * 4 for _ in range(4)]
    for x in range(4):
        state = x
        for k in range(3):
            ways = [(state, DELETE, "D")]
            if fault < 2:
                more = TRUNCATED * fault
                ways.append((_NEXT[state], REROLE + more, "R"))
                if (state, initial) in _KEPT:
                    ways.append((_KEPT[state, initial], more, "K"))
            for y, cost, edit in ways:
                out[x][y] = min(out[x][y], (cost + k * INSERT, "I" * k + edit))
            state = _NEXT[state]
    return out


def forward(rows: str, start: int) -> tuple[list[int], list[int]]:
    """Cost of reaching each state by the rows, and the order of the states' least audits.

    Each audit ends with an edit of the last row, so that none begins another one; their order stays whatever follows.
    """
    cost, rank = [_FAR] * 4, [4] * 4
    cost[start], rank[start] = 0, 0
    for letter in rows:
        steps = _steps(letter)
        best = [min((cost[x] + steps[x][y][0], rank[x], steps[x][y][1]) for x in range(4)) for y in range(4)]
        cost = [min(b[0], _FAR) for b in best]
        order = sorted(range(4), key=lambda y: (cost[y] >= _FAR, best[y][1:]))
        rank = [order.index(y) for y in range(4)]
    return cost, rank


def backward(rows: str, end: list[int]) -> list[int]:
    """Cost from each state by the rows to the end, whose states cost ``end``."""
    for letter in reversed(rows):
        steps = _steps(letter)
        end = [min(min(steps[x][y][0] + end[y] for y in range(4)), _FAR) for x in range(4)]
    return end


def hirschberg(rows: str, start: int, end: list[int]) -> list[str]:
    """The edits of each row, inserts before it first: of the cheapest the ASCII-least as a whole."""
    if not rows:
        return []
    if len(rows) == 1:
        steps = _steps(rows)
        return [min((steps[start][y][0] + end[y], steps[start][y][1]) for y in range(4))[1]]
    mid = len(rows) // 2
    (cost, rank), back = forward(rows[:mid], start), backward(rows[mid:], end)
    _, _, meet = min((cost[y] + back[y], rank[y], y) for y in range(4))
    at = [_FAR] * 4
    at[meet] = 0
    return hirschberg(rows[:mid], start, at) + hirschberg(rows[mid:], meet, end)


@lru_cache(100_000)
def piece_costs(rows: str) -> tuple[list[int], list[int], int]:
    """4 x 4 costs and ranks between the states before and after the rows, and the number of illegal neighbours among them."""
    both = [forward(rows, x) for x in range(4)]
    inits = [_INITIALS[(ord(c) - 65) // _FAULTS] for c in rows]
    illegal = sum(a + b not in _LEGAL for a, b in zip(inits, inits[1:], strict=False))
    return [c for cost, _ in both for c in cost], [r for _, rank in both for r in rank], illegal


@lru_cache(100_000)
def piece_edits(rows: str, start: int, end: int) -> tuple[list[str], list[tuple[int, list[str], str | None, bool]]]:
    """The edits of a piece between two states, and (row, inserted roles, new role, deleted) of rows that are not just kept."""
    at = [_FAR] * 4
    at[end] = 0
    edits, changed, state = hirschberg(rows, start, at), [], start
    for i, (letter, edit) in enumerate(zip(rows, edits, strict=True)):
        before = []
        for _ in edit[:-1]:
            state = _NEXT[state]
            before.append(_ROLE[state])
        role = None
        if edit[-1] == "R":
            state = _NEXT[state]
            role = _ROLE[state]
        elif edit[-1] == "K":
            state = _KEPT[state, _INITIALS[(ord(letter) - 65) // _FAULTS]]
        if edit != "K":
            changed.append((i, before, role, edit[-1] == "D"))
    return edits, changed


def chain(pieces: list[dict]) -> tuple[int, list[int]]:
    """Least cost of a conversation from the costs of its pieces in order, and the states at the ends of pieces."""
    cost, rank, came = [0, _FAR, _FAR, _FAR], [0, 4, 4, 4], []
    for p in pieces:
        best = [min((cost[x] + p["cost"][4 * x + y], rank[x], p["rank"][4 * x + y], x) for x in range(4)) for y in range(4)]
        came.append([b[3] for b in best])
        cost = [min(b[0], _FAR) for b in best]
        order = sorted(range(4), key=lambda y: (cost[y] >= _FAR, best[y][1:3]))
        rank = [order.index(y) for y in range(4)]
    total, _, state = min((cost[y] + _END[y], rank[y], y) for y in range(4))
    states = [state]
    for c in reversed(came):
        states.append(c[states[-1]])
    return total, states[::-1]


def damage(turns: DataFrame) -> DataFrame:
    """The rows with planted faults: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it the user's.

    Nulls in key, role and text are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = turns.select("conv_id", "turn", F.when(k == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), k.alias("_k")).filter("_k > 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


def repair(turns: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """A report of every conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and the repaired rows (conv_id, row_no, n, role, text).

    ``turns`` has conv_id, turn, role and text. Rows are ordered by turn (nulls first), ties by role and text; null roles and texts are one space, null conv_ids one
    conversation. A row is blank (no character but ASCII white space), else duplicate (role and text as in an earlier row, so repeated rows
    are), else truncated (last character but white space none of ``.!?``). Blank and duplicate rows are deleted. A role is known
    by its first character; an empty role has none, so that such a row cannot be kept as it is. Long texts travel once
    for the sort and once for the edits; an empty table gives no conversations. Other columns are ignored. Repaired rows are ordered by (row_no, n).
    """
    spark, space = turns.sparkSession, lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    # _c takes the place of conv_id, which may be null; equal rows are told apart by where they are read, which changes no result
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    rows = turns.select("conv_id", conv.alias("_c"), "turn", space("role").alias("role"), space("text").alias("text"), F.lit(1).alias("_one"), F.monotonically_increasing_id().alias("_tie"))
    rows = running_start(small_batches(rows), ["_c", "turn", "role", "text", "_tie"], "_one", "row_no").drop("_one", "_tie")
    body = F.rtrim("text", F.lit(_SPACE))
    initial, hashes = F.substring("role", 1, 1), [F.xxhash64(F.lit(s), "role", "text").alias(f"_h{s}") for s in (1, 2)]
    marks = rows.select(
        "_c", "conv_id", "turn", "row_no", *hashes, (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"),
        F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3).alias("who"),
    )
    key = ["_c", "_h1", "_h2"]
    twice = marks.filter(~F.col("blank")).groupBy(*key).agg(F.min("row_no").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    marks = marks.hint("shuffle_merge").join(twice.hint("shuffle_merge"), key, "left")
    again = ~F.col("blank") & F.coalesce(F.col("row_no") > F.col("_first"), F.lit(False))
    fault = F.when(F.col("blank") | again, 2).when(F.col("open"), 1).otherwise(0)
    marks, drop_marks = stored(marks.select("_c", "conv_id", "turn", "row_no", "blank", again.alias("again"), (fault == 1).alias("open"), F.char(65 + F.col("who") * _FAULTS + fault).alias("letter")))

    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "letter"))), lambda x: x["letter"]), "")  # of one piece
    pieces = marks.groupBy("_c", F.floor(F.col("row_no") / piece).alias("piece")).agg(F.min("row_no").alias("at"), letters.alias("rows"))
    pieces, drop_pieces = stored(pieces)

    def costs(batches):
        for b in batches:
            got = [piece_costs(r) for r in b.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("_c"), b.column("piece"), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.int64()), b.column("ends")],
                names=["_c", "piece", "cost", "rank", "illegal", "ends"],
            )

    ends = F.concat(F.substring("rows", 1, 1), F.substring("rows", -1, 1)).alias("ends")
    costed = pieces.select("_c", "piece", "rows", ends).mapInArrow(costs, "_c string, piece long, cost array<long>, rank array<long>, illegal long, ends string")
    chains = costed.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("piece", "cost", "rank", "illegal", "ends"))).alias("pieces"))  # 4 x 4 numbers for each piece

    def chained(batches):
        initial = lambda c: _INITIALS[(ord(c) - 65) // _FAULTS]
        for b in batches:
            out = []
            for c, found in zip(b.column("_c").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                total, states = chain(found)
                illegal = sum(p["illegal"] for p in found) + sum(initial(p["ends"][1]) + initial(q["ends"][0]) not in _LEGAL for p, q in zip(found, found[1:], strict=False))
                last = len(found) - 1
                between = [{"piece": p["piece"], "start": states[i], "end": states[i + 1], "tail": _TAIL[states[-1]] if i == last else 0} for i, p in enumerate(found)]
                out.append({"_c": c, "cost": total, "illegal": illegal, "between": between})
            kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("piece", "start", "end", "tail")]))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_c", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("between", kind)]))

    solved, drop_solved = stored(chains.mapInArrow(chained, "_c string, cost long, illegal long, between array<struct<piece:long,start:long,end:long,tail:long>>"))
    states = solved.select("_c", F.explode("between").alias("b")).select("_c", "b.*")
    states = pieces.hint("shuffle_merge").join(states.hint("shuffle_merge"), ["_c", "piece"])

    def edits(batches):
        kind = pa.struct([("row_no", pa.int64()), ("before", pa.list_(pa.string())), ("as", pa.string()), ("gone", pa.bool_()), ("after", pa.list_(pa.string()))])
        for b in batches:
            audits, changes = [], []
            for r in b.select(["at", "rows", "start", "end", "tail"]).to_pylist():
                done, changed = piece_edits(r["rows"], r["start"], r["end"])
                audits.append("".join(done) + "I" * r["tail"])
                own = [{"row_no": r["at"] + i, "before": before, "as": role, "gone": gone, "after": []} for i, before, role, gone in changed]
                if r["tail"]:
                    last = r["at"] + len(done) - 1
                    if not own or own[-1]["row_no"] != last:
                        own.append({"row_no": last, "before": [], "as": None, "gone": False, "after": []})
                    own[-1]["after"] = ["user", "assistant"][-r["tail"] :]
                changes.append(own)
            yield pa.RecordBatch.from_arrays([b.column("_c"), b.column("piece"), pa.array(audits, pa.string()), pa.array(changes, pa.list_(kind))], names=["_c", "piece", "audit", "changes"])

    solution, _ = stored(states.mapInArrow(edits, "_c string, piece long, audit string, changes array<struct<row_no:long,before:array<string>,as:string,gone:boolean,after:array<string>>>"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "").alias("audit")
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    facts = marks.groupBy("_c").agg(
        F.first("conv_id", ignorenulls=True).alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"), count("blank"), count("again").alias("duplicate"), count("open").alias("truncated")
    )
    report, _ = stored(
        facts.hint("shuffle_merge").join(solved.select("_c", "illegal", "cost").hint("shuffle_merge"), "_c").join(solution.groupBy("_c").agg(audit).hint("shuffle_merge"), "_c")
        .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    )
    for drop in (drop_marks, drop_pieces, drop_solved):
        drop()

    changes = solution.select(F.explode("changes").alias("x")).select("x.*")
    made = rows.hint("shuffle_merge").join(changes.hint("shuffle_merge"), "row_no", "left")
    entry = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    empty = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda r: entry(r, F.lit("")))
    own = F.filter(F.array(entry(F.coalesce("as", "role"), F.col("text"))), lambda _: ~F.coalesce(F.col("gone"), F.lit(False)))
    made = made.select("conv_id", "row_no", F.posexplode(F.concat(empty(F.col("before")), own, empty(F.col("after")))).alias("n", "x"))
    return report, made.select("conv_id", "row_no", "n", "x.role", "x.text")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows: ``role:text``, joined by newlines; a conversation's rows pass by one task one at a time, as a digest asks for."""
    conv = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def hashed(batches):
        names, at, digest, one = ["conv_id", "repaired_sha256"], None, None, None
        for b in batches:
            done: list[tuple] = []
            for c, conv_id, line in zip(b.column("_c").to_pylist(), b.column("conv_id").to_pylist(), b.column("line").to_pylist(), strict=True):
                if c != at:
                    if digest:
                        done.append((one, digest.hexdigest()))
                    at, one, digest = c, conv_id, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            id_kind = b.schema.field("conv_id").type
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], id_kind), pa.array([d[1] for d in done], pa.string())], names=names)
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([one], id_kind), pa.array([digest.hexdigest()], pa.string())], names=names)

    lines = rows.select(conv.alias("_c"), "conv_id", "row_no", "n", F.concat_ws(":", "role", "text").alias("line"))
    return small_batches(lines.repartition("_c").sortWithinPartitions("_c", "row_no", "n")).mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")


def op13_structure_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, least edits and digest of the repair of every conversation after damage."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report, rows = repair(damage(turns))
    none = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": ""}
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    out = turns.select("conv_id").distinct().alias("t").join(report.hint("shuffle_merge").alias("r"), same("t", "r"), "left").select("t.conv_id", *[f"r.{c}" for c in none])
    out = out.alias("t").join(digests(rows).hint("shuffle_merge").alias("d"), same("t", "d"), "left")
    filled = [F.coalesce(f"t.{c}", F.lit(v) if c == "audit" else F.lit(v).cast("long")).alias(c) for c, v in none.items()]
    return out.select("t.conv_id", *filled, F.coalesce("d.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


OP13_SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS c, coalesce(turn::VARCHAR, ' ') AS t, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
crc AS MATERIALIZED (
  SELECT k, i, x FROM (SELECT k, 0::BIGINT AS i, 4294967295::BIGINT AS x FROM (SELECT DISTINCT c || ':' || t AS k FROM o))
  ),
hash(k, i, x) AS (
  SELECT k, i, x FROM crc
  UNION ALL
  SELECT k, i + 1, (SELECT list_reduce([xor(x, ('0x' || substr(hex(encode(k)), (2 * i + 1)::BIGINT, 2))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)))
  FROM hash WHERE i < strlen(k)),
bucket AS (SELECT k, xor(x, 4294967295) % 20 AS b FROM hash WHERE i = strlen(k)),
dam AS (
  SELECT conv_id, c, turn, CASE WHEN b = 4 THEN 'user' ELSE role END AS role, CASE b WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN b = 3 THEN 2 ELSE 1 END)) AS n
  FROM o JOIN bucket ON k = c || ':' || t WHERE b > 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS p,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dam),
f AS (
  SELECT *, left(role, 1) AS w, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS w2,
         CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault FROM r),
-- state, inserts, state after, audit of inserts
ins(x, z, e) AS (VALUES ('0', '0', ''), ('0', 'u', 'I'), ('0', 'a', 'II'), ('s', 's', ''), ('s', 'u', 'I'), ('s', 'a', 'II'), ('u', 'u', ''), ('u', 'a', 'I'), ('a', 'a', ''), ('a', 'u', 'I')),
kept(z, w, y) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
turned(z, y) AS (VALUES ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
way(fault, w, x, y, cost, e) AS (
  SELECT fault, w, x, z, 4 + 3 * length(e), e || 'D' FROM ins, (SELECT DISTINCT fault, w FROM f)
  UNION ALL SELECT fault, w, x, y, 3 + 3 * length(e) + 3 * (fault = 't')::INT, e || 'R' FROM ins JOIN turned USING (z), (SELECT DISTINCT fault, w FROM f WHERE fault IN ('k', 't'))
  UNION ALL SELECT g.fault, g.w, x, y, 3 * length(e) + 3 * (g.fault = 't')::INT, e || 'K' FROM ins JOIN kept USING (z) JOIN (SELECT DISTINCT fault, w FROM f WHERE fault IN ('k', 't')) g ON g.w = kept.w),
dp(c, p, x, cost, audit) AS (
  SELECT DISTINCT c, 0::BIGINT, '0', 0::BIGINT, '' FROM f
  UNION ALL
  SELECT c, p, x, cost, audit FROM (
    SELECT d.c, d.p + 1 AS p, way.y AS x, d.cost + way.cost AS cost, d.audit || way.e AS audit, row_number() OVER (PARTITION BY d.c, way.y ORDER BY d.cost + way.cost, d.audit || way.e) AS n
    FROM dp d JOIN f ON f.c = d.c AND f.p = d.p + 1 JOIN way ON way.fault = f.fault AND way.w = f.w AND way.x = d.x) WHERE n = 1),
fin(x, more) AS (VALUES ('0', ''), ('s', 'II'), ('u', 'I'), ('a', '')),
best AS (
  SELECT c, cost + 3 * length(more) AS cost, audit || more AS audit FROM dp JOIN fin USING (x) JOIN (SELECT c, max(p) AS p FROM f GROUP BY c) USING (c, p)
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost + 3 * length(more), audit || more) = 1),
facts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (w2 IS NOT NULL AND w || w2 NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
-- the edits again, one letter at a time
walk(c, audit, i, p, state, line) AS (
  SELECT c, audit, 0::BIGINT, 0::BIGINT, '0', NULL::VARCHAR FROM best
  UNION ALL
  SELECT c, audit, i + 1, p + (e <> 'I')::INT, CASE WHEN e = 'D' THEN state WHEN e = 'K' THEN w ELSE go END,
         CASE WHEN e = 'D' THEN NULL WHEN e = 'K' THEN role || ':' || text WHEN e = 'I' THEN go_role || ':' ELSE go_role || ':' || text END
  FROM (SELECT k.*, substr(audit, i + 1, 1) AS e, CASE WHEN state = 'u' THEN 'a' ELSE 'u' END AS go, CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END AS go_role, f.w, f.role, f.text
        FROM walk k LEFT JOIN f ON f.c = k.c AND f.p = k.p + 1 WHERE i < length(audit))),
lines AS (SELECT c, string_agg(line, chr(10) ORDER BY i) AS t FROM walk GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM o) LEFT JOIN facts USING (c) LEFT JOIN best USING (c) LEFT JOIN lines USING (c)
"""
