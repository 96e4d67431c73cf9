"""Secret scans over a trigram index.

Every rule is a regular expression. From its syntax tree a Boolean query over the trigrams
that any match must contain is derived; rows are indexed by those trigrams, batch by batch,
as posting lists; intersecting and uniting the lists gives the candidates, and only these are
scanned by the expression itself. A rule without a mandatory trigram scans every row. The
index lives and dies within one task, so it needs no shuffle and any lost task can be redone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.text import rebased, small_batches
from docgrid.llm.text import spans as pieces


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base rules, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Further kinds: private key headers, and tokens with a published fixed prefix.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

#: A literal alternative set larger than this is treated as "any character".
MOST_STRINGS = 64


def _cross(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MOST_STRINGS else None


def _trigrams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _any_of(strings: set[str]) -> list[frozenset] | None:
    """Disjunction of the trigram sets of some strings; None if one of them has no trigram."""
    sets = [_trigrams(s) for s in strings]
    return None if not sets or any(not s for s in sets) else sorted(set(sets), key=sorted)


def trigram_query(pattern: str) -> list[list[frozenset]]:
    """A conjunction of disjunctions of conjunctions of lower-case trigrams that a match must contain.

    Empty: the expression has no mandatory trigram. Everything is folded to lower case, so the
    query may let more rows pass than needed, never fewer.
    """
    clauses: list[list[frozenset]] = []

    def close(run: set[str]) -> None:
        if q := _any_of(run):
            clauses.append(q)

    def exact(item) -> set[str] | None:
        """The finite set of strings that an item stands for, or None."""
        op, arg = item
        if op is C.LITERAL:
            return {chr(arg).lower()} if chr(arg).lower().isascii() else None
        if op is C.IN:
            out: set[str] = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    out.add(chr(x).lower())
                elif kind is C.RANGE and x[1] - x[0] < MOST_STRINGS:
                    out |= {chr(k).lower() for k in range(x[0], x[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 and all(x.isascii() for x in out) else None
        if op is C.SUBPATTERN:
            return sequence(arg[3])
        if op is C.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 2:
            one = sequence(arg[2])
            if one is None:
                return None
            out, now = ({""} if arg[0] == 0 else set()), {""}
            for k in range(1, arg[1] + 1):
                now = _cross(now, one)
                if now is None:
                    return None
                out |= now if k >= arg[0] else set()
            return out
        return None

    def sequence(items) -> set[str] | None:
        run: set[str] | None = {""}
        for item in items:
            one = exact(item)
            run = _cross(run, one) if run is not None and one is not None else None
            if run is None:
                return None
        return run

    def walk(items) -> None:
        run = {""}
        for item in items:
            op, arg = item
            one = exact(item)
            joined = _cross(run, one) if one is not None else None
            if joined is not None:
                run = joined
                continue
            close(run)
            run = {""}
            if one is not None:
                run = one
            elif op is C.SUBPATTERN:
                walk(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        close(run)

    walk(_parser.parse(pattern))
    return clauses


def postings(texts: list[bytes], wanted: list[str]) -> dict[str, np.ndarray]:
    """For each wanted trigram the sorted indexes of the texts (lower-cased bytes) that contain it."""
    joined = np.frombuffer(b"\0".join(texts) + b"\0\0\0", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not wanted or not len(joined):
        return {w: np.empty(0, np.int64) for w in wanted}
    a = joined.astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    known = np.zeros(1 << 24, np.bool_)
    codes = {w: (ord(w[0]) << 16) | (ord(w[1]) << 8) | ord(w[2]) for w in wanted}
    known[list(codes.values())] = True
    at = np.flatnonzero(known[code])
    row, hit = np.searchsorted(ends, at, side="right"), code[at]
    return {w: np.unique(row[hit == c]) for w, c in codes.items()}


def candidates(query: list[list[frozenset]], index: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Rows that satisfy a trigram query; all rows if the query is empty."""
    found = np.ones(n, np.bool_)
    for clause in query:
        some = np.zeros(n, np.bool_)
        for grams in clause:
            rows = None
            for g in sorted(grams, key=lambda g: len(index[g])):
                rows = index[g] if rows is None else np.intersect1d(rows, index[g], assume_unique=True)
            some[rows] = True
        found &= some
    return found


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_batch(texts: pa.Array, rules: tuple[Rule, ...] = RULES, queries: list | None = None) -> list[list[tuple]]:
    """Spans (start, rank of the rule, end) of every text, leftmost and non-overlapping within a rule."""
    queries = queries or [trigram_query(r.pattern) for r in rules]
    strings = pc.fill_null(rebased(texts).cast(pa.large_string()), "")
    low = [t.encode() for t in pc.ascii_lower(strings).to_pylist()]
    index = postings(low, sorted({g for q in queries for c in q for s in c for g in s}))
    plain = strings.to_pylist()
    found: list[list[tuple]] = [[] for _ in plain]
    for rank, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        find = re.compile(rule.pattern).finditer
        for i in np.flatnonzero(candidates(query, index, len(plain))):
            for m in find(plain[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), rank, m.end()))
    for spans in found:
        spans.sort()
    return found


def scan_secrets(df: DataFrame, text_col: str = "text", out: str = "secret_spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``out``: the spans of all rules, ordered by start and then by rule; ends are exclusive, in code points.

    A null or empty text has an empty list. Rows are independent: repeated rows give repeated
    results, an empty table an empty one. A column of the name ``out`` is replaced; all other
    columns stay as they are. Long texts are scanned whole. Work is a single pass without a shuffle.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    kinds = [r.kind for r in rules]

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        found = [x for s, n in pieces(texts) for x in scan_batch(texts.slice(s, n), rules, queries)]
        return pa.array([[{"kind": kinds[k], "start": s, "end": e} for s, k, e in x] for x in found], _SPAN_TYPE)

    return small_batches(df).withColumn(out, spans(F.col(text_col).cast("string")))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, out="found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )
