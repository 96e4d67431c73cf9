"""Which lines of a page belong to a cited chunk: longest common substrings by suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.shared import hinted, is_small

#: Lines of one page that are compared in one task.
MOST_SPANS = 10_000


class Automaton:
    """All substrings of a text: states with transitions, and the suffix link and longest length of each. Built in one pass."""

    def __init__(self, text: str):
        self.text_length = len(text)
        self.moves: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            new = self._state({}, -1, self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.moves[p]:
                self.moves[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.moves[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    copy = self._state(dict(self.moves[q]), self.link[q], self.length[p] + 1)
                    while p >= 0 and self.moves[p].get(c) == q:
                        self.moves[p][c] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def _state(self, moves: dict[str, int], link: int, length: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def longest(self, other: str) -> int:
        """Length of the longest common substring: one step for each character of ``other``, and at most as many back."""
        state = size = most = 0
        for c in other:
            while state and c not in self.moves[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.moves[state]:
                state, size = self.moves[state][c], size + 1
                most = max(most, size)
        return most

    def ratio(self, other: str) -> float:
        """The longest common substring by the shorter length; 0 where either text is empty."""
        short = min(self.text_length, len(other))
        return self.longest(other) / short if short else 0.0


def parted(text: str, letters: set[str]) -> str:
    """The longest stretch of the text that has only such letters."""
    other = set(text) - letters
    if not other:
        return text
    mark = min(other)
    return max(text.translate(dict.fromkeys(map(ord, other), mark)).split(mark), key=len)


class Chunk:
    """A text with which others are compared. A common substring has letters of both, so a longest stretch of such
    letters, where it is found whole, is the longest one; only for others is an automaton made, once."""

    def __init__(self, text: str):
        self.text, self.letters = text, set(text)
        self.automaton: Automaton | None = None

    def longest(self, other: str) -> int:
        stretch = parted(other, self.letters)
        if stretch in self.text:
            return len(stretch)
        self.automaton = self.automaton or Automaton(self.text)
        return self.automaton.longest(other)

    def ratio(self, other: str) -> float:
        short = min(len(self.text), len(other))
        return self.longest(other) / short if short else 0.0


def common_ratio(a: str, b: str) -> float:
    """The longest common substring by the shorter length; the shorter text is the automaton, where one is needed."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    for x, y in ((short, long), (long, short)):
        stretch = parted(x, set(y))
        if stretch in y:
            return len(stretch) / len(short)
    return Automaton(short).ratio(long)


def folded(text: str | None) -> str:
    """Composed Unicode form in lower case, so that both forms of an accent compare equal."""
    import unicodedata

    return unicodedata.normalize("NFC", text or "").lower()


def normalized(text: Column) -> Column:
    @F.arrow_udf("string")
    def nfc(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else folded(x) for x in t.to_pylist()], pa.string())

    return nfc(text)


def match_ratio(chunk: Column, span: Column) -> Column:
    """Longest common substring divided by the shorter length, of normalized texts."""

    @F.arrow_udf("double")
    def ratio(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([common_ratio(folded(a.as_py()), folded(b.as_py())) for a, b in zip(x, y, strict=True)], pa.float64())

    return ratio(chunk, span)


def span_ratios(citations: DataFrame, spans: DataFrame, most_spans: int = MOST_SPANS) -> DataFrame:
    """(document_id, page, chunk_id, span_id, ratio) of every span (document_id, page, span_id, span_text) with every cited chunk
    (document_id, page, chunk_id, text) of its page.

    A page's chunks and spans come to a task in that order, so each text travels once, and spans stream past the chunks. A span whose longest stretch of
    the chunk's letters is in the chunk needs a search only; for the first one that is not, the chunk becomes an automaton, in time linear in its length. A page with more than ``most_spans`` spans is dealt over
    several tasks, each with the page's chunks. Spans of four characters or fewer without
    surrounding spaces are left out; so are pages without chunks, and rows with a null document or page. Null texts are empty
    and match nothing. Equal rows are compared each. Lengths are in code points.
    """
    page = ["document_id", "page"]
    kinds = {**dict(citations.dtypes), **dict(spans.dtypes)}
    long = spans.filter(F.length(F.trim("span_text")) > 4).select(*page, "span_id", "span_text")
    parts = long.groupBy(*page).agg(F.ceil(F.count(F.lit(1)) / most_spans).cast("int").alias("_parts"))  # a row for each page
    own, other = F.lit(None).cast(kinds["chunk_id"]).alias("chunk_id"), F.lit(None).cast(kinds["span_id"]).alias("span_id")
    small = is_small(parts)
    chunk_rows = citations.select(*page, "chunk_id", "text").join(hinted(parts, small), page)
    chunk_rows = chunk_rows.select(*page, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("kind"), "chunk_id", other, "text")
    span_rows = long.join(hinted(parts, small), page)
    span_rows = span_rows.select(*page, F.pmod(F.xxhash64("span_id"), F.col("_parts")).cast("int").alias("part"), F.lit(1).alias("kind"), own, "span_id", F.col("span_text").alias("text"))
    rows = chunk_rows.unionByName(span_rows).repartition(*page, "part").sortWithinPartitions(*page, "part", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cited = None, []
        for b in batches:
            out: list[tuple] = []
            for doc, number, part, kind, chunk, span, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (doc, number, part):
                    at, cited = (doc, number, part), []
                if kind == 0:
                    cited.append((chunk, Chunk(folded(text))))
                else:
                    line = folded(text)
                    out += [(doc, number, c, span, a.ratio(line)) for c, a in cited]
            types = [b.schema.field(k).type for k in (0, 1, 4, 5)] + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["document_id", "page", "chunk_id", "span_id", "ratio"])

    return rows.mapInArrow(compare, ", ".join(f"{c} {kinds[c]}" for c in (*page, "chunk_id", "span_id")) + ", ratio double")


def highlight_spans(citations: DataFrame, spans: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(document_id, page, chunk_id, span_id, ratio) of the spans that belong to a cited chunk of their page: those with a ratio above the threshold."""
    return span_ratios(citations, spans).filter(F.col("ratio") > threshold).withColumn("ratio", F.round("ratio", 6))
