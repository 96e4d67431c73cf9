"""Blocks to token-budgeted, overlapping chunks: atoms as column expressions, packed in pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.config import DEFAULT, Config
from docgrid.functions.columns import word_count
from docgrid.operators.packing import PIECE, packed
from docgrid.operators.structure import section_runs
from docgrid.shared import stored

Counter = Callable[[Column], Column]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def atoms(text: Column, max_tokens: int, count: Counter = word_count) -> Column:
    """Sentences and lines of a text, stripped; one over the budget is cut into equal slices of characters."""
    sentences = F.filter(F.transform(F.split(text, r"(?U)(?<=[.;:!?])\s+|\n+", -1), _strip), lambda s: s != "")

    def cut(s: Column) -> Column:
        n = count(s)
        width = F.greatest(F.lit(1), F.floor(F.length(s) * F.lit(max_tokens) / F.greatest(n, F.lit(1)))).cast("int")
        slices = F.transform(F.sequence(F.lit(1), F.length(s), width), lambda i: F.substring(s, i, width))
        return F.when(n <= max_tokens, F.array(s)).otherwise(slices)

    return F.flatten(F.transform(sentences, cut))


def chunks(
    block_rows: DataFrame, max_tokens: int | None = None, overlap_tokens: int | None = None, min_chars: int | None = None, count: Counter = word_count, config: Config = DEFAULT, piece: int = PIECE
) -> DataFrame:
    """(document_id, position, page, section, text) of blocks (document_id, block, page, section, text).

    A chunk never mixes sections. Units fill a chunk up to the budget; a new chunk starts with the last units of the one before
    that fit into the overlap and leave room for the unit that comes. Chunks shorter than ``min_chars`` are dropped before they are
    numbered, after the overlap has been taken. ``count`` is the token counter; a unit has one token at least. Units are packed in pieces
    of ``piece``, so that one long document is the work of several tasks.
    """
    max_tokens, overlap = max_tokens or config.chunk_max_tokens, config.chunk_overlap_tokens if overlap_tokens is None else overlap_tokens
    least = config.chunk_min_chars if min_chars is None else min_chars
    rows = section_runs(block_rows).select("document_id", "run", "section", "block", F.col("page").cast("int").alias("page"), atoms(F.col("text"), max_tokens, count).alias("units"))
    along = Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    size = F.size("units").cast("long")
    rows = rows.withColumn("_at", F.coalesce(F.sum(size).over(along), F.lit(0))).withColumn("total", F.sum(size).over(Window.partitionBy("document_id")))
    rows, _ = stored(rows.withColumn("units", F.transform("units", lambda t: F.struct(t.alias("t"), count(t).alias("n")))))
    units = rows.select("document_id", "run", "section", "page", "total", "_at", F.posexplode("units").alias("i", "u"))
    units = units.select("document_id", "run", "section", "page", "total", (F.col("_at") + F.col("i")).alias("row"), "u.t", "u.n")
    return packed(units, max_tokens, overlap, least, piece)
