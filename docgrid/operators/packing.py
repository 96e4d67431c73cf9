"""Greedy packing of long sequences in pieces that several tasks take.

Where a chunk starts decides where the next one starts, so a piece of the sequence is a map from the chunk that is open at its
start to the one that is open at its end. Next starts of all places are found at once from running sums, and composed by
doubling. The maps of the pieces of a run are then chained, a few numbers for each piece, after which every
piece is packed by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.shared import few, stored

#: Units of a document that a task takes.
PIECE = 20_000


def next_starts(n: np.ndarray, most: int, overlap: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For a chunk that starts at each place: the place of the unit that does not fit, or the end of the run, and where the chunk with that unit starts.

    ``ends`` are the ends of the runs of all places; all are one run without it. The new chunk takes the last units before that fit
    into ``overlap`` and leave room for the unit that comes.
    """
    sums = np.concatenate([[0], np.cumsum(n)])
    start = np.arange(len(n))
    stop = np.maximum(np.searchsorted(sums, sums[:-1] + most, "right") - 1, start + 1)
    stop = np.minimum(stop, len(n) if ends is None else ends)
    room = np.minimum(overlap, most - n[np.minimum(stop, len(n) - 1)])
    back = np.searchsorted(sums, sums[stop] - room, "left")
    return stop, np.where(room < 0, stop, np.clip(back, start, stop))


def open_at_end(n: np.ndarray, most: int, overlap: int) -> np.ndarray:
    """For a chunk that starts at each place of a run: the start of the chunk that is open after the last unit."""
    stop, then = next_starts(n, most, overlap)
    jump = np.where(stop < len(n), then, np.arange(len(n)))
    while True:
        twice = jump[jump]
        if (twice == jump).all():
            return jump
        jump = twice


def starts_from(at: int, end: int, stop: list[int], then: list[int]) -> Iterator[tuple[int, int]]:
    """(start, stop) of the chunks from the one that starts at ``at``; the last one stops at the end of the run."""
    while stop[at] < end:
        yield at, stop[at]
        at = then[at]
    yield at, end


def _sections(keys: list) -> list[tuple[int, int]]:
    """(start, end) of consecutive equal values."""
    cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if keys else []


def _whole_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each piece of each document, of rows sorted by these."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        cells = list(zip(b.column("document_id").to_pylist(), b.column("piece").to_pylist(), strict=True))
        for start, end in _sections(cells):
            if held and cells[start] != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = cells[start]
            held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _open(rows: DataFrame, most: int, overlap: int, piece: int) -> DataFrame:
    """(document_id, piece, open): the first unit of the chunk that is open where a piece, which is not its document's first one, starts."""
    kinds = dict(rows.dtypes)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last run of each piece: from the chunk that is open at its start, or at the run's start, to the one open at its end."""
        for t in _whole_pieces(batches):
            row, n, first = np.asarray(t.column("row")), np.asarray(t.column("n")), t.column("piece")[0].as_py() * piece
            start, end = _sections(t.column("run").to_pylist())[-1]
            ends = open_at_end(n[start:end], most, overlap) + start
            inner = bool(row[start] >= first)
            come = np.array([start]) if inner else start + np.flatnonzero(row[start:] < first)
            yield pa.RecordBatch.from_arrays(
                [*(t.column(c).chunk(0).slice(start, 1) for c in ("document_id", "run", "piece")), pa.array([inner]), pa.array([row[come]], pa.list_(pa.int64())), pa.array([row[ends[come - start]]], pa.list_(pa.int64()))],
                names=["document_id", "run", "piece", "inner", "come", "go"],
            )

    narrow = rows.select("document_id", "piece", "run", "row", "n").repartition("document_id", "piece").sortWithinPartitions("document_id", "piece", "row")
    found = narrow.mapInArrow(maps, f"document_id {kinds['document_id']}, run {kinds['run']}, piece long, inner boolean, come array<long>, go array<long>")
    runs = found.groupBy("document_id", "run").agg(F.array_sort(F.collect_list(F.struct("piece", "inner", "come", "go"))).alias("pieces"))  # the pieces of one run

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("piece", pa.int64()), ("open", pa.int64())]))
        for b in batches:
            out = []
            for pieces in b.column("pieces").to_pylist():
                at, done = None, []
                for p in pieces:
                    at = p["go"][0 if p["inner"] else p["come"].index(at)]
                    done.append({"piece": p["piece"] + 1, "open": at})
                out.append(done)
            yield pa.RecordBatch.from_arrays([b.column("document_id"), pa.array(out, kind)], names=["document_id", "x"])

    chained = runs.select("document_id", "pieces").mapInArrow(chain, f"document_id {kinds['document_id']}, x array<struct<piece:long,open:long>>")
    return stored(chained.select("document_id", F.explode("x").alias("x")).select("document_id", "x.*"))[0]


def packed(units: DataFrame, most: int, overlap: int, least: int = 0, piece: int = PIECE) -> DataFrame:
    """(document_id, position, page, section, text) of chunks of units (document_id, run, section, page, t, n, row, total), each run by itself.

    ``units`` is read up to three times. ``row`` numbers the ``total`` units of a document from 0, run after run. A unit counts as one token at least. Chunks of fewer than ``least``
    characters without surrounding spaces are left out before the others are numbered. Equal to one pass over each document. A task takes ``piece`` units
    of a document; the last ``most`` + 1 of them also go to the next piece, since a chunk that is open between them starts there.
    """
    piece = max(piece, 4 * (most + 2))
    kinds = dict(units.dtypes)
    rows = units.withColumn("n", F.greatest(F.col("n"), F.lit(1)).cast("long")).withColumn("row", F.col("row").cast("long"))
    own = F.floor(F.col("row") / piece)
    on = (F.col("row") % piece >= piece - most - 1) & ((own + 1) * piece < F.col("total"))
    several = bool(rows.filter(F.col("total") > piece).limit(1).count())
    if several:
        rows = rows.withColumn("piece", F.explode(F.when(on, F.array(own, own + 1)).otherwise(F.array(own))))
    else:
        rows = rows.withColumn("piece", F.lit(0).cast("long"))
    opened = _open(rows, most, overlap, piece) if several else None
    rows = rows.join(few(opened), ["document_id", "piece"], "left") if several else rows.withColumn("open", F.lit(None).cast("long"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_pieces(batches):
            row, n, text = np.asarray(t.column("row")), np.asarray(t.column("n")), t.column("t").to_pylist()
            number, opened_at, total = (t.column(c)[0].as_py() for c in ("piece", "open", "total"))
            first, last = number * piece, (number + 1) * piece >= total
            runs = _sections(t.column("run").to_pylist())
            stop, then = (x.tolist() for x in next_starts(n, most, overlap, np.repeat([e for _, e in runs], [e - s for s, e in runs])))
            made: list[tuple[int, str]] = []
            for start, end in runs:
                if row[end - 1] < first - 1:
                    continue  # a run that the piece before has ended
                at = start if row[start] >= first else int(np.searchsorted(row, opened_at))
                for a, b in starts_from(at, end, stop, then):
                    if b < end or end < len(row) or last:  # what is open at the end goes on in the next piece
                        made.append((a, " ".join(text[a:b])))
            made = [m for m in made if len(m[1].strip()) >= least]
            take = pa.array([a for a, _ in made], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(t.column(c).chunk(0).take(take) for c in ("document_id", "piece", "page", "section")), pa.array(range(len(made)), pa.int64()), pa.array([m[1] for m in made], pa.string())],
                names=["document_id", "piece", "page", "section", "nth", "text"],
            )

    field = lambda names: ", ".join(f"{c} {kinds[c]}" for c in names)
    rows = rows.select("document_id", "piece", "run", "row", "total", "n", "page", "section", "t", "open").repartition("document_id", "piece").sortWithinPartitions("document_id", "piece", "row")
    made = rows.mapInArrow(pack, f"document_id {kinds['document_id']}, piece long, {field(['page', 'section'])}, nth long, text string")
    before = F.lit(0)
    if several:
        # chunks of earlier pieces of the document: a number for each of its pieces
        made, _ = stored(made)
        counts = made.groupBy("document_id", "piece").agg(F.count(F.lit(1)).alias("_n"))
        over = Window.partitionBy("document_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        sums, _ = stored(counts.withColumn("_before", F.sum("_n").over(over)).filter("_before > 0").drop("_n"))
        made, before = made.join(few(sums), ["document_id", "piece"], "left"), F.coalesce("_before", F.lit(0))
    return made.select("document_id", (F.col("nth") + before).cast("int").alias("position"), "page", "section", "text")
