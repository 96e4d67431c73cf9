"""Substring dedup by super-k-mers.

A window is a run of ``window`` words of one document. Its minimiser is the least hash among its
``m``-word sequences, so equal windows have equal minimisers, and consecutive windows mostly
share one: they travel as one packed string, a super-k-mer, to the bucket of their minimiser,
where sorting settles which windows are equal and which document has each of them first.

Texts lie in blocks. A block first sends its minimisers only; those that one document alone has
are done. It then sends, once for each different string, the super-k-mers of the others, and gets
the first holder of every repeated window back. Nothing is sent once for each copy, so that a text
or passage with many copies costs a row for each block that holds it. A minimiser with more than
``most`` strings is not sorted in one task: its windows become rows, which Spark aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.blocks import opened, text_blocks
from docgrid.llm.text import coded, hash_words, mix64, small_batches, words_of
from docgrid.shared import stored

#: Words of a window, and of the sequences of which the least hash is the minimiser.
WINDOW, M = 50, 8
#: Most windows of a super-k-mer; only texts that repeat a sequence within a window reach it.
MOST_WINDOWS = 64
#: Strings of one minimiser that may meet in a task; beyond, its windows are aggregated as rows.
MOST_STRINGS = 4096
#: Bytes of text of a block, and of strings that a task sorts at once.
BLOCK_BYTES, BUCKET_BYTES = 4_000_000, 4_000_000

_BASE = 0x9E3779B97F4A7C15
_NONE = np.iinfo(np.int64).max


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= w:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    rest = w - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def super_kmers(hashes: np.ndarray, at: np.ndarray, usable: np.ndarray, window: int, m: int) -> tuple[np.ndarray, ...]:
    """(document, first word, number of windows, minimiser, hash of the string) of each super-k-mer.

    ``hashes`` are those of all words of all documents, ``at`` the offsets of documents, ``usable`` tells which count.
    """
    n = len(hashes)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    grams = np.zeros(n - m + 1, np.uint64)
    for k in range(m):
        grams = grams * np.uint64(_BASE) + hashes[k : n - m + 1 + k]
    least = sliding_min(mix64(grams), window - m + 1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = (doc[: n - window + 1] == doc[window - 1 :]) & usable[doc[: n - window + 1]]
    spot = np.flatnonzero(ok)
    mini, of = least[spot], doc[spot]
    new = np.ones(len(spot), np.bool_)
    new[1:] = (mini[1:] != mini[:-1]) | (of[1:] != of[:-1])
    place = np.arange(len(spot))
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % MOST_WINDOWS == 0
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(spot)))
    start, mini, of = spot[first], mini[first], of[first]
    # a polynomial over the words between two places, from sums up to either
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)])
    back = _powers(pow(_BASE, -1, 1 << 64), n)
    span = (sums[start + windows + window - 1] - sums[start]) * back[start]
    return of, start, windows, mini, mix64(mix64(span + windows.astype(np.uint64)) ^ mini)


def window_ranks(ids: np.ndarray, window: int) -> np.ndarray:
    """A number for each window such that equal windows, and only these, have equal numbers: sorted by pairs of halves."""
    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    rank, span = ids, 1
    while span * 2 <= window:
        rank, span = pairs(rank[:-span], rank[span:]), span * 2
    rest = window - span
    return pairs(rank[: len(rank) - rest], rank[rest:]) if rest else rank


def _extremes(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, least lo, greatest hi) of each value of ``group``, in the order of values."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=group[order][:1] - group.dtype.type(1)))
    return order[first], np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first)


def _ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, one after the other, and the offsets of ranges."""
    ends = np.concatenate([[0], np.cumsum(length)])
    return np.arange(int(ends[-1])) - np.repeat(ends[:-1] - start, length), ends


class _Block:
    """Words, documents and super-k-mers of a block."""

    def __init__(self, row: dict, window: int, m: int):
        ids = pa.array(row["id"], pa.int64())
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0))
        self.words, self.at = words_of(pa.array(opened(row), pa.large_string()))
        codes, distinct = coded(self.words)
        hashes = hash_words(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
        self.of, self.start, self.windows, self.mini, self.sid = super_kmers(hashes, self.at, self.known, window, m)


def _joined(words: pa.Array, offsets: np.ndarray) -> pa.Array:
    """The words of each range, joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words.cast(pa.string())), " ")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _first_holders(words: pa.Array, lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string the least document that has it, ``_NONE`` where no other document does; offsets of strings."""
    flat, at = words_of(words)
    codes, _ = coded(flat)
    count = np.diff(at) - window + 1
    spot, ends = _ranges(at[:-1], count)
    row = np.repeat(np.arange(len(count)), count)
    group = window_ranks(codes, window)[spot]
    _, least, most = _extremes(group, lo[row], hi[row])
    dense = np.unique(group, return_inverse=True)[1]
    return np.where(least < most, least, _NONE)[dense], ends


def repeated_windows(blocks: DataFrame, window: int, m: int, most: int) -> DataFrame:
    """(block, held: array of (sid, los)): for super-k-mers of each block the first holder of each window that several documents have."""
    def minimisers(batches):
        for b in batches:
            for row in b.to_pylist():
                x = _Block(row, window, m)
                if not len(x.mini):
                    continue
                doc = x.ids[x.of]
                first, lo, hi = _extremes(x.mini, doc, doc)
                _, one = np.unique(x.sid, return_index=True)
                n = np.bincount(np.searchsorted(x.mini[first], x.mini[one]), minlength=len(first))
                yield pa.RecordBatch.from_arrays([_signed(x.mini[first]), pa.array(np.full(len(first), row["block"])), pa.array(lo), pa.array(hi), pa.array(n)], names=["mini", "block", "lo", "hi", "n"])

    asks, drop_asks = stored(small_batches(blocks).mapInArrow(minimisers, "mini long, block long, lo long, hi long, n long"))
    shared = asks.groupBy("mini").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).filter("lo < hi")
    # written, as are the holders below: then both sides of the joins are plain shuffles, whose hot keys adaptive execution splits
    shared, drop_shared = stored(shared.select("mini", (F.col("n") > most).alias("hot")))
    wanted = asks.select("mini", "block").hint("shuffle_merge").join(shared.hint("shuffle_merge"), "mini").groupBy("block").agg(F.collect_list(F.struct("mini", "hot")).alias("wanted"))

    def strings(batches):
        for b in batches:
            for row in b.to_pylist():
                x = _Block(row, window, m)
                asked = np.array([w["mini"] for w in row["wanted"]], np.int64).view(np.uint64)
                order = np.argsort(asked)
                hot = np.array([w["hot"] for w in row["wanted"]])[order]
                spot = np.minimum(np.searchsorted(asked[order], x.mini), len(asked) - 1)
                keep = np.flatnonzero(asked[order][spot] == x.mini)
                doc = x.ids[x.of[keep]]
                first, lo, hi = _extremes(x.sid[keep], doc, doc)
                pick = keep[first]
                places, ends = _ranges(x.start[pick], x.windows[pick] + window - 1)
                words = _joined(x.words.take(pa.array(places)), ends)
                yield pa.RecordBatch.from_arrays(
                    [_signed(x.mini[pick]), _signed(x.sid[pick]), pa.array(np.full(len(pick), row["block"])), pa.array(lo), pa.array(hi), pa.array(hot[spot[pick]]), words],
                    names=["mini", "sid", "block", "lo", "hi", "hot", "words"],
                )

    sent = blocks.hint("shuffle_hash").join(wanted.hint("shuffle_hash"), "block")
    sent, drop_sent = stored(sent.mapInArrow(strings, "mini long, sid long, block long, lo long, hi long, hot boolean, words string"))

    def solve(rows: pa.Table):
        mini, sid = (np.asarray(rows.column(c)) for c in ("mini", "sid"))
        held, ends = _first_holders(rows.column("words").combine_chunks(), np.asarray(rows.column("lo")), np.asarray(rows.column("hi")), window)
        found = np.logical_or.reduceat(held < _NONE, ends[:-1])
        order = np.lexsort((sid, mini))
        same = np.zeros(len(order), np.bool_)
        same[1:] = (mini[order][1:] == mini[order][:-1]) & (sid[order][1:] == sid[order][:-1])
        pick = order[~same & found[order]]
        places, at = _ranges(ends[:-1][pick], np.diff(ends)[pick])
        yield pa.RecordBatch.from_arrays([pa.array(mini[pick]), pa.array(sid[pick]), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(held[places]))], names=["mini", "sid", "los"])

    def sort_bucket(batches):
        kept: list[pa.RecordBatch] = []
        for b in batches:
            kept.append(b)
            if sum(k.nbytes for k in kept) > BUCKET_BYTES:
                rows = pa.Table.from_batches(kept).combine_chunks()
                mini = np.asarray(rows.column("mini"))
                whole = int(np.searchsorted(mini, mini[-1]))
                if whole:
                    yield from solve(rows.slice(0, whole))
                    kept = rows.slice(whole).to_batches()
        if rows := pa.Table.from_batches(kept) if kept else None:
            yield from solve(rows.combine_chunks())

    cold = sent.filter(~F.col("hot")).select("mini", "sid", "lo", "hi", "words").repartition("mini").sortWithinPartitions("mini")
    cold = cold.mapInArrow(sort_bucket, "mini long, sid long, los array<long>")

    def windows_of(batches):
        for b in batches:
            flat, at = words_of(b.column("words"))
            codes, distinct = coded(flat)
            count = np.diff(at) - window + 1
            spot, ends = _ranges(at[:-1], count)
            row = np.repeat(np.arange(len(count)), count)
            hashed = hash_words(distinct)
            names = []
            for mixed in (hashed, mix64(hashed ^ np.uint64(_BASE))):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[codes] * _powers(_BASE, len(codes)), dtype=np.uint64)])
                names.append(mix64((sums[spot + window] - sums[spot]) * _powers(pow(_BASE, -1, 1 << 64), len(codes))[spot]))
            cols = [b.column(c).take(pa.array(row)) for c in ("mini", "sid", "lo", "hi")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(len(spot)) - np.repeat(ends[:-1], count)), *map(_signed, names)], names=["mini", "sid", "lo", "hi", "i", "h0", "h1"])

    strings_once = sent.filter("hot").groupBy("mini", "sid", "words").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows, drop_rows = stored(strings_once.mapInArrow(windows_of, "mini long, sid long, lo long, hi long, i long, h0 long, h1 long"))
    holders = rows.groupBy("h0", "h1").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("h0", "h1", F.col("lo").alias("first"))
    holders, drop_holders = stored(holders)
    per = rows.select("mini", "sid", "i", "h0", "h1").hint("shuffle_merge").join(holders.hint("shuffle_merge"), ["h0", "h1"], "left")
    per = per.groupBy("mini", "sid").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("first", F.lit(_NONE)).alias("lo")))).alias("l"), F.count("first").alias("n"))
    hot = per.filter("n > 0").select("mini", "sid", F.transform("l", lambda x: x["lo"]).alias("los"))
    answers = cold.unionByName(hot)
    back = sent.select("mini", "sid", "block").hint("shuffle_merge").join(answers.hint("shuffle_merge"), ["mini", "sid"])
    out, _ = stored(back.groupBy("block").agg(F.collect_list(F.struct("sid", "los")).alias("held")))
    for drop in (drop_asks, drop_shared, drop_sent, drop_rows, drop_holders):
        drop()
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = M, block_bytes: int = BLOCK_BYTES, most: int = MOST_STRINGS) -> DataFrame:
    """(id, n_words, spans, text) of every row: words apart from those of windows that a document with a smaller id has, too.

    Words are what ASCII white space separates; ``spans`` are the maximal runs [start, end) of removed words, and ``text``
    holds the others joined by one space. Windows are judged on the input. A null or empty text, and one shorter than a
    window, loses nothing. A null id is neither smaller nor greater than any: such a row loses nothing and takes nothing
    from others. Rows with equal ids are one document as far as removal goes, so copies under one id all stay. An
    empty table gives none. Other columns are ignored, whatever their names. A long text is a block of its own and is
    handled whole by one task.
    """
    if not 1 <= m <= window:
        raise ValueError("m is to be from 1 to window")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks, _ = text_blocks(rows, "text", block_bytes)
    held = repeated_windows(blocks, window, m, most)

    def apply(batches):
        for b in batches:
            for row in b.to_pylist():
                x = _Block(row, window, m)
                gone = np.zeros(len(x.words) + 1, np.int64)
                if row["held"]:
                    sid = np.array([h["sid"] for h in row["held"]], np.int64).view(np.uint64)
                    order = np.argsort(sid)
                    flat = np.concatenate([np.array(h["los"], np.int64) for h in row["held"]])
                    ends = np.concatenate([[0], np.cumsum([len(h["los"]) for h in row["held"]])])
                    spot = order[np.minimum(np.searchsorted(sid[order], x.sid), len(sid) - 1)]
                    hit = np.flatnonzero(sid[spot] == x.sid)
                    places, _ = _ranges(ends[spot[hit]], x.windows[hit])
                    starts, _ = _ranges(x.start[hit], x.windows[hit])
                    starts = starts[flat[places] < np.repeat(x.ids[x.of[hit]], x.windows[hit])]
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                before = np.concatenate([[0], np.cumsum(~gone)])[x.at]
                text = _joined(x.words.filter(pa.array(~gone)), before)
                doc = np.repeat(np.arange(len(x.ids)), np.diff(x.at))
                edge = np.ones(len(gone), np.bool_)
                edge[1:] = (gone[1:] != gone[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(edge)
                end = np.append(first[1:], len(gone))
                runs = gone[first]
                first, end = first[runs], end[runs]
                of = doc[first]
                spans = pa.StructArray.from_arrays([pa.array(first - x.at[of]), pa.array(end - x.at[of])], names=["start", "end"])
                per = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(x.ids)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["id"], pa.int64()), pa.array(np.diff(x.at)), pa.ListArray.from_arrays(pa.array(per), spans), text], names=["id", "n_words", "spans", "text"]
                )

    # the lists of blocks are the side that is held in memory; texts are not sorted
    joined = blocks.join(held.hint("shuffle_hash"), "block", "left")
    out = joined.mapInArrow(apply, "id long, n_words long, spans array<struct<start:long,end:long>>, text string")
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "text")


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Removed words of every whole document, and the digest of the others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k
      FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
hit AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY k) AS f FROM w) WHERE f < doc_id),
gone AS (SELECT r, list(DISTINCT p) AS g FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY r),
word AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM d),
out AS (SELECT r, p, x FROM word ANTI JOIN (SELECT r, unnest(g) AS p FROM gone) USING (r, p)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM out GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
