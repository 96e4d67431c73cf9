"""Words and bytes of Arrow string arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.shared import BATCH_BYTES, BATCH_ROWS, fresh, small_batches  # noqa: F401

#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def least_rows(rows: DataFrame, by: list[str], columns: list[str], same: list[str]) -> DataFrame:
    """``columns`` of one row for each ``by``: the least one by all of them but ``same``, in which rows agree, nulls first.

    Maps and variants, which have no order, are compared as JSON. Rows that agree in all columns are one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ordered = [F.to_json(F.struct(c)) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(c) for c in columns if c not in same]
    (least,) = fresh(rows, "least")
    return rows.groupBy(*by).agg(F.min_by(F.struct(*columns), F.struct(F.lit(0), *ordered)).alias(least)).select(f"{least}.*")


def rebased(texts: pa.Array) -> pa.Array:
    """The array itself, or a copy if it is a slice: Arrow's case functions misread the offsets of slices."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.take(pa.array(np.arange(len(texts)))) if texts.offset else texts


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and offsets (n + 1) of each text's words. A null text has none."""
    texts = pc.fill_null(rebased(texts).cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    flat, offsets = split.flatten(), np.asarray(split.offsets, dtype=np.int64)
    keep = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(keep)])
    return flat.filter(pa.array(keep)), before[offsets - offsets[0]]


#: Bytes of text that are taken apart at once.
PIECE_BYTES = 1_000_000


def spans(texts: pa.Array, most: int = PIECE_BYTES) -> list[tuple[int, int]]:
    """(start, length) of slices of about ``most`` bytes, so that memory does not follow the batch."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    group = np.cumsum(size) // most
    first = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.empty(0, np.int64)
    return list(zip(first.tolist(), np.diff(np.append(first, len(group))).tolist(), strict=True))


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense ids of the words, and the distinct words."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over unsigned integers (multiply, shift, xor)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of words: a random number for each byte in its place, summed."""
    words = rebased(distinct).cast(pa.large_binary())
    n = np.asarray(pc.binary_length(words), dtype=np.int64)
    if not len(n):
        return np.empty(0, np.uint64)
    ends = np.cumsum(n)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[: int(ends[-1])] if ends[-1] else np.empty(0, np.uint8)
    place = np.arange(len(raw)) - np.repeat(ends - n, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(raw.astype(np.uint64) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(256)), dtype=np.uint64)])
    return mix64(total[ends] - total[ends - n] + n.astype(np.uint64))


#: Bits of a filter that names a set of hashes to every task: 4 MB, however many hashes there are.
FILTER_BITS = 25


def filter_of(keys: DataFrame, name: str):
    """A broadcast of bits for the long hashes in column ``name`` of ``keys``, for ``passes``."""
    cell = F.col(name).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = keys.select(F.shiftright(cell, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    held = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    held[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(held)


def passes(held: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether hashes pass a filter: all that it was made of do, and some others; the more, the more there were."""
    cell = x.astype(np.int64).view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
    return (held[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(np.bool_)


def maybe_in(keys: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test for long hashes by a filter of column ``name`` of ``keys``."""
    shared = filter_of(keys, name)

    @F.arrow_udf("boolean")
    def test(x: pa.Array) -> pa.Array:
        return pa.array(passes(shared.value, x.to_numpy(zero_copy_only=False)))

    return test
