"""Texts in blocks of bounded size, and packed integers that blocks send to each other."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.text import small_batches
from docgrid.shared import stored

#: Blocks that a task may number; the rest of the number is the task's partition.
_BLOCK_BITS = 20


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers as bytes: the width that the largest needs, then all low bytes, all next ones, and so on; compressed."""
    import zstandard

    x = x.astype("<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    width = raw[0]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :width] = flat.T
    return out.view("<u8").ravel().astype(np.uint64)


def text_blocks(df: DataFrame, text_col: str, block_bytes: int) -> tuple[DataFrame, Callable[[], None]]:
    """(block, an array for each other column of ``df``, chars, raw) of all rows, written; and a function that deletes the table.

    A block holds about ``block_bytes`` of text, or one longer text. A null text counts as empty. ``block`` is a
    number of less than 43 bits, for up to 8 million partitions of a million blocks each.
    """
    others = [f for f in df.schema if f.name != text_col]
    names = [f.name for f in others]

    def gather(batches):
        import zstandard
        from pyspark import TaskContext

        part, held, texts, bytes_, number = TaskContext.get().partitionId(), [[] for _ in names], [], 0, 0
        kinds: list[pa.DataType] = []

        def out():
            raw = zstandard.ZstdCompressor(level=3).compress("".join(texts).encode())
            cols = [pa.array([(part << _BLOCK_BITS) | number], pa.int64())]
            cols += [pa.array([h], pa.list_(t)) for h, t in zip(held, kinds, strict=True)]
            cols += [pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", *names, "chars", "raw"])

        for b in batches:
            kinds = [b.schema.field(c).type for c in names]
            sizes = pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_pylist()
            columns = [b.column(c).to_pylist() for c in names]
            for i, (t, s) in enumerate(zip(b.column(text_col).to_pylist(), sizes, strict=True)):
                if texts and bytes_ + s > block_bytes:
                    yield out()
                    held, texts, bytes_, number = [[] for _ in names], [], 0, number + 1
                for h, c in zip(held, columns, strict=True):
                    h.append(c[i])
                texts.append(t or "")
                bytes_ += s + 16
        if texts:
            yield out()

    fields = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in others)
    rows = small_batches(df).select(*names, F.col(text_col).cast("string").alias(text_col))
    return stored(rows.mapInArrow(gather, f"block long, {fields}, chars array<int>, raw binary"))


def opened(block: dict) -> list[str]:
    """The texts of a block."""
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(block["raw"]).decode(), 0, []
    for n in block["chars"]:
        out.append(raw[at : at + n])
        at += n
    return out


def sections(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values of a sorted array."""
    if not len(values):
        return []
    first = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    return list(zip(values[first].tolist(), first.tolist(), np.append(first[1:], len(values)).tolist(), strict=True))
