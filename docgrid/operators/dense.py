"""Exact vector search by blocks: one matrix product for each batch of chunks and the questions of its document.

A task keeps the best ``k`` chunks of each question while chunks stream through it, so that what is
shuffled afterwards is ``k`` rows of a question and task, not a row for each pair. Few questions are sent
to all tasks, and vectors are not shuffled at all; many meet the chunks of their document in
parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.shared import is_small

#: Chunks of a document and questions that meet in one task, where both are many.
PART, QUESTIONS = 32_768, 1024


class Best:
    """The best ``k`` chunks so far of each of some questions: by score, then smallest id; no score comes last."""

    def __init__(self, ids: list, vectors: list, k: int):
        self.ids, self.k = ids, k
        self.scores, self.chunks = [np.empty(0)] * len(ids), [np.empty(0, object)] * len(ids)
        self.shapes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        for size, own in by_size.items():
            self.shapes[size] = np.array(own), _unit(np.array([vectors[i] for i in own], np.float64).reshape(len(own), size))

    def add(self, chunks: np.ndarray, vectors: np.ndarray) -> None:
        """Chunks with vectors of one length; questions of another length give them no score."""
        own, matrix = self.shapes.get(vectors.shape[1], (np.empty(0, np.int64), None))
        scored = np.full((len(self.ids), len(chunks)), -np.inf)
        if len(own):
            with np.errstate(invalid="ignore"):
                product = np.round(matrix @ _unit(vectors.astype(np.float64)).T, 9)
            scored[own] = np.where(np.isnan(product), -np.inf, product)
        for i, row in enumerate(scored):
            # those that reach the k-th best, with all that are equal to it
            near = np.flatnonzero(row >= np.partition(row, len(row) - self.k)[len(row) - self.k]) if len(row) > self.k else np.arange(len(row))
            score, chunk = np.concatenate([self.scores[i], row[near]]), np.concatenate([self.chunks[i], chunks[near]])
            best = np.lexsort((chunk, -score))[: self.k]
            self.scores[i], self.chunks[i] = score[best], chunk[best]

    def rows(self) -> Iterator[tuple]:
        for q, scores, chunks in zip(self.ids, self.scores, self.chunks, strict=True):
            for s, c in zip(scores.tolist(), chunks.tolist(), strict=True):
                yield q, c, None if s == -np.inf else s


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; one of length zero becomes no number."""
    n = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(n > 0, n, np.nan)


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length; nulls within a vector are no numbers."""
    size = np.diff(np.asarray(vectors.offsets))
    flat = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], np.cumsum(size)])
    for n in np.unique(size):
        places = np.flatnonzero(size == n)
        yield places, flat[(ends[places][:, None] + np.arange(n))].reshape(len(places), int(n))


def _plain(b: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(b.column(name).to_pylist(), object)


def _batch(best: list[Best], kinds: list[pa.DataType]) -> pa.RecordBatch:
    rows = [r for x in best for r in x.rows()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([*kinds, pa.float64()])], names=["question_id", "chunk_id", "score"])


def block_scores(questions: DataFrame, chunks: DataFrame, k: int, small: bool | None = None, part: int = PART, most_questions: int = QUESTIONS) -> DataFrame:
    """(question_id, chunk_id, score): of each task, the ``k`` nearest chunks of each question's document; all of the ``k`` nearest are among them.

    ``questions`` (question_id, document_id, embedding) and ``chunks`` (document_id, chunk_id, embedding). Scores are cosines, rounded to nine places;
    null where a vector has no length, a null in it or another number of places. Rows without document or vector have no place. Equal rows count each.
    """
    small = is_small(questions) if small is None else small
    schema = f"question_id {dict(questions.dtypes)['question_id']}, chunk_id {dict(chunks.dtypes)['chunk_id']}, score double"
    q = questions.select("document_id", "question_id", "embedding").filter("document_id is not null and embedding is not null")
    c = chunks.select("document_id", "chunk_id", "embedding").filter("document_id is not null and embedding is not null")
    if small:
        table = q.toArrow()  # few, as has been counted
        by_document: dict = {}
        for doc, *rest in zip(*(table.column(x).to_pylist() for x in ("document_id", "question_id", "embedding")), strict=True):
            by_document.setdefault(doc, []).append(rest)
        shared = chunks.sparkSession.sparkContext.broadcast((by_document, table.schema.field("question_id").type))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, q_kind = shared.value
            best: dict = {}
            for b in batches:
                docs, kind = _plain(b, "document_id"), b.schema.field("chunk_id").type
                ids = _plain(b, "chunk_id")
                for places, matrix in _matrices(b.column("embedding")):
                    for doc in set(docs[places]) & wanted.keys():
                        if doc not in best:
                            best[doc] = Best(*map(list, zip(*wanted[doc], strict=True)), k)
                        own = docs[places] == doc
                        best[doc].add(ids[places][own], matrix[own])
            if best:
                yield _batch(list(best.values()), [q_kind, kind])

        asked = F.col("document_id").isin(*list(by_document)) if len(by_document) <= 1000 else F.lit(True)
        return c.filter(asked).mapInArrow(scan, schema)

    # parts of a document by hash, as many as its chunks and questions ask for
    parts = c.groupBy("document_id").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("_parts"))
    groups = q.groupBy("document_id").agg(F.ceil(F.count(F.lit(1)) / most_questions).cast("int").alias("_groups"))
    sizes = parts.hint("merge").join(groups.hint("merge"), "document_id")
    dealt = lambda c_, n: F.pmod(F.xxhash64(c_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.join(sizes.hint("merge"), "document_id").select("document_id", every("_parts").alias("part"), dealt("question_id", "_groups").alias("grp"), F.lit(0).alias("kind"), "question_id", F.lit(None).cast(dict(c.dtypes)["chunk_id"]).alias("chunk_id"), "embedding")
    right = c.join(sizes.hint("merge"), "document_id").select("document_id", dealt("chunk_id", "_parts").alias("part"), every("_groups").alias("grp"), F.lit(1).alias("kind"), F.lit(None).cast(dict(q.dtypes)["question_id"]).alias("question_id"), "chunk_id", "embedding")
    keys = ["document_id", "part", "grp"]
    rows = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, asked = None, None, []
        for b in batches:
            cells = list(zip(*(b.column(x).to_pylist() for x in keys), strict=True))
            kind, ids, names, vectors = np.asarray(b.column("kind")), _plain(b, "chunk_id"), b.column("question_id").to_pylist(), b.column("embedding")
            types = [b.schema.field(x).type for x in ("question_id", "chunk_id")]
            start = 0
            while start < len(cells):
                end = start
                while end < len(cells) and cells[end] == cells[start]:
                    end += 1
                if cells[start] != at:
                    if best:
                        yield _batch([best], types)
                    at, best, asked = cells[start], None, []
                first = start + int((kind[start:end] == 0).sum())
                asked += zip(names[start:first], vectors.slice(start, first - start).to_pylist(), strict=True)
                if first < end and asked:  # no question may have come to this group
                    best = best or Best(*map(list, zip(*asked, strict=True)), k)
                    for places, matrix in _matrices(vectors.slice(first, end - first)):
                        best.add(ids[first + places], matrix)
                start = end
        if best:
            yield _batch([best], types)

    return rows.mapInArrow(meet, schema)
