"""Mixing sources to target weights by balanced (cube) sampling.

A source's target, divided by its size, is the number of copies that each of its documents
should give on average: the whole part is taken as it is, the fraction is an inclusion
probability. The flight phase of the cube method moves these probabilities along directions in
which neither the number of documents nor the number of words of a source changes, until each
is 0 or 1 but for two in a block. What is left over of all blocks flies again, in blocks of
blocks, until one small rest for each source remains; the landing rounds that rest so that
words, then documents, come nearest to their totals, and turns a few decisions of the last block
where a long document had to be rounded.

Blocks are spans of global row numbers inside a source, in a seeded hash order, so results do
not depend on partitions, and a source with most rows spreads over as many blocks as it needs.
"""

from __future__ import annotations

import itertools
import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.text import least_rows
from docgrid.shared import cut, fresh, running_start

#: Fixed values of the mix: weights by rank of the source, repeating, and the most copies of a document.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BLOCK = 4096
#: Up to so many sources (one narrow row each) are sent to every task; beyond, they are joined by a shuffle.
MOST_BROADCAST = 100_000
EDGE = 1e-9
#: Decisions that a landing may turn.
REPAIRS = 64


def fly(ids: list, sizes: list[float], probs: list[float], seed: int, land: bool) -> list[float]:
    """The flight phase over one block, and the landing if asked for: new probabilities, in order.

    Three undecided units at a time have a direction that keeps both sum(p) and sum(size * p).
    """
    rng, p, hand = random.Random(seed), list(probs), []
    for i in range(len(ids)):
        if not EDGE < p[i] < 1 - EDGE:
            p[i] = float(round(p[i]))
            continue
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = hand
        move = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
        if not any(move):
            move = (1.0, -1.0, 0.0)
        up = min(((1 - p[k]) / m if m > 0 else -p[k] / m) for k, m in zip(hand, move, strict=True) if m)
        down = min((p[k] / m if m > 0 else (p[k] - 1) / m) for k, m in zip(hand, move, strict=True) if m)
        step = up if rng.random() * (up + down) < down else -down
        left = []
        for k, m in zip(hand, move, strict=True):
            p[k] += step * m
            if EDGE < p[k] < 1 - EDGE:
                left.append(k)
            else:
                p[k] = float(round(p[k]))
        hand = left
    if land and hand:
        words, docs = sum(p[k] * sizes[k] for k in hand), sum(p[k] for k in hand)
        best = min(
            itertools.product((0.0, 1.0), repeat=len(hand)),
            key=lambda x: (abs(sum(v * sizes[k] for v, k in zip(x, hand, strict=True)) - words), abs(sum(x) - docs), x),
        )
        for k, v in zip(hand, best, strict=True):
            p[k] = v
        off = words - sum(p[k] * sizes[k] for k in hand)
        for _ in range(REPAIRS):
            flip = min(range(len(ids)), key=lambda i: abs(off - sizes[i] * (1 - 2 * p[i])) if 0 < probs[i] < 1 else abs(off))
            if abs(off - sizes[flip] * (1 - 2 * p[flip])) >= abs(off):
                break
            off -= sizes[flip] * (1 - 2 * p[flip])
            p[flip] = 1 - p[flip]
    return p


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, first_row, target) of (source, size) rows.

    Sources are ranked by code point, null last; ``weights`` repeat along the ranks. Each target is
    weight * level, at most ``most`` times the source's size; the level is raised until the targets
    share all sizes. Only sums reach the driver, one pair a step.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by = by.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1))
    by = running_start(by, ["_null", "source"], "_one", "_rank")
    by = cut(running_start(by, ["_rank"], "n_docs", "first_row"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    by = by.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(most))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        full = F.col("_cap") < F.col("_w") * F.lit(level)
        free, taken = by.agg(F.sum(F.when(~full, F.col("_w"))), F.sum(F.when(full, F.col("_cap")))).first()
        if not free:
            break
        before, level = level, max(level, (total - (taken or 0.0)) / free)
    return by.select("source", "source_size", "n_docs", "first_row", F.least(F.col("_w") * level, F.col("_cap")).alias("target"))


def cube_mix(
    rows: DataFrame,
    id_cols: list[str],
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST_COPIES,
    seed: int = 6,
    block: int = BLOCK,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """Narrow ``rows`` (``id_cols``, source, size) with source_size, target, copies and taken (= copies * size).

    ``id_cols`` should tell rows apart; rows that agree in all columns are interchangeable. A null
    or negative size counts as 0; the null source is a source of its own; a source of size 0 has
    target 0; texts do not travel, whatever their length. No row gets more than ``most`` copies. Reruns agree. An empty table gives none.
    """
    rows = rows.select(*id_cols, "source", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("size"))
    targets = cut(source_targets(rows, weights, most))
    few = targets.count() <= most_broadcast
    per = F.broadcast(targets) if few else targets.hint("shuffle_merge")
    joined = rows.alias("r").join(per.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    joined = joined.withColumn("_each", each).withColumn("_one", F.lit(1))
    joined = joined.withColumn("_h", F.xxhash64(F.lit(seed), *id_cols, "size"))
    numbered = running_start(joined.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source", "_h", *id_cols, "size"], "_one", "_row")
    cur = numbered.withColumn("_at", F.col("_row") - F.col("first_row")).withColumn("_p", F.col("_each") - F.floor("_each"))
    cur = cur.withColumn("_block", F.floor(F.col("_at") / block)).drop("_null", "_one", "_h")
    schema, done = cur.schema, None
    blocks = (targets.agg(F.max("n_docs")).first()[0] or 0) // block + 1
    level = 0
    while True:
        land = blocks == 1

        def flight(batches, land=land, level=level):
            """Blocks arrive whole and in order; a block is flown when the next one begins."""
            held: list[pa.RecordBatch] = []

            def out():
                t = pa.Table.from_batches(held).combine_chunks()
                at = t.schema.get_field_index("_p")
                rows_ = t.column("_row").to_pylist()
                p = fly(rows_, [float(x) for x in t.column("size").to_pylist()], t.column("_p").to_pylist(), hash((seed, level, rows_[0])), land)
                return t.set_column(at, "_p", pa.array(p, pa.float64())).to_batches()

            last = None
            for b in batches:
                keys = list(zip(b.column("first_row").to_pylist(), b.column("_block").to_pylist(), strict=True))
                start = 0
                for i, k in enumerate(keys):
                    if k != last:
                        if i > start:
                            held.append(b.slice(start, i - start))
                        if held:
                            yield from out()
                        held, start, last = [], i, k
                if start < len(keys):
                    held.append(b.slice(start))
            if held:
                yield from out()

        flown = cur.repartition("first_row", "_block").sortWithinPartitions("first_row", "_block", "_at").mapInArrow(flight, schema)
        flown = cut(flown)
        open_ = (F.col("_p") > EDGE) & (F.col("_p") < 1 - EDGE)
        decided = flown if land else flown.filter(~open_)
        done = decided if done is None else done.unionByName(decided)
        if land:
            break
        step = max(2, block // 4)  # three at most are left of each block
        cur = flown.filter(open_).withColumn("_block", F.floor(F.col("_block") / step))
        blocks, level = (blocks - 1) // step + 1, level + 1
    copies = (F.floor("_each") + F.round("_p")).cast("int")
    return done.select(*id_cols, "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def n_words(text: str = "text"):
    """Number of words of a text column, 0 for null, without building the words."""
    t = F.col(text)
    return F.coalesce(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **mix) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns as before. Sizes are words.

    Of rows that repeat id, text and source the least by all columns is laid out for all. A null or empty text has
    size 0 and is taken as often as the mix takes it; a text of any length travels once, to the number of its copies;
    an empty table stays empty; columns may have any names. ``mix`` goes to ``cube_mix``.
    """
    key, own_id, own_key, own_source, n, times, copy = fresh(docs, "key", "own_id", "own_key", "own_source", "n", "times", "copy")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    rows = keyed.select(F.col(id_col).alias("_id"), F.col(key).alias("_key"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    per = cube_mix(rows, ["_id", "_key"], **mix).groupBy("_id", "_key", "source").agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(times))
    per = cut(per.filter(F.col(n) > 0).withColumnsRenamed({"_id": own_id, "_key": own_key, "source": own_source}))
    on = keyed[id_col].eqNullSafe(per[own_id]) & (keyed[key] == per[own_key]) & keyed[source_col].eqNullSafe(per[own_source])
    joined = keyed.hint("shuffle_merge").join(per.hint("shuffle_merge"), on).drop(own_key, own_id, own_source)
    if not per.filter(F.col(times) > 1).isEmpty():
        once = joined.filter(F.col(times) == 1).select(*docs.columns, n)
        joined = once.unionByName(least_rows(joined.filter(F.col(times) > 1), [id_col, key, source_col], [*docs.columns, n], [id_col, text_col, source_col]))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)


def op6_cube_mix(spark, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of sources that weigh 5, 2, 1, repeating."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), "source", n_words().alias("size"))
    return cube_mix(rows, ["doc_id", "_text"]).drop("_text", "source")
