"""Chat formatting: collapse cumulative snapshots, then render.

A chat log often holds a conversation several times, each time with more turns. Additive
hashes of (position, role, text), summed along the turns, identify every prefix; a
conversation whose whole hash is the hash of a proper prefix of another one is dropped by an
anti-join, and only maximal conversations are rendered. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.shared import cut

#: Turns are numbered and summed in spans of so many turn numbers, so that a very long conversation spreads over tasks.
SPAN = 512


def _halves(*cols: Column) -> list[Column]:
    """A 128-bit hash as four numbers below 2**32, whose sums cannot overflow a long."""
    hashes = [F.xxhash64(F.lit(seed), *cols) for seed in (11, 23)]
    return [x for h in hashes for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, len (1, 2, ...), p0..p3): the hash of every prefix of every conversation, repeated rows counted once.

    Only hashes of role and text travel. Turns are numbered by turn, then role, then the text's hash.
    """
    seeds = (11, 23)
    marks = [F.xxhash64(F.lit(s), "role", F.col("role").isNull(), "text", F.col("text").isNull()).alias(f"_m{k}") for k, s in enumerate(seeds)]
    t = turns.select("conv_id", "turn", "role", *marks).distinct()
    t = t.withColumn("_span", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / SPAN))
    inner = Window.partitionBy("conv_id", "_span").orderBy(*[F.asc_nulls_first(c) for c in ("turn", "role", "_m0", "_m1")])
    outer = Window.partitionBy("conv_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    on = (F.col("t.conv_id").eqNullSafe(F.col("s.conv_id"))) & (F.col("t._span") == F.col("s._span"))
    t = t.withColumn("_i", F.row_number().over(inner)).drop("turn", "role")
    spans = t.groupBy("conv_id", "_span").agg(F.count(F.lit(1)).alias("_n"))
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(outer), F.lit(0))).drop("_n")
    t = t.alias("t").join(spans.hint("shuffle_hash").alias("s"), on).select("t.*", "s._before")
    t = t.withColumn("len", (F.col("_i") + F.col("_before")).cast("long")).drop("_before")
    for k, h in enumerate(_halves(F.col("len"), F.col("_m0"), F.col("_m1"))):
        t = t.withColumn(f"_h{k}", h)
    t = t.drop("_m0", "_m1")
    sums = t.groupBy("conv_id", "_span").agg(*[F.sum(f"_h{k}").alias(f"_s{k}") for k in range(4)])
    for k in range(4):
        sums = sums.withColumn(f"_b{k}", F.coalesce(F.sum(f"_s{k}").over(outer), F.lit(0)))
    sums = sums.drop(*[f"_s{k}" for k in range(4)])
    t = t.alias("t").join(sums.hint("shuffle_hash").alias("s"), on).select("t.*", *[f"s._b{k}" for k in range(4)])
    along = Window.partitionBy("conv_id", "_span").orderBy("_i")
    return t.select("conv_id", "len", *[(F.col(f"_b{k}") + F.sum(f"_h{k}").over(along)).alias(f"p{k}") for k in range(4)])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that prefix no longer one.

    Of conversations with equal turns the smallest conv_id stays (null last) and ``n_copies`` counts them.
    """
    t = cut(prefix_hashes(turns))  # three steps read them
    p = [f"p{k}" for k in range(4)]
    last = F.max_by(F.struct("len", *p), "len")
    whole = t.groupBy("conv_id").agg(last.alias("_w")).select("conv_id", "_w.*")
    # a null id sorts last and stands only where no other id does
    kept = whole.groupBy("len", *p).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    ends = whole.select("conv_id", F.col("len").alias("_n"))
    inside = (
        t.alias("t").join(ends.hint("shuffle_hash").alias("e"), F.col("t.conv_id").eqNullSafe(F.col("e.conv_id")))
        .filter(F.col("t.len") < F.col("e._n")).select("t.len", *[f"t.{c}" for c in p]).distinct()
    )
    out = kept.hint("shuffle_merge").join(inside.hint("shuffle_merge"), ["len", *p], "left_anti")
    return out.select("conv_id", F.col("len").alias("n_turns"), "n_copies")


def render(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen conversations as text: each turn as ``<|role|>`` line, its text and an end mark."""
    t = turns.select("conv_id", "turn", "role", "text")
    joined = t.alias("t").join(chosen.hint("shuffle_merge").alias("c"), F.col("t.conv_id").eqNullSafe(F.col("c.conv_id"))).select("t.*", "c.n_turns", "c.n_copies")
    entry = F.struct("turn", "role", "text")
    line = lambda x: F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("")), F.lit("|>\n"), F.coalesce(x["text"], F.lit("")), F.lit("<|end|>\n"))
    return joined.groupBy("conv_id", "n_turns", "n_copies").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(entry)), line), "").alias("rendered")  # one conversation is one row of the result
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of all maximal conversations.

    Turns are ordered by turn, then role, then text, nulls first (to compare conversations, ties in turn
    and role by the text's hash); repeated rows count once. Null
    roles and texts render as empty; null conv_ids form one conversation. A conversation without
    rows does not exist; an empty table gives none. Other columns are ignored. Texts of any length are hashed where
    they lie and travel once, to be rendered whole.
    """
    return render(turns, maximal_conversations(turns))


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
s AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(concat('<|', coalesce(role, ''), '|>', chr(10), coalesce(text, ''), '<|end|>', chr(10)), ''
                        ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered,
             list({'r': role, 'x': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
      FROM t GROUP BY conv_id),
g AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n_turns) AS n_turns, any_value(rendered) AS rendered FROM s GROUP BY l),
p AS (SELECT DISTINCT l[:k] AS l FROM (SELECT l, unnest(range(1, n_turns)) AS k FROM g))
SELECT conv_id, n_turns, n_copies, rendered FROM g WHERE l NOT IN (SELECT l FROM p)
"""
