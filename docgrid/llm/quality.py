"""Quality rules with cross-document line frequency.

Lines are normalised and hashed together with their host; a line that occurs in more distinct
documents of its host than the limit allows is boilerplate and is removed. A document that
loses too many of its words, or that fails the plain rules, is rejected.

Only hashes and counts are shuffled. Copies of one text count once, are pre-aggregated before
the shuffle, and a line that is very common in one host meets its limit through partial
aggregation and a merge join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.text import coded, rebased, small_batches, spans, words_of
from docgrid.shared import cut, fresh, written

#: Normalisation of a line: ASCII lower case, digits to 0; words are then joined by one space.
NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
#: A line of a host is boilerplate in more than so many distinct texts of it, and more than this share of them.
MIN_DOCS, HOST_SHARE = 10, 0.02
#: Up to so many removed lines are sent to every task as a sorted array of 8-byte hashes.
MOST_BROADCAST = 200_000

FACTS = (
    "struct<text_hi:long,text_lo:long,n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,"
    "n_repeat_words:long,lines:array<struct<h:long,w:int>>>"
)
_LINES = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))
_LONGS = ("text_hi", "text_lo", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FACTS = pa.struct([*((c, pa.int64()) for c in _LONGS), ("lines", _LINES)])


def repeat_words(ids: np.ndarray, base: int) -> int:
    """Words inside 3-word windows that occur at least twice; ``ids`` are below ``base``."""
    if len(ids) < 4:
        return 0
    pair = ids[:-2] * base + ids[1:-1]
    if base**3 >= 2**63:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pair * base + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    mark = np.zeros(len(ids), np.bool_)
    for k in range(3):
        mark[k : len(ids) - 2 + k] |= twice
    return int(mark.sum())


def line_hashes(host: bytes, lines: list[bytes]) -> list[tuple[int, int]]:
    """Signed 64-bit hash with its host, and number of words, of every line; (0, 0) for a line without words."""
    import xxhash

    out = []
    for line in lines:
        words = line.translate(NORMAL).split()
        out.append((xxhash.xxh3_64_intdigest(host + b"\0" + b" ".join(words)) - (1 << 63), len(words)) if words else (0, 0))
    return out


def _facts(texts: pa.Array, hosts: pa.Array) -> pa.Array:
    parts = [_facts_of(texts.slice(s, n), hosts.slice(s, n)) for s, n in spans(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], _FACTS)


def _facts_of(texts: pa.Array, hosts: pa.Array) -> pa.Array:
    import xxhash

    texts = pc.fill_null(rebased(texts).cast(pa.large_string()), "")
    words, at = words_of(texts)
    ids, distinct = coded(words)
    chars = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(words), dtype=np.int64))])
    symbols = pc.count_substring_regex(texts, "[#*$%&|<>]").to_pylist()
    rows = []
    for i, (text, host) in enumerate(zip(texts.to_pylist(), hosts.to_pylist(), strict=True)):
        raw = text.encode()
        lines = raw.split(b"\n")
        hashed = line_hashes(host.encode(), lines)
        worded = [x for x, (_, w) in zip(lines, hashed, strict=True) if w]
        per: dict[int, int] = {}
        for h, w in hashed:
            if w:
                per[h] = per.get(h, 0) + w
        key = xxhash.xxh3_128_intdigest(raw)
        rows.append(
            {
                "text_hi": (key >> 64) - (1 << 63),
                "text_lo": (key & (2**64 - 1)) - (1 << 63),
                "n_words": int(at[i + 1] - at[i]),
                "word_chars": int(chars[at[i + 1]] - chars[at[i]]),
                "n_symbols": symbols[i],
                "n_dup_lines": len(worded) - len(set(worded)),
                "n_repeat_words": repeat_words(ids[at[i] : at[i + 1]], max(1, len(distinct))),
                "lines": [{"h": h, "w": w} for h, w in per.items()],
            }
        )
    return pa.array(rows, _FACTS)


def _host(col: Column) -> Column:
    """A host as text that is never null; the null host is a host of its own."""
    return F.coalesce(F.concat(F.lit("h"), col.cast("string")), F.lit(""))


def facts_of(df: DataFrame, keep: list[str], host_col: str, text_col: str) -> DataFrame:
    """``keep`` and, as struct ``_q``, the facts of every row; written to the shared folder, as three steps read them."""
    small_batches(df)
    facts = F.arrow_udf(_facts, FACTS)
    return written(
        df.select(
            *[F.col(c) for c in keep],
            facts(F.col(text_col).cast("string"), _host(F.col(host_col))).alias("_q"),
            _host(F.col(host_col)).alias("_host"),
        )
    )


def frequent_lines(facts: DataFrame, min_docs: int, host_share: float) -> DataFrame:
    """Hashes ``h`` of lines that occur in more than max(min_docs, host_share * host's documents) documents of their host."""
    texts = F.struct("_q.text_hi", "_q.text_lo").alias("_text")
    lines = facts.select("_host", texts, F.explode("_q.lines").alias("_line")).select("_host", "_text", F.col("_line.h").alias("h"))
    counts = lines.groupBy("_host", "h").agg(F.countDistinct("_text").alias("n")).filter(F.col("n") > min_docs)
    hosts = facts.groupBy("_host").agg(F.countDistinct(texts).alias("n_docs"))
    return (
        counts.hint("shuffle_merge")
        .join(hosts.hint("shuffle_merge"), "_host")
        .filter(F.col("n") > F.col("n_docs") * F.lit(host_share))
        .select("h")
        .distinct()
    )


def quality_report(
    df: DataFrame,
    keep: list[str],
    host_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    host_share: float = HOST_SHARE,
    least_left: float = 0.3,
    least_words: int = 50,
    most_repeated: float = 0.5,
    facts: DataFrame | None = None,
    frequent: DataFrame | None = None,
) -> DataFrame:
    """One row for each row of ``df``: ``keep`` and the counts, ``n_lost_words``, ``base_failed`` and ``kept``.

    ``n_lost_words`` are the words on removed lines. A row is kept if the plain rules hold
    (``least_words``, ``most_repeated``) and at least ``least_left`` of its words are left. Null or
    empty text: no words, so the plain rules reject it. Null hosts form one host. Repeated rows and
    copies get equal verdicts and count once as documents of their host. An empty table gives none.
    """
    facts = facts if facts is not None else facts_of(df, keep, host_col, text_col)
    # small sides are checkpointed, so that both sides of the joins are plain shuffles, whose hot keys adaptive execution splits
    frequent = frequent if frequent is not None else cut(frequent_lines(facts, min_docs, host_share))
    lines = facts.select("_host", "_q.text_hi", "_q.text_lo", F.explode("_q.lines").alias("_line"))
    lines = lines.select("_host", "text_hi", "text_lo", F.col("_line.h").alias("h"), F.col("_line.w").alias("w"))
    lost = (
        lines.hint("shuffle_merge")
        .join(frequent.hint("shuffle_merge"), "h")
        .groupBy("_host", "text_hi", "text_lo", "h")
        .agg(F.max("w").alias("w"))
        .groupBy("_host", "text_hi", "text_lo")
        .agg(F.sum("w").alias("_lost"))
    )
    lost = cut(lost)
    flat = facts.select(*keep, "_host", "_q.*").drop("lines")
    out = flat.hint("shuffle_merge").join(lost.hint("shuffle_merge"), ["_host", "text_hi", "text_lo"], "left")
    n, r, gone = F.col("n_words"), F.col("n_repeat_words"), F.coalesce(F.col("_lost"), F.lit(0)).cast("long")
    failed = (n < least_words) | (r > most_repeated * n)
    return out.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        gone.alias("n_lost_words"),
        failed.alias("base_failed"),
        (~failed & (n - gone >= least_left * n)).alias("kept"),
    )


def quality_filter(
    df: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    host_share: float = HOST_SHARE,
    least_left: float = 0.3,
    least_words: int = 50,
    most_repeated: float = 0.5,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """The rows of ``df`` that the rules keep, with the removed lines taken out of the text; columns as before.

    Cases are as in ``quality_report``; columns may have any names. Long texts are read whole. The set of removed lines is counted first: up to
    ``most_broadcast`` hashes go to every task and texts are never shuffled; beyond, the lines'
    hashes are joined by document and the texts are shuffled once.
    """
    facts = facts_of(df, [], host_col, text_col)
    frequent = written(frequent_lines(facts, min_docs, host_share))
    spark = df.sparkSession
    n = frequent.count()
    result, own_host, own_key, of_host, of_text, gone_lines = fresh(df, "clean", "host", "key", "of_host", "of_text", "gone")
    limits = (least_left, least_words, most_repeated)
    if n <= most_broadcast:
        gone = np.sort(np.array([r.h for r in frequent.collect()], np.int64))
        shared = spark.sparkContext.broadcast(gone)

        @F.arrow_udf("struct<kept:boolean,text:string>")
        def clean(texts: pa.Array, hosts: pa.Array) -> pa.Array:
            return _cleaned(texts, hosts, [shared.value] * len(texts), limits)

        done = df.withColumn(result, clean(F.col(text_col).cast("string"), _host(F.col(host_col))))
    else:
        lines = facts.select(F.explode(F.transform("_q.lines", lambda x: F.struct("_q.text_hi", "_q.text_lo", x["h"].alias("h")))).alias("x"), "_host")
        lines = lines.select("_host", "x.text_hi", "x.text_lo", "x.h").distinct()
        per = (
            lines.hint("shuffle_merge").join(frequent.hint("shuffle_merge"), "h")
            .groupBy("_host", "text_hi", "text_lo").agg(F.sort_array(F.collect_list("h")).alias("_gone"))  # of one document
        )

        @F.arrow_udf("struct<hi:long,lo:long>")
        def key(texts: pa.Array) -> pa.Array:
            import xxhash

            ks = [xxhash.xxh3_128_intdigest((t or "").encode()) for t in texts.to_pylist()]
            return pa.array([{"hi": (k >> 64) - (1 << 63), "lo": (k & (2**64 - 1)) - (1 << 63)} for k in ks], pa.struct([("hi", pa.int64()), ("lo", pa.int64())]))

        @F.arrow_udf("struct<kept:boolean,text:string>")
        def clean_own(texts: pa.Array, hosts: pa.Array, gone: pa.Array) -> pa.Array:
            return _cleaned(texts, hosts, [np.array(g or [], np.int64) for g in gone.to_pylist()], limits)

        rows = df.withColumn(own_key, key(F.col(text_col).cast("string"))).withColumn(own_host, _host(F.col(host_col)))
        per = per.select(F.col("_host").alias(of_host), F.struct(F.col("text_hi").alias("hi"), F.col("text_lo").alias("lo")).alias(of_text), F.col("_gone").alias(gone_lines))
        on = (F.col(own_host) == F.col(of_host)) & (F.col(own_key)["hi"] == F.col(of_text)["hi"]) & (F.col(own_key)["lo"] == F.col(of_text)["lo"])
        rows = rows.hint("shuffle_merge").join(per.hint("shuffle_merge"), on, "left")
        done = rows.withColumn(result, clean_own(F.col(text_col).cast("string"), F.col(own_host), F.col(gone_lines)))
    done = done.filter(F.col(result)["kept"])
    return done.select(*[F.col(result)["text"].alias(c) if c == text_col else F.col(c) for c in df.columns])


_CLEAN = pa.struct([("kept", pa.bool_()), ("text", pa.string())])


def _cleaned(texts: pa.Array, hosts: pa.Array, gone: list[np.ndarray], limits: tuple) -> pa.Array:
    parts = [_cleaned_of(texts.slice(s, n), hosts.slice(s, n), gone[s : s + n], limits) for s, n in spans(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], _CLEAN)


def _cleaned_of(texts: pa.Array, hosts: pa.Array, gone: list[np.ndarray], limits: tuple) -> pa.Array:
    least_left, least_words, most_repeated = limits
    texts = pc.fill_null(rebased(texts).cast(pa.large_string()), "")
    words, at = words_of(texts)
    ids, distinct = coded(words)
    out = []
    for i, (text, host) in enumerate(zip(texts.to_pylist(), hosts.to_pylist(), strict=True)):
        n = int(at[i + 1] - at[i])
        kept = n >= least_words and repeat_words(ids[at[i] : at[i + 1]], max(1, len(distinct))) <= most_repeated * n
        if kept and len(gone[i]):
            lines = text.encode().split(b"\n")
            hashed = line_hashes(host.encode(), lines)
            h = np.array([x for x, _ in hashed], np.int64)
            spot = np.minimum(np.searchsorted(gone[i], h), len(gone[i]) - 1)
            drop = (gone[i][spot] == h) & np.array([w > 0 for _, w in hashed])
            if drop.any():
                left = n - sum(w for (_, w), d in zip(hashed, drop, strict=True) if d)
                kept = left >= least_left * n
                text = b"\n".join(x for x, d in zip(lines, drop, strict=True) if not d).decode()
        out.append({"kept": bool(kept), "text": text if kept else None})
    return pa.array(out, _CLEAN)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdict of the quality rules on every document, at their default limits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return quality_report(docs, ["doc_id"])


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
norm AS (SELECT doc_id, host, t, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+') AS ws FROM lines),
worded AS (SELECT doc_id, host, t, line, array_to_string(ws, ' ') AS nl, len(ws) AS n FROM norm WHERE len(ws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT t) AS n_docs FROM d GROUP BY host),
freq AS (SELECT host, nl, count(DISTINCT t) AS n FROM worded GROUP BY host, nl),
gone AS (SELECT host, nl FROM freq JOIN hosts USING (host) WHERE n > 10 AND n > n_docs * 0.02),
lost AS (SELECT doc_id, sum(n) AS n_lost FROM worded JOIN gone USING (host, nl) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lost, 0)::BIGINT AS n_lost_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * (n_words - n_lost_words) >= 3 * n_words) AS kept
FROM f
"""
