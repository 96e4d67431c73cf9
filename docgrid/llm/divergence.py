"""How far the sources of a language differ in their words.

The terms of each language are numbered by their counts (all of the language first, then a hash of the counts
of every source), so that terms with equal counts lie together; the counts of a group (language,
source) over these numbers then are a column of runs. A pair of groups is compared run by run: run boundaries of both are merged, and
the divergence of one term is multiplied by the length of the run.

Numbers are cut into segments and sources into tiles, so that a task holds two tiles of one
segment, whatever the vocabulary and the number of sources; segments of a pair are summed.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm.text import small_batches
from docgrid.shared import few, running_start, stored

#: Documents of a language in which a term is to be.
LEAST_DOCS = 10
SCALE = 1_000_000_000
#: Term numbers of a segment, sources of a tile.
SEGMENT, TILE = 2048, 64
#: Different terms that a task counts before it sends them.
HELD_TERMS = 200_000

#: Letters A-Z in lower case, other ASCII characters a space; bytes of other characters stay.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def term_counts(df: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; nulls are empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out():
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                words = text.encode().translate(_TERMS).split()
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(words)
                docs.update(set(words))
                size += len(n)
                if size > HELD_TERMS:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    rows = small_batches(df).select(*[empty(c).alias(c) for c in ("lang", "source", "text")])
    parts = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, total):
    """p of a count: 1 + floor(SCALE * (n + 2) / total), exact."""
    return (F.lit(1) + F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(({n}) + 2 as decimal(20,0))) div cast({total} as decimal(24,0))")).cast("long")


def divergence_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _column(start: np.ndarray, end: np.ndarray, p: np.ndarray, rest: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of all runs over ``size`` numbers: those given, and ``rest`` between them."""
    order = np.argsort(start)
    starts = np.stack([start[order], end[order]], 1).ravel()
    values = np.stack([p[order], np.full(len(order), rest)], 1).ravel()
    starts, values = np.concatenate([[0], starts]), np.concatenate([[rest], values])
    keep = np.append(starts[1:] > starts[:-1], starts[-1] < size)  # an empty run has the start of the next one
    return starts[keep], values[keep]


def pair_value(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int) -> int:
    """Sum of the divergence over two columns: once for each run of both, times its length."""
    if not size:
        return 0
    starts = np.union1d(a[0], b[0])
    p, q = (x[1][np.searchsorted(x[0], starts, "right") - 1] for x in (a, b))
    return int((divergence_of(p, q) * np.diff(np.append(starts, size))).sum())


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def compare_tiles(rows: pa.Table) -> pa.Table:
    """(lang, source, item, value) of all pairs of sources of two tiles in a segment, both ways.

    Rows are runs (source, tile, start, end, p) and, with a null start, one for each source: p of a count of 0 and, as end, the segment's size.
    """
    names, tile = rows.column("source").to_pylist(), np.asarray(rows.column("tile"))
    head = np.asarray(rows.column("start").is_null())
    start, end, p = np.asarray(rows.column("start").fill_null(0)), np.asarray(rows.column("end")), np.asarray(rows.column("p"))
    lang, first, second = rows.column("lang")[0].as_py(), rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
    codes = {s: i for i, s in enumerate(dict.fromkeys(names))}
    code = np.array([codes[s] for s in names])
    columns, tiles, size = {}, {}, 0
    for s, i in codes.items():
        own = code == i
        top, runs = np.flatnonzero(own & head)[0], own & ~head
        size, tiles[s] = int(end[top]), int(tile[top])
        columns[s] = _column(start[runs], end[runs], p[runs], int(p[top]), size)
    left, right = ([s for s in codes if tiles[s] == t] for t in (first, second))
    out = []
    for k, s in enumerate(left):
        for t in left[k + 1 :] if first == second else right:
            value = pair_value(columns[s], columns[t], size)
            out += [(lang, s, t, value), (lang, t, s, value)]
    return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_PAIRS)], schema=_PAIRS)


def source_divergence(df: DataFrame, least_docs: int = LEAST_DOCS, top: int = 10, segment: int = SEGMENT, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language (``pair``), and its most typical terms (``term``).

    ``df`` has lang, source and text; nulls are empty texts, which are a language and a source as any other. A term is a run of ASCII letters, lower-cased, and
    other characters that are not ASCII; a language keeps terms of ``least_docs`` documents or more. p of a term is 1 + floor(10^9 (n + 2) / (N + 2 V)); the divergence of
    p and q is floor((p - q)^2 / (p + q)). A pair has the sum over all kept terms, also those that neither has; 0 without kept terms. Terms
    are those that a source uses more than its language, ``top`` at most. Ranks go by value, then item. Repeated rows count each; texts are
    read whole, however long; an empty table gives no rows. Other columns are ignored.
    """
    docs = df.select("lang", "source", "text")
    counts, _ = stored(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sum(F.xxhash64("source", "n").cast("decimal(20,0)")).alias("like"), F.lit(1).alias("one"))
    kept = running_start(kept.filter(F.col("docs") >= least_docs).drop("docs"), ["lang", "total", "like", "term"], "one", "at").drop("one", "like")
    langs = kept.groupBy("lang").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("v"), F.sum("total").alias("all_n"))
    terms = counts.drop("docs").hint("shuffle_merge").join(kept.hint("shuffle_merge"), ["lang", "term"])
    terms, _ = stored(terms)
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = found.hint("shuffle_merge").join(sums.hint("shuffle_merge"), ["lang", "source"], "left").join(langs.hint("shuffle_merge"), "lang", "left").na.fill(0, ["own_n", "first", "v", "all_n"])
    # sources of a language in tiles: by hash, so that no window over all of them is needed; the number of tiles follows their number
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    groups, _ = stored(groups.hint("shuffle_merge").join(tiles.hint("shuffle_merge"), "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")))
    groups = few(groups)

    rows = terms.join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", "term", "n", "tile", "tiles", (F.col("at") - F.col("first")).alias("at"), share("n", "own_n + 2 * v").alias("p"), share("total", "all_n + 2 * v").alias("q"))
    more = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("cast((p - q) * (p - q) div (p + q) as long)").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    typical = more.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # runs: neighbours with one count, within a segment
    along = Window.partitionBy("lang", "source", "seg").orderBy("at")
    cell = rows.select("lang", "source", "tile", "tiles", F.floor(F.col("at") / segment).alias("seg"), F.pmod(F.col("at"), F.lit(segment)).alias("at"), "n", "p")
    cell = cell.withColumn("run", F.col("at") - F.row_number().over(along)).withColumn("new", F.coalesce((F.col("n") != F.lag("n").over(along)) | (F.col("run") != F.lag("run").over(along)), F.lit(True)))
    cell = cell.withColumn("run", F.sum(F.col("new").cast("long")).over(along))
    runs = cell.groupBy("lang", "source", "seg", "run").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"), F.first("p").alias("p"), F.first("tile").alias("tile"), F.first("tiles").alias("tiles")).drop("run")
    last = F.greatest(F.ceil(F.col("v") / segment), F.lit(1)).cast("long") - 1
    heads = groups.select("lang", "source", "tile", "tiles", "v", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seg"), share("0", "greatest(own_n + 2 * v, 1)").alias("p"))
    heads = heads.select("lang", "source", "seg", F.lit(None).cast("long").alias("start"), F.least(F.lit(segment), F.col("v") - F.col("seg") * segment).cast("long").alias("end"), "p", "tile", "tiles")
    both = runs.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    both = both.select("lang", "seg", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "source", "tile", "start", "end", "p")
    parts = both.groupBy("lang", "seg", "a", "b").applyInArrow(compare_tiles, "lang string, source string, item string, value long")
    values = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = values.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(typical)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Divergence of all sources of all whole documents."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS nn FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS nn FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (own.nn + 2 * v) AS p, 1 + 1000000000::HUGEINT * (total + 2) // (l.nn + 2 * v) AS q
      FROM own JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every
QUALIFY part = 'pair' OR rank <= 10
"""
