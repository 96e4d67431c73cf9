"""N-gram Jaccard join by rare-first prefix filtering.

A text is the set of its distinct word n-grams. In a fixed order of all n-grams, two sets that
are similar enough share an n-gram within their first few ("prefix"), and the first one that they
share leaves room for all that they must have in common behind it. N-grams are ordered by how often
the whole corpus holds them, rarest first, so the prefix of a text without near copies is made of
n-grams that no other text has.

Frequencies are exact. Blocks of texts ask for those of their own n-grams with sorted hashes,
written as differences, one message for each range of the hash space; the owner of a range adds up
and answers in the order of the question. No task holds more than a range or a block.

Texts that share a prefix n-gram form a group. First every member is compared with one pivot, the
member for which the n-gram comes earliest: in a group of near copies that is the one that all
others derive from. Links are contracted to components; a group whose members are in one component
is done, and members that the lengths of the group leave no partner drop out. In what is left, members
of different components are joined by n-gram and length band where positions, lengths and the odd
sketches of their sets (parities of hashes, whose differing bits bound the difference of the sets)
leave room. Pairs are verified once, on whole sets, after the suffix filter. Equal texts count as
one from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.blocks import opened, pack, sections, text_blocks, unpack
from docgrid.llm.text import PIECE_BYTES, coded, hash_words, least_rows, maybe_in, mix64, small_batches, spans, words_of
from docgrid.shared import cut, fresh, stored, written

#: Bytes of text of a block, and of the text whose n-grams one range of the hash space holds. Messages shrink where
#: there are as many ranges as a block has n-grams, so both should grow with executors' memory on a very large corpus.
BLOCK_BYTES, RANGE_BYTES = 2_000_000, 8_000_000
#: Long integers of an odd sketch.
SKETCH = 16


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text; fewer words count as one shingle."""
    words, at = words_of(texts, lower=True)
    codes, distinct = coded(words)
    h = (hash_words(distinct)[codes] if len(distinct) else np.empty(0, np.uint64)).astype(np.uint64)
    rolled = h.copy()
    for k in range(1, min(n, len(h))):
        rolled[: len(h) - k] = mix64(rolled[: len(h) - k]) * np.uint64(3) + h[k:]
    rolled = mix64(rolled)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= n:
            out.append(np.unique(rolled[s : e - n + 1]))
        elif e > s:
            x = np.array([e - s], np.uint64)
            for v in h[s:e]:
                x = mix64(x) * np.uint64(5) + v
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def pieces(texts: pa.Array, most: int = PIECE_BYTES):
    """Slices of about ``most`` bytes."""
    return (texts.slice(s, n) for s, n in spans(texts, most))


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each of 64 * SKETCH cells: sets differ in no fewer hashes than their sketches do in bits."""
    odd = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Frequencies as numbers below 256 that keep their order: exact below 128, eighths of powers of two above."""
    high = 128 + 8 * (np.log2(np.maximum(counts, 128)) - 7)
    return np.where(counts < 128, counts, np.minimum(high, 255)).astype(np.uint8)


_PREFIX = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())]))
_SIGNED = pa.schema([*((c, pa.int64()) for c in ("k1", "k2", "id", "n")), ("prefix", _PREFIX), ("odd", pa.list_(pa.int64())), ("set", pa.binary())])


def signatures(docs: DataFrame, n: int, percent: int, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(k1, k2, id, n, prefix, odd, set) of each distinct text of ``docs`` (k1, k2, text), whose texts all have words; written.

    ``id`` numbers the texts, n is the size of the set, and prefix holds the n-grams of the prefix that occur more than once,
    with their places in it. Where there are any, odd and set are the sketch and the whole set.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = (size // range_bytes).bit_length()
    bits = max(24, size.bit_length() + 4)  # hashes of this length rarely collide, and rarity needs no more
    blocks, drop_blocks = text_blocks(docs, "text", block_bytes)

    def block_grams(sets: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([*sets, np.empty(0, np.uint64)]) >> np.uint64(64 - bits)

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                own = dict(zip(zip(row["k1"], row["k2"], strict=True), opened(row), strict=True))
                grams, counts = np.unique(block_grams(_shingled(list(own.values()), n)), return_counts=True)
                got = [(row["block"], r, pack(np.diff(grams[s:e], prepend=np.uint64(0))), pack(counts[s:e])) for r, s, e in sections((grams >> np.uint64(bits - range_bits)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "range", "grams", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        """All questions about one range, answered."""
        keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in group.column("grams").to_pylist()]
        counts = np.concatenate([unpack(x) for x in group.column("counts").to_pylist()]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        level = levels(np.bincount(inverse, weights=counts).astype(np.int64))[inverse]
        ends = np.cumsum([len(k) for k in keys])
        told = [pack(level[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)]
        return pa.table({"block": group.column("block"), "range": group.column("range"), "levels": pa.array(told, pa.binary())})

    asked = blocks.mapInArrow(ask, "block long, range long, grams binary, counts binary")
    answers = asked.groupBy("range").applyInArrow(answer, "block long, range long, levels binary").withColumn("firsts", F.lit(None).cast("array<int>"))
    places = blocks.select("block", F.posexplode(F.arrays_zip("k1", "k2")).alias("i", "k")).groupBy("k.k1", "k.k2").agg(F.min(F.struct("block", "i")).alias("f"))
    firsts = places.groupBy("f.block").agg(F.collect_list("f.i").alias("firsts"))  # of one block
    replies = answers.unionByName(firsts.select("block", F.lit(-1).cast("long").alias("range"), F.lit(None).cast("binary").alias("levels"), "firsts"))

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        row, told, firsts_ = left.to_pylist()[0], [], []
        for r in right.to_pylist():
            if r["range"] < 0:
                firsts_ += r["firsts"]
            else:
                told.append((r["range"], r["levels"]))
        texts, firsts_ = opened(row), sorted(firsts_)
        sets = _shingled([texts[i] for i in firsts_], n)
        everything = dict(zip(zip(row["k1"], row["k2"], strict=True), texts, strict=True))
        level = np.concatenate([unpack(x) for _, x in sorted(told)]).astype(np.uint8)
        others = [] if len(everything) == len(firsts_) else _shingled([everything[k] for k in everything.keys() - {(row["k1"][i], row["k2"][i]) for i in firsts_}], n)
        _, inverse = np.unique(block_grams([*sets, *others]), return_inverse=True)
        rarity, at, out = level[inverse], 0, []
        for i, s in zip(firsts_, sets, strict=True):
            own = rarity[at : at + len(s)]
            at += len(s)
            order = np.argsort(own, kind="stable")[: len(s) - -(-percent * len(s) // 100) + 1]  # ties by hash, as sets are sorted
            pos = np.flatnonzero(own[order] > 1)
            some = len(pos) > 0
            prefix = [{"h": h, "pos": p} for h, p in zip(s[order[pos]].view(np.int64).tolist(), pos.tolist(), strict=True)]
            out.append((row["k1"][i], row["k2"][i], (row["block"] << 20) | i, len(s), prefix, odd_sketch(s) if some else None, s.tobytes() if some else None))
        return pa.Table.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_SIGNED)], schema=_SIGNED)

    signed = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(sign, "k1 long, k2 long, id long, n long, prefix array<struct<h:long,pos:int>>, odd array<long>, set binary")
    signed = written(signed)
    drop_blocks()
    return signed


def _shingled(texts: list[str], n: int) -> list[np.ndarray]:
    return [s for part in pieces(pa.array(texts, pa.large_string())) for s in shingle_sets(part, n)]


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the size of the intersection of two sorted arrays, by halving both at shared split points."""
    if depth == 0 or not len(x) or not len(y):
        return min(len(x), len(y))
    w = y[len(y) // 2]
    i, j = int(np.searchsorted(x, w)), len(y) // 2
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, after the length and suffix filters."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if min(len(x), len(y)) < need or suffix_bound(x, y) < need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of all ends of the links (a, b): the smallest id reachable. Alternating large and small stars."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.hint("shuffle_merge").join(low.hint("shuffle_merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("shuffle_merge").join(low.hint("shuffle_merge"), "u")
        small = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("id"), "comp").distinct())


def _room(n: Column | str, pos: Column | str, of: Column | str, percent: int) -> Column:
    """Whether a set of ``n`` n-grams that shares the one at ``pos`` first can have enough in common with one of ``of``."""
    n, pos, of = (F.col(x) if isinstance(x, str) else x for x in (n, pos, of))
    return (n - pos) * (100 + percent) >= (n + of) * percent


def _verified(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    @F.arrow_udf("boolean")
    def verify(a: pa.Array, b: pa.Array) -> pa.Array:
        view = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
        return pa.array([linked(view(x), view(y), percent) for x, y in zip(a, b, strict=True)], pa.bool_())

    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets, drop_sets = stored(signed.filter("set is not null").select("id", "set").hint("shuffle_merge").join(ends.hint("shuffle_merge"), "id", "left_semi"))
    found = pairs.hint("shuffle_merge").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")).hint("shuffle_merge"), "a")
    found = found.hint("shuffle_merge").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")).hint("shuffle_merge"), "b")
    found = cut(found.filter(verify("sa", "sb")).select("a", "b"))
    drop_sets()
    return found


def similar_links(signed: DataFrame, percent: int) -> DataFrame | None:
    """(id, comp) of all texts that link with another one: the smallest id reachable; None where no texts link."""
    postings = signed.select("id", "n", F.explode("prefix").alias("p")).select("p.h", "p.pos", "id", "n")
    # aggregates are checkpointed, so that both sides of the joins are plain shuffles, whose hot keys adaptive execution splits
    groups = postings.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.min(F.struct("pos", "n", "id")).alias("p")).filter("c > 1")
    groups = cut(groups.select("h", "least", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos")))
    if groups.isEmpty():
        return None
    rows, drop_rows = stored(postings.hint("shuffle_merge").join(groups.hint("shuffle_merge"), "h").filter(_room("n", "pos", "least", percent)))
    pairs = rows.filter((F.col("id") != F.col("pid")) & _room("n", "pos", "pn", percent) & _room("pn", "ppos", "n", percent))
    tried = cut(pairs.select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct())
    links = None if tried.isEmpty() else _verified(tried, signed, percent)
    comps = None if links is None or links.isEmpty() else components(links)

    left = rows.select("h", "id", "n", "pos")
    if comps is None:
        left = left.withColumn("comp", F.col("id"))
    else:
        left = left.hint("shuffle_merge").join(comps.hint("shuffle_merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    left = cut(left)
    open_ = left.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("n").alias("least")).filter("x < y").select("h", "least")
    left = left.hint("shuffle_merge").join(cut(open_).hint("shuffle_merge"), "h").filter(_room("n", "pos", "least", percent)).drop("least")
    left = left.hint("shuffle_merge").join(signed.filter("odd is not null").select("id", "odd").hint("shuffle_merge"), "id")
    # sets that link are in the same band of lengths or in neighbouring ones
    left = cut(left.withColumn("band", F.floor(F.log("n") / math.log(101 / percent))))
    drop_rows()
    side = lambda x: left.select("h", "band", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "pos", "comp", "odd")])
    near = side("b").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    differ = sum((F.bit_count(F.get("odd_a", F.lit(k)).bitwiseXOR(F.get("odd_b", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    on = (F.col("x.h") == F.col("y.h")) & (F.col("x.band") == F.col("y.band")) & (F.col("id_a") < F.col("id_b")) & (F.col("comp_a") != F.col("comp_b"))
    on &= _room("n_a", "pos_a", "n_b", percent) & _room("n_b", "pos_b", "n_a", percent)
    on &= differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    pairs = near.hint("shuffle_merge").alias("y").join(side("a").hint("shuffle_merge").alias("x"), on)
    pairs = cut(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct().hint("shuffle_merge").join(tried.hint("shuffle_merge"), ["a", "b"], "left_anti"))
    if pairs.isEmpty():
        return comps
    more = _verified(pairs, signed, percent)
    if more.isEmpty():
        return comps
    return components(more if comps is None else more.unionByName(comps.filter("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b"))))


def text_keys(text: Column) -> list[Column]:
    """Two hashes, k1 and k2, that name a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id_col, n_shingles, component_id, class_key, text_key) of each row.

    Two rows link when the Jaccard similarity of their sets of n-word shingles is at least
    ``percent`` / 100 (ASCII case ignored; a text with fewer words is one shingle). ``component_id``
    is the smallest id reachable by links, the row's own id included; ``class_key`` names the component
    whatever its ids (null: a row without words, which links with nothing); ``text_key`` is xxhash64 of the text.
    A null id never becomes a component's id unless no other id is there. Repeated rows link.
    An empty table gives none. Long texts are read whole. ``id_col`` is an integer column; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("_id"), *text_keys(text))
    worded = docs.select(*text_keys(text), text.alias("text")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    signed = signatures(worded, n, percent, block_bytes, range_bytes)
    comps = similar_links(signed, percent)

    least = rows.groupBy("k1", "k2").agg(F.min("_id").alias("least"))
    nodes = signed.select("k1", "k2", "id", "n").hint("shuffle_merge").join(least.hint("shuffle_merge"), ["k1", "k2"])
    if comps is None:
        nodes = nodes.withColumn("class_key", F.col("id"))
    else:
        nodes = cut(nodes.hint("shuffle_merge").join(comps.hint("shuffle_merge"), "id", "left"))
        several = nodes.filter("comp is not null")
        tops = cut(several.groupBy("comp").agg(F.min("least").alias("top")))
        several = several.hint("shuffle_merge").join(tops.hint("shuffle_merge"), "comp").withColumn("least", F.col("top"))
        columns = ["k1", "k2", "n", "least"]
        nodes = nodes.filter("comp is null").select(*columns, F.col("id").alias("class_key")).unionByName(several.select(*columns, F.col("comp").alias("class_key")))
    nodes = cut(nodes.select("k1", "k2", "n", "least", "class_key"))
    out = rows.hint("shuffle_merge").join(nodes.hint("shuffle_merge"), ["k1", "k2"], "left")
    own = F.when(F.col("class_key").isNotNull(), F.col("least")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), own.alias("component_id"), "class_key", F.col("k1").alias("text_key"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that another row of their component stands for: the one with the smallest id stays.

    Of rows that repeat id and text the least by all columns stays; a null id gives way to any other; rows without words
    all stay. Columns are as before, whatever their names.
    """
    found, drop_found = stored(jaccard_components(docs, id_col, text_col, n, percent).select(F.col(id_col).alias("id"), "text_key", "class_key").filter("class_key is not null"))
    pick = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "text_key")).alias("p")
    first = found.groupBy("class_key").agg(pick).select("p.id", F.col("p.text_key").alias("key"))
    rows = found.groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    same = F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.text_key") == F.col("f.key"))
    judged = rows.hint("shuffle_merge").alias("r").join(first.withColumn("kept", F.lit(True)).hint("shuffle_merge").alias("f"), same, "left")
    own_id, own_key, kept, key, maybe = fresh(docs, "kept_id", "kept_key", "kept", "key", "maybe")
    special = cut(judged.filter("kept is null or times > 1").select(F.col("r.id").alias(own_id), F.col("r.text_key").alias(own_key), F.coalesce("kept", F.lit(False)).alias(kept)))
    drop_found()
    named = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    named = named.withColumn(maybe, maybe_in(special, own_key)(F.col(key)))  # the texts of all other rows need not travel
    on = named[id_col].cast("long").eqNullSafe(special[own_id]) & (named[key] == special[own_key])
    joined = named.filter(maybe).hint("shuffle_merge").join(special.hint("shuffle_merge"), on, "left")
    once = named.filter(~F.col(maybe)).select(*docs.columns).unionByName(joined.filter(F.col(kept).isNull()).select(*docs.columns))
    repeated = least_rows(joined.filter(F.col(kept)), [id_col, key], docs.columns, [id_col, text_col])
    return once.unionByName(repeated)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Component of every document under 4-word shingle similarity of 0.85 and more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
