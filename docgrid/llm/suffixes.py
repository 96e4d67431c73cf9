"""Removal of byte strings that occur more than once, by a distributed sort of suffixes.

A string of ``least`` bytes that starts at s is represented by its anchor, the place of the
smallest 8-byte hash among the first starts of its blocks of K bytes. Equal strings have equal
anchors, so only the K bytes at the anchors, a hundredth of all places, need to be compared
across the corpus: an anchor whose block occurs once stands for strings that occur once.

Strings whose whole surroundings of the anchor occur twice are repeated without another look.
What is left lies at the edges of repeated passages. The suffixes that start at these anchors
are dealt to ranges by sampled splitters over all of their bytes, so a block that very many texts
hold is split like any other part of the order. Every range is sorted by multikey quicksort, eight
bytes a step, and its first and last suffix are compared across its boundaries; the same is done
with what comes before the anchors. Neighbours in these orders bound how far any match of a suffix
can reach, and settle nearly all strings; the few that two different neighbours bound are compared
themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.text import filter_of, mix64, passes, small_batches
from docgrid.shared import cut, stored, written

LEAST = 200
K = 64
#: Suffixes that one range should hold, and bytes of a text whose anchors are looked for at once.
RANGE_ROWS, PIECE = 20_000, 1_000_000

KEY = "struct<hi:long,lo:long>"
_KEY = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])


def key_of(raw: bytes) -> tuple[int, int]:
    import xxhash

    k = xxhash.xxh3_128_intdigest(raw)
    return (k >> 64) - (1 << 63), (k & (2**64 - 1)) - (1 << 63)


def anchors(raw: bytes, least: int = LEAST, piece: int = PIECE):
    """(place, first start, last start) of each anchor and the starts of ``least``-byte strings that it stands for; in arrays by pieces of the text."""
    begin, stop = 0, len(raw) - least + 1
    while begin < stop:
        end = min(begin + piece, stop)
        at, first, last = (x + begin for x in _anchors(raw[begin : end + least - 1], least))
        if end < stop and len(at) > 1:  # the last anchor may stand for starts of the next piece, too
            at, first, last, end = at[:-1], first[:-1], last[:-1], int(first[-1])
        yield at, first, last
        begin = end


def _anchors(raw: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = least - K + 1
    a = np.frombuffer(raw, np.uint8)[: len(raw) - K + 8].astype(np.uint64)
    gram = np.zeros(len(a) - 7, np.uint64)
    for i in range(8):
        gram = (gram << np.uint64(8)) | a[i : len(gram) + i]
    low = (mix64(gram) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    return at[first], first, last


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (words of 8 bytes) and the group of equal rows of each place in that order.

    Multikey quicksort with a word as character: all rows are ordered by a word, and only groups
    that still tie go on to the next one.
    """
    order = np.arange(len(rows))
    group = np.zeros(len(rows), np.int64)
    open_ = np.arange(len(rows))
    for w in range(rows.shape[1]):
        if not len(open_):
            break
        part = order[open_]
        o = np.lexsort((rows[part, w], group[open_]))
        part, g, v = part[o], group[open_][o], rows[part[o], w]
        order[open_] = part
        new = np.ones(len(part), np.bool_)
        new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
        starts = np.flatnonzero(new)
        group[open_] = open_[starts][np.cumsum(new) - 1]  # the place of a group's first row names it
        size = np.diff(np.append(starts, len(part)))
        open_ = open_[np.repeat(size, size) > 1]
    return order, group


def padded(rows: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes as a matrix, zeros behind."""
    return np.frombuffer(b"".join(r[:width].ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)


def common(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common start of rows i and j."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 20_000):
        differ = x[i[s : s + 20_000]] != x[j[s : s + 20_000]]
        out[s : s + 20_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
    return out


_TOLD = pa.schema([*((c, pa.int64()) for c in ("k", "hi", "lo")), *((c, pa.int32()) for c in ("a", "side", "reach", "low", "high"))])
TOLD = "k long, hi long, lo long, a int, side int, reach int, low int, high int"


def neighbours(t: pa.Table, i: np.ndarray, j: np.ndarray, right: np.ndarray, back: np.ndarray, side: int, least: int) -> pa.RecordBatch:
    """What rows i and j, neighbours in the order of one side, tell of each other.

    ``reach`` is how far any match of the row can reach on that side, as far as this neighbour tells; strings that
    start low..high bytes before the anchor (none, if low is above high) occur at the neighbour as well.
    """
    before, after, length = (t.column(c).to_numpy().astype(np.int64) for c in ("before", "after", "length"))
    same = t.column("k").to_numpy()[i] == t.column("k").to_numpy()[j]
    i, j = i[same], j[same]
    r, l = common(right, i, j), common(back, i, j)
    reach = l if side else r
    r, l = np.minimum(r, np.minimum(length[i], length[j])), np.minimum(l, np.minimum(before[i], before[j]))
    low = np.maximum(least - r, np.maximum(after[i], after[j]))
    who = pa.array(np.concatenate([i, j]))
    cols = [t.column(c).combine_chunks().take(who) for c in ("k", "hi", "lo", "a")]
    cols += [pa.array(np.concatenate([x, x]).astype(np.int32)) for x in (np.full(len(i), side), reach, low, l)]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=_TOLD)


def _matrices(t: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    return padded(t.column("suffix").to_pylist(), -(-least // 8) * 8), padded(t.column("back").to_pylist(), -(-max(least - K, 1) // 8) * 8)


def compared(rows: DataFrame, side: int, ranges: int, least: int) -> DataFrame:
    """What neighbours tell of each other in the order of suffixes (side 0), or of blocks and the bytes before them (side 1)."""
    lead = F.substring("suffix", 1, K)
    by = [lead, F.col("back"), F.col("suffix")] if side else [F.col("suffix"), F.col("back")]
    dealt = rows.repartitionByRange(ranges, *by)
    kept = ["k", "hi", "lo", "a", "before", "after", "suffix", "back"]

    def order(batches):
        """One range: neighbours inside it, and its two ends, which the ranges beside it must see."""
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        right, back = _matrices(t, least)
        key = np.column_stack([right[:, :K].copy().view(">u8"), back.view(">u8"), right.view(">u8")]) if side else np.column_stack([right.view(">u8"), back.view(">u8")])
        o, _ = multikey_order(key)
        t = t.append_column("length", pa.array([len(x) for x in t.column("suffix").to_pylist()], pa.int64()))
        told = neighbours(t, o[:-1], o[1:], right, back, side, least)
        ends = t.take(pa.array([o[0], o[-1]])).select(kept)
        part = TaskContext.get().partitionId()
        n = told.num_rows
        blank = {c: pa.nulls(n, ty) for c, ty in (("before", pa.int32()), ("after", pa.int32()), ("suffix", pa.binary()), ("back", pa.binary()), ("end", pa.int64()))}
        yield pa.RecordBatch.from_arrays([*told.columns, *blank.values()], names=[*told.schema.names, *blank])
        cols = {c: ends.column(c).combine_chunks() for c in kept}
        none = pa.nulls(2, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [cols["k"], cols["hi"], cols["lo"], cols["a"], none, none, none, none, cols["before"], cols["after"], cols["suffix"], cols["back"], pa.array([2 * part, 2 * part + 1], pa.int64())],
            names=[*told.schema.names, *blank],
        )

    out = written(dealt.select(*kept).mapInArrow(order, f"{TOLD}, before int, after int, suffix binary, back binary, end long"))

    def across(batches):
        """Ends of ranges, in order within a block: the last suffix of a range against the first of the next one."""
        last: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            t = pa.concat_tables([last, t]).combine_chunks() if last is not None else t
            right, back = _matrices(t, least)
            t = t.append_column("length", pa.array([len(x) for x in t.column("suffix").to_pylist()], pa.int64()))
            end = t.column("end").to_numpy()
            i = np.flatnonzero((end[:-1] % 2 == 1) & (end[1:] % 2 == 0))
            yield neighbours(t, i, i + 1, right, back, side, least)
            last = t.slice(t.num_rows - 1).drop_columns(["length"])

    ends = out.filter("end is not null").select(*kept, "end")
    crossed = ends.repartition("k").sortWithinPartitions("k", "end").mapInArrow(across, TOLD)
    return out.filter("end is null").select("k", "hi", "lo", "a", "side", "reach", "low", "high").unionByName(crossed)


def _texts(col: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in col.to_pylist()]


def text_key(col: Column) -> Column:
    @F.arrow_udf(KEY)
    def key(texts: pa.Array) -> pa.Array:
        ks = [key_of(t) for t in _texts(texts)]
        return pa.array([{"hi": h, "lo": x} for h, x in ks], _KEY)

    return key(col.cast("string"))


def _chosen(docs: DataFrame, text_col: str, keys: DataFrame) -> DataFrame:
    """(hi, lo, raw) of the texts with the given keys, each at least once, and of a few others; within a task once."""
    bits = filter_of(keys, "lo")

    def choose(batches):
        """Keys, filter and texts in one pass, so that a task needs one Python worker."""
        seen: set[tuple[int, int]] = set()
        for b in batches:
            raws = _texts(b.column(0))
            named = [(*key_of(raw), raw) for raw in raws]
            rows = []
            for row, maybe in zip(named, passes(bits.value, np.array([k[1] for k in named], np.int64)).tolist(), strict=True):
                if maybe and row[:2] not in seen:
                    seen.add(row[:2])
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["hi", "lo", "raw"])

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(choose, "hi long, lo long, raw binary")


_FOUND = pa.schema([*((c, pa.int64()) for c in ("k", "c", "hi", "lo")), *((c, pa.int32()) for c in ("a", "before", "after"))])


def repeated_spans(docs: DataFrame, text_col: str = "text", least: int = LEAST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(hi, lo, spans) of each distinct text, named by a 128-bit hash of its bytes, that has repeated strings.

    ``spans`` are the maximal runs of bytes (start, end exclusive, ordered) that are covered by a
    string of ``least`` bytes that also starts elsewhere, in any row, the same one included. Null
    and empty texts, and texts shorter than ``least``, have none. Rows with equal texts repeat each other, also
    when all their columns agree. An empty table gives none. Long texts are read whole, in pieces; other columns are ignored.
    """
    small_batches(docs)

    def emit(batches):
        """Anchors, and spans (k is null, from a to before) that the text or the task itself shows to be repeated."""
        import xxhash

        seen: dict[tuple[int, int], int] = {}
        cols: list[list] = [[] for _ in _FOUND]

        def put(*row):
            for c, v in zip(cols, row, strict=True):
                c.append(v)

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)
            for c in cols:
                c.clear()
            return out

        for b in batches:
            for raw in _texts(b.column(0)):
                if len(raw) < least:
                    continue
                hi, lo = key_of(raw)
                times = seen[hi, lo] = seen.get((hi, lo), 0) + 1
                if times > 1:  # a copy in this task: all of the text is repeated
                    if times == 2:
                        put(None, None, hi, lo, 0, len(raw), 0)
                    continue
                own: dict[tuple[int, int], int] = {}
                run = [0, 0]
                for a, s, e in (x for part in anchors(raw, least) for x in zip(*(y.tolist() for y in part), strict=True)):
                    k = xxhash.xxh3_64_intdigest(raw[a : a + K]) - (1 << 63)
                    c = xxhash.xxh3_64_intdigest(raw[s : e + least], seed=a - s) - (1 << 63)
                    n = own[k, c] = own.get((k, c), 0) + 1
                    if n <= 2:
                        put(k, c, hi, lo, a, a - s, a - e)
                    elif s <= run[1]:  # two are enough to show that surroundings are repeated; the others are spans, as in a run of one byte
                        run[1] = e + least
                    else:
                        if run[1]:
                            put(None, None, hi, lo, *run, 0)
                        run = [s, e + least]
                    if len(cols[0]) >= 20_000:
                        yield batch()
                if run[1]:
                    put(None, None, hi, lo, *run, 0)
            yield batch()

    found = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(emit, "k long, c long, hi long, lo long, a int, before int, after int")
    found, drop_found = stored(found)
    known = cut(found.filter("k is null").select("hi", "lo", F.col("a").alias("s"), F.col("before").alias("e")))
    found = found.filter("k is not null")
    # a small side that is checkpointed first leaves both sides as plain shuffles, whose hot keys adaptive execution splits
    twice = cut(found.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k"))
    same = written(found.hint("shuffle_merge").join(twice.hint("shuffle_merge"), "k"))
    drop_found()

    per = same.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("hi", "lo", "a", "before", "after")).alias("first"))
    kinds = per.groupBy("k").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("fewest"))
    full = cut(per.filter("n > 1").select("k", "c"))
    whole = same.hint("shuffle_merge").join(full.hint("shuffle_merge"), ["k", "c"])
    covered = whole.select("hi", "lo", (F.col("a") - F.col("before")).alias("s"), (F.col("a") - F.col("after") + least).alias("e"))

    # one place of each surrounding of a block whose surroundings differ and of which some occur once
    edge = cut(per.hint("shuffle_merge").join(kinds.filter("kinds > 1 and fewest = 1").hint("shuffle_merge"), "k").select("k", "first.*"))
    marks = edge.groupBy("hi", "lo").agg(F.collect_list(F.struct("k", "a", "before", "after")).alias("edges"))  # of one text
    texts = _chosen(docs, text_col, edge)
    joined = texts.hint("shuffle_merge").join(marks.hint("shuffle_merge"), ["hi", "lo"]).select("hi", "lo", "raw", "edges")
    names, kinds_ = ["k", "hi", "lo", "a", "before", "after", "suffix", "back"], [*[pa.int64()] * 3, *[pa.int32()] * 3, *[pa.binary()] * 2]

    def surroundings(batches):
        done: set[tuple[int, int]] = set()
        for b in batches:
            rows: list[tuple] = []
            for i in range(b.num_rows):
                hi, lo, raw, edges = (b.column(j)[i].as_py() for j in range(4))
                if (hi, lo) in done:  # texts that several tasks have sent are here more than once
                    continue
                done.add((hi, lo))
                for x in edges:
                    a, before, after = x["a"], x["before"], x["after"]
                    rows.append((x["k"], hi, lo, a, before, after, raw[a : a + least - after], raw[a - before : a][::-1]))
                    if len(rows) >= 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], ty) for j, ty in enumerate(kinds_)], names=names)
                        rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], ty) for j, ty in enumerate(kinds_)], names=names)

    around = written(joined.mapInArrow(surroundings, "k long, hi long, lo long, a int, before int, after int, suffix binary, back binary"))
    ranges = max(1, -(-around.count() // range_rows))
    told = cut(compared(around, 0, ranges, least).unionByName(compared(around, 1, ranges, least)))
    again = told.filter("low <= high").select("hi", "lo", (F.col("a") - F.col("high")).alias("s"), (F.col("a") - F.col("low") + least).alias("e"))

    # starts that no neighbour has settled and that no bound excludes
    settled = F.array_compact(F.collect_list(F.when(F.col("low") <= F.col("high"), F.struct("low", "high"))))  # six at most
    reach = lambda side: F.max(F.when(F.col("side") == side, F.col("reach")))
    bounds = told.groupBy("k", "hi", "lo", "a").agg(reach(0).alias("right"), reach(1).alias("left"), settled.alias("settled")).filter("right is not null and left is not null")
    bounds = bounds.hint("shuffle_merge").join(edge.hint("shuffle_merge"), ["k", "hi", "lo", "a"])
    bounds = bounds.select("k", "hi", "lo", "a", F.greatest(F.lit(least) - F.col("right"), F.col("after")).cast("int").alias("least_low"), F.least("left", "before").cast("int").alias("most_high"), "settled")
    bounds = cut(bounds.filter("least_low <= most_high"))
    starts = F.sequence("least_low", "most_high")
    unsure = F.filter(starts, lambda d: ~F.exists("settled", lambda x: (x["low"] <= d) & (d <= x["high"])))
    asked = cut(bounds.select("k", F.explode(unsure).alias("d")).distinct().groupBy("k").agg(F.collect_set("d").alias("ds")))  # fewer than ``least``
    again = again.unionByName(_compared_strings(around, bounds, asked, least))
    all_ = known.unionByName(covered).unionByName(again)
    # copies in several tasks: their anchors repeat each other, so they are covered already

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def merged(spans: pa.Array) -> pa.Array:
        out = []
        for x in spans.to_pylist():
            runs: list[list[int]] = []
            for s, e in sorted((y["s"], y["e"]) for y in x):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            out.append([{"start": s, "end": e} for s, e in runs])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    grouped = all_.groupBy("hi", "lo").agg(F.collect_set(F.struct("s", "e")).alias("_all"))  # of one text
    return grouped.select("hi", "lo", merged("_all").alias("spans"))


def _compared_strings(around: DataFrame, bounds: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """(hi, lo, s, e) of the strings of a block that start ``ds`` bytes before their anchors, within bounds, and that occur twice."""
    open_ = bounds.hint("shuffle_merge").join(asked.hint("shuffle_merge"), "k")
    open_ = open_.select("hi", "lo", "a", F.filter("ds", lambda d: d.between(F.col("least_low"), F.col("most_high"))).alias("ds")).filter(F.size("ds") > 0)
    rows = around.select("hi", "lo", "a", "suffix", "back").hint("shuffle_merge").join(cut(open_).hint("shuffle_merge"), ["hi", "lo", "a"])

    def strings(batches):
        import xxhash

        for b in batches:
            rows_ = []
            for hi, lo, a, suffix, back, ds in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for d in ds:
                    h = xxhash.xxh3_128_intdigest(back[:d][::-1] + suffix[: least - d])
                    rows_.append(((h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63), hi, lo, a - d))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_], pa.int64() if k < 4 else pa.int32()) for k in range(5)], names=["h", "g", "hi", "lo", "s"])

    each = cut(rows.mapInArrow(strings, "h long, g long, hi long, lo long, s int"))
    many = cut(each.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g"))
    each = each.hint("shuffle_merge").join(many.hint("shuffle_merge"), ["h", "g"])
    return each.select("hi", "lo", "s", (F.col("s") + least).alias("e"))


def cut_spans(raw: bytes, spans: list[dict]) -> bytes:
    """The bytes outside the spans."""
    out, at = [], 0
    for x in spans:
        out.append(raw[at : x["start"]])
        at = x["end"]
    return b"".join([*out, raw[at:]])


def remaining(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """(hi, lo, spans, kept) of the texts that have spans: kept are the remaining bytes."""

    @F.arrow_udf("binary")
    def rest(raw: pa.Array, runs: pa.Array) -> pa.Array:
        return pa.array([cut_spans(r, s) for r, s in zip(raw.to_pylist(), runs.to_pylist(), strict=True)], pa.binary())

    texts = _chosen(docs, text_col, spans)
    joined = texts.hint("shuffle_merge").join(spans.hint("shuffle_merge"), ["hi", "lo"])
    return joined.select("hi", "lo", "spans", rest("raw", "spans").alias("kept"))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is removed from every document, and a hash of what remains."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = written(repeated_spans(docs))
    runs = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    per = remaining(docs, spans).select("hi", "lo", runs.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    per = cut(per.groupBy("hi", "lo").agg(*[F.max(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256")]))  # several tasks may have sent a text
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("_whole"), text_key(F.col("text")).alias("_k"))
    rows = rows.select("doc_id", "n_bytes", "_whole", "_k.hi", "_k.lo")
    out = rows.hint("shuffle_merge").join(per.hint("shuffle_merge"), ["hi", "lo"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256"))
