"""Benchmark decontamination by CGK embedding.

Texts are sequences of words. The CGK random walk maps a sequence to a longer one so that a few
edits become a few differing places; sampling places of the embedding gives hash keys under
which near sequences collide, and enough repetitions reach the wanted recall. Every window of a
document that is as long as the benchmark items of a length class is a candidate, once it holds
enough words and word pairs of these items to be near one at all: k edits leave all but k words and
all but 2k pairs, so nothing is lost. Windows that collide with an item are verified by exact edit distance.

The distance of embeddings grows faster than the edit rate on long sequences. A long item is therefore
cut into pieces that are searched each: if the whole item is within the edit rate, one piece is at least.

Documents are mapped without a shuffle. Benchmark items go to the tasks in blocks of bounded size; a pass over
the documents takes a few blocks, and a benchmark of more of them takes more passes, so that what tasks hold does not grow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.text import coded, hash_words, mix64, small_batches, spans, words_of
from docgrid.shared import fresh, written

#: Bytes of benchmark text of a block, and blocks that one pass over the documents searches for.
BLOCK_BYTES, BLOCKS = 4_000_000, 8
MOST_EDITS = 0.2
#: Places sampled for a key, and repetitions: with half of the places differing, a key survives with 1/8, one of 40 with over 0.995.
#: Half is what a fifth of edits makes of a sequence of up to about LONGEST words; longer ones differ in more.
PLACES, REPETITIONS = 3, 40
#: Items of more words are cut into pieces of this many words at most.
LONGEST = 40
#: Ratio of the longest to the shortest item of a length class.
CLASS_RATIO = 1.15
#: Steps of the walk for a word of the longest item of a class: a walk takes two on average, and what lies behind its end tells nothing.
STEPS = 1.8
#: Windows whose keys are held at once.
WINDOWS = 20_000
_PAD = np.uint64(0x9E3779B97F4A7C15)


def most_edits(n: int, rate: float) -> int:
    return int(rate * n)


def walk_keys(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Sampled keys of the CGK embeddings of tokens[start:end], one column for each repetition."""
    rng = np.random.default_rng([seed, steps])
    out = np.empty((len(starts), REPETITIONS), np.uint64)
    padded = np.append(tokens, _PAD)
    for r in range(REPETITIONS):
        places = set(rng.choice(steps, min(PLACES, steps), replace=False).tolist())
        coins = rng.integers(0, 2**63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        at = starts.copy()
        key = np.full(len(starts), np.uint64(r + 1))
        for j in range(max(places) + 1):
            tok = padded[np.where(at < ends, at, len(tokens))]
            if j in places:
                key = mix64(key ^ tok) * np.uint64(3)
            at += (tok * coins[j] >> np.uint64(63)).astype(np.int64)
        out[:, r] = key
    return out


def cuts(n: int) -> list[int]:
    """Bounds of the pieces of an item of ``n`` words, of lengths that differ by one at most."""
    k = -(-n // LONGEST)
    return [n * j // k for j in range(k + 1)]


def best_fit(item: list[int], text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the part of ``text`` nearest to ``item``; the leftmost end on ties.

    A row of the alignment at a time; edits and start are one number, so the least of it has least edits, then the leftmost start.
    """
    n = len(text)
    edit, at = np.int64(n + 1), np.arange(n + 1)
    row = at.astype(np.int64)
    for i, a in enumerate(item, 1):
        new = row + edit
        new[1:] = np.minimum(new[1:], row[:-1] + (text != a) * edit)
        new[0] = i * edit
        row = np.minimum.accumulate(new - at * edit) + at * edit
    end = int((row // edit).argmin())
    return int(row[end] // edit), int(row[end] % edit), end


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    return mix64(tokens[:-1]) * np.uint64(3) + tokens[1:]


def tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the texts' words, the words as numbers, and the hashes of these."""
    words, at = words_of(texts, lower=True)
    codes, distinct = coded(words)
    return at, codes, hash_words(distinct)


class Index:
    """Benchmark items, or their pieces, by length class: their words, and their keys in sorted arrays."""

    def __init__(self, ids: list[int], texts: list[str | None], rate: float = MOST_EDITS, seed: int = 3):
        self.rate, self.seed = rate, seed
        words, at = words_of(pa.array(texts, pa.large_string()), lower=True)
        codes, distinct = coded(words)
        hashes = hash_words(distinct)[codes] if len(distinct) else np.empty(0, np.uint64)
        self.ids = ids
        self.items = [hashes[at[i] : at[i + 1]].tolist() for i in range(len(ids))]
        self.classes = []
        #: (item, first word, end) of each piece; an item that is not cut is its only piece.
        self.pieces = [(i, a, b) for i, x in enumerate(self.items) if x for a, b in zip(cuts(len(x)), cuts(len(x))[1:], strict=False)]
        lens = [b - a for _, a, b in self.pieces]
        order = sorted(range(len(self.pieces)), key=lens.__getitem__)
        while order:
            low = lens[order[0]]
            own = [k for k in order if lens[k] <= max(low, int(low * CLASS_RATIO))]
            order = order[len(own) :]
            size = max(lens[k] for k in own)
            starts = np.array([at[self.pieces[k][0]] + self.pieces[k][1] for k in own], np.int64)
            ends = starts + np.array([lens[k] for k in own], np.int64)
            keys = walk_keys(hashes, starts, ends, int(STEPS * size) + 1, seed)
            flat, who = keys.ravel(), np.repeat(own, REPETITIONS)
            o = np.argsort(flat, kind="stable")
            vocabulary = np.unique(np.concatenate([hashes[s:e] for s, e in zip(starts, ends, strict=True)]))
            pairs = np.unique(np.concatenate([pair_hashes(hashes[s:e]) for s, e in zip(starts, ends, strict=True)]))
            lengths = {int(e - s) for s, e in zip(starts, ends, strict=True)}
            words_left = min(n - most_edits(n, rate) for n in lengths)
            pairs_left = min(n - 1 - 2 * most_edits(n, rate) for n in lengths)
            self.classes.append((size, vocabulary, words_left, pairs, pairs_left, flat[o], who[o]))
        self.pairs = np.unique(np.concatenate([c[3] for c in self.classes] or [np.empty(0, np.uint64)]))

    def search(self, texts: pa.Array) -> list[list[dict]]:
        return self.find(*tokenised(texts))

    def find(self, at: np.ndarray, codes: np.ndarray, hd: np.ndarray) -> list[list[dict]]:
        """For each text its matches: item_id, start and end word (end exclusive), edits; the nearest one of each item."""
        tokens = hd[codes] if len(hd) else np.empty(0, np.uint64)
        stop = np.repeat(at[1:], np.diff(at))
        found: list[dict[int, list[int]]] = [{} for _ in range(len(at) - 1)]
        begin = np.arange(len(tokens))
        pair = np.zeros(len(tokens), np.int64)  # of a word and the next one; 0 is no pair of the benchmark
        if len(self.pairs) and len(tokens) > 1:
            h = pair_hashes(tokens)
            spot = np.minimum(np.searchsorted(self.pairs, h), len(self.pairs) - 1)
            pair[:-1] = np.where(self.pairs[spot] == h, spot + 1, 0)
        for size, vocabulary, words_left, pairs, pairs_left, keys, who in self.classes:
            known = np.isin(hd, vocabulary)
            if not known.any():
                continue
            end = np.minimum(begin + size, stop)
            wide = np.minimum(begin + size + most_edits(size, self.rate), stop)
            own = np.concatenate([[False], np.isin(self.pairs, pairs)])
            seen = np.concatenate([[0], np.cumsum(own[pair], dtype=np.int32)])
            starts = begin[seen[np.maximum(wide - 1, begin)] - seen[begin] >= pairs_left]
            seen = np.concatenate([[0], np.cumsum(known[codes], dtype=np.int32)])
            starts = starts[seen[wide[starts]] - seen[starts] >= words_left]
            for s in range(0, len(starts), WINDOWS):
                w = starts[s : s + WINDOWS]
                mine = walk_keys(tokens, w, end[w], int(STEPS * size) + 1, self.seed)
                lo, hi = np.searchsorted(keys, mine, side="left"), np.searchsorted(keys, mine, side="right")
                rows, cols = np.nonzero(hi > lo)
                n = (hi - lo)[rows, cols]
                hit = who[np.repeat(lo[rows, cols] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                met = np.unique(np.stack([np.repeat(rows, n), hit]), axis=1)
                docs = np.searchsorted(at, w[met[0]], side="right") - 1
                for doc, start, piece in zip(docs.tolist(), w[met[0]].tolist(), met[1].tolist(), strict=True):
                    item, skipped, _ = self.pieces[piece]
                    found[doc].setdefault(item, []).append(start - skipped)
        out = []
        for doc, per in enumerate(found):
            hits = []
            for item, spots in sorted(per.items()):
                if hit := self.verify(item, sorted(set(spots)), tokens, int(at[doc]), int(at[doc + 1])):
                    hits.append(hit)
            out.append(hits)
        return out

    def verify(self, item: int, spots: list[int], tokens: np.ndarray, first: int, stop: int) -> dict | None:
        """The nearest place of an item around the given starts (of windows, less the words before their piece), if it is near enough."""
        own = self.items[item]
        most = most_edits(len(own), self.rate)
        slack, best, s = most + 1, None, 0
        words, pairs = set(own), set(zip(own, own[1:], strict=False))
        reach = int(len(own) * CLASS_RATIO) + 2 * slack
        before = slack if len(own) <= LONGEST else slack + most_edits(LONGEST, self.rate)  # edits before a piece move its start, too
        while s < len(spots):
            a = max(first, spots[s] - before)
            e = s
            while e + 1 < len(spots) and spots[e + 1] - spots[e] <= slack and spots[e + 1] - spots[s] < 4 * len(own):
                e += 1
            b = min(stop, spots[e] + reach)
            listed = tokens[a:b].tolist()
            s = e + 1
            if sum(w in words for w in listed) < len(own) - most or sum(w in pairs for w in zip(listed, listed[1:], strict=False)) < len(own) - 1 - 2 * most:
                continue
            edits, x, y = best_fit(own, tokens[a:b])
            if edits <= most and (best is None or edits < best["edits"]):
                best = {"item_id": self.ids[item], "start": a + x - first, "end": a + y - first, "edits": edits}
        return best


MATCHES = "array<struct<item_id:long,start:int,end:int,edits:int>>"
_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))


def contamination(df: DataFrame, items: DataFrame, text_col: str = "text", out: str = "matches", rate: float = MOST_EDITS, block_bytes: int = BLOCK_BYTES, blocks: int = BLOCKS) -> DataFrame:
    """Add ``out``: matches of benchmark items (item_id, text) in the text of each row.

    An item of n words matches where a part of the text is within ``rate`` * n word edits (ASCII
    case ignored). Null and empty texts match nothing, and items without words nothing. Items that
    repeat an id are searched each. Null item ids are reported as null. No item or no row: empty
    lists, or no rows. A column named ``out`` is replaced. Long texts are searched whole.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    sc = small_batches(df).sparkSession.sparkContext
    (before,) = fresh(df, "before")
    found = df
    for first in range(0, n_blocks, blocks):
        shared = []
        for k in range(first, min(first + blocks, n_blocks)):
            block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()  # about block_bytes
            block.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text or ""))
            shared.append(sc.broadcast(cloudpickle.dumps(Index([r.item_id for r in block], [r.text for r in block], rate))))
        mine = _searcher(shared)(F.col(text_col).cast("string"))
        if first == 0:
            found = found.withColumn(out, mine)
        else:  # what earlier passes have found is written, so that their blocks can be let go
            found = written(found.withColumnRenamed(out, before)).withColumn(out, F.concat(before, mine)).drop(before)
    return found


def _searcher(shared: list):
    held: list[Index] = []

    @F.arrow_udf(MATCHES)
    def search(texts: pa.Array) -> pa.Array:
        if not held:
            held.extend(cloudpickle.loads(x.value) for x in shared)
        out = []
        for s, n in spans(texts):
            words = tokenised(texts.slice(s, n))
            out += [[hit for hits in per for hit in hits] for per in zip(*(index.find(*words) for index in held), strict=True)]
        return pa.array(out, _MATCH)

    return search


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """The nearest match of each benchmark item in a document that holds one; documents without any have no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, items)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", F.col("m.start").alias("start_word"), F.col("m.end").alias("end_word"), "m.edits")
