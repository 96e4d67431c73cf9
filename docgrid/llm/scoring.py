"""Language-model scores by a weighted backoff automaton.

The model is a word trigram model over the whole training part. States are seen pairs of words,
words, and the root, which stands for no context. Seen trigrams are arcs of pair states and seen
pairs arcs of word states; every pair state has a failure arc to the state of its last word, and
that one to the root, where words that training has not seen share one arc. A text is read once from
left to right, carrying the state and adding log-probabilities.

Counts are global, by 64-bit hashes at any size of the input, and no task ever holds the whole model. Texts lie
in blocks of bounded size. Each block asks for the counts of its own words and pairs: sorted hashes,
written as differences, one message for each range of the hash space, together with the block's
own training counts. The owner of a range adds up and answers in the order of the question; of a pair it also says
whether several blocks have it. Then blocks ask for their triples in the same way, but not for those that
have a pair which no other block has: no other block has these, so that the block's own counts are all. Hot
words are one entry for each block, and hashes spread evenly, so no range is larger than others.
A block then builds the part of the automaton that its texts can reach.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.blocks import opened, pack, sections, text_blocks, unpack
from docgrid.llm.text import coded, hash_words, mix64, words_of
from docgrid.shared import hashed_fold, stored, stored_by, written

#: Bytes of text of a block, and of the text whose hashes one range should hold. There is no most number of ranges: where
#: a block has fewer hashes than there are ranges, a message holds one hash, so both should grow with executors' memory.
BLOCK_BYTES, RANGE_BYTES = 3_000_000, 8_000_000
#: A seen pair of a context counts at least this much, however new the context's successors are.
LEAST_TRUST = 0.1
MOST_DISCOUNT = 0.9
#: A pair that occurred so often as a context gives half of its weight to the words that followed it.
HALF_TRUST = 4.0
#: Tokens that a lane of the traversal reads.
LANE = 256
BINS = 64


def _token_hash(word: bytes) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(word))


class Block:
    """Coded texts: every text is its words and one end. Triples are found when they are first asked for."""

    def __init__(self, texts: list[str]):
        words, at = words_of(pa.array(texts, pa.large_string()), lower=True)
        codes, distinct = coded(words)
        n = len(texts)
        self.at = at + np.arange(n + 1)  # one end after each text
        ids = np.full(int(self.at[-1]), len(distinct), np.int64)
        ends = np.zeros(len(ids), np.bool_)
        ends[self.at[1:] - 1] = True
        ids[~ends] = codes
        self.ids = ids
        self.start = len(distinct) + 1  # the state before the first token
        self.hashes = np.concatenate([hash_words(distinct), [_token_hash(b"\n"), _token_hash(b"\t")]]).astype(np.uint64)
        before = np.concatenate([[self.start], ids[:-1]])
        before[self.at[:-1]] = self.start
        self.before = before
        pairs = (before << 32) | ids
        self.pairs, self.pair_of = np.unique(pairs, return_inverse=True)
        h = self.hashes
        self.pair_hashes = mix64(mix64(h[self.pairs >> 32]) * np.uint64(3) + h[self.pairs & 0xFFFFFFFF])
        # triples end at every token but the first one of a text
        self.inner = np.ones(len(ids), np.bool_)
        self.inner[self.at[:-1]] = False

    @cached_property
    def _by_triple(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        last = np.flatnonzero(self.inner)
        triples, first, triple_of = np.unique((self.pair_of[last - 1] << 32) | self.ids[last], return_index=True, return_inverse=True)
        return triples, triple_of, self.pair_of[last[first]]

    @property
    def triples(self) -> np.ndarray:
        """Each different triple: its first pair and its last token."""
        return self._by_triple[0]

    @property
    def triple_of(self) -> np.ndarray:
        return self._by_triple[1]

    @property
    def ends(self) -> np.ndarray:
        """The pair that each triple ends with."""
        return self._by_triple[2]

    @cached_property
    def triple_hashes(self) -> np.ndarray:
        return mix64(self.pair_hashes[self.triples >> 32] * np.uint64(5) + self.hashes[self.triples & 0xFFFFFFFF])

    def asked(self, kind: int, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places) of the words (kind 1), pairs (2) or triples (3) that are asked for, in the order of hashes; of triples, those of which both pairs are ``shared``."""
        if kind == 3:
            places = np.flatnonzero(shared[self.triples >> 32] & shared[self.ends])
            h = self.triple_hashes[places]
        else:
            h = self.hashes[: self.start] if kind == 1 else self.pair_hashes
            places = np.arange(len(h))
        order = np.argsort(h)
        return h[order], places[order]

    def counts(self, kind: int, train: np.ndarray) -> np.ndarray:
        """How often each word, pair or triple occurs in the block's own training texts."""
        learn = np.repeat(train, np.diff(self.at))
        if kind == 3:
            return np.bincount(self.triple_of[learn[self.inner]], minlength=len(self.triples))
        of, n = (self.ids, self.start) if kind == 1 else (self.pair_of, len(self.pairs))
        return np.bincount(of[learn], minlength=n)

    def questions(self, kind: int, train: np.ndarray, range_bits: int, shared: np.ndarray | None = None):
        """(range, kind, hashes, training counts) with hashes sorted; a range is the first bits of a hash."""
        x, places = self.asked(kind, shared)
        n = self.counts(kind, train)[places]
        first = (x >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(x), np.int64)
        for r, s, e in sections(first):
            yield r, kind, pack(np.diff(x[s:e], prepend=np.uint64(0))), pack(n[s:e])

    def answered(self, kind: int, answers: list[tuple[int, bytes]], shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, counts) that were answered."""
        places = self.asked(kind, shared)[1]
        return places, np.concatenate([unpack(x) for _, x in sorted(answers)]).astype(np.int64) if len(places) else np.zeros(0, np.int64)

    def known_pairs(self, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The counts of all pairs, and whether several blocks have them."""
        places, got = self.answered(2, answers)
        out = np.zeros(len(places), np.int64)
        out[places] = got
        return out >> 1, (out & 1).astype(np.bool_)


class Automaton:
    """States are the words of a block, the start, the root, and the pairs of the block; only those that training knows are entered."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, totals: dict):
        self.block, self.root = block, block.start + 1
        n, v, d = totals["n"], totals["v"], totals["discount"]
        count = np.append(words, [totals["texts"], 0])  # of the words and the end, the start, the root
        self.known = count[: block.start] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            p1 = np.where(self.known, (count[: block.start] - d) / max(n, 1), d * v / n if n else 1.0)
            trust = np.where(count > 0, totals["trust"][np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), BINS - 1)], 0.0)
            state, token = block.pairs >> 32, block.pairs & 0xFFFFFFFF
            p2 = np.where(pairs > 0, trust[state] * pairs / count[state], 0.0) + (1 - trust[state]) * p1[token]
            self.seen = pairs > 0
            self.fall, self.fail, self.weights = np.log10(p1), np.log10(1 - trust), np.log10(p2)
            half = pairs / (pairs + HALF_TRUST)
            self.fail_pair = np.log10(1 - half)
            arcs = triples > 0
            self.arcs, context = block.triples[arcs], block.triples[arcs] >> 32
            self.arc_weights = np.log10(half[context] * triples[arcs] / pairs[context] + (1 - half[context]) * p2[block.ends[arcs]])

    @staticmethod
    def _find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), np.bool_)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return at, keys[at] == codes

    def after(self, pair: np.ndarray) -> np.ndarray:
        """The state that a text is in behind a pair of neighbours."""
        token = self.block.pairs[pair] & 0xFFFFFFFF
        return np.where(self.seen[pair], self.root + 1 + pair, np.where(self.known[token], token, self.root))

    def read(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of the tokens, and the states after them."""
        deep = state > self.root
        pair = np.where(deep, state - self.root - 1, 0)
        word = np.where(deep, self.block.pairs[pair] & 0xFFFFFFFF, state)
        at2, there = self._find(self.block.pairs, (word << 32) | token)
        hit2 = there & self.seen[at2]
        weight = np.where(hit2, self.weights[at2], self.fail[word] + self.fall[token])
        at3, hit3 = self._find(self.arcs, np.where(deep, (pair << 32) | token, -1))
        weight = np.where(deep, self.fail_pair[pair], 0.0) + weight
        if len(self.arcs):
            weight = np.where(hit3, self.arc_weights[at3], weight)
        return weight, np.where(hit2, self.root + 1 + at2, np.where(self.known[token], token, self.root))

    def traverse(self) -> np.ndarray:
        """Log-probability of each text. Texts are read in lanes of LANE tokens side by side; a lane that begins inside a text starts in the state that the pair before it leads to."""
        block = self.block
        ids, at = block.ids, block.at
        starts = np.concatenate([np.arange(s, e, LANE) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] or [np.empty(0, np.int64)])
        text = np.searchsorted(at, starts, side="right") - 1
        stops = np.minimum(starts + LANE, at[1:][text])
        state = np.where(block.inner[starts], self.after(block.pair_of[starts - 1]), block.start)
        total = np.zeros(len(starts))
        order = np.argsort(-(stops - starts), kind="stable")
        starts, stops, state, text = starts[order], stops[order], state[order], text[order]
        length = stops - starts
        for k in range(int(length.max()) if len(length) else 0):
            m = int(np.searchsorted(-length, -k, side="left"))  # lanes with a token left
            weight, state[:m] = self.read(state[:m], ids[starts[:m] + k])
            total[:m] += weight
        return np.bincount(text, weights=total, minlength=len(at) - 1)


def score_texts(df: DataFrame, id_col: str, train: Column, text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id_col, train, n_tokens, n_known, train_tokens, base_score, score) of each row, learning from rows where ``train`` holds.

    Null and empty texts are one end token. A null ``train`` is false. Without training rows nothing is known,
    and scores are those of the empty model (base: one class of weight 1, score 0). Repeated rows count and score as often as they
    occur; a null id is kept. An empty table gives none. Long texts are read whole. Other columns are ignored. ``id_col`` is an integer.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = (size // range_bytes).bit_length()
    gathered, drop_gathered = text_blocks(rows, "text", block_bytes)
    blocks, drop_blocks = stored_by(gathered, "block")  # read three times, twice beside answers
    drop_gathered()

    messages, replies = "block long, range long, kind int, hashes binary, counts binary", "block long, range long, kind int, counts binary, bins array<array<long>>"
    fields = [("block", pa.int64()), ("range", pa.int64()), ("kind", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]

    def posed(block: int, questions: list[tuple]) -> pa.Table:
        return pa.Table.from_pylist([dict(zip(("block", "range", "kind", "hashes", "counts"), (block, *q), strict=True)) for q in questions], pa.schema(fields))

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                block, train_ = Block(opened(row)), np.array(row["train"], np.bool_)
                yield from posed(row["block"], [q for kind in (1, 2) for q in block.questions(kind, train_, range_bits)]).to_batches()

    def ask_triples(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block(opened(row))
        _, shared = block.known_pairs([(r["range"], r["counts"]) for r in right.to_pylist()])
        return posed(row["block"], list(block.questions(3, np.array(row["train"], np.bool_), range_bits, shared)))

    def answer(group: pa.Table) -> pa.Table:
        """All questions about one range of one kind: answers, of pairs with a last bit that says whether several blocks asked; and of words one row that sums the range up."""
        rows_ = group.to_pylist()
        kind, number = rows_[0]["kind"], rows_[0]["range"]
        keys = [np.cumsum(unpack(r["hashes"]), dtype=np.uint64) for r in rows_]
        counts = np.concatenate([unpack(r["counts"]) for r in rows_]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=counts).astype(np.int64)
        told = total << 1 | (np.bincount(inverse) > 1) if kind == 2 else total
        at, out = 0, []
        for r, k in zip(rows_, keys, strict=True):
            out.append({"block": r["block"], "range": number, "kind": kind, "counts": pack(told[inverse[at : at + len(k)]]), "bins": None})
            at += len(k)
        if kind == 1:
            own = total[total > 0]
            bins = np.log2(np.maximum(own, 1)).astype(np.int64)
            sums = [[len(own), int(own.sum()), int((own == 1).sum()), int((own == 2).sum())], np.bincount(bins, minlength=BINS).tolist(), np.bincount(bins, weights=own, minlength=BINS).astype(np.int64).tolist()]
            out.append({"block": None, "range": number, "kind": 0, "counts": None, "bins": sums})
        return pa.Table.from_pylist(out, pa.schema([*fields[:3], fields[4], ("bins", pa.list_(pa.list_(pa.int64())))]))

    answers, drop_answers = stored(blocks.mapInArrow(ask, messages).groupBy("range", "kind").applyInArrow(answer, replies))
    of_pairs = answers.filter("kind = 2").select("block", "range", "counts")
    triples_asked = blocks.groupBy("block").cogroup(of_pairs.groupBy("block")).applyInArrow(ask_triples, messages)
    of_triples, drop_of_triples = stored(triples_asked.groupBy("range", "kind").applyInArrow(answer, replies))
    flat = answers.filter("kind = 0").select(F.posexplode("bins").alias("part", "x")).select("part", F.posexplode("x").alias("k", "n"))
    sums = {(r.part, r.k): r.n for r in flat.groupBy("part", "k").agg(F.sum("n").alias("n")).collect()}  # a constant number
    totals = model_totals(sums, rows.filter("train").count())

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block(opened(row))
        got: dict[int, list] = {1: [], 2: [], 3: []}
        for r in right.to_pylist():
            got[r["kind"]].append((r["range"], r["counts"]))
        pairs, shared = block.known_pairs(got[2])
        words, triples = np.zeros(block.start, np.int64), block.counts(3, np.array(row["train"], np.bool_))  # all there are of those that are not shared
        for kind, counts in ((1, words), (3, triples)):
            places, told = block.answered(kind, got[kind], shared)
            counts[places] = told
        own, at = words[block.ids], block.at
        base = np.log10((words + 0.5) / (totals["n"] + 0.5 * (totals["v"] + 1)))[block.ids]
        cut_ = at[:-1]
        return pa.table(
            {
                "id": pa.array(row["id"], pa.int64()),
                "train": pa.array(row["train"], pa.bool_()),
                "n_tokens": pa.array(np.diff(at)),
                "n_known": pa.array(np.add.reduceat((own > 0).astype(np.int64), cut_)),
                "base_score": pa.array(np.add.reduceat(base, cut_)),
                "score": pa.array(Automaton(block, words, pairs, triples, totals).traverse()),
            }
        )

    told = answers.filter("kind > 0").unionByName(of_triples).select("block", "range", "kind", "counts")
    out = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, "id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    scored = written(out.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(totals["n"]).cast("long").alias("train_tokens"), "base_score", "score"))
    for drop in (drop_blocks, drop_answers, drop_of_triples):
        drop()
    return scored


def model_totals(sums: dict, texts: int) -> dict:
    """Tokens, distinct tokens, discount and trust by size of context, from sums over the training tokens.

    The discount is n1 / (n1 + 2 n2), below 1 also where no word occurs twice. The trust in the seen successors of a context that occurred c times is
    what c draws from the unigram distribution leave to words drawn before, by bins of powers of two.
    """
    v, n, n1, n2 = (sums.get((0, k), 0) for k in range(4))
    d = min(n1 / (n1 + 2 * n2), MOST_DISCOUNT) if n1 else 0.5
    kinds = np.array([sums.get((1, k), 0) for k in range(BINS)], float)
    mass = np.array([sums.get((2, k), 0) for k in range(BINS)], float)
    p = np.where(kinds > 0, mass / np.maximum(kinds, 1) / max(n, 1), 0.0)
    new = np.array([float((mass / max(n, 1) * (1 - p) ** (2.0**b - 1)).sum()) for b in range(BINS)])
    return {"n": int(n), "v": int(v), "texts": texts, "discount": d, "trust": np.clip(1 - new, LEAST_TRUST, 0.999)}


def op2_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of every document, held out or not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_texts(docs, "doc_id", hashed_fold(F.col("doc_id"), 5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
