"""Language identification by character language models.

For every language an interpolated Kneser-Ney trigram model over letters is fitted on a bounded
sample of labelled rows. The models share sorted arrays of n-gram hashes with one column of
log-probabilities for each language. A text gets the language of the lowest cross-entropy for
a character; how certain that is, and beyond which entropy it is rejected, is calibrated on a
part of the sample that the models do not see.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm.text import mix64, rebased, small_batches
from docgrid.shared import hashed_fold, written

#: At most so many texts of each language are learned from (lowest hashes first), one in five of them only calibrates; and at most
#: so many languages, those with most texts, so that the model's size has a bound.
PER_LANGUAGE, MOST_LANGUAGES = 500, 1000
#: Characters that are handled together.
PIECE = 1_000_000
DISCOUNT = 0.75
END = 0  # the class of everything that is no letter; runs of it count once


def letter_classes(alphabet: list[str]) -> np.ndarray:
    """Class of every code point: 0 no letter, 1.. letters of the alphabet, the next one all other letters."""
    table = np.zeros(0x110000, np.uint16)
    other = len(alphabet) + 1
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = other
    for i, c in enumerate(alphabet):
        table[ord(c)] = i + 1
    return table


def classed(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of all texts, runs of no letter as one, and offsets. Every text ends with one 0."""
    low = pc.utf8_lower(pc.fill_null(rebased(texts).cast(pa.large_string()), ""))
    low = pc.binary_join_element_wise(low, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    n = np.asarray(pc.utf8_length(low), dtype=np.int64)
    cps = np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), np.uint32)
    cls = table[cps]
    first = np.zeros(len(cls), np.bool_)
    ends = np.cumsum(n)
    first[np.concatenate([[0], ends[:-1]])[: len(n)]] = True
    keep = cls != END
    keep[1:] |= cls[:-1] != END  # a space counts after a letter only
    keep[first] = cls[first] != END
    before = np.concatenate([[0], np.cumsum(keep)])
    return cls[keep], before[np.concatenate([[0], ends])]


def fit_kneser_ney(grams: Counter, size: int) -> tuple[dict, dict, dict, dict]:
    """Interpolated Kneser-Ney from trigram counts over ``size`` classes.

    Gives p3(abc), weight left by context ab, p2(bc) and weight left by context b; p1 is inside p2,
    and p2 of an unseen pair is the context's weight times p1 (kept under the key (None, c)).
    """
    left2, left1, cont = defaultdict(set), defaultdict(set), Counter()
    for a, b, c in grams:
        left2[b, c].add(a)
    pair_mid, fan_mid = Counter(), Counter()
    for (b, c), lefts in left2.items():
        left1[c].add(b)
        pair_mid[b] += len(lefts)
        fan_mid[b] += 1
    all_pairs = sum(len(v) for v in left1.values())
    for c, bs in left1.items():
        cont[c] = len(bs)
    p1 = {c: (cont[c] + 0.5) / (all_pairs + 0.5 * size) for c in range(size)}
    w2 = {b: DISCOUNT * fan_mid[b] / pair_mid[b] for b in pair_mid}
    p2 = {(b, c): max(len(x) - DISCOUNT, 0) / pair_mid[b] + w2[b] * p1[c] for (b, c), x in left2.items()}
    p2 |= {(None, c): p for c, p in p1.items()}
    total, fan = Counter(), Counter()
    for (a, b, _), n in grams.items():
        total[a, b] += n
        fan[a, b] += 1
    w3 = {ab: DISCOUNT * fan[ab] / total[ab] for ab in total}

    def low(b: int, c: int) -> float:
        return p2.get((b, c)) or w2.get(b, 1.0) * p1[c]

    p3 = {(a, b, c): max(n - DISCOUNT, 0) / total[a, b] + w3[a, b] * low(b, c) for (a, b, c), n in grams.items()}
    return p3, w3, p2, w2


class Model:
    """Sorted hash arrays: trigrams, pairs (as trigram ends and as contexts) and single classes."""

    def __init__(self, grams: dict[str, Counter], alphabet: list[str]):
        self.languages = sorted(grams)
        self.table = letter_classes(alphabet)
        self.size = m = len(alphabet) + 2
        fits = [fit_kneser_ney(grams[x], m) for x in self.languages]
        code3 = lambda a, b, c: (a * m + b) * m + c
        code2 = lambda b, c: b * m + c

        def low(f, b, c):
            return f[2].get((b, c)) or f[3].get(b, 1.0) * f[2][None, c]

        def store(keys: list[int], rows: list[list[float]]):
            h = mix64(np.array(keys, np.uint64)) if keys else np.empty(0, np.uint64)
            o = np.argsort(h)
            return h[o], np.log(np.array(rows, np.float64).reshape(len(keys), len(fits)))[o].astype(np.float32)

        tri = sorted(set().union(*[f[0] for f in fits])) if fits else []
        pairs = sorted({(b, c) for f in fits for b, c in f[2] if b is not None} | {(b, c) for _, b, c in tri})
        ctx = sorted(set().union(*[f[1] for f in fits])) if fits else []
        self.tri = store([code3(*k) for k in tri], [[f[0].get(k) or f[1].get(k[:2], 1.0) * low(f, *k[1:]) for f in fits] for k in tri])
        self.pair = store([code2(*k) for k in pairs], [[low(f, *k) for f in fits] for k in pairs])
        self.ctx = store([code2(*k) for k in ctx], [[f[1].get(k, 1.0) for f in fits] for k in ctx])
        self.one = np.log(np.array([[f[2][None, c] for f in fits] for c in range(m)], np.float64).reshape(m, len(fits))).astype(np.float32)
        self.mid = np.log(np.array([[f[3].get(b, 1.0) for f in fits] for b in range(m)], np.float64).reshape(m, len(fits))).astype(np.float32)
        self.scale, self.limits = 1.0, {}

    @staticmethod
    def _find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix64(codes)
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.bool_)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def log_probs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Log-probability, for each language, of class c after a and b."""
        m = np.uint64(self.size)
        at, hit = self._find(self.tri[0], (a * m + b) * m + c)
        out = self.tri[1][at] if len(self.tri[0]) else np.zeros((len(a), len(self.languages)), np.float32)
        if not hit.all():
            x, y, z = a[~hit], b[~hit], c[~hit]
            at2, hit2 = self._find(self.pair[0], y * m + z)
            low = np.where(hit2[:, None], self.pair[1][at2], self.mid[y.astype(np.int64)] + self.one[z.astype(np.int64)])
            at3, hit3 = self._find(self.ctx[0], x * m + y)
            out[~hit] = low + np.where(hit3[:, None], self.ctx[1][at3], np.float32(0))
        return out

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy for a character, text by language, and whether the text has a letter."""
        cls, at = classed(texts, self.table)
        n, k = len(at) - 1, len(self.languages)
        sums = np.zeros((n, k))
        starts = np.zeros(len(cls), np.bool_)
        starts[at[:-1][at[:-1] < at[1:]]] = True
        for s in range(0, len(cls), PIECE):
            e = min(s + PIECE, len(cls))
            c = cls[s:e].astype(np.uint64)
            b = np.concatenate([cls[s - 1 : s] if s else [0], cls[s : e - 1]]).astype(np.uint64)
            a = np.concatenate([cls[s - 2 : s] if s > 1 else np.zeros(2), cls[s : max(s, e - 2)]])[: e - s].astype(np.uint64)
            f = starts[s:e]
            b[f], a[f] = 0, 0
            a[1:][f[:-1]] = 0
            if s and starts[s - 1]:
                a[0] = 0
            lp = self.log_probs(a, b, c)
            rows = np.searchsorted(at, np.arange(s, e), side="right") - 1
            edges = np.flatnonzero(np.diff(rows, prepend=-1))
            sums[rows[edges]] += np.add.reduceat(lp, edges, axis=0, dtype=np.float64)
        length = np.diff(at)
        return -sums / np.maximum(length, 1)[:, None], length > 0

    def predict(self, texts: pa.Array) -> list[dict]:
        if not self.languages:
            return [{"lang": "und", "score": 0.0, "entropy": None, "rejected": True}] * len(texts)
        h, has = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h.min(axis=1)
        share = 1.0 / np.exp(-(h - low[:, None]) * self.scale).sum(axis=1)
        return [
            {"lang": self.languages[b], "score": float(s), "entropy": float(e), "rejected": bool(e > self.limits.get(self.languages[b], np.inf))}
            if ok
            else {"lang": "und", "score": 0.0, "entropy": None, "rejected": True}
            for b, s, e, ok in zip(best, share, low, has, strict=True)
        ]


def learned(docs: DataFrame, train: "F.Column", text_col: str, lang_col: str, per_language: int, most_languages: int) -> DataFrame:
    """(text, lang, _r) of the rows to learn from, written: distinct texts by rank of their hashes in their language, ``per_language`` of them."""
    rows = docs.filter(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    largest = rows.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n")).orderBy(F.desc("_n"), "lang").limit(most_languages)
    # hashes are even, so this share of them holds the lowest ones of a language several times over, however many texts it has
    share = F.least(F.lit(1.0), F.lit(3.0 * per_language + 100) / F.col("_n"))
    low = rows.join(F.broadcast(largest), "lang").filter(F.col("_h").cast("double") <= share * 2.0**64 - 2.0**63)  # most_languages rows
    w = Window.partitionBy("lang").orderBy("_h")
    sample = low.select("text", "lang", "_h").dropDuplicates(["lang", "_h"]).withColumn("_r", F.row_number().over(w))
    return written(sample.filter(F.col("_r") <= per_language).select("text", "lang", "_r"))


def fit(docs: DataFrame, train: "F.Column", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """Fit and calibrate a model; what is gathered is bounded by ``per_language`` texts of each of ``most_languages``.

    Every fifth text of a language calibrates, so a language of fewer is learned from whole. Repeated texts count once; null
    texts and languages are left out; without labelled rows the model knows no language.
    """
    sample = learned(small_batches(docs), train, text_col, lang_col, per_language, most_languages)

    def letters(batches):
        for b in batches:
            seen = Counter()
            for t in pc.utf8_lower(b.column("text").cast(pa.large_string())).to_pylist():
                seen.update(t)
            got = [c for c in seen if c.isalpha()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array([seen[c] for c in got], pa.int64())], names=["c", "n"])

    own = sample.filter("_r % 5 <> 0")
    alphabet = [r.c for r in own.mapInArrow(letters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).filter("n >= 2").orderBy("c").collect()]
    table = letter_classes(alphabet)

    def count(batches):
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                cls, _ = classed(pa.array([text]), table)
                x = [0, 0, *cls.tolist()]
                seen[lang].update(zip(x, x[1:], x[2:], strict=False))
            flat = [(k, *g, n) for k, v in seen.items() for g, n in v.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in flat], pa.string()), *[pa.array([r[j] for r in flat], pa.int64()) for j in range(1, 5)]], names=["lang", "x", "y", "z", "n"]
            )

    rows = own.mapInArrow(count, "lang string, x long, y long, z long, n long").groupBy("lang", "x", "y", "z").agg(F.sum("n").alias("n")).collect()
    grams: dict[str, Counter] = defaultdict(Counter)
    for r in rows:
        grams[r.lang][r.x, r.y, r.z] = r.n
    model = Model(grams, alphabet)
    if model.languages:
        calibrate(model, sample.filter("_r % 5 = 0"))
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Set the scale of the score and the entropy beyond which a text is rejected (the highest percent of its language)."""

    def measure(batches):
        for b in batches:
            h, has = model.entropies(b.column("text"))
            lang = b.column("lang").filter(pa.array(has))
            yield pa.RecordBatch.from_arrays([lang, pa.array(h[has].tolist(), pa.list_(pa.float64()))], names=["lang", "h"])

    got = [r for r in rows.select("text", "lang").mapInArrow(measure, "lang string, h array<double>").collect() if r.lang in model.languages]
    if not got:
        return
    h = np.array([r.h for r in got])
    y = np.array([model.languages.index(r.lang) for r in got])
    d = h - h.min(axis=1, keepdims=True)
    loss = {s: float((np.log(np.exp(-d * s).sum(axis=1)) + d[np.arange(len(y)), y] * s).mean()) for s in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)}
    model.scale = min(loss, key=lambda s: (loss[s], s))
    for k, lang in enumerate(model.languages):
        if (y == k).any():
            model.limits[lang] = float(np.quantile(h[y == k, k], 0.99)) * 1.05


def identify(df: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """Add struct ``out`` (lang, score, entropy, rejected).

    A null text and one without a letter are ``und`` with score 0. Otherwise lang is a learned one, ties going to
    the first by name; score is its calibrated share. ``rejected`` marks texts whose entropy is beyond that of
    nearly all calibration rows. Rows are independent; a column named ``out`` is replaced; an empty table stays empty.
    """
    # the model's size is bounded by the sample that it is fitted on
    shared = small_batches(df).sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    held: list[Model] = []

    @F.arrow_udf("struct<lang:string,score:double,entropy:double,rejected:boolean>")
    def guess(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(cloudpickle.loads(shared.value))
        m, size = held[0], np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
        group, out_ = np.cumsum(size) // PIECE, []
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            out_ += m.predict(texts.slice(int(at[0]), len(at)))
        return pa.array(out_, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())]))

    return df.withColumn(out, guess(F.col(text_col).cast("string")))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = hashed_fold(F.col("doc_id"), 3) == 1
    model = fit(docs, ~held)
    found = identify(docs.select("doc_id", "text"), model, out="found")
    return found.select("doc_id", held.alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))
