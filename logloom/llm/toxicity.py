"""Toxicity by class-conditional Kneser-Ney models.

Per class ``c``, toxic or ordinary, a word has the Kneser-Ney probability

    P_c(w) = max(n_c(w) - d_c, 0) / N_c + rest * P_shared(w)

where ``n_c(w)`` counts the distinct words before ``w`` in texts of the class (so
copies of a text, and runs of one word, add nothing), ``N_c`` is their sum, ``d_c``
the absolute discount (0.75) and ``P_shared`` the continuation distribution of both
classes together. A word keeps counts of its own if they tell the classes apart (a
likelihood ratio of at least ``evidence`` and a factor of e between its
probabilities), however small its share of the corpus. All others, in particular
rare expressions, are smoothed into the shared counts and then say the same in both
models.

Above the words stand pairs, a word ``w`` behind ``v`` (or at a text's start):

    P_c(w | v) = max(n_c(v, w) - d, 0) / n_c(v) + back(v) * P_c(w)

where ``n_c(v, w)`` counts the distinct texts of the class that have the pair (copies
and repeats within a text add nothing), ``n_c(v)`` is their sum and ``back(v)`` the
discounted mass of both classes, ``d`` times the pairs of ``v`` over their counts. As in a
pruned back-off model, pairs in fewer than five texts, and those whose share of toxic
texts is what their word and the place behind ``v`` let expect (by the same ratio and
factor), back off to their word. A telling pair has the difference to its word as its
weight, so all below holds for words and pairs alike. A document's raw score is the difference of its two log-likelihoods per
word; a logistic curve over its inverse hyperbolic sine, fitted on a fold that gave
no counts, makes it a probability.

Counts cover every labelled document outside the held-out and the calibration
fold and are summed by Spark. Telling words stay a table that grows with the
corpus. Those with over ``share`` of a class's counts, at most ``2/share`` whatever
the corpus (200,000 words at the default; pairs over a tenth of it), go to every task, as does a bitmap of fixed
size (1 MB) of the hashes of the others; words of a text that the bitmap may hold
are joined with the table, once per distinct text, salted. ``share`` decides where a
word is looked up, never what it weighs. Weights are whole multiples of 2^-20, so
that sums agree in any order. The driver also sees the histogram of calibration
scores. Where the table has no others, scoring is one pass without a shuffle.

Defined results: texts null, empty or without letters have raw score 0, the same
as texts without telling words; without labels of both classes every score is 0.
A document labelled twice counts once per label. Repeated rows are scored
alike. Other columns are kept, and replaced if they bear a name added here.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import fold, materialize, replaced

WORDS = re.compile(r"[^\W\d_]+")
#: Bits of a word's hash, and of its left neighbour's, in a bigram's key.
WORD_BITS, LEFT_BITS = 35, 28
#: Raw scores are per word and small; they are stretched before calibration.
STRETCH = 1000.0
#: Words gathered before a task emits its bigrams.
FLUSH = 2_000_000
#: Characters of the whole texts that a task turns into arrays at a time.
PORTION = 1 << 20
DISCOUNT = 0.75
#: Texts that a pair must be in to have counts of its own.
LEAST = 5
#: Pairs go to every task from this part of the share that words need: occurrences of the others are moved.
PAIR_PART = 0.1
#: Weights are log ratios in units of 1/UNIT.
UNIT = 1 << 20
#: Bits of a word's hash that are its place in the bitmap, and bits in a row of it.
SLOT_BITS, ROW_BITS = 23, 1 << 15
#: Parts that the occurrences of a word are dealt to for the join.
SALTS = 16


class _Hashes(dict):
    """Hash of a word, computed once while the table is below its limit."""

    limit = 400_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> (64 - WORD_BITS)
        return h


def _tokens(texts, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and words per text."""
    sizes, parts = [], []
    for text in texts:
        found = WORDS.findall(text.lower()) if text else ()
        sizes.append(len(found))
        parts.append(np.fromiter(map(hashes.__getitem__, found), np.int64, len(found)))
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array(sizes, np.int64)


def _portions(texts: list) -> Iterator[slice]:
    """Consecutive texts of ``PORTION`` characters together; a longer one is alone or last."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= PORTION:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _bigrams(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Keys ``word, left neighbour``; the neighbour of a first word is 0."""
    left = np.zeros_like(words)
    left[1:] = words[:-1] & ((1 << LEFT_BITS) - 1)
    starts = np.cumsum(sizes)[:-1]
    left[starts[starts < len(words)]] = 0
    return (words << LEFT_BITS) | left


def _pair_ids(keys):
    """Ids of pairs, below 0 as words have the others; the low bits say both words (arrays or columns)."""
    if isinstance(keys, np.ndarray):
        return ~(keys ^ (keys >> LEFT_BITS))
    return F.bitwise_not(keys.bitwiseXOR(F.shiftright(keys, LEFT_BITS)))


def _once(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sorted keys, each as often as there are texts that have it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.argsort(keys, kind="stable")
    keys, owner = keys[at], owner[at]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new]


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct bigrams of a task's texts and how many texts of each class have them, in blocks."""
    hashes, held, n = _Hashes(), ([], []), 0

    def flush():
        both = [np.unique(np.concatenate(h) if h else np.empty(0, np.int64), return_counts=True) for h in held]
        keys = np.union1d(both[0][0], both[1][0])
        columns = [keys]
        for k, c in both:
            counts = np.zeros(len(keys), np.int64)
            counts[np.searchsorted(keys, k)] = c
            columns.append(counts)
        for h in held:
            h.clear()
        step = 100_000
        for i in range(0, len(keys), step):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[i:i + step]) for c in columns], ["key", "ordinary", "toxic"])

    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for y in (0, 1):
            mine = [t for t, label in zip(texts, labels) if label == y]
            for part in _portions(mine):
                words, sizes = _tokens(mine[part], hashes)
                if len(words):
                    held[y].append(_once(_bigrams(words, sizes), sizes))
                    n += len(words)
        if n >= FLUSH:
            yield from flush()
            n = 0
    if n:
        yield from flush()


@dataclass(frozen=True)
class Frequent:
    """What every task gets: weights of frequent telling words, a bitmap of the others.

    With ``pairs`` words stands for the ids of pairs as well.
    """

    words: np.ndarray
    weights: np.ndarray
    bitmap: np.ndarray
    pairs: bool = False

    def sums(self, texts, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Weights and words per text, and the words of each that may be among the others."""
        words, sizes = _tokens(texts, hashes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        if self.pairs:
            # A place's word and its pair, side by side, so that a text's stay together.
            words = np.stack([words, _pair_ids(_bigrams(words, sizes))], 1).ravel()
            owner = np.repeat(owner, 2)
        weight, hit = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[at] == words
            weight[hit] = self.weights[at[hit]]
        total = np.bincount(owner, weight, len(sizes)).astype(np.int64)
        others = [np.empty(0, np.int64)] * len(sizes)
        if len(self.bitmap):
            slot = words & ((1 << SLOT_BITS) - 1)
            open_ = np.flatnonzero(~hit & ((self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1) == 1))
            others = np.split(words[open_], np.searchsorted(owner[open_], np.arange(1, len(sizes))))
        return total, sizes, others


@dataclass(frozen=True)
class Model:
    """Weights of telling words: the frequent ones, and a table of the others (if any)."""

    frequent: Frequent
    others: DataFrame | None = None


NOTHING = Model(Frequent(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)))


def _evidence(t, o, p):
    """Twice the log-likelihood ratio against a share ``p`` of ``t`` (columns)."""
    p = p if isinstance(p, Column) else F.lit(p)
    n = t + o
    term = lambda c, e: F.when(c > 0, c * F.log(c / e)).otherwise(0.0)
    return 2 * (term(t, n * p) + term(o, n * (1 - p)))


def _distinct_texts(train: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` without all but the first document of a text and class."""
    text = [F.xxhash64("text").alias("_h"), F.length("text").alias("_n")]
    rows = train.select("doc_id", *text).join(known, F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_h", "_n", "_toxic").agg(F.min("_id").alias("_id")).select("_id", "_toxic").distinct()


def fit(
    docs: DataFrame, labels: DataFrame, share: float = 1e-5, evidence: float = 20.0, order: int = 1
) -> Model:
    """The models of folds 2 to 4: of words, or with ``order`` 2 of word pairs that back off to them."""
    known = labels.where(F.col("toxic").isin(0, 1)).select(
        F.col("doc_id").alias("_id"), F.col("toxic").cast("long").alias("_toxic"))
    train = docs.where(fold("doc_id") >= 2).select("doc_id", "text")
    if order > 1:
        known = materialize(_distinct_texts(train, known))
    # The texts are moved once, unsorted; rows without a label stay behind.
    train = train.join(known.hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).select("text", "_toxic")
    types = train.mapInArrow(_types, "key long, ordinary long, toxic long")
    types = types.groupBy("key").agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o"))
    if order > 1:
        types = materialize(types)
    words = types.groupBy(F.shiftright("key", LEFT_BITS).alias("word")).agg(
        F.count_if(F.col("t") > 0).alias("t"), F.count_if(F.col("o") > 0).alias("o"))
    words = materialize(words)
    sums = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "to"]).collect()[0]
    if not (sums.t and sums.o):
        return NOTHING
    t, o, both = F.col("t"), F.col("o"), sums.t + sums.o
    told = words.where(_evidence(t, o, sums.t / both) >= evidence)
    # Whole numbers, so that the sums don't depend on the order of the rows.
    kept = told.agg(*[
        (F.coalesce(F.sum(c), F.lit(0)) - DISCOUNT * F.count_if(F.col(c) > 0)).alias(c) for c in "to"]).collect()[0]
    rest = 1 - (kept.t / sums.t + kept.o / sums.o) / 2
    p_t, p_o = (
        F.greatest(n - DISCOUNT, F.lit(0.0)) / total + rest * (t + o) / both
        for n, total in ((t, sums.t), (o, sums.o)))
    ratio = F.log(p_t / p_o)
    weighed = told.where(F.abs(ratio) >= 1).select(
        "word", "t", "o", p_t.alias("p_t"), p_o.alias("p_o"), F.round(ratio * UNIT).cast("long").alias("weight"))
    often = (t > share * sums.t) | (o > share * sums.o)
    terms = weighed.select("word", "weight", often.alias("often"))
    if order > 1:
        weighed = materialize(weighed)
        terms = materialize(terms.unionByName(_pairs(types, words, weighed, both, share, evidence)))
    # Over the share: at most 1/share rows per class of words, ten times that of pairs.
    got = sorted(tuple(r) for r in terms.where("often").select("word", "weight").collect())
    word, weight = (np.array([r[i] for r in got], np.int64) for i in range(2))
    others = terms.where("not often").select("word", "weight")
    bitmap = _bitmap(others)
    return Model(Frequent(word, weight, bitmap, order > 1), others if len(bitmap) else None)


def _pairs(
    types: DataFrame, words: DataFrame, weighed: DataFrame, both: int, share: float, evidence: float
) -> DataFrame:
    """``word`` (a pair's id), ``weight``, ``often``: what telling pairs add to the weight of their word."""
    t, o, n = F.col("t"), F.col("o"), F.col("t") + F.col("o")
    left = F.col("key").bitwiseAND((1 << LEFT_BITS) - 1).alias("left")
    pairs = types.select("key", left, F.shiftright("key", LEFT_BITS).alias("word"), "t", "o")
    total = pairs.agg(F.sum("t").alias("t"), F.sum("o").alias("o")).collect()[0]
    share = share * PAIR_PART
    context = pairs.groupBy("left").agg(
        F.sum("t").alias("v_t"), F.sum("o").alias("v_o"), F.count("*").alias("v_n"))
    plain = (F.col("t") + F.col("o")) / F.lit(both)
    lower = words.join(weighed.select("word", "p_t", "p_o"), "word", "left").select(
        "word", F.coalesce("p_t", plain).alias("p_t"), F.coalesce("p_o", plain).alias("p_o"))
    found = pairs.where(n >= LEAST).join(context, "left").join(lower, "word")
    v_t, v_o, p_t, p_o = (F.col(c) for c in ("v_t", "v_o", "p_t", "p_o"))
    found = found.where(_evidence(t, o, v_t * p_t / (v_t * p_t + v_o * p_o)) >= evidence)
    rest = DISCOUNT * F.col("v_n") / (v_t + v_o)
    q_t, q_o = (
        F.greatest(c - DISCOUNT, F.lit(0.0)) / F.greatest(v, F.lit(1)) + rest * p
        for c, v, p in ((t, v_t, p_t), (o, v_o, p_o)))
    gain = F.log(q_t / q_o) - F.log(p_t / p_o)
    return found.where(F.abs(gain) >= 1).select(
        _pair_ids(F.col("key")).alias("word"), F.round(gain * UNIT).cast("long").alias("weight"),
        ((t > share * total.t) | (o > share * total.o)).alias("often"))


def _bitmap(others: DataFrame) -> np.ndarray:
    """Bits of the places that words of ``others`` have; empty without words."""
    place = F.col("word").bitwiseAND((1 << SLOT_BITS) - 1) + 1
    rows = others.groupBy(F.bitmap_bucket_number(place).alias("row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros((1 << SLOT_BITS) // 8 if rows else 0, np.uint8)
    for r in rows:
        at = (r.row - 1) * ROW_BITS // 8
        out[at:at + ROW_BITS // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


MARKS = StructType([
    StructField("weight", LongType()), StructField("n", LongType()),
    StructField("others", ArrayType(LongType())), StructField("key", BinaryType()),
])


def marked(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``raw``: weight of the frequent words, words, words to join, digest of the text."""
    docs = docs.drop("raw")
    at, frequent = docs.columns.index("text"), model.frequent
    schema = StructType([*docs.schema.fields, StructField("raw", MARKS)])
    kind = pa.struct([
        ("weight", pa.int64()), ("n", pa.int64()), ("others", pa.list_(pa.int64())), ("key", pa.binary())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = _Hashes()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for part in _portions(texts):
                total, sizes, others = frequent.sums(texts[part], hashes)
                keys = [xxhash.xxh3_128_digest(t) if len(o) else None for t, o in zip(texts[part], others)]
                raw = pa.StructArray.from_arrays(
                    [pa.array(total), pa.array(sizes), pa.array(others, pa.list_(pa.int64())), pa.array(keys, pa.binary())],
                    fields=list(kind))
                own = batch.slice(part.start, len(sizes))
                yield pa.RecordBatch.from_arrays([*own.columns, raw], [*batch.schema.names, "raw"])

    return docs.mapInArrow(mark, schema)


def joined(rows: DataFrame, model: Model) -> DataFrame:
    """``key``, ``more``: the weight of other words by text, of the ``marked`` (written) ``rows``."""
    texts = rows.select("raw.key", "raw.others").where(F.col("key").isNotNull()).dropDuplicates(["key"])
    found = texts.select("key", F.explode("others").alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))
    found = found.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    table = model.others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.join(table, ["word", "salt"]).groupBy("key").agg(F.sum(F.col("n") * F.col("weight")).alias("more"))


def raw_scores(rows: DataFrame, more: DataFrame | None) -> DataFrame:
    """``marked`` rows with ``raw`` as the difference of log-likelihoods per word."""
    def per_word(weight):
        return weight / F.lit(float(UNIT)) / F.greatest(F.col("raw.n"), F.lit(1))

    weight = F.col("raw.weight")
    if more is None:
        return replaced(rows, {"raw": per_word(weight)})
    # Only texts with other words move.
    stay = replaced(rows.where("raw.key is null"), {"raw": per_word(weight)})
    more = more.select(F.struct(F.col("key"), F.col("more")).alias("_more"))
    move = rows.where("raw.key is not null").join(more, F.col("raw.key") == F.col("_more.key"), "left")
    move = replaced(move, {"raw": per_word(weight + F.coalesce("_more.more", F.lit(0)))}).drop("_more")
    return stay.unionByName(move)


def _stretched(raw):
    return F.asinh(raw * STRETCH)


def calibrated(scored: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """Slope and offset of the logistic curve on fold 1 (all folds if it lacks a class).

    The histogram has steps of 0.01 of a value below 20, so at most 4,000 bins.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), "toxic")
    rows = scored.where(fold("doc_id") != 0).select(
        "doc_id", (fold("doc_id") == 1).alias("own"), F.round(_stretched(F.col("raw")), 2).alias("z"))
    rows = rows.join(known, F.col("doc_id") == F.col("_id"))
    bins = rows.groupBy("own", "z").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count("*").alias("n")).collect()
    mine = [b for b in bins if b.own]
    if not 0 < sum(b.p for b in mine) < sum(b.n for b in mine):
        mine = bins
    if not 0 < sum(b.p for b in mine) < sum(b.n for b in mine):
        return 0.0, -math.inf
    z, p, n = (np.array([float(b[k]) for b in sorted(mine, key=lambda b: b.z)]) for k in ("z", "p", "n"))
    slope = offset = 0.0
    for _ in range(60):  # Newton steps with a weak pull to 0, as classes may be separable
        q = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        w = n * q * (1 - q)
        g = np.array([(p - n * q) @ z - 0.1 * slope, (p - n * q).sum()])
        h = np.array([[w @ (z * z) + 0.1, w @ z], [w @ z, w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, offset = slope + step[0], offset + step[1]
    return max(float(slope), 0.0), float(offset)


def scores(docs: DataFrame, labels: DataFrame, narrow: bool = False, order: int = 2, **options) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; only ``doc_id`` of them if ``narrow``."""
    model = fit(docs, labels, order=order, **options)
    rows = materialize(marked(docs.select("doc_id", "text"), model).drop("text"))
    more = None if model.others is None else materialize(joined(rows, model))
    scored = raw_scores(rows, more)
    slope, offset = calibrated(scored, labels)
    if not narrow:
        scored = raw_scores(marked(docs, model), more)
    p = F.lit(0.0) if offset == -math.inf else 1 / (1 + F.exp(-(_stretched(F.col("raw")) * slope + offset)))
    out = replaced(scored, {"score": p}).drop("raw")
    return replaced(out, {"predicted": (F.col("score") >= 0.5).cast("int")})
