"""Language identification, words first.

A word that the training texts know scores by the logarithm of its frequency in
each language. An unseen word falls back to its character n-grams, from four
characters (with marks at both ends of the word) down to one: the longest order
of which any n-gram is known decides, by the mean of their log frequencies. A
document's language is the one with the largest sum over its words; the score is
that language's share when all languages are equally likely beforehand.

Training counts cover every word of every document outside the held-out fold
whose language is given; they are counted per task, then summed by Spark. n-grams
are counted over the distinct words of a language, which resemble unseen words
better than frequent ones do. A word or n-gram is known from a share of its
language on, so the model has at most ``1/share`` words and n-grams of each order
per language, whatever the size of the corpus.

Defined results: ``und`` and score 0 for texts that are null or have no letter,
and for all texts if no training text has a word; ties go to the smaller name;
repeated rows get the same answer. Columns named as a result are replaced,
others kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fold, materialize

WORDS = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
WORD_SHARE = 2e-5
GRAM_SHARE = 1e-5
#: Added to every count of a known word or n-gram.
FLOOR = 0.1
#: Distinct entries a task holds before it emits them.
FLUSH = 500_000
UNKNOWN = "und"

_COUNTS = ["lang", "item", "n"]


def _emit(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, counter in held.items():
        items = list(counter.items())
        for i in range(0, len(items), 100_000):
            part = items[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(part), pa.string()), pa.array([k for k, _ in part], pa.string()),
                pa.array([c for _, c in part], pa.int64())], _COUNTS)
    held.clear()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
        if sum(map(len, held.values())) > FLUSH:
            yield from _emit(held)
    yield from _emit(held)


def grams(word: str, order: int) -> list[str]:
    marked = f"\x02{word}\x03" if order > 1 else word
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    for b in batches:
        for lang, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counter = held.setdefault(lang, Counter())
            for order in ORDERS:
                counter.update(grams(word, order))
        if sum(map(len, held.values())) > FLUSH:
            yield from _emit(held)
    yield from _emit(held)


@dataclass(frozen=True)
class Model:
    """Log frequencies by language (columns of the arrays) of words and n-grams."""

    langs: tuple[str, ...]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words by the longest order of which an n-gram is known."""
        out = np.zeros((len(words), len(self.langs)))
        rest, get = list(enumerate(words)), self.grams.get
        for order in ORDERS:
            rows, owners, starts, left = [], [], [], []
            for at, word in rest:
                known = [r for g in grams(word, order) if (r := get(g)) is not None]
                if known:
                    owners.append(at)
                    starts.append(len(rows))
                    rows += known
                else:
                    left.append((at, word))
            if rows:
                sums = np.add.reduceat(self.gram_logs[rows], starts, axis=0)
                out[owners] = sums / np.diff([*starts, len(rows)])[:, None]
            rest = left
        return out


class Scorer:
    """Scores texts; the rows of words met before are kept, up to a limit."""

    limit = 300_000

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.rows, self.table = dict(self.model.words), self.model.word_logs

    def best(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [WORDS.findall(t.lower()) if t else [] for t in texts]
        if len(self.rows) - len(self.model.words) > self.limit:
            self._forget()
        new = list({w for words in found for w in words if w not in self.rows})
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.table = np.concatenate([self.table, self.model.unseen(new)])
        return [self._one(words) for words in found]

    def _one(self, words: list[str]) -> tuple[str, float]:
        if not self.model.langs or not any(any(map(str.isalpha, w)) for w in words):
            return UNKNOWN, 0.0
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        sums = self.table[at].sum(axis=0)
        i = int(sums.argmax())
        return self.model.langs[i], float(1 / np.exp(np.maximum(sums - sums[i], -700)).sum())


def _known(counts: DataFrame, totals: DataFrame, share: float) -> pa.Table:
    """Counts, by language, of items over ``share`` of any language's total."""
    held = counts.join(totals, "lang")
    able = held.where(F.col("n") >= F.col("total") * share).select("item").distinct()
    return held.join(able, "item", "left_semi").select("lang", "item", "n").toArrow()


def _logs(table: pa.Table, langs: tuple[str, ...], totals: dict[str, float]) -> tuple[dict[str, int], np.ndarray]:
    rows: dict[str, int] = {}
    items, names, n = (table.column(c).to_pylist() for c in ("item", "lang", "n"))
    for item in sorted(set(items)):
        rows[item] = len(rows)
    counts = np.full((len(rows), len(langs)), FLOOR)
    column = {lang: i for i, lang in enumerate(langs)}
    for item, lang, c in zip(items, names, n):
        counts[rows[item], column[lang]] += c
    all_ = np.array([totals[lang] for lang in langs])
    return rows, np.log(counts / (all_ + FLOOR * max(len(rows), 1)))


def fit(docs: DataFrame, word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE) -> Model:
    """The model of the documents outside fold 0 (``text``, ``lang``, ``doc_id``)."""
    train = docs.where((fold("doc_id") != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    schema = "lang string, item string, n long"
    words = train.select("lang", "text").mapInArrow(_words, schema)
    words = materialize(words.groupBy("lang", "item").agg(F.sum("n").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    by_lang = {r.lang: float(r.total) for r in totals.collect()}
    langs = tuple(sorted(by_lang))
    known = _logs(_known(words, totals, word_share), langs, by_lang)
    pieces = words.select("lang", "item").mapInArrow(_grams, schema)
    pieces = materialize(pieces.groupBy("lang", "item").agg(F.sum("n").alias("n")))
    tables, logs = {}, []
    for order in ORDERS:
        own = pieces.where(F.length("item") == order)
        sums = own.groupBy("lang").agg(F.sum("n").alias("total"))
        found = {r.lang: float(r.total) for r in sums.collect()}
        rows, values = _logs(_known(own, sums, gram_share), langs, {x: found.get(x, 0.0) + 1 for x in langs})
        tables.update({item: len(tables) + i for i, item in enumerate(rows)})
        logs.append(values)
    return Model(langs, *known, tables, np.vstack(logs) if langs else np.zeros((0, 0)))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    at = docs.columns.index("text")
    schema = StructType([
        *docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            texts = b.column(at).to_pylist()
            best = [x for i in range(0, len(texts), 2000) for x in scorer.best(texts[i:i + 2000])]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in best], pa.string()), pa.array([s for _, s in best], pa.float64())],
                [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)


__all__ = ["Model", "Scorer", "fit", "grams", "identified"]
