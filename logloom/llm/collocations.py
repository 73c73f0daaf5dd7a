"""Phrase collocations by direct-address tiling of frequency-ranked ids.

1. Each task encodes its texts in blocks: word numbers of the block's own dictionary.
   Dictionaries, not texts, are shuffled; they give every word's count.
2. Words that are frequent enough get ids by frequency, 0 being the most frequent of its
   language, and blocks are translated to them; all other words become gaps. A phrase
   can be frequent only if its words are.
3. Neighbouring ids are points of a square, cut into tiles of ``TILE`` by ``TILE``. Tiles with
   many points, near the corner where frequent words meet, are counted by address with
   ``bincount``; points of all others are sorted into coordinates with counts. Spark sums
   the coordinates of all tasks.
4. Frequent pairs are ranked like words and blocks learn their pairs' ids; a pair and the
   word after it are again points of a square, and so on for longer phrases.

Scores are exact: whole numbers of up to 38 digits, for corpora of up to 10^15 words.

Memory of a task is bounded by a block and ``HELD`` points. A language may be all of the
corpus: its rows are dealt by block, word or pair, never by language, and its report is
cut down through a tree of groups.

Defined results: null and empty texts have no words; null languages are ``und``; repeated
rows count each; phrases never span texts; texts of any length are encoded whole, in
stretches; an empty table has no phrases. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of text of a block, and of a stretch that is split into words at a time.
BLOCK, STRETCH = 1 << 23, 1 << 20
#: Side of a tile; points from which it is counted by address; ids that may lie in such tiles.
TILE, DENSE, HEAD = 512, 512 * 512 // 16, 1 << 14
#: Points that a task holds before it counts them; entries of an emitted row.
HELD, ROW = 1 << 21, 1 << 16
#: What ends a piece of text, and what parts words.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b"\t"
_TABLE = bytes(0xFF if b in ENDS else 0x20 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Stands for the end of a piece; not a byte of UTF-8.
_END = b"\xff"

_codec = "zstd"


def pack(ids: np.ndarray) -> bytes:
    """Ids as compressed bytes: low halves, then high halves, which are mostly zero."""
    halves = ids.astype("<i4").view("<u2").reshape(-1, 2)
    return pa.compress(np.ascontiguousarray(halves.T).tobytes(), codec=_codec, asbytes=True) if len(ids) else b""


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int32)
    raw = pa.decompress(data, decompressed_size=4 * n, codec=_codec, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, "<u2").reshape(2, n).T).view("<i4").ravel()


def _lists(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*parts, np.empty(0, kind)]).astype(kind)))


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """Words and ends of pieces of a lower-cased text."""
    text = text.translate(_TABLE).replace(_END, b" \xff ")
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + STRETCH)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


class _Dictionary:
    """Words of a block, numbered as they come."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {_END: -1}
        self.ids: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        coded = pa.array(words, pa.binary()).dictionary_encode()
        numbers = [self.numbers.setdefault(w, len(self.numbers) - 1) for w in coded.dictionary.to_pylist()]
        self.ids.append(np.array(numbers, np.int32)[coded.indices.to_numpy()] if words else np.empty(0, np.int32))


def encoded(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``block, lang, n, ids, words, counts``: blocks of word numbers with their dictionaries."""
    names = ["block", "lang", "n", "ids", "words", "counts"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        size = 0

        def made(lang: str, texts: list[bytes]) -> pa.RecordBatch:
            own = _Dictionary()
            for words in _stretches(b"\n".join(texts)):
                own.add(words)
            ids = np.concatenate([*own.ids, np.empty(0, np.int32)])
            words = [w for w in own.numbers if w != _END]
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            return pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([lang]), pa.array([len(ids)], pa.int64()),
                pa.array([pack(ids)], pa.binary()), pa.array([words], pa.list_(pa.binary())), _lists([counts])], names)

        for b in batches:
            for t, la in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    held.setdefault(la, []).append(t)
                    size += len(t)
                if size >= BLOCK:
                    for la, texts in held.items():
                        yield made(la, texts)
                    held, size, block = {}, 0, block + 1
        for la, texts in held.items():
            yield made(la, texts)

    rows = docs.select(
        F.col(f"`{text}`").cast("string").cast("binary").alias("text"),
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(
        encode, "block long, lang string, n long, ids binary, words array<binary>, counts array<long>")


def ranked(rows: DataFrame, *ties: str) -> DataFrame:
    """Adds ``id``: rows of a language counted from 0 by falling ``f``, then by ``ties``.

    Ranges of the order become tasks; each numbers its rows and starts behind those before.
    """
    order = [F.col("lang"), F.col("f").desc(), *ties]
    placed = materialize(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("lang", "_range").agg(F.min("_at").alias("_lo"), F.count("*").alias("_n")).select(
        "lang", "_range", "_lo", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(starts, ["lang", "_range"]).select(
        *rows.columns, (F.col("_at") - F.col("_lo") + F.col("_before")).alias("id"))


def _learned(entries: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """``block, lang, at, id``: for every block, which of its entries have which ids."""
    hits = entries.join(known, on).groupBy("block", "lang").agg(F.collect_list(F.struct("at", "id")).alias("_hits"))
    return hits.select("block", "lang", F.col("_hits.at").alias("at"), F.col("_hits.id").alias("id"))


def translated(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """``block, lang, n, ids``: blocks in the ids of ``words``; gaps are -1."""
    entries = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    learned = _learned(entries, words.select("lang", "word", "id"), ["lang", "word"])
    names = ["block", "lang", "n", "ids"]

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                block, lang, n, ids, at, new = (c[row] for c in b.columns)
                old = unpack(ids.as_py(), n.as_py())
                # One more place at the end: where gaps, numbered -1, look.
                to = np.full(old.max(initial=-1) + 2, -1, np.int32)
                to[at.values.to_numpy()] = new.values.to_numpy()
                yield pa.RecordBatch.from_arrays([
                    pa.array([block.as_py()], pa.int64()), pa.array([lang.as_py()]), pa.array([n.as_py()], pa.int64()),
                    pa.array([pack(to[old])], pa.binary())], names)

    joined = blocks.select("block", "lang", "n", "ids").join(learned, ["block", "lang"])
    return joined.select(*names, "at", "id").mapInArrow(translate, "block long, lang string, n long, ids binary")


def _points(ids: np.ndarray) -> np.ndarray:
    """Neighbours as ``left << 32 | right``; -1 where there is a gap."""
    left, right = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    return np.where((left >= 0) & (right >= 0), left << 32 | right, -1)


def tally(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct points of a square with their counts, tile by tile."""
    near = (left < HEAD) & (right < HEAD)
    side = HEAD // TILE
    x, y = left[near], right[near]
    tile = (x // TILE * side + y // TILE).astype(np.int16)
    order = np.argsort(tile, kind="stable")
    sizes = np.bincount(tile, minlength=side * side)
    ends = np.cumsum(sizes)
    sparse = [~near]
    rest = np.ones(len(x), bool)
    for t in np.flatnonzero(sizes >= DENSE):
        at = order[ends[t] - sizes[t]:ends[t]]
        counts = np.bincount(x[at] % TILE * TILE + y[at] % TILE, minlength=TILE * TILE)
        cells = np.flatnonzero(counts)
        yield t // side * TILE + cells // TILE, t % side * TILE + cells % TILE, counts[cells]
        rest[at] = False
    sparse = np.concatenate([left[~near] << 32 | right[~near], x[rest] << 32 | y[rest]])
    points, counts = np.unique(sparse, return_counts=True)
    for i in range(0, len(points), ROW):
        p = points[i:i + ROW]
        yield p >> 32, p & 0xFFFFFFFF, counts[i:i + ROW]


def counted(rows: DataFrame, points: Callable[[tuple], tuple[np.ndarray, np.ndarray]], least: int) -> DataFrame:
    """``lang, x, y, f``: points of all rows that occur at least ``least`` times in a language.

    ``points`` gives the ids of a row's points, left and right; the row's first column is
    the language.
    """
    names = ["lang", "x", "y", "c"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def made() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                left, right = (np.concatenate(p) for p in zip(*parts, strict=True))
                for x, y, c in tally(left, right):
                    for i in range(0, len(x), ROW):
                        cut = slice(i, i + ROW)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang]), _lists([x[cut]]), _lists([y[cut]]), _lists([c[cut]])], names)

        for b in batches:
            for row in range(b.num_rows):
                lang, *values = (c[row] for c in b.columns)
                left, right = points(values)
                held.setdefault(lang.as_py(), []).append((left, right))
                size += len(left)
                if size >= HELD:
                    yield from made()
                    held, size = {}, 0
        yield from made()

    parts = rows.mapInArrow(count, "lang string, x array<long>, y array<long>, c array<long>")
    cells = parts.select("lang", F.explode(F.arrays_zip("x", "y", "c")).alias("p"))
    return cells.groupBy("lang", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(
        F.sum("p.c").alias("f")).where(F.col("f") >= least)


def _pairs_of(values: tuple) -> tuple[np.ndarray, np.ndarray]:
    n, ids = values
    p = _points(unpack(ids.as_py(), n.as_py()))
    p = p[p >= 0]
    return p >> 32, p & 0xFFFFFFFF


def _triples_of(values: tuple) -> tuple[np.ndarray, np.ndarray]:
    n, ids, at, new = values
    ids = unpack(ids.as_py(), n.as_py())
    known, place = np.unique(_points(ids), return_inverse=True)
    to = np.full(len(known), -1, np.int64)
    to[at.values.to_numpy()] = new.values.to_numpy()
    pair = to[place]
    # Both pairs of a frequent triple are frequent.
    good = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
    return pair[good], ids[good + 2].astype(np.int64)


def _with_pairs(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Blocks with the ids of their pairs, by place among the block's distinct pairs."""
    names = ["block", "lang", "points"]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                block, lang, n, ids = (c[row].as_py() for c in b.columns)
                known = np.unique(_points(unpack(ids, n)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([lang]), _lists([known])], names)

    found = blocks.select("block", "lang", "n", "ids").mapInArrow(
        distinct, "block long, lang string, points array<long>")
    entries = found.select("block", "lang", F.posexplode("points").alias("at", "point")).where("point >= 0")
    point = F.shiftleft("x", 32).bitwiseOR(F.col("y")).alias("point")
    learned = _learned(entries, pairs.select("lang", point, "id"), ["lang", "point"])
    return blocks.join(learned, ["block", "lang"]).select("lang", "n", "ids", "at", "id")


def _score(a: str, left: str, right: str) -> Column:
    whole = "cast({} as decimal(15,0))".format
    return F.expr(
        f"(cast(1000000 as decimal(7,0)) * {whole(a)} * {whole(a)}) div ({whole(left)} * {whole(right)})").cast("long")


def _best(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of each language with ``rank``, through a tree of groups."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("phrase"), F.lit(4096)))
    for groups in (4096, 64, 1):
        rows = rows.withColumn("_group", F.pmod("_group", F.lit(groups)))
        place = F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order))
        rows = rows.withColumn("rank", place).where(F.col("rank") <= limit)
    return rows.drop("_group")


def phrases(docs: DataFrame, least: int = 10, cover: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """All candidates that stay: ``lang, phrase, a, l, r, n, score``.

    Phrases of two and three words that occur at least ``least`` times, except those inside
    a longer one that occurs at least ``cover`` percent as often.
    """
    blocks = materialize(encoded(docs, text, lang))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    sizes = blocks.groupBy("lang").agg(F.sum(total).alias("n"))
    entry = F.explode(F.arrays_zip("words", "counts")).alias("e")
    words = blocks.select("lang", entry).groupBy("lang", F.col("e.words").alias("word")).agg(
        F.sum("e.counts").alias("f")).where(F.col("f") >= least)
    words = materialize(ranked(materialize(words), "word"))
    blocks = materialize(translated(blocks, words))
    pairs = materialize(ranked(materialize(counted(blocks.select("lang", "n", "ids"), _pairs_of, least)), "x", "y"))
    triples = materialize(counted(_with_pairs(blocks, pairs), _triples_of, least))

    def named(*columns: str) -> DataFrame:
        """Words under other names: id, text, count."""
        i, w, f = columns
        return words.select("lang", F.col("id").alias(i), F.col("word").cast("string").alias(w), F.col("f").alias(f))

    two = pairs.join(named("x", "w1", "l"), ["lang", "x"]).join(named("y", "w2", "r"), ["lang", "y"])
    two = materialize(two.select(
        "lang", "id", "x", "y", F.col("f").alias("a"), "l", "r", F.concat_ws(" ", "w1", "w2").alias("phrase")))
    front = two.select("lang", F.col("id").alias("x"), F.col("y").alias("middle"), F.col("l").alias("f1"),
                       F.col("a").alias("f12"), F.col("phrase").alias("start"))
    back = pairs.select("lang", F.col("x").alias("middle"), "y", F.col("f").alias("f23"), F.col("id").alias("second"))
    three = materialize(
        triples.join(front, ["lang", "x"]).join(named("y", "w3", "f3"), ["lang", "y"])
        .join(back, ["lang", "middle", "y"])
        .select("lang", F.col("x").alias("first"), "second", F.col("f").alias("a"), "f1", "f23", "f12", "f3",
                F.concat_ws(" ", "start", "w3").alias("phrase")))
    # The lower score is the cut that counts; the first at equal ones.
    late = _score("a", "f12", "f3") < _score("a", "f1", "f23")
    three_scored = three.select(
        "lang", "phrase", "a", F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(late, F.col("f3")).otherwise(F.col("f23")).alias("r"))
    longer = three.select("lang", F.col("first").alias("id"), F.col("a").alias("inside")).unionByName(
        three.select("lang", F.col("second").alias("id"), F.col("a").alias("inside")))
    longer = longer.groupBy("lang", "id").agg(F.max("inside").alias("inside"))
    kept = two.join(longer, ["lang", "id"], "left").where(
        F.col("inside").isNull() | (100 * F.col("inside") < cover * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "l", "r").unionByName(three_scored)
    return rows.withColumn("score", _score("a", "l", "r")).join(sizes, "lang").select(
        "lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, limit: int = 2000, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``limit`` phrases."""
    return _best(phrases(docs, **options), limit).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
c AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
    FROM g, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
k AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM c WHERE m > 1),
s AS (SELECT k.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k
    JOIN c l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ')
    JOIN c r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:k.m], ' ')),
b AS (SELECT lang, m, phrase, a, first(l ORDER BY score, k) AS l, first(r ORDER BY score, k) AS r, min(score) AS score FROM s GROUP BY lang, m, phrase, a),
i AS (SELECT lang, part, max(a) AS inside FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part
    FROM k WHERE m = 3 AND k = 1) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i ON b.m = 2 AND i.lang = b.lang AND i.part = b.phrase WHERE inside IS NULL OR 100 * inside < 50 * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""
