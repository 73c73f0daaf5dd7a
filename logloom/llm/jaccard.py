"""N-gram Jaccard self-join by token-combination prefixes.

A document's tokens are its distinct word n-grams, as 64-bit hashes. Documents
with equal sets form a class, named by its smallest id, and only classes are
joined. Two classes link when ``100 * intersection >= percent * union``; the
result gives each document the smallest id it reaches by links.

*Prefixes.* A set of ``n`` tokens may miss at most ``t = n - ceil(percent/100 * n)``
of them in a partner. Tokens are ordered rare first, frequent last, by hash
inside. A rare token is indexed by itself; frequent tokens are split into groups
by hash and indexed by pairs inside their group. The prefix is extended until
its rare tokens, plus those of each group less one, number ``t + 1``; then at least
one rare token, or two frequent tokens of one group, of the shorter-reaching
prefix occur in the partner, and so in the partner's prefix. Long sets have more
groups, so that pairs stay few; a set near a limit of size is indexed for both
sides of it. A number of groups is used only from the size on at which a whole set
has enough tokens beside the first of each group; smaller sets have one group, and
below two common tokens their tokens are indexed by themselves. The level of the
smaller set of a pair so suffices for both, at any percent. Sets too small to link
with any other are not indexed.

*Frequent tokens* are counted over all documents. Only tokens in the lowest fifth of
the hashes can be rare, so only those are counted; the others belong to the
frequent class from the start, which is as right (any split is) and last in the
order. Rare tokens occur in fewer than ``RARE`` documents, or than ``share`` of them
in a large corpus: less than ``tokens per document / share`` can then be frequent,
which bounds the list that tasks get whatever the size of the corpus.

*Verification* never takes all pairs of a group of near copies: first each class
is compared with the likeliest of the pivots that share an index entry with it,
and classes that link so get one label. Afterwards only pairs of different labels
that share an entry are compared, all of them. Nothing is capped. A pair meets in one of
its common entries: near copies share nearly all of theirs, so each class names its
smallest entry of each of ``LEADS`` parts of the hashes, and a pair that has one of these
in common meets in the first such. A pair's sets are fetched only if its sketches allow a link: a sketch holds the parities of the
tokens that fall on each of its bits, so the bits in which two sketches differ are
at most the tokens in which the sets differ. Texts that no pair asks for don't move.
In entries of ``CROWD`` rows and more, texts are mostly near copies just beyond the limit;
there the tokens that a set has for itself count in full, sets that have too many of them
leave, and sketches of the rest are ``FINER`` times as large. The pairs whose sets are
fetched are then about those that link; the sketches compared still grow with the square
of such a group.

Defined results: null, empty and blank texts have no tokens, 0 shingles and their
own id; a null id has a null component and links with nothing; repeated rows get
the same result each; ids are taken to name one document (classes with the same
smallest id count as one when links are followed). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sifted

#: Limits of set sizes and numbers of groups of frequent tokens up to them.
LEVELS = ((128, 8), (1024, 32), (8192, 128), (None, 1024))
#: Tokens below this hash, a fifth of all, can be rare; from how many documents they are not.
LOW = -(2**63) + 2**64 // 5
RARE = 8
#: Tokens that a task holds before it sums them up.
BLOCK = 2_000_000
#: Parts of the hashes of which a class names its smallest entry.
LEADS = 8
#: Words of 64 bits in a sketch, powers of two: the least and the most.
SKETCH = (2, 64)
#: Rows from which an entry is crowded, and how many times larger sketches are there.
CROWD = 64
FINER = 4


@dataclass(frozen=True)
class Join:
    """``words`` per n-gram, ``percent`` of the union; ``share`` of the documents from
    which a token is frequent."""

    words: int = 3
    percent: int = 90
    share: float = 1e-5

    def missing(self, n: int) -> int:
        return n - -(-self.percent * n // 100)

    def smallest(self) -> int:
        """Size from which a set can link with a different one."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else 1 << 62

    def levels(self, n: int) -> list[int]:
        """Numbers of groups to index a set of ``n`` tokens for; 0 is for single tokens."""
        low, high = -(-self.percent * n // 100), 100 * n // self.percent
        starts = [(1, 0), (100 // self.percent + 1, 1)]
        first = 0
        for limit, groups in LEVELS:
            groups *= max(1, (100 - self.percent) // 10)  # longer prefixes
            # From here on linked sets have more tokens in common than there are groups.
            starts.append((max(first, 100 * groups // self.percent + 1), groups))
            first = limit
        ends = [start for start, _ in starts[1:]] + [high + 1]
        return [groups for (start, groups), end in zip(starts, ends) if high >= start and low < end]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text.

    Bytes are lower-cased and split by ASCII rules only; a text of fewer than
    ``n`` words is one n-gram.
    """
    from pandas.util import hash_array

    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.int64)
    # All words at once: a dictionary of words, most of them seen once, took longer than hashing.
    w = hash_array(np.array(found, object), categorize=False)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h + w[i:len(w) - k + 1 + i])
    h = np.sort(h.view(np.int64))
    return h[np.append(True, h[1:] != h[:-1])]


def sketch(t: np.ndarray, percent: int = 90, finer: int = 1) -> np.ndarray:
    """Parity of the number of tokens on each bit.

    Sets with nothing in common differ in half of the bits. There are so many bits that
    this is four standard deviations over what linked sets of that size may differ in;
    ``finer`` times as many tell sets just beyond the limit from those within.
    """
    size, most = SKETCH
    allowed = 2 * len(t) * (100 - percent) / (100 + percent)
    while size < most and 32 * size - 16 * size**0.5 < allowed:
        size *= 2
    size *= finer
    at = (_mix(t.view(np.uint64)) % np.uint64(64 * size)).astype(np.int64)
    bits = (np.bincount(at, minlength=64 * size) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def _class(t: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    import xxhash

    d = xxhash.xxh3_128_digest(t.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


_I64 = pa.int64()


def _profiled(docs: DataFrame, join: Join) -> DataFrame:
    """A row per document: id, class, size, sketch."""
    names = ["doc_id", "h1", "h2", "n", "sketch"]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = tokens(text, join.words)
                row = (doc, *_class(t), len(t), sketch(t, join.percent) if len(t) >= join.smallest() else None)
                for column, v in zip(out, row):
                    column.append(v)
            yield _batch(out, [_I64] * 4 + [pa.list_(_I64)], names)

    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", sketch array<long>"
    return docs.mapInArrow(profile, schema)


def _low_counts(docs: DataFrame, join: Join) -> DataFrame:
    """``token, n``: documents per low token, summed within blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def block():
            all_, counts = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(all_), 200_000):
                yield _batch([all_[i:i + 200_000], counts[i:i + 200_000]], [_I64] * 2, ["token", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                t = tokens(text, join.words)
                if len(t) < join.smallest() or (c := _class(t)) in seen:  # copies in a block count once
                    continue
                seen.add(c)
                held.append(t[:np.searchsorted(t, LOW)])
                size += len(held[-1])
                if size >= BLOCK:
                    yield from block()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield from block()

    return docs.select("text").mapInArrow(count, "token long, n long")


def signatures(t: np.ndarray, frequent: np.ndarray, join: Join) -> np.ndarray:
    """Index entries of a set."""
    n = len(t)
    need = join.missing(n) + 1
    often = t >= LOW
    if len(frequent):
        often |= frequent[np.minimum(np.searchsorted(frequent, t), len(frequent) - 1)] == t
    rare, common = t[~often], t[often]
    entries = [_mix(rare[:need].view(np.uint64))]
    need -= len(entries[0])
    if need > 0:
        for groups in join.levels(n):
            if not groups:
                entries.append(_mix(common[:need].view(np.uint64)))
                continue
            group = (_mix(common.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
            # Tokens that are not the first of their group count.
            first = np.zeros(len(common), bool)
            first[np.unique(group, return_index=True)[1]] = True
            counted = np.cumsum(~first)
            end = int(np.searchsorted(counted, need)) + 1
            part, group = common[:end].view(np.uint64), group[:end]
            order = np.argsort(group, kind="stable")
            part, group = part[order], group[order]
            step = 1
            while True:  # pairs of a group's tokens that stand ``step`` apart
                same = group[step:] == group[:-step]
                if not same.any():
                    break
                pair = _mix(part[:-step][same]) + part[step:][same]
                entries.append(_mix(_mix(pair) + np.uint64(groups)))
                step += 1
    return np.concatenate(entries).view(np.int64)


def _indexed(docs: DataFrame, frequent: np.ndarray, join: Join, owner: tuple[str, ...]) -> DataFrame:
    """``entry, n`` and the ``owner``: the document's id (``id``) or its class (``h1, h2``)."""
    names = ["entry", *owner, "n"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            parts, owners, sizes, counts = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = tokens(text, join.words)
                if len(t) < join.smallest():
                    continue
                c = _class(t)
                if c in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(c)
                found = signatures(t, frequent, join)
                parts.append(found)
                owners.append((doc,) if owner == ("id",) else c)
                sizes.append(len(t))
                counts.append(len(found))
            if parts:
                at = np.repeat(np.arange(len(parts)), counts)
                columns = [np.concatenate(parts), *np.array(owners, np.int64)[at].T, np.array(sizes, np.int64)[at]]
                for i in range(0, len(at), 200_000):
                    yield _batch([x[i:i + 200_000] for x in columns], [_I64] * len(names), names)

    return docs.select("doc_id", "text").mapInArrow(index, ", ".join(f"{c} long" for c in names))


def _sets(docs: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """``id, tokens`` of the wanted classes (``id, h1, h2``), from the text of that id."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for i in range(0, b.num_rows, 500):
                ids, found = [], []
                for doc, text, h1, h2 in zip(*[c[i:i + 500] for c in columns]):
                    t = tokens(text, join.words)
                    if _class(t) == (h1, h2):
                        ids.append(doc)
                        found.append(t)
                if ids:
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids, _I64),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), _I64)),
                    ], ["id", "tokens"])

    # Texts that no pair asks for stay where they are.
    asked, _ = sifted(docs, wanted.select("id"))
    texts = asked.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "text", "h1", "h2")
    return texts.mapInArrow(sets, "id long, tokens array<long>")


def _sets_of(ids: DataFrame, docs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    wanted = materialize(classes.join(ids.distinct(), "id", "left_semi").select("id", "h1", "h2"))
    return materialize(_sets(docs, wanted, join))


def _apart(a: Column, b: Column) -> Column:
    """Tokens in which two sets differ at least.

    The halves of a sketch add up to the sketch of half its size; more than that apart in
    size, sketches say nothing.
    """
    def differ(a: Column, b: Column) -> Column:
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)

    def half(c: Column) -> Column:
        size = (F.size(c) / 2).cast("int")
        return F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, size + 1, size), lambda x, y: x.bitwiseXOR(y))

    return F.when(F.size(a) == F.size(b), differ(a, b)).when(F.size(a) == 2 * F.size(b), differ(half(a), b)).when(
        F.size(b) == 2 * F.size(a), differ(a, half(b))).otherwise(0)


def _able(apart: Column, n: Column, m: Column, join: Join) -> Column:
    return apart * (100 + join.percent) <= (n + m) * (100 - join.percent)


def _own(sets: DataFrame) -> DataFrame:
    """``id, own``: the tokens that no other of the sets (``id, tokens``) has."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each token's least and largest id, within blocks."""
        ids, held, size = [], [], 0

        def block():
            t = np.concatenate(held)
            owner = np.repeat(np.array(ids, np.int64), [len(x) for x in held])
            order = np.argsort(t, kind="stable")
            t, owner = t[order], owner[order]
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            columns = [t[first], np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)]
            for i in range(0, len(first), 200_000):
                yield _batch([c[i:i + 200_000] for c in columns], [_I64] * 3, ["token", "least", "most"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                held.append(t.values.to_numpy())
                size += len(held[-1])
                if size >= BLOCK // 4:  # sorting takes some copies
                    yield from block()
                    ids, held, size = [], [], 0
        if size:
            yield from block()

    tokens = sets.mapInArrow(ends, "token long, least long, most long").groupBy("token").agg(
        F.min("least").alias("id"), F.max("most").alias("most"))
    return tokens.where("id = most").groupBy("id").agg(F.collect_list("token").alias("own"))


def _crowded(sets: DataFrame, join: Join) -> DataFrame:
    """``id, own, sketch`` of those of the sets that may link with another of them.

    A set's own tokens, of which only the number is given, tell it from all the others;
    the sketch is of the rest. Sets of which too much is their own are left out.
    """
    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[], [], []]
            for i, t, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                t = t.values.to_numpy()
                left = t[~np.isin(t, own.values.to_numpy())] if own.is_valid else t
                if len(left) * 100 >= join.percent * len(t):
                    for column, v in zip(found, (i, len(t) - len(left), sketch(left, join.percent, FINER))):
                        column.append(v)
            yield _batch(found, [_I64, _I64, pa.list_(_I64)], ["id", "own", "sketch"])

    return sets.join(_own(sets), "id", "left").select("id", "tokens", "own").mapInArrow(
        rest, "id long, own long, sketch array<long>").distinct()


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Those ``x, y`` that link, by their whole sets."""
    pairs = materialize(pairs)
    sets = _sets_of(pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))), docs, classes, join)
    a = sets.select(F.col("id").alias("x"), F.col("tokens").alias("_a"))
    b = sets.select(F.col("id").alias("y"), F.col("tokens").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - both
    return materialize(
        pairs.join(a, "x").join(b, "y").where(both * 100 >= union * join.percent).select("x", "y"))


def _close(n: Column, m: Column, join: Join) -> Column:
    return (n * 100 >= m * join.percent) & (m * 100 >= n * join.percent)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of the nodes of ``x, y``.

    Every node moves to its smallest neighbour, twice over; edges inside a node
    vanish. The rest is the graph of the next round; rounds are about the
    logarithm of a component's size.
    """
    edges = materialize(edges.select("x", "y").where("x <> y").distinct())
    labels = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        move = ends.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("_y")).select(
            "node", F.least("node", "_y").alias("to"))
        move = materialize(move)
        second = move.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        move = materialize(move.join(second, "to").select("node", F.col("_to").alias("to")))
        x = move.select(F.col("node").alias("x"), F.col("to").alias("_x"))
        y = move.select(F.col("node").alias("y"), F.col("to").alias("_y"))
        edges = materialize(edges.join(x, "x").join(y, "y").where("_x <> _y").select(
            F.col("_x").alias("x"), F.col("_y").alias("y")).distinct())
        if labels is None:
            labels = move.select("node", F.col("to").alias("component"))
        else:
            step = move.select(F.col("node").alias("component"), "to")
            labels = labels.join(step, "component", "left").select(
                "node", F.coalesce("to", "component").alias("component"))
        labels = materialize(labels)
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")) if labels is None else labels


def _shared(index: DataFrame, join: Join) -> DataFrame:
    """``index`` without the rows that can link with no other class of their entry.

    Those are the rows of an entry with one class, and those whose next smaller and next
    larger set in the entry are too far in size: all others are farther. Unlike texts that
    share an entry by chance mostly go so, and chance grows faster than the corpus.
    """
    entry = Window.partitionBy("entry")
    index = index.select("*", F.min("id").over(entry).alias("_l"), F.max("id").over(entry).alias("_h")).where("_l <> _h")
    # Only what is left is put in order.
    by_size = entry.orderBy("n")
    index = index.select(
        "entry", "id", "n", F.lag("n").over(by_size).alias("_less"), F.lead("n").over(by_size).alias("_more"))
    near = [F.coalesce(_close(F.col("n"), F.col(c), join), F.lit(False)) for c in ("_less", "_more")]
    return index.where(near[0] | near[1]).select("entry", "id", "n").distinct()


def _met(index: DataFrame, order: list[Column], classes: DataFrame, join: Join) -> DataFrame:
    """``x, y, nx, ny, apart``: classes and the pivots of their entries, the first by each order."""
    pivots = index.groupBy("entry").agg(*[
        F.min(F.struct(o.alias("o"), F.col("id").alias("y"), F.col("n").alias("m"))).alias(f"p{k}")
        for k, o in enumerate(order)])
    named = F.array_distinct(F.array(*[F.struct(f"p{k}.y", f"p{k}.m") for k in range(len(order))]))
    met = index.join(pivots.select("entry", named.alias("p")), "entry").select("id", "n", F.explode("p").alias("p"))
    met = met.where((F.col("id") != F.col("p.y")) & _close(F.col("n"), F.col("p.m"), join)).select(
        F.col("id").alias("x"), "p.y").distinct()
    side = lambda c: classes.select(
        F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    met = met.join(side("x"), "x").join(side("y"), "y")
    return met.select("x", "y", "nx", "ny", _apart(F.col("sx"), F.col("sy")).alias("apart"))


def _with_pivots(index: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Each class with up to six pivots of its index entries, the likeliest to link.

    Entries first name four pivots by hash. What a class is apart from those it
    meets tells how central it is: the text that others were copied from is apart
    from them by their edits only, the copies from each other by the edits of both.
    Entries then name their most central class as one more pivot.
    """
    by_hash = [F.xxhash64(F.lit(seed), "id") for seed in range(1, 5)]
    met = materialize(_met(index, by_hash, classes, join))
    spread = met.groupBy(F.col("x").alias("id")).agg(F.avg(F.col("apart") / F.col("nx")).alias("spread"))
    central = index.join(spread, "id")
    met = met.withColumn("kind", F.lit(0)).unionByName(
        _met(central, [F.col("spread")], classes, join).withColumn("kind", F.lit(1)))
    met = met.where(_able(F.col("apart"), F.col("nx"), F.col("ny"), join))
    # The nearest in each third of the pivots, of either kind.
    third = F.pmod(F.xxhash64("y"), F.lit(3))
    names = [f"p{kind}{k}" for kind in (0, 1) for k in range(3)]
    chosen = met.groupBy("x").agg(*[
        F.min(F.when((F.col("kind") == int(c[1])) & (third == int(c[2])), F.struct("apart", "y"))).alias(c)
        for c in names])
    near = F.array_distinct(F.filter(F.array(*[f"{c}.y" for c in names]), lambda y: y.isNotNull()))
    return chosen.select("x", F.explode(near).alias("y"))


def _across(index: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """All pairs of different labels that share an entry and that may link by their sketches.

    In a crowded entry nearly every two texts are near copies beyond the limit. What
    each has for itself among all texts of such entries, and finer sketches of the rest,
    tell there which pairs may link, so that no sets are fetched for the others.
    """
    members = index.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "entry", "id", "n", F.coalesce("component", "id").alias("label"))
    open_ = members.groupBy("entry").agg(
        F.min("label").alias("_l"), F.max("label").alias("_h"), (F.count("*") >= CROWD).alias("crowd")).where("_l <> _h")
    members = materialize(members.join(open_.select("entry", "crowd"), "entry"))
    part = F.pmod(F.xxhash64("entry"), F.lit(LEADS))
    leads = members.groupBy("id").agg(
        F.array(*[F.min(F.when(part == k, F.col("entry"))) for k in range(LEADS)]).alias("leads"))
    told = classes.select("id", F.lit(0).cast("long").alias("own"), "sketch", F.lit(False).alias("crowd"))
    crowd = members.where("crowd").select("id")
    if not crowd.isEmpty():
        finer = materialize(_crowded(_sets_of(crowd, docs, classes, join), join))
        told = told.unionByName(finer.withColumn("crowd", F.lit(True)))
    members = members.join(leads, "id").join(told, ["id", "crowd"])

    def side(c: str) -> DataFrame:
        return members.select(
            "entry", F.col("id").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("label", "n", "own", "sketch", "leads")])

    a, b = side("x"), side("y")
    n, m, own = F.col("n_x"), F.col("n_y"), F.col("own_x") + F.col("own_y")
    # Where two classes name the same entry, it is common to them, and they meet there alone.
    ex, ey = ([F.get(c, F.lit(k)) for k in range(LEADS)] for c in ("leads_x", "leads_y"))
    place = F.coalesce(*[F.when(e == f, e) for e, f in zip(ex, ey)])
    met = (a["entry"] == b["entry"]) & (F.col("x") < F.col("y")) & (F.col("label_x") != F.col("label_y")) & _close(
        n, m, join) & _able(own, n, m, join) & (F.coalesce(place, a["entry"]) == a["entry"])
    near = _able(own + _apart(F.col("sketch_x"), F.col("sketch_y")), n, m, join)
    return a.join(b, met & near).select("x", "y").distinct()


def linked(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(_profiled(docs, join))
    counts = _low_counts(docs, join).groupBy("token").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= max(RARE, join.share * rows.count())).select("token")
    frequent = np.sort(np.asarray(often.toArrow().column(0).to_numpy(), np.int64))

    classes = materialize(rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("h1", "h2").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    names = classes.select("h1", "h2", "id")
    rows = materialize(rows.join(names, ["h1", "h2"], "left").select("doc_id", "n", "id"))

    # Most documents name their class, so their entries need no more than their id.
    copies = rows.where((F.col("id") != F.col("doc_id")) & (F.col("n") >= join.smallest())).select("doc_id")
    others, first = sifted(docs.where(F.col("doc_id").isNotNull()), copies)
    index = _indexed(first, frequent, join, ("id",)).select("entry", "id", "n").unionByName(
        _indexed(others, frequent, join, ("h1", "h2")).distinct().join(names, ["h1", "h2"]).select("entry", "id", "n"))
    index = materialize(_shared(index, join))

    found = _links(_with_pivots(index, classes, join), docs, classes, join)
    labels = components(found)
    # Links found so far are kept as labels of their nodes.
    more = _links(_across(index, labels, docs, classes, join), docs, classes, join)
    edges = more.unionByName(labels.select(F.col("node").alias("x"), F.col("component").alias("y")))
    reached = components(edges)

    named = rows.join(reached.withColumnRenamed("node", "id"), "id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE
    unnest(list_transform(range(1, greatest(len(ws) - 1, 2)), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS g
    FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g)
    WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach r ON r.x = w.doc_id GROUP BY ALL
"""
