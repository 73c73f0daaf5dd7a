"""Prefix trie of conversations by whole-sequence collapse.

Identical rebuilt conversations become one weighted sequence, with the list of those
that end there. Only one representative of a sequence (its smallest id) is spelled out
into prefixes. Sequences that are proper prefixes of others are dropped by an anti-join;
those that stay are the leaves. Prefixes are then aggregated with the weights.

A turn sequence is known by two 64-bit sums: the exclusive or of hashes of (place, role,
text). Equal prefixes have equal sums, so a prefix needs neither its texts nor the ones
before it, and the sums of a long conversation are taken in slices of ``SLICE`` turns and
shifted by those of the slices before. No task holds a conversation, and texts are never
shuffled behind the first hash.

A conversation belongs to one node per depth, so (smallest member, depth) names a node.
A node's own tokens are counted with the one sequence that names it: suffix sums along
that sequence, then sums over all sequences through a prefix, give subtree totals without
a join by prefix, however many conversations share it. Groups combine before they
shuffle. Ids of a hot sequence are written in blocks of at most ``BLOCK`` ids; the digest of
their list is then taken block by block, as it is defined over one long text.

Defined results: null ``conv_id`` rows are left out; null roles and texts are empty; turns
of equal number are ordered by role and text, repeated rows are turns each; a null turn
comes first. Texts of any length are hashed whole. An empty table has no nodes. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Turns of a slice of a conversation.
SLICE = 256
#: Turns that a conversation may take from the start of another.
SHARED = 8
#: Range of ids whose members of a sequence are written as one block.
BLOCK = 1024
#: Fixed value: digest of the empty list.
NO_ENDS = sha256(b"").hexdigest()

NODE = ["p1", "p2", "depth"]


def _sums(rows: DataFrame, keys: list[str], slot: str, order: list, totals: dict[str, tuple]) -> DataFrame:
    """Running totals per key, ``name: (aggregate, input, of totals, of two, nothing)``, in slices of order.

    ``slot`` numbers a key's slices. Each is summed by itself; keys of several slices then
    take up the totals of the slices before.
    """
    own = Window.partitionBy(*keys, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: agg(x).over(own) for n, (agg, x, *_) in totals.items()})
    first = F.min(slot).over(Window.partitionBy(*keys))
    before = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, slot).agg(*[agg(x).alias(n) for n, (agg, x, *_) in totals.items()])
        .withColumn("_first", first)
        .withColumns({f"_{n}": whole(F.col(n)).over(before) for n, (_, _, whole, *_) in totals.items()})
        .where(F.col(slot) > F.col("_first")).select(*keys, slot, *[f"_{n}" for n in totals])
    )
    joined = local.join(starts, [*keys, slot], "left")
    shifted = {
        n: combine(F.col(n), F.coalesce(f"_{n}", F.lit(nothing))) for n, (_, _, _, combine, nothing) in totals.items()
    }
    return joined.withColumns(shifted).drop(*[f"_{n}" for n in totals])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, j, k1, k2, bytes``: a conversation's turns from 1 on, hashed where they are read."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    # Nulls share the first slice.
    hashed = rows.withColumns({
        "_slot": F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(2**62))).cast("long"),
        "k1": F.xxhash64(F.lit(1), F.octet_length("role"), "role", "text"),
        "k2": F.xxhash64(F.lit(2), F.octet_length("role"), "role", "text"),
        "bytes": F.octet_length("text").cast("long"),
    })
    narrow = materialize(hashed.drop("role", "text"))
    place = ["conv_id", "_slot", "turn"]
    several = narrow.groupBy(*place).count().where("count > 1").select(*place)
    tie = F.lit(0)
    if not several.isEmpty():
        # Only turns of equal number need their texts for the order.
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in place]
        tied = hashed.alias("l").join(several.alias("r"), same, "left_semi").distinct().withColumn(
            "tie", F.row_number().over(Window.partitionBy(*place).orderBy("role", "text")))
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*place, "k1", "k2")]
        narrow = narrow.alias("l").join(tied.alias("r"), same, "left").select("l.*", "r.tie")
        tie = F.col("tie")
    one = {"j": (F.count, F.lit(1), F.sum, _plus, 0)}
    return _sums(narrow, ["conv_id"], "_slot", [F.col("turn").asc_nulls_first(), tie], one).select(
        "conv_id", "j", "k1", "k2", "bytes")


def rebuilt(numbered: DataFrame, group: int = 5, cut: int = SHARED + 1) -> DataFrame:
    """``conv_id, i, k1, k2, bytes``: every conversation with its group's first turns.

    The first ``h = crc32(id) % cut`` turns come from conversation ``id - id % group``, the
    others are its own behind its first ``h``. A conversation without any turn left has one
    row with a null ``i``.
    """
    c = F.col("conv_id")
    turn = F.struct("j", "k1", "k2", "bytes")
    # Fewer than ``cut`` turns a conversation.
    heads = numbered.where(F.col("j") <= max(cut - 1, 1)).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("head"))
    taken = (F.crc32(c.cast("string").cast("binary")) % cut).cast("int")
    lent = heads.select(F.col("conv_id").alias("_base"), "head")
    every = heads.select("conv_id", (c - c % group).alias("_base")).join(lent, "_base", "left").select(
        "conv_id", taken.alias("h"), F.coalesce("head", F.array().cast(lent.schema["head"].dataType)).alias("head"))
    every = every.withColumn("head", F.slice("head", F.lit(1), F.col("h")))
    starts = every.select("conv_id", F.explode_outer("head").alias("t")).select(
        "conv_id", F.col("t.j").alias("i"), "t.k1", "t.k2", "t.bytes")
    own = numbered.join(every.select("conv_id", "h", F.size("head").alias("m")), "conv_id").where(F.col("j") > F.col("h"))
    rest = own.select("conv_id", (F.col("j") - F.col("h") + F.col("m")).alias("i"), "k1", "k2", "bytes")
    return starts.unionByName(rest)


def _prefixes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``p1, p2``: what names the turns up to ``i``."""
    placed = rows.withColumns({
        "_slot": F.floor((F.col("i") - 1) / SLICE),
        "_x1": F.xxhash64(F.lit(3), "i", "k1", "k2"), "_x2": F.xxhash64(F.lit(4), "i", "k2", "k1"),
    })
    totals = {p: (F.bit_xor, F.col(x), F.bit_xor, _xor, 0) for p, x in (("p1", "_x1"), ("p2", "_x2"))}
    return _sums(placed, keys, "_slot", ["i"], totals).drop("_slot", "_x1", "_x2")


def sequences(rows: DataFrame) -> DataFrame:
    """``conv_id, p1, p2, depth``: the whole sequence of every rebuilt conversation."""
    x1, x2 = F.xxhash64(F.lit(3), "i", "k1", "k2"), F.xxhash64(F.lit(4), "i", "k2", "k1")
    has = F.col("i").isNotNull()
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.bit_xor(F.when(has, x1)), F.lit(0)).alias("p1"),
        F.coalesce(F.bit_xor(F.when(has, x2)), F.lit(0)).alias("p2"),
        F.count("i").alias("depth"))


def ends(whole: DataFrame, repeated: DataFrame) -> DataFrame:
    """``p1, p2, depth, ends_sha256`` of the sequences in ``repeated``: digests of all ids that end there."""
    block = F.floor(F.col("conv_id") / BLOCK).alias("block")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    blocks = whole.groupBy(*NODE, block).agg(F.array_join(ids, ",").alias("ids"))
    blocks = blocks.join(repeated.select(*NODE), NODE, "left_semi")
    names = [*NODE, "ends_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def made():
            return pa.RecordBatch.from_arrays([
                *[pa.array([k], pa.int64()) for k in key], pa.array([state.hexdigest()])], names)

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if row[:3] != key:
                    if key is not None:
                        yield made()
                    key, state = row[:3], sha256()
                else:
                    state.update(b",")
                state.update(row[3].encode())
        if key is not None:
            yield made()

    dealt = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return dealt.mapInArrow(digest, "p1 long, p2 long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, group: int = 5, cut: int = SHARED + 1) -> DataFrame:
    """A row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows = materialize(rebuilt(materialize(turns(conversations)), group, cut))
    whole = materialize(sequences(rows))
    weighted = materialize(whole.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")))

    # Every prefix of every distinct sequence, once; the root has no text.
    spelled = rows.where("i is not null").join(weighted.select("conv_id"), "conv_id", "left_semi")
    proper = _prefixes(spelled, ["conv_id"]).select("conv_id", F.col("i").alias("depth"), "p1", "p2", "bytes")
    zero = F.lit(0).cast("long")
    roots = weighted.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("bytes"))
    # The node above: the sums without this turn's part.
    paths = materialize(proper.unionByName(roots))
    inner = paths.join(weighted.select("conv_id", F.col("depth").alias("length")), "conv_id").where("depth < length")
    leaves = weighted.join(inner.select(*NODE).distinct(), NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    carried = weighted.select("conv_id", "n").join(leaves, "conv_id", "left")
    carried = materialize(carried.select("conv_id", "n", F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")))

    nodes = materialize(
        paths.join(carried, "conv_id").groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
            F.max("bytes").alias("bytes")))

    # A node's tokens count with the sequence that names it, there from its place to the start.
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    named = nodes.select("conv_id", "depth", saved.alias("own"))
    counted = paths.select("conv_id", *NODE).join(named, ["conv_id", "depth"], "left").withColumns({
        "own": F.coalesce("own", F.lit(0)), "_slot": F.floor(-F.col("depth") / SLICE)})
    below = _sums(counted, ["conv_id"], "_slot", [F.col("depth").desc()], {
        "below": (F.sum, F.col("own"), F.sum, _plus, 0)})
    totals = below.groupBy(*NODE).agg(F.sum("below").alias("saved_tokens"))

    # The node above a named one lies on the same sequence.
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("p1").alias("u1"), F.col("p2").alias("u2"))
    linked = nodes.join(above, ["conv_id", "depth"], "left")
    upper = nodes.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), (F.col("depth") + 1).alias("depth"),
                         F.col("conv_id").alias("parent_conv_id"))
    linked = linked.join(upper, ["u1", "u2", "depth"], "left")
    children = linked.where("depth > 0").groupBy(
        F.col("u1").alias("p1"), F.col("u2").alias("p2"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))

    repeated = weighted.where("n > 1")
    alone = weighted.where("n = 1").select(*NODE, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    ended = alone.unionByName(ends(whole, repeated))
    return (
        linked.join(children, NODE, "left").join(totals, NODE).join(ended, NODE, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    )


#: crc32 of a short ASCII text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda u, k: xor(u >> 1, 3988292384::BIGINT * (u & 1)))), 4294967295::BIGINT)"""
SQL = f"""
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM t),
h AS (SELECT c, c - c % 5 AS b, {_CRC} % 9 AS h FROM ids),
m AS (SELECT h.c, any_value(h.b) AS b, any_value(h.h) AS h, count(t.j) AS m FROM h LEFT JOIN t ON t.c = h.b AND t.j <= h.h GROUP BY h.c),
r AS (SELECT m.c, t.j AS i, t.role, t.text FROM m JOIN t ON t.c = m.b AND t.j <= m.h
    UNION ALL SELECT m.c, t.j - m.h + m.m, t.role, t.text FROM m JOIN t ON t.c = m.c AND t.j > m.h),
w AS (SELECT ids.c, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY r.i) FILTER (r.i IS NOT NULL), []) AS s FROM ids LEFT JOIN r ON r.c = ids.c GROUP BY ids.c),
p AS (SELECT c, len(s) AS n, s, unnest(range(len(s) + 1)) AS d FROM w),
k AS (SELECT c, d, n, s[1:d] AS s, CASE WHEN d > 0 THEN s[1:d - 1] END AS up FROM p),
nodes AS (SELECT d, s, any_value(up) AS up, min(c) AS c, count(*) AS n_convs,
    CASE WHEN d > 0 THEN strlen(s[d].text) ELSE 0 END AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM k GROUP BY d, s),
kids AS (SELECT d - 1 AS d, up AS s, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.s = nodes.s),
sub AS (SELECT e, s[1:e] AS s, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
    FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_nodes) GROUP BY ALL)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, u.c AS parent_conv_id, f.n_convs, f.n_children, sub.n_leaves::BIGINT AS n_leaves,
    sub.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN sub ON sub.e = f.d AND sub.s = f.s LEFT JOIN nodes u ON u.d = f.d - 1 AND u.s = f.up
"""
