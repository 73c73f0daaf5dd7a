"""Mixing sources to target weights.

Each document gets a hash-random key. Documents are put in order of the key
within their source, prefix sums of their sizes are computed, and the source is
cut at its exact budget; a budget above the source's size takes whole epochs
first. The order is never made in one task: the key space of a source is split
into ``buckets`` equal ranges, sizes are summed per range, and a document's
prefix sum is its range's offset plus the sum inside its range. Since keys are
hash-random, ranges of a hot source are even.

Targets: the sources, in order of code points with null last, weigh
``weights[i % len(weights)]`` and share the total of all sizes. A target stops at
``max_epochs`` times its source's size; the excess is shared again by weight.

Defined results: a null text has size 0; a document of size 0 takes no words; a null source is a source of its own; repeated rows are documents of their
own, which take their places one after the other; an empty table gives an empty result; other columns of the
input are ignored by :func:`mix` and kept by :func:`mixed_rows`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, replaced, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: The key space of a source is cut into 2^13 ranges. A range of the hottest
#: source at 10^10 documents still holds under a million narrow rows.
RANGE_BITS = 13


def source_targets(
    sums: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (a row per source).

    Capped sources are those that reach their cap when all are filled at the
    same rate per unit of weight; in order of that rate they form a prefix.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    ranked = sums.withColumn("_i", F.row_number().over(order) - 1)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")
    )
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(max_epochs))
    ranked = ranked.withColumn("_rate", F.col("_cap") / F.col("_w"))
    by_rate = Window.orderBy("_rate", "_i")
    upto = by_rate.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_rate.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.select(
        "*",
        F.sum("_cap").over(upto).alias("_caps"),
        (F.sum("_w").over(whole) - F.sum("_w").over(upto)).alias("_later"),
        F.sum("source_size").over(whole).cast("double").alias("_total"),
    )
    # What all sources take together when filled up to this one's rate.
    capped = F.col("_caps") + F.col("_rate") * F.col("_later") <= F.col("_total")
    ranked = ranked.withColumn("_capped", capped)
    ranked = ranked.select(
        "*",
        F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(whole).alias("_given"),
        F.sum(F.when(~F.col("_capped"), F.col("_w")).otherwise(0.0)).over(whole).alias("_open"),
    )
    share = (F.col("_total") - F.col("_given")) * F.col("_w") / F.col("_open")
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(share, F.col("_cap")))
    return ranked.select("source", "source_size", target.alias("target"))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with ``_size`` and a hash-random ``_key``."""
    size = word_count(F.col("text"))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"), F.col("source"))
    return replaced(docs, {"_size": size, "_key": key})


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    range_bits: int = RANGE_BITS,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, size, source_size, target, epochs, part, taken, key``.

    ``epochs`` whole copies of the document are taken, then its first ``part``
    words; ``taken`` is the number of words of both. ``doc_id`` and ``key``
    together find the document again.
    """
    narrow = materialize(_keyed(docs, seed).select(
        "doc_id",
        # A source that is never null, so that one partitioning serves window and join.
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"),
        F.col("_size").alias("size"),
        F.col("_key").alias("key"),
        F.shiftrightunsigned("_key", 64 - range_bits).cast("int").alias("range"),
    ))
    # A row per source and range: as many as sources times ranges at most.
    ranges = materialize(narrow.groupBy("src", "range").agg(F.sum("size").alias("_sum")))
    sums = ranges.groupBy("src").agg(F.sum("_sum").alias("source_size")).withColumn(
        "source", F.when(F.col("src") != "", F.substring("src", 2, 2**31 - 1))
    )
    targets = source_targets(sums, weights, max_epochs).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), "source_size", "target"
    )
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "src", "range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    ).join(targets, "src")
    inside = Window.partitionBy("src", "range").orderBy("key", "doc_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Joined on source and range, so a hot source is spread over its ranges.
    placed = narrow.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, ["src", "range"]
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - F.col("_offset") - F.col("_inside")
    part = F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size")))
    return placed.select(
        "doc_id", "size", "source_size", "target", epochs.alias("epochs"), part.alias("part"),
        (epochs * F.col("size") + part).alias("taken"), "key",
    )


def mixed_rows(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as they are taken.

    The document at the cut keeps its words inside the budget. Columns are those
    of ``docs``; ``n_chars`` follows the text if it is there. Rows equal in id,
    text and source are taken one after the other, so all but one are whole or
    absent beside their epochs, as in :func:`mix`.
    """
    counts = materialize(mix(docs, seed=seed, **options).groupBy("doc_id", "key").agg(
        F.min("epochs").alias("_epochs"), F.sum("part").alias("_part"), F.count("*").alias("_rows")
    ).where((F.col("_epochs") > 0) | (F.col("_part") > 0)).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_k"), "_epochs", "_part", "_rows"
    ))

    def rows(counts: DataFrame) -> DataFrame:
        return _keyed(docs, seed).join(
            counts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")))

    found, again = rows(counts.where("_rows = 1")), counts.where("_rows > 1")
    if not again.isEmpty():
        whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
        place = F.row_number().over(Window.partitionBy("_id", "_k").orderBy(F.xxhash64(whole))) - 1
        left = F.col("_part") - place * F.col("_size")
        found = found.unionByName(rows(again).withColumn("_part", F.greatest(
            F.lit(0).cast("long"), F.least(left, F.col("_size")))))
    sizes = F.concat(
        F.array_repeat(F.col("_size"), F.col("_epochs").cast("int")),
        F.filter(F.array(F.col("_part")), lambda n: n > 0),
    )
    taken = found.withColumn("_keep", F.explode(sizes))
    pieces = F.split("text", rf"(?<=[^{SPACE}])(?=[{SPACE}])")
    text = F.when(F.col("_keep") == F.col("_size"), F.col("text")).otherwise(
        F.array_join(F.slice(pieces, 1, F.col("_keep").cast("int")), "")
    )
    taken = taken.withColumn("_cut", text)
    own = {"text": F.col("_cut")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("_cut").cast(docs.schema["n_chars"].dataType)
    return taken.select(*[own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
