"""Row numbers per stream, and look-back windows, without one task per stream.

A stream may hold a third of all rows, so no window here spans a whole stream.
``pos`` is distinct within its stream, hence a slice of ``SLICE`` consecutive
positions holds at most that many rows: rows are numbered inside slices, and a
running total over the slice sizes (one row per slice) makes the numbers global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 1 << 17
CHUNK = 1 << 14


def with_ordinal(
    df: DataFrame, name: str, stream: str = "stream_id", order: str = "pos", size: int = SLICE
) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in ``order`` within each stream."""
    sliced = df.withColumn("_slice", F.floor(F.col(order) / size).cast("long"))
    earlier = Window.partitionBy(stream).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        sliced.groupBy(stream, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .select(
            stream, "_slice",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        )
    )
    inside = Window.partitionBy(stream, "_slice").orderBy(order)
    return (
        sliced.withColumn("_row", F.row_number().over(inside))
        .join(starts, [stream, "_slice"])
        .withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("long"))
        .select(*df.columns, name)
    )


def with_chunks(df: DataFrame, ordinal: str, lookback: int, size: int = CHUNK) -> DataFrame:
    """Add ``chunk`` and ``own``; rows another chunk looks back on are copied to it.

    A window over (stream, chunk, ...) that looks back at most ``lookback``
    ordinals is then exact on the rows that are ``own``.
    """
    if size < lookback:
        raise ValueError(f"chunks of {size} rows are shorter than the look-back of {lookback}")
    own = F.floor(F.col(ordinal) / size).cast("long")
    seen_by_next = F.col(ordinal) % size >= size - lookback
    chunks = F.when(seen_by_next, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        df.withColumn("chunk", F.explode(chunks))
        .withColumn("own", F.col("chunk") == F.floor(F.col(ordinal) / size))
    )


def in_reach(earlier: Column, here: Column, lookback: int) -> Column:
    """Whether an earlier ordinal exists and is at most ``lookback`` behind."""
    return F.coalesce(earlier >= here - lookback, F.lit(False))
