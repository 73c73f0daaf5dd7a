"""``constant_fields``: keys that held one value over the recent records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.ordinals import CHUNK, SLICE, in_reach, with_chunks, with_ordinal

# Records looked at, and occurrences needed as evidence.
WINDOW = 256
MIN_SEEN = 3


def constant_fields(
    df: DataFrame, window: int = WINDOW, min_seen: int = MIN_SEEN,
    chunk: int = CHUNK, size: int = SLICE,
) -> DataFrame:
    """``stream_id, pos, i`` of every field that is constant where it stands.

    The window is the last ``window`` records that have fields, this one
    included. A key is constant in it iff its ``min_seen``-th latest occurrence
    is inside and its latest change of value is not. Both follow from the
    neighbours of each occurrence, so the windows only grow and each row costs
    the same however hot the key is.
    """
    with_fields = df.filter(F.col("parsed") & (F.size("fields") > 0)).select(
        "stream_id", "pos", "fields"
    )
    numbered = with_ordinal(with_fields, "fn", size=size)
    chunked = with_chunks(numbered, "fn", window - 1, chunk)
    each = chunked.select(
        "stream_id", "pos", "fn", "chunk", "own", F.posexplode("fields").alias("i", "f")
    ).select("stream_id", "pos", "fn", "chunk", "own", "i", "f.key", "f.val")

    occurrences = Window.partitionBy("stream_id", "chunk", "key").orderBy("fn", "i")
    # RANGE takes in the other occurrences of the key in the same record.
    up_to_record = (
        Window.partitionBy("stream_id", "chunk", "key").orderBy("fn")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.lag("fn").over(occurrences)
    changed = F.lag("val").over(occurrences) != F.col("val")
    judged = (
        each.withColumns(
            {
                "_before_change": F.when(changed, before),
                "_nth_latest": F.lag("fn", min_seen - 1).over(occurrences)
                if min_seen > 1 else F.col("fn"),
            }
        )
        .withColumns(
            {
                "_change": F.max("_before_change").over(up_to_record),
                "_nth": F.max("_nth_latest").over(up_to_record),
            }
        )
        .filter(
            F.col("own")
            & in_reach(F.col("_nth"), F.col("fn"), window - 1)
            & ~in_reach(F.col("_change"), F.col("fn"), window - 1)
        )
    )
    return judged.select("stream_id", "pos", "i")


def demote_constant_fields(
    df: DataFrame, source: DataFrame | None = None, **kw
) -> DataFrame:
    """Set ``demoted`` on the fields that ``constant_fields`` finds.

    ``source`` gives the same records where ``df`` already has joins on top,
    which would be run again to read the fields.
    """
    marks = (
        constant_fields(df if source is None else source, **kw)
        .groupBy("stream_id", "pos")
        .agg(F.collect_list("i").alias("_constant"))
    )
    marked = F.transform(
        "fields", lambda f, i: f.withField("demoted", F.array_contains("_constant", i))
    )
    return (
        df.join(marks, ["stream_id", "pos"], "left")
        .withColumn(
            "fields", F.when(F.col("_constant").isNull(), F.col("fields")).otherwise(marked)
        )
        .select(*df.columns)
    )
