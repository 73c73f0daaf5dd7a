"""Folding of repeated events into runs.

``fold_islands``: a run is a chain of same-template records, each at most ten
parsed records after the one before. ``fold_session`` ends a run by event time, also by its length if asked. The
stream fold proper, which also bounds the number of open runs, is in ``runs``.
Passthrough records end every run in it and in islands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.ordinals import CHUNK, SLICE, in_reach, with_chunks, with_ordinal
from logloom.operators.runs import FOLD_WINDOW
from logloom.sources.materialize import materialize

# How long a paused and a busy run may be held back.
IDLE = "750 milliseconds"
IDLE_MS = 750
#: Idle times in a time slice of the batch form of ``fold_session``.
SESSION_SLICES = 1024
MAX_HOLD_MS = 3_000

RUN_COLUMNS = ("stream_id", "head_pos", "last_pos", "repeat", "template")


def _numbered(df: DataFrame, size: int) -> DataFrame:
    """All records with ``q``, their ordinal; ``template`` is NULL on passthrough."""
    narrow = df.select(
        "stream_id", "pos", F.when(F.col("parsed"), F.col("template")).alias("template")
    )
    return with_ordinal(narrow, "q", size=size)


def fold_islands(
    df: DataFrame, gap: int = FOLD_WINDOW, chunk: int = CHUNK, size: int = SLICE
) -> DataFrame:
    """Runs by the gap rule alone: ``stream_id, head_pos, last_pos, repeat, template``.

    Each chunk folds its own records; only islands that touch a chunk's edge are
    then linked across chunks, at most two per template and chunk.
    """
    records = _numbered(df, size)
    # One look-back reaches the previous parsed records and the last reset.
    order = Window.partitionBy("stream_id", "chunk").orderBy("q")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Parsed records between two of a template: passthrough ones reset anyway,
    # so inside a segment the ordinals of all records count the parsed ones.
    chunked = with_chunks(records, "q", gap, chunk).withColumn(
        "_reset", F.max(F.when(F.col("template").isNull(), F.col("q"))).over(upto)
    )
    same = Window.partitionBy("stream_id", "chunk", "template").orderBy("q")
    before = F.lag("q").over(same)
    joins = in_reach(before, F.col("q"), gap) & ~F.coalesce(before < F.col("_reset"), F.lit(False))
    marked = chunked.filter(F.col("template").isNotNull()).withColumn("_joins", joins)
    own = Window.partitionBy("stream_id", "chunk", "template").orderBy("q").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = (
        marked.filter("own")
        .withColumn("_island", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(own))
        .groupBy("stream_id", "chunk", "template", "_island")
        .agg(
            F.min("pos").alias("head_pos"), F.max("pos").alias("last_pos"),
            F.count(F.lit(1)).alias("repeat"),
        )
    )
    # Island 0 goes on from the chunk before; the last one may go on after it.
    last = F.max("_island").over(Window.partitionBy("stream_id", "chunk", "template"))
    edged = local.withColumn("_edge", (F.col("_island") == 0) | (F.col("_island") == last))
    chain = Window.partitionBy("stream_id", "template").orderBy("chunk", "_island").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    linked = (
        edged.filter("_edge")
        .withColumn("_run", F.sum(F.when(F.col("_island") == 0, 0).otherwise(1)).over(chain))
        .groupBy("stream_id", "template", "_run")
        .agg(
            F.min("head_pos").alias("head_pos"), F.max("last_pos").alias("last_pos"),
            F.sum("repeat").alias("repeat"),
        )
    )
    inner = edged.filter(~F.col("_edge"))
    return inner.select(*RUN_COLUMNS).unionByName(linked.select(*RUN_COLUMNS))


def _sessions(timed: DataFrame, idle: str, *keys: str) -> DataFrame:
    return (
        timed.groupBy("stream_id", "template", *keys, F.session_window("ts", idle).alias("_w"))
        .agg(
            F.min("pos").alias("head_pos"), F.max("pos").alias("last_pos"),
            F.count(F.lit(1)).alias("repeat"),
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        )
    )


def fold_session(
    df: DataFrame, idle: str = IDLE, slices: int = SESSION_SLICES, hold: str | None = None
) -> DataFrame:
    """Runs by event time: a template's run ends after ``idle`` without a record.

    Also runs on a watermarked stream. Records without a time are left out. In
    batch, time is cut into slices of ``slices`` times the idle time, so that a
    template that most of a stream consists of is spread over many tasks; runs
    that reach the edge of their slice are joined across it afterwards.

    With ``hold``, in batch, a run that goes on is also cut every ``hold`` from its
    first record, so that none lasts that long and a storm shows at least so often.
    """
    timed = df.filter(F.col("parsed") & F.col("ts").isNotNull())
    columns = [*RUN_COLUMNS, "first_ts", "last_ts"]
    if df.isStreaming:
        if hold:
            raise ValueError("on a stream, fold_stream holds runs by time")
        return _sessions(timed, idle).select(*columns)
    gap = _micros(idle)
    width = gap * slices
    if hold:
        return _held(timed, gap, width, _micros(hold)).select(*columns)
    us = F.unix_micros("ts")
    parts = _sessions(timed.withColumn("_slice", F.floor(us / width)), idle, "_slice")
    # A run can go on beyond its slice only from within ``idle`` of the edge.
    first, last = F.unix_micros("first_ts"), F.unix_micros("last_ts")
    edged = parts.withColumn(
        "_edge", (first - F.col("_slice") * width <= gap) | ((F.col("_slice") + 1) * width - last <= gap))
    chain = Window.partitionBy("stream_id", "template").orderBy("first_ts", "head_pos")
    before = F.lag(last).over(chain)
    joined = (
        edged.filter("_edge")
        .withColumn("_new", F.when(first - before <= gap, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("stream_id", "template", "_run")
        .agg(
            F.min("head_pos").alias("head_pos"), F.max("last_pos").alias("last_pos"),
            F.sum("repeat").alias("repeat"), F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
    )
    return edged.filter("not _edge").select(*columns).unionByName(joined.select(*columns))


def _held(timed: DataFrame, gap: int, width: int, hold: int) -> DataFrame:
    """Sessions cut every ``hold``; only where a slice is entered amid one is its start looked up."""
    keys = ["stream_id", "template", "_slice"]
    us = F.unix_micros("ts")
    here = Window.partitionBy(*keys).orderBy("_us", "pos")
    # Read twice below, so what the lines are parsed into is written, narrow, first.
    narrow = materialize(timed.select("stream_id", "template", "pos", us.alias("_us")))
    rows = (
        narrow.withColumn("_slice", F.floor(F.col("_us") / width))
        .withColumn("_first", F.when(F.col("_us") - F.lag("_us").over(here) <= gap, None).otherwise(F.col("_us")))
        .withColumn("_start", F.max("_first").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # A row for each slice: how it begins and ends. Starts pass through slices without a break.
    chain = Window.partitionBy("stream_id", "template").orderBy("_slice")
    entered = (
        rows.groupBy(*keys)
        .agg(F.min("_us").alias("_a"), F.max("_us").alias("_z"), F.max("_start").alias("_last"))
        .withColumn("_joined", F.coalesce(F.col("_a") - F.lag("_z").over(chain) <= gap, F.lit(False)))
        .withColumn("_left", F.when(~F.col("_joined") | (F.col("_last") > F.col("_a")), F.col("_last")))
        .withColumn("_from", F.last("_left", True).over(chain.rowsBetween(Window.unboundedPreceding, -1)))
        .filter("_joined").select(*keys, "_a", "_from")
    )
    begun = F.when(F.col("_start") == F.col("_a"), F.col("_from")).otherwise(F.col("_start"))
    return (
        rows.join(entered, keys, "left").withColumn("_start", begun)
        .groupBy("stream_id", "template", "_start", F.floor((F.col("_us") - F.col("_start")) / hold).alias("_part"))
        .agg(
            F.min("pos").alias("head_pos"), F.max("pos").alias("last_pos"),
            F.count(F.lit(1)).alias("repeat"),
            F.timestamp_micros(F.min("_us")).alias("first_ts"), F.timestamp_micros(F.max("_us")).alias("last_ts"),
        )
    )


def _micros(span: str) -> int:
    """Microseconds of a span such as ``750 milliseconds``."""
    number, unit = span.split()
    scale = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6,
             "hour": 3600 * 10**6, "day": 86400 * 10**6}
    return int(float(number) * scale[unit.rstrip("s")])


def fold(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Keep run heads, with ``repeat``, and the passthrough records.

    As in the stream, an unfolded record has ``repeat`` 0 and a lone run 1.
    """
    heads = runs.select("stream_id", F.col("head_pos").alias("pos"), "repeat")
    return (
        df.join(heads, ["stream_id", "pos"], "left")
        .filter(~F.col("parsed") | F.col("repeat").isNotNull())
        .withColumn("repeat", F.coalesce("repeat", F.lit(0).cast("long")))
    )


