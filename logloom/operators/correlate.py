"""Request groups and links to recent trouble, as look-back windows.

Both look at the last ``WINDOW`` parsed records of the stream and compare times
that may be missing or out of order. Most rows are settled by running values in
one linear pass. Where that is not enough, the group's recent rows are gathered
and compared, at most ``WINDOW`` of them; groups without such a row are split
into single-row partitions first, so the gathering costs them nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.identity import corr_tag, summarize
from logloom.operators.ordinals import CHUNK, SLICE, in_reach, with_chunks, with_ordinal
from logloom.schema import WARN
from logloom.sources.materialize import materialize

# Records remembered, and the two time spans in microseconds.
WINDOW = 512
GROUP_SPAN_US = 60_000_000
LINK_SPAN_US = 5_000_000

NARROW = ("stream_id", "pos", "ts", "clock", "effective", "text", "template", "corr_key", "method")


def remembered(df: DataFrame, size: int = SLICE) -> DataFrame:
    """The parsed records with ``pn``, their ordinal, and ``us``, their time.

    Only elevated ones keep their text: others are never pointed at.
    """
    narrow = df.filter("parsed").select(*NARROW).withColumn(
        "text", F.when(F.col("effective") >= WARN, F.col("text"))
    )
    return with_ordinal(narrow, "pn", size=size).withColumn("us", F.unix_micros("ts"))


def _close(a: Column, b: Column, span: int) -> Column:
    """Within the span; a missing time does not separate two records."""
    return F.coalesce(F.abs(a - b) <= span, F.lit(True))


def corr_groups(
    records: DataFrame, window: int = WINDOW, span_us: int = GROUP_SPAN_US, chunk: int = CHUNK
) -> DataFrame:
    """``stream_id, pos`` of records whose key was seen in the recent window.

    ``records`` come from ``remembered``.
    """
    keyed = records.filter(F.col("corr_key").isNotNull()).select(
        "stream_id", "pos", "pn", "us", "corr_key"
    )
    group = ["stream_id", "chunk", "corr_key"]
    past = Window.partitionBy(*group).orderBy("pn").rowsBetween(Window.unboundedPreceding, -1)
    step = Window.partitionBy(*group).orderBy("pn")
    pn, us = F.col("pn"), F.col("us")
    seen = with_chunks(keyed, "pn", window, chunk).withColumns(
        {
            "_last": F.lag("pn").over(step),
            "_last_timeless": F.max(F.when(us.isNull(), pn)).over(past),
            "_last_timed": F.last(
                F.when(us.isNotNull(), F.struct("pn", "us")), ignorenulls=True
            ).over(past),
        }
    )
    seen = seen.withColumn(
        "_backward", F.when(us < F.col("_last_timed.us"), pn)
    ).withColumn("_last_backward", F.max("_backward").over(past))
    some = in_reach(F.col("_last"), pn, window)
    timed = in_reach(F.col("_last_timed.pn"), pn, window)
    sure = some & (
        us.isNull()
        | in_reach(F.col("_last_timeless"), pn, window)
        | (timed & _close(F.col("_last_timed.us"), us, span_us))
    )
    # With times rising through the window, the latest one is the closest.
    in_order = (F.col("_last_timed.us") <= us) & ~in_reach(F.col("_last_backward"), pn, window)
    open_ = timed & ~sure & ~F.coalesce(in_order, F.lit(False))
    judged = seen.withColumns({"_sure": sure, "_open": open_})
    gathered = _gather(judged, group, window, F.struct(us.alias("us")))
    hit = F.col("_sure") | (
        F.col("_open") & F.exists("_recent", lambda e: _close(e["us"], us, span_us))
    )
    return gathered.filter(F.col("own") & hit).select("stream_id", "pos", "corr_key")


def _gather(
    df: DataFrame, group: list[str], window: int, entry: Column, only: Column | None = None
) -> DataFrame:
    """Add ``_recent``: entries of the last ``window`` ordinals of the group,
    filled only in groups that have an open row."""
    whole = Window.partitionBy(*group)
    needed = F.max("_open").over(whole)
    split = df.withColumn("_part", F.when(needed, F.lit(-1)).otherwise(F.col("pn")))
    recent = Window.partitionBy(*group, "_part").orderBy("pn").rangeBetween(-window, -1)
    kept = entry if only is None else F.when(only, entry)
    return split.withColumn("_recent", F.collect_list(kept).over(recent))


def related_events(
    records: DataFrame, window: int = WINDOW, span_us: int = LINK_SPAN_US, chunk: int = CHUNK
) -> DataFrame:
    """For each record the latest earlier elevated one of the same method.

    It must be of another template, within ``window`` records and ``span_us``.
    Gives ``stream_id, pos, related``.
    """
    group = ["stream_id", "chunk", "method"]
    keyed = records.filter(F.col("method").isNotNull()).select(
        "stream_id", "pos", "pn", "us", "clock", "effective", "template", "text", "method"
    )
    past = Window.partitionBy(*group).orderBy("pn").rowsBetween(Window.unboundedPreceding, -1)
    pn, us, tmpl = F.col("pn"), F.col("us"), F.col("template")
    elevated = F.col("effective") >= WARN
    entry = F.struct("pn", "pos", "us", "clock", "template", F.col("_summary").alias("summary"))
    seen = (
        with_chunks(keyed, "pn", window, chunk)
        .withColumn("_summary", F.when(elevated, summarize(F.col("text"))))
        .withColumn("_latest", F.last(F.when(elevated, entry), ignorenulls=True).over(past))
        # Before the elevated records of one template came one of another.
        .withColumn(
            "_other",
            F.last(
                F.when(elevated & (F.col("_latest.template") != tmpl), F.col("_latest")),
                ignorenulls=True,
            ).over(past),
        )
        .withColumns(
            {
                "_timeless": F.max(F.when(elevated & us.isNull(), pn)).over(past),
                "_backward": F.max(
                    F.when(elevated & (us < F.col("_latest.us")), pn)
                ).over(past),
            }
        )
        .withColumn(
            "_found",
            F.when(F.col("_latest.template") != tmpl, F.col("_latest")).otherwise(F.col("_other")),
        )
    )
    near = in_reach(F.col("_found.pn"), pn, window)
    sure = near & _close(F.col("_found.us"), us, span_us)
    # Older records are farther away while all times are known and rising.
    settled = (
        (F.col("_latest.us") <= us)
        & ~in_reach(F.col("_timeless"), pn, window)
        & ~in_reach(F.col("_backward"), pn, window)
    )
    judged = seen.withColumns(
        {"_sure": sure, "_open": near & ~sure & ~F.coalesce(settled, F.lit(False))}
    )
    gathered = _gather(judged, group, window, entry, only=elevated)
    match = F.filter(
        "_recent", lambda e: (e["template"] != tmpl) & _close(e["us"], us, span_us)
    )
    found = F.when(F.col("_sure"), F.col("_found")).when(
        F.col("_open"), F.try_element_at(F.array_sort(match), F.lit(-1))
    )
    return (
        gathered.filter("own").withColumn("_hit", found).filter(F.col("_hit").isNotNull())
        .select(
            "stream_id", "pos",
            F.struct(
                F.col("_hit.pos").alias("pos"),
                F.timestamp_micros(F.col("_hit.us")).alias("ts"),
                F.col("_hit.clock").alias("clock"),
                F.col("_hit.summary").alias("summary"),
            ).alias("related"),
        )
    )


def correlate(df: DataFrame, chunk: int = CHUNK, size: int = SLICE) -> DataFrame:
    """Add ``corr`` and ``related`` to identified records.

    Only narrow columns travel through the windows; the records themselves are
    shuffled once, to take up what was found.
    """
    records = materialize(remembered(df, size))
    groups = corr_groups(records, chunk=chunk).select(
        "stream_id", "pos", corr_tag(F.col("corr_key")).alias("corr")
    )
    links = related_events(records, chunk=chunk)
    marks = groups.join(links, ["stream_id", "pos"], "full_outer")
    return df.join(marks, ["stream_id", "pos"], "left").select(*df.columns, "corr", "related")
