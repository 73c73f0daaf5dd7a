"""Triage summary per stream: counts by severity, time span, top templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.render import report_text
from logloom.schema import DEBUG, ERROR, INFO, UNKNOWN, WARN
from logloom.sources.materialize import materialize

# Templates tracked per stream, and lines shown per level.
TRACKED = 64
SHOWN = 8


def narrowed(df: DataFrame) -> DataFrame:
    """What the summary needs of each record; texts of warnings and errors only.

    Clocks travel as seconds of the day.
    """
    parsed = F.col("parsed")
    clock = F.split("clock", ":")
    second = (
        F.get(clock, F.lit(0)).cast("int") * 3600
        + F.get(clock, F.lit(1)).cast("int") * 60
        + F.get(clock, F.lit(2)).cast("int")
    )
    at = F.when(parsed & F.col("ts").isNotNull(), F.col("pos"))
    failed = parsed & (F.col("effective") >= WARN)
    columns = set(df.columns)
    own = {c: F.when(failed, F.col(c)) if c in columns else F.lit(None).cast("string")
           for c in ("template", "text")}
    return df.select("stream_id", "parsed", "effective", "ts", "pos", at.alias("at"), second.alias("second"),
                     own["template"].alias("template"), own["text"].alias("text"))


def tallies(narrow: DataFrame) -> DataFrame:
    """One row per stream, level and, for warnings and errors, template, from :func:`narrowed`.

    All parts of the summary follow from it but the texts, which :func:`with_text` fetches
    for the few that are shown: so all that is kept per group is of fixed width, and Spark
    aggregates by hash. ``first_at`` and ``last_at`` are the positions of the first and last
    record with a time.
    """
    return narrow.groupBy("stream_id", "parsed", "effective", "template").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.min_by("ts", "at").alias("first_ts"), F.max_by("ts", "at").alias("last_ts"),
        F.min_by("second", "at").alias("first_s"), F.max_by("second", "at").alias("last_s"),
    )


def with_text(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """Adds ``text``: that of the record at ``first_pos``."""
    texts = narrow.where(F.col("template").isNotNull()).select(
        "stream_id", F.col("pos").alias("first_pos"), "text")
    return rows.join(texts, ["stream_id", "first_pos"], "left").select(*rows.columns, "text")


def _counts(found: DataFrame) -> DataFrame:
    """Tallies by severity, and the span, of each stream."""
    parsed, level = F.col("parsed"), F.col("effective")

    def total(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))

    def two(c: Column) -> Column:
        return F.lpad(c.cast("int").cast("string"), 2, "0")

    def clock_text(s: str) -> Column:
        c = F.col(s)
        text = F.concat_ws(":", two(F.floor(c / 3600)), two(F.floor(c / 60) % 60), two(c % 60))
        return F.when(c.isNotNull(), text)

    return (
        found.groupBy("stream_id")
        .agg(
            total(parsed & (level == ERROR)).alias("errors"),
            total(parsed & (level == WARN)).alias("warns"),
            total(parsed & level.isin(INFO, DEBUG)).alias("infos"),
            total(parsed & (level == UNKNOWN)).alias("unknown"),
            total(~parsed).alias("passthrough"),
            F.min_by("first_ts", "first_at").alias("first_ts"),
            F.max_by("last_ts", "last_at").alias("last_ts"),
            F.min_by("first_s", "first_at").alias("_first"),
            F.max_by("last_s", "last_at").alias("_last"),
        )
        .withColumns(
            {"first_clock": clock_text("_first"), "last_clock": clock_text("_last")}
        )
        .drop("_first", "_last")
    )


def summary_counts(df: DataFrame) -> DataFrame:
    """One row per stream: tallies by effective level and the time span.

    The span runs from the first to the last record that has a time, in stream
    order.
    """
    return _counts(tallies(narrowed(df.select("stream_id", "pos", "parsed", "effective", "ts", "clock"))))


def _templates(found: DataFrame) -> DataFrame:
    # A template names its level, so it has one row per stream.
    return found.filter(F.col("parsed") & (F.col("effective") >= WARN)).select(
        "stream_id", "template", F.col("effective").alias("level"), "n", "first_pos")


def template_counts(df: DataFrame) -> DataFrame:
    """Warnings and errors per template: level, count, first text and position.

    They are written once, narrow: counted by hash, and read again for the first texts.
    """
    failed = materialize(
        df.filter(F.col("parsed") & (F.col("effective") >= WARN))
        .select("stream_id", "pos", "effective", "template", "text"))
    counts = failed.groupBy("stream_id", "template").agg(
        F.max("effective").alias("level"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    return with_text(counts, failed)


def tracked_templates(counts: DataFrame, cap: int | None = TRACKED) -> DataFrame:
    """The first ``cap`` templates of each stream, by first appearance."""
    if cap is None:
        return counts
    seen = Window.partitionBy("stream_id").orderBy("first_pos")
    return (
        counts.withColumn("_seen", F.row_number().over(seen))
        .filter(F.col("_seen") <= cap).drop("_seen")
    )


def template_totals(counts: DataFrame, cap: int | None = TRACKED) -> DataFrame:
    """Per stream: distinct tracked templates by level, and untracked records."""
    # The few tracked templates count negative against the total of all.
    tracked = tracked_templates(counts, cap).select("stream_id", "level", "n", F.lit(1).alias("t"))
    every = counts.select("stream_id", "level", "n", F.lit(0).alias("t"))
    own = F.col("t") == 1
    return (
        every.unionByName(tracked)
        .groupBy("stream_id")
        .agg(
            F.count_if(own & (F.col("level") == ERROR)).alias("unique_errors"),
            F.count_if(own & (F.col("level") == WARN)).alias("unique_warns"),
            F.sum(F.when(own, -F.col("n")).otherwise(F.col("n"))).alias("untracked"),
        )
    )


def top_templates(
    counts: DataFrame, cap: int | None = TRACKED, shown: int = SHOWN
) -> DataFrame:
    """The ``shown`` most frequent tracked templates per stream and level."""
    often = Window.partitionBy("stream_id", "level").orderBy(F.desc("n"), "first_pos")
    return (
        tracked_templates(counts, cap)
        .withColumn("rank", F.row_number().over(often))
        .filter(F.col("rank") <= shown)
        .select("stream_id", "level", "rank", "n", "first_pos",
                *[c for c in ("text", "template") if c in counts.columns])
    )


def summary_report(
    df: DataFrame, cap: int | None = TRACKED, shown: int = SHOWN
) -> DataFrame:
    """``stream_id, report``: the summary as text, one row per stream.

    Lines are decoded once: narrow records are written, and tallies of them feed counts,
    totals and top lines. Only the top lines' texts are fetched from the records.
    """
    narrow = materialize(narrowed(df))
    found = materialize(tallies(narrow))
    counts = _templates(found)
    tops = with_text(top_templates(counts, cap, shown), narrow)
    return report_of(found, tops, template_totals(counts, cap), shown)


def report_of(found: DataFrame, tops: DataFrame, totals: DataFrame, shown: int) -> DataFrame:
    """The report from tallies, top templates with their texts, and totals."""
    listed = tops.groupBy("stream_id").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("level")).alias("order"), "rank", "n", "text"))
        ).alias("top")
    )
    return (
        _counts(found)
        .join(totals, "stream_id", "left")
        .join(listed, "stream_id", "left")
        .select("stream_id", report_text(shown).alias("report"))
    )
