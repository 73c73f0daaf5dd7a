"""Windowed summaries and sessions over event time.

Only a record's own time moves event time. Records without a time, and those whose
format gives no year (they are read as of the year 2000), are summed by time of
arrival instead, apart from the others: one of them must neither lift the
watermark past older records nor be late itself. :func:`split_timed` makes the two
parts; each is summed in a query of its own, and their results are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from logloom.operators.fold import IDLE, fold_session
from logloom.operators.summary import (
    SHOWN,
    TRACKED,
    narrowed,
    report_of,
    tallies,
    top_templates,
    with_text,
)
from logloom.schema import DEBUG, ERROR, INFO, UNKNOWN, WARN
from logloom.sources.materialize import materialize
from logloom.sources.sinks import write_stream

#: Formats whose times have no year.
YEARLESS = ("glog",)


def split_timed(df: DataFrame, delay: str = "1 minute") -> tuple[DataFrame, DataFrame]:
    """Records with a full time, and all others; both with ``at`` and ``timed``.

    ``at`` is the record's time, or its arrival; each part has a watermark on it. Arrival is
    when the batch is read, so a batch that runs again may count it in another window.
    """
    full = F.col("ts").isNotNull() & ~F.coalesce(F.col("format").isin(*YEARLESS), F.lit(False))
    own = df.filter(full).withColumns({"at": F.col("ts"), "timed": F.lit(True)})
    rest = df.filter(~full).withColumns({"at": F.current_timestamp(), "timed": F.lit(False)})
    return own.withWatermark("at", delay), rest.withWatermark("at", delay)


def live_counts(df: DataFrame, window: str = "1 minute") -> DataFrame:
    """Tallies by effective level per stream and window, of a part of ``split_timed``."""
    parsed, level = F.col("parsed"), F.col("effective")
    return (
        df.groupBy(F.window("at", window).alias("w"), "timed", "stream_id")
        .agg(
            F.count_if(parsed & (level == ERROR)).alias("errors"),
            F.count_if(parsed & (level == WARN)).alias("warns"),
            F.count_if(parsed & level.isin(INFO, DEBUG)).alias("infos"),
            F.count_if(parsed & (level == UNKNOWN)).alias("unknown"),
            F.count_if(~parsed).alias("passthrough"),
        )
        .select(F.col("w.start").alias("start"), "timed", "stream_id", "errors", "warns", "infos",
                "unknown", "passthrough")
    )


def live_templates(df: DataFrame, window: str = "1 minute") -> DataFrame:
    """Warnings and errors per template, stream and window, of a part of ``split_timed``.

    ``first_pos`` says where the first text is; what state holds is of fixed width.
    """
    return (
        df.filter(F.col("parsed") & (F.col("effective") >= WARN))
        .groupBy(F.window("at", window).alias("w"), "timed", "stream_id", "template")
        .agg(
            F.max("effective").alias("level"), F.count(F.lit(1)).alias("n"),
            F.min("pos").alias("first_pos"),
        )
        .select(F.col("w.start").alias("start"), "timed", "stream_id", "template", "level", "n",
                "first_pos")
    )


def live_sessions(df: DataFrame, delay: str = "1 minute", idle: str = IDLE) -> DataFrame:
    """Runs by event time, emitted once the watermark has passed their end."""
    return fold_session(df.withWatermark("ts", delay), idle)


def write_live(
    parts: tuple[DataFrame, DataFrame], path: str, checkpoint: str, **options
) -> list[StreamingQuery]:
    """Start a query per part; what windows end with goes to ``path/timed`` and ``path/untimed``.

    With ``available_now`` the input is read to its end. Windows that the watermark
    has not passed by then stay in the checkpoint and come with the next run.
    """
    return [
        write_stream(part, f"{path}/{name}", f"{checkpoint}/{name}", **options)
        for part, name in zip(parts, ("timed", "untimed"), strict=True)
    ]


def upserted(rows: DataFrame, batch: int, path: str) -> None:
    """Write a batch of an updating result; later batches replace its windows.

    For ``foreachBatch`` in update mode; :func:`latest` reads what stands. A batch
    that runs again overwrites what it wrote before.
    """
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(
        f"{path}/batch={batch:012d}")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key of an updating result."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def _batch(path: str, batch: int) -> str:
    return f"{path}/batch={batch:012d}"


def merge_report(records: DataFrame, batch: int, path: str, cap: int = TRACKED) -> None:
    """Take a batch of enriched records into the report's state, for ``foreachBatch``.

    A state is a table of bounded size a stream: tallies by level, and per template for the
    first ``cap`` templates that the stream met. Warnings and errors of other templates
    stay in the tally of their level. It is the state of the batch before plus the batch's
    own tallies, which Spark combines in parallel, and is written beside it: a batch that
    runs again writes the same again. Templates of one batch count as met by position.
    """
    spark = records.sparkSession
    narrow = materialize(narrowed(records))
    found = with_text(tallies(narrow), narrow).withColumn("tracked", F.lit(False))
    if batch:
        found = found.unionByName(spark.read.parquet(_batch(path, batch - 1)))
    keys = ["stream_id", "parsed", "effective"]
    spans = [
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.min_by("first_ts", "first_at").alias("first_ts"), F.max_by("last_ts", "last_at").alias("last_ts"),
        F.min_by("first_s", "first_at").alias("first_s"), F.max_by("last_s", "last_at").alias("last_s"),
    ]
    every = materialize(found.groupBy(*keys, "template").agg(
        F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"), F.min_by("text", "first_pos").alias("text"),
        *spans, F.max("tracked").alias("tracked")))
    met = Window.partitionBy("stream_id").orderBy(F.desc("tracked"), "first_pos", "template")
    kept = (
        every.where(F.col("parsed") & (F.col("effective") >= WARN) & F.col("template").isNotNull())
        .withColumn("_met", F.row_number().over(met)).where(F.col("_met") <= cap)
        .drop("_met").withColumn("tracked", F.lit(True))
    )
    # The tracked ones count negative against the total of all.
    signed = every.select(*every.columns, F.col("n").alias("m")).unionByName(
        kept.select(*kept.columns, (-F.col("n")).alias("m")))
    rest = signed.groupBy(*keys).agg(
        F.sum("m").alias("n"), F.min("first_pos").alias("first_pos"), *spans,
    ).withColumns({"template": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "tracked": F.lit(False)})
    state = kept.unionByName(rest.select(*kept.columns))
    state.write.mode("overwrite").parquet(_batch(path, batch))


def live_report(spark: SparkSession, path: str, shown: int = SHOWN) -> DataFrame:
    """``stream_id, report``: the summary as of the last batch."""
    rows = spark.read.option("basePath", path).parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    # A batch id is a partition value, hence a number.
    state = spark.read.parquet(_batch(path, int(last or 0)))
    tracked = state.where("tracked")
    templates = tracked.select("stream_id", "template", F.col("effective").alias("level"), "n", "first_pos", "text")
    level, own = F.col("effective"), F.col("tracked")
    failed = F.col("parsed") & (level >= WARN)
    totals = state.groupBy("stream_id").agg(
        F.count_if(own & (level == ERROR)).alias("unique_errors"), F.count_if(own & (level == WARN)).alias("unique_warns"),
        F.coalesce(F.sum(F.when(failed & ~own, F.col("n"))), F.lit(0)).alias("untracked"))
    return report_of(state, top_templates(templates, None, shown), totals, shown)


def split_late(rows: DataFrame, batch: int, path: str, delay: str, at: str = "ts") -> None:
    """Write a batch's rows to ``path/on_time`` or ``path/late``, for ``foreachBatch``: none is dropped.

    Late are rows whose ``at`` lies more than ``delay`` before the latest ``at`` of all batches
    before, which is kept beside them. Feed windows from ``on_time`` and correct them from
    ``late``. A batch that runs again writes the same again.
    """
    spark = rows.sparkSession
    seen = None
    if batch:
        seen = spark.read.parquet(_batch(f"{path}/seen", batch - 1)).first()["at"]
    before = F.lit(seen).cast("timestamp")
    late = F.coalesce(F.col(at) < before - F.expr(f"interval {delay}"), F.lit(False))
    own = materialize(rows)
    own.where(~late).write.mode("overwrite").parquet(_batch(f"{path}/on_time", batch))
    own.where(late).write.mode("overwrite").parquet(_batch(f"{path}/late", batch))
    own.agg(F.greatest(F.max(at), before).alias("at")).write.mode("overwrite").parquet(_batch(f"{path}/seen", batch))


class LateRows(StreamingQueryListener):
    """Counts what stateful operators dropped behind the watermark, by query id.

    An aggregation drops after its partial step, so a dropped row can stand for
    several records of one window, key and task. Register with
    ``spark.streams.addListener`` before the query starts.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(int(op.numRowsDroppedByWatermark) for op in progress.stateOperators)
        self.dropped[str(progress.id)] = self.dropped.get(str(progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
