"""Writers for lines, records and summaries, in batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.sources.materialize import materialize


def write_lines(
    lines: DataFrame, path: str, format: str = "text", by_stream: bool = False,
    partitions: int | None = None, mode: str = "error",
) -> None:
    """Write ``stream_id, pos, line`` in stream order.

    Ranges of (stream, position) become files, so a large stream is spread over
    many and each file is in order. ``by_stream`` gives each stream a folder; where there
    are many streams, use ``write_streams``. The lines are written to the scratch folder before,
    as finding the ranges reads them once more.
    """
    keys = ["stream_id", "pos"]
    lines = materialize(lines.select("stream_id", "pos", "line") if format == "text" else lines)
    ranged = (
        lines.repartitionByRange(partitions, *keys) if partitions
        else lines.repartitionByRange(*keys)
    ).sortWithinPartitions(*keys)
    out = ranged
    if format == "text":
        out = ranged.select(*(["stream_id"] if by_stream else []), "line")
    writer = out.write.mode(mode).format(format)
    if by_stream:
        writer = writer.partitionBy("stream_id")
    writer.save(path)


def write_records(
    records: DataFrame, path: str, mode: str = "error", files_per_day: int = 16
) -> None:
    """Write records as Parquet, in folders by day (UTC), for pruning on time.

    A day's records are dealt to ``files_per_day`` tasks, so that not every task
    writes into every folder and a busy day is still spread.
    """
    number = F.floor(F.unix_micros("ts") / 86_400_000_000).cast("int")
    day = F.coalesce(F.date_from_unix_date(number).cast("string"), F.lit("none"))
    part = F.pmod(F.xxhash64("stream_id", "pos"), F.lit(files_per_day))
    dealt = records.withColumn("day", day).repartition("day", part)
    dealt.write.mode(mode).partitionBy("day").parquet(path)


#: Folders that streams are dealt to.
FOLDERS = 256
_INDEX = "_streams"


def write_streams(
    rows: DataFrame, path: str, folders: int = FOLDERS, partitions: int | None = None, mode: str = "error"
) -> None:
    """Write ``stream_id, pos, ...`` as Parquet in at most ``folders`` folders, however many streams.

    A stream lies in one folder, in order, over as many files as it fills. An index beside
    the folders names each stream's folder, its rows and its positions; ``read_streams``
    finds a stream by it.
    """
    folder = F.pmod(F.xxhash64("stream_id"), F.lit(folders)).cast("int")
    keys = ["folder", "stream_id", "pos"]
    # Read three times: for the ranges, the rows and the index.
    dealt = materialize(rows).withColumn("folder", folder)
    ranged = dealt.repartitionByRange(partitions, *keys) if partitions else dealt.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode(mode).partitionBy("folder").parquet(path)
    index = dealt.groupBy("folder", "stream_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    index.repartitionByRange("stream_id").sortWithinPartitions("stream_id").write.mode("overwrite").parquet(
        f"{path}/{_INDEX}")


def stream_index(spark: SparkSession, path: str) -> DataFrame:
    """``folder, stream_id, rows, first_pos, last_pos`` of what ``write_streams`` wrote."""
    return spark.read.parquet(f"{path}/{_INDEX}")


def read_streams(spark: SparkSession, path: str, *streams: str) -> DataFrame:
    """Rows of the given streams, or of all; only their folders and row groups are read."""
    found = spark.read.parquet(path)
    if streams:
        here = F.col("stream_id").isin(*streams)
        folders = [r.folder for r in stream_index(spark, path).where(here).select("folder").distinct().collect()]
        found = found.where(F.col("folder").isin(*folders) & here)
    return found.drop("folder")


def write_summary(report: DataFrame, path: str, mode: str = "error", folders: int = FOLDERS) -> None:
    """Write ``stream_id, report`` in at most ``folders`` folders, with an index of streams.

    Read reports back with ``read_streams``.
    """
    write_streams(report.select("stream_id", F.lit(0).cast("long").alias("pos"), "report"), path, folders, mode=mode)


def write_stream(
    rows: DataFrame, path: str, checkpoint: str, format: str = "parquet",
    available_now: bool = False, every: str | None = None, by_stream: bool = False,
) -> StreamingQuery:
    """Append a streaming result; with ``available_now`` stop at the end of input.

    Text takes one column, so records are written as Parquet or, as lines, with
    ``format="text"``.
    """
    out = rows
    if format == "text":
        out = rows.select(*(["stream_id"] if by_stream else []), "line")
    writer = out.writeStream.format(format).outputMode("append").option(
        "checkpointLocation", checkpoint
    )
    if by_stream:
        writer = writer.partitionBy("stream_id")
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start(path)
