"""Log lines from files, directories and Kafka: ``stream_id, pos, raw``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators.ordinals import SLICE, with_ordinal

# Fixed value: a line of this many bytes or more is not taken.
MAX_LINE = 4 * 1024 * 1024

_LOCAL_BITS = 33
_LOCAL = (1 << _LOCAL_BITS) - 1


def _text(reader, path: str | list[str]) -> DataFrame:
    # Lines end at \n only: by default a lone \r would end one as well.
    return reader.option("lineSep", "\n").format("text").load(path)


def _raw() -> Column:
    return F.regexp_replace("value", r"\r\z", "")


def _position(block: Column) -> Column:
    """A line's place in its file, from its split and its number in the task.

    Rises along the file, with gaps between splits; needs no shuffle.
    """
    local = F.monotonically_increasing_id().bitwiseAND(_LOCAL)
    return F.shiftleft(F.shiftright(block, 10), _LOCAL_BITS).bitwiseOR(local)


def read_lines(
    spark: SparkSession, path: str | list[str], keep: Column | None = None
) -> DataFrame:
    """Lines of text files, every file a stream; blank lines are rows too.

    ``keep`` selects files, by ``_metadata`` (path, size, time) or by partition
    columns of the folder. It is applied below the positions, which a later filter
    could not pass, and so reaches the scan. Partition columns stay in the result.
    """
    found = _text(spark.read, path)
    folders = [c for c in found.columns if c != "value"]
    return (found if keep is None else found.where(keep)).select(
        F.col("_metadata.file_path").alias("stream_id"),
        _position(F.col("_metadata.file_block_start")).alias("pos"),
        _raw().alias("raw"),
        *folders,
    )


def join_files(lines: DataFrame, stream: Column, size: int = SLICE) -> DataFrame:
    """Make several files one stream, in order of their paths.

    ``stream`` names the stream of a file, from ``stream_id``, its path. The new
    ``pos`` counts 0, 1, 2, ... through the files of a stream.
    """
    numbered = with_ordinal(lines, "_n", size=size)
    before = Window.partitionBy("_stream").orderBy("stream_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    files = (
        lines.groupBy("stream_id").agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_stream", stream)
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    )
    return numbered.join(files, "stream_id").select(
        F.col("_stream").alias("stream_id"), (F.col("_start") + F.col("_n")).alias("pos"), "raw"
    )


def split_long(lines: DataFrame, limit: int = MAX_LINE) -> tuple[DataFrame, DataFrame]:
    """Lines short enough to take, and the rest: one line must not end a job."""
    long = F.octet_length("raw") >= limit
    return lines.filter(~long), lines.filter(long)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as they appear in a directory: ``stream_id, block, raw``.

    Lines cannot be numbered in a streaming plan; where order matters, call
    ``number_lines`` on the micro-batches.
    """
    return _text(spark.readStream, path).select(
        F.col("_metadata.file_path").alias("stream_id"),
        F.col("_metadata.file_block_start").alias("block"),
        _raw().alias("raw"),
    )


def number_lines(batch: DataFrame) -> DataFrame:
    """``pos`` for a micro-batch of ``stream_lines``: a file is read in one batch."""
    return batch.select("stream_id", _position(F.col("block")).alias("pos"), "raw")


def kafka_lines(records: DataFrame) -> DataFrame:
    """Lines from the Kafka source's columns, batch or stream.

    A partition of a topic is a stream and the offset is the position, as order
    holds only inside a partition.
    """
    return records.select(
        F.concat_ws("-", "topic", F.col("partition").cast("string")).alias("stream_id"),
        F.col("offset").alias("pos"),
        F.regexp_replace(F.col("value").cast("string"), r"\r\z", "").alias("raw"),
    )
