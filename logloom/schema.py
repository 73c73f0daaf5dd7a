"""The fixed outer schema of a log record, and the severity scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_TYPE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("val", T.StringType()),
        T.StructField("demoted", T.BooleanType()),
    ]
)

FRAME_TYPE = T.StructType(
    [
        T.StructField("func", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("kind", T.StringType()),
    ]
)

STACK_TYPE = T.StructType(
    [
        T.StructField("header", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("frames", T.ArrayType(FRAME_TYPE)),
    ]
)

RELATED_TYPE = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("clock", T.StringType()),
        T.StructField("summary", T.StringType()),
    ]
)

#: ``fields`` is an array and not a map: source order and duplicate keys count.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("raw", T.StringType()),
        T.StructField("parsed", T.BooleanType()),
        T.StructField("format", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("clock", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("effective", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("fields", T.ArrayType(FIELD_TYPE)),
        T.StructField("stack", STACK_TYPE),
        T.StructField("template", T.StringType()),
        T.StructField("corr_key", T.StringType()),
        T.StructField("corr", T.StringType()),
        T.StructField("related", RELATED_TYPE),
        T.StructField("repeat", T.LongType()),
    ]
)

# Severity ordinals, their labels, and the accepted spellings.
UNKNOWN, DEBUG, INFO, WARN, ERROR = 0, 1, 2, 3, 4
LEVEL_LABELS = ("?", "DEBUG", "INFO", "WARN", "ERR")
LEVEL_SPELLINGS = {
    DEBUG: ("DEBUG", "debug", "Debug", "TRACE", "trace"),
    INFO: ("INFO", "info", "Info", "INFORMATION"),
    WARN: ("WARN", "warn", "Warn", "WARNING", "warning"),
    ERROR: (
        "ERROR", "error", "Error", "ERR", "err", "FATAL", "fatal",
        "PANIC", "panic", "CRITICAL", "critical", "Critical",
    ),
}


def parse_level(word: Column) -> Column:
    """Severity ordinal of an exact level spelling; 0 when it is not one."""
    out = F.when(word.isin(*LEVEL_SPELLINGS[INFO]), INFO)
    for ordinal in (DEBUG, WARN, ERROR):
        out = out.when(word.isin(*LEVEL_SPELLINGS[ordinal]), ordinal)
    return out.otherwise(UNKNOWN)


def level_ordinal(word: str) -> int:
    """The same table for a Python string, used to validate arguments."""
    for ordinal, words in LEVEL_SPELLINGS.items():
        if word in words:
            return ordinal
    return UNKNOWN


def level_label(ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVEL_LABELS]), ordinal + 1)
