"""``where``: select records by level, fields and pattern.

A passthrough record has no level and no fields to be judged by, so only the
pattern can drop it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.fields import first_field
from logloom.schema import UNKNOWN, level_ordinal


def _check_pattern(pattern: str) -> str:
    pattern = pattern.replace("(?P<", "(?<")
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:
            if isinstance(e, CapturedException) or "PatternSyntax" in str(e):
                raise ValueError(f"invalid pattern {pattern!r}") from e
            raise
    return pattern


def min_level(word: str) -> Column:
    ordinal = level_ordinal(word)
    if ordinal == UNKNOWN:
        raise ValueError(f"unknown level {word!r}, want debug, info, warn or error")
    return ~F.col("parsed") | (F.col("effective") >= ordinal)


def field_contains(spec: str) -> Column:
    """``key=text``: the first field of that key holds ``text``, in any case."""
    key, eq, text = spec.partition("=")
    if not eq or not key:
        raise ValueError(f"invalid field test {spec!r}, want key=text")
    val = first_field(key)
    return ~F.col("parsed") | F.coalesce(
        F.contains(F.lower(val), F.lit(text.lower())), F.lit(False)
    )


def _unix(pattern: str) -> str:
    """Only ``\\n`` ends a line for ``.``, and a last ``$`` is the end of the text."""
    slashes = len(pattern[:-1]) - len(pattern[:-1].rstrip("\\"))
    if pattern.endswith("$") and slashes % 2 == 0:
        pattern = pattern[:-1] + r"\z"
    return "(?d)" + pattern


def grep(pattern: str) -> Column:
    """Pattern found in the message or a field value; in the line if undecoded."""
    pattern = _unix(_check_pattern(pattern))
    found = F.col("message").rlike(pattern) | F.exists(
        "fields", lambda f: f["val"].rlike(pattern)
    )
    return F.when(F.col("parsed"), found).otherwise(F.col("raw").rlike(pattern))


def predicate(
    level: str = "", pattern: str = "", fields: Iterable[str] = ()
) -> Column | None:
    tests = []
    if level:
        tests.append(min_level(level))
    tests.extend(field_contains(spec) for spec in fields)
    if pattern:
        tests.append(grep(pattern))
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def where(
    df: DataFrame, level: str = "", pattern: str = "", fields: Iterable[str] = ()
) -> DataFrame:
    """Keep the records that pass every given test; no test keeps everything."""
    cond = predicate(level, pattern, fields)
    return df if cond is None else df.filter(cond)
