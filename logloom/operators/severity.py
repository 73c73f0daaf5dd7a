"""``rerank_severity``: raise the level of records whose text tells of trouble."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.fields import field_value
from logloom.functions.stage import computed
from logloom.schema import ERROR, UNKNOWN, WARN

# Words, in lower case, and the least level each implies.
ERROR_WORDS = ("panic", "nil pointer", "runtime error", "fatal")
WARN_WORDS = ("connection refused", "unavailable", "timeout", "failed", "error")


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def rerank_severity(df: DataFrame) -> DataFrame:
    """Set ``effective`` to the higher of the declared and the implied level."""
    text = F.lower(F.concat_ws("\n", F.col("message"), field_value("error")))
    implied = (
        F.when(_mentions(F.col("_hay"), ERROR_WORDS), ERROR)
        .when(_mentions(F.col("_hay"), WARN_WORDS), WARN)
        .otherwise(UNKNOWN)
    )
    effective = F.when(F.col("parsed"), F.greatest("level", implied)).otherwise(F.col("level"))
    searched = df.withColumn("_hay", F.when(F.col("parsed"), text))
    return computed(searched, {"effective": effective}).drop("_hay")
