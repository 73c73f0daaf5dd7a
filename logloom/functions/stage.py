"""Computed-once columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) columns that are evaluated once per row.

    A plain projection may be evaluated again wherever it is read: a filter on
    a parsed column is pushed below the projection together with the whole
    parser. Here the values are the single row of an inlined array, which later
    filters stay above, while filters on the other columns still reach the scan.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    # The values are made in a projection, which compiles them; the generator
    # above it, which only unpacks them, is what filters do not pass.
    return df.select(*kept, row.alias("_row")).select(*kept, F.inline(F.array("_row")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
