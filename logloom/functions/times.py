"""Timestamps as written in logs.

A parsed time is a struct ``(us, clock)``: microseconds since the epoch, and the
wall clock in the zone the producer wrote, because that is what is displayed.
All arithmetic is on epoch values, so the session time zone plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Micros of year 1, January 1: a producer's "no time set" marker.
ZERO_US = -62135596800 * 1_000_000

_FRACTION = r"(?:[.,]\d+)?"
_CLOCK = r"\d{1,2}:\d{2}:\d{2}"
_PLAIN = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,9})?"
_ZONED = rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_CLOCK}{_FRACTION}(?:Z|[+-]\d{{2}}:\d{{2}})$"
_ZONELESS = rf"^\d{{4}}-\d{{2}}-\d{{2}}(?:T| +){_CLOCK}{_FRACTION}$"
_YEARLESS = rf"^\d{{4}} +{_CLOCK}{_FRACTION}$"
_SECONDS = r"^(?:\d{10}|[+-]\d{9})$"
_MILLIS = r"^(?:\d{13}|[+-]\d{12})$"

#: The year given to dates that carry none; a leap year, so that 0229 is a date.
YEARLESS_YEAR = "2000"


def _utc_micros(date: Column, s: Column) -> Column:
    """Micros of ``date`` plus the clock and fraction found in ``s``, as UTC."""
    clock = F.regexp_extract(s, r"(?:T| )(\d{1,2}:\d{2}:\d{2})", 1)
    micros = F.rpad(F.regexp_extract(s, r"[.,](\d{1,6})", 1), 6, "0")
    text = F.concat(date, F.lit("T"), F.lpad(clock, 8, "0"), F.lit("."), micros, F.lit("Z"))
    return F.unix_micros(F.try_to_timestamp(text))


def _offset_micros(s: Column) -> Column:
    hours = F.substring(s, -5, 2).cast("int")
    minutes = F.substring(s, -2, 2).cast("int")
    size = (hours * 3600 + minutes * 60).cast("long") * 1_000_000
    size = F.when((hours <= 24) & (minutes <= 60), size)
    return F.when(F.substring(s, -6, 1) == "-", -size).otherwise(size)


def parse_micros(s: Column) -> Column:
    """Epoch micros of a time value, NULL when it is not a time."""
    date = F.substring(s, 1, 10)
    month_day = F.concat(
        F.lit(YEARLESS_YEAR + "-"), F.substring(s, 1, 2), F.lit("-"), F.substring(s, 3, 2)
    )
    return (
        # The two usual forms need no taking apart.
        F.when(s.rlike(_PLAIN + "Z$"), F.unix_micros(F.try_to_timestamp(s)))
        .when(s.rlike(_PLAIN + "$"), F.unix_micros(F.try_to_timestamp(F.concat(s, F.lit("Z")))))
        .when(s.rlike(_ZONED),
               F.when(F.endswith(s, F.lit("Z")), _utc_micros(date, s))
               .otherwise(_utc_micros(date, s) - _offset_micros(s)))
        .when(s.rlike(_ZONELESS), _utc_micros(date, s))
        .when(s.rlike(_YEARLESS), _utc_micros(month_day, s))
        .when(s.rlike(_SECONDS), s.cast("long") * 1_000_000)
        .when(s.rlike(_MILLIS), s.cast("long") * 1_000)
    )


def clock_of_micros(us: Column) -> Column:
    """HH:MM:SS in UTC."""
    day = F.pmod(F.floor(us / F.lit(1_000_000)), F.lit(86_400)).cast("int")

    def two(c: Column) -> Column:
        return F.lpad(c.cast("int").cast("string"), 2, "0")

    return F.concat_ws(
        ":", two(F.floor(day / 3600)), two(F.floor(day / 60) % 60), two(day % 60)
    )


def clock_of_text(s: Column, us: Column) -> Column:
    """The wall clock written in a parsed time value."""
    shown = F.regexp_extract(s, r"(?:T| )(\d{1,2}:\d{2}:\d{2})", 1)
    return F.when(shown != "", F.lpad(shown, 8, "0")).otherwise(clock_of_micros(us))
