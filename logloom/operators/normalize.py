"""``normalize``: raw lines of any known format into log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.fields import FIELDS_TYPE
from logloom.functions.stage import computed, let
from logloom.functions.text import trim_space
from logloom.functions.times import ZERO_US, clock_of_text, parse_micros
from logloom.operators import decode
from logloom.schema import UNKNOWN, parse_level

# Key names that carry the time, the level and the message.
TIME_KEYS = ("time", "ts", "timestamp", "@timestamp", "t")
LEVEL_KEYS = ("level", "lvl", "severity", "levelname")
MESSAGE_KEYS = ("msg", "message")

_LAST = 2_147_483_647


def detect_format(raw: Column) -> Column:
    """Name of the format whose shape a line has; "text" when none."""
    trimmed = trim_space(raw)
    first, *rest = decode.FORMATS
    out = F.when(first.sniff(trimmed), first.name)
    for fmt in rest:
        out = out.when(fmt.sniff(trimmed), fmt.name)
    return out.otherwise("text")


def _with_pairs(lines: DataFrame) -> DataFrame:
    """Decode each line by its ``format``; JSON takes three steps, the others one."""
    raw, fmt = F.col("raw"), F.col("format")
    is_json = fmt == "json"
    others = [f for f in decode.FORMATS if f.name != "json"]
    flat = F.when(fmt == others[0].name, others[0].pairs(raw))
    for f in others[1:]:
        flat = flat.when(fmt == f.name, f.pairs(raw))
    checked = lines.withColumn("_guarded", F.when(is_json, decode.json_needs_guard(raw)))
    docs = computed(
        checked, {"_parts": F.when(is_json, decode.json_parts(raw, F.col("_guarded")))}
    )
    members = decode.json_members(F.col("_parts"), F.col("_guarded"))
    pairs = F.when(is_json, members).otherwise(flat.cast(decode.PAIRS_TYPE))
    return computed(docs, {"_pairs": pairs}).drop("_guarded", "_parts")


def _candidates(pairs: Column) -> Column:
    """The few pairs named like a time, level or message, with their readings."""
    named = F.filter(
        F.transform(
            pairs,
            lambda p, i: F.struct(i.alias("i"), p["key"].alias("key"), p["value"].alias("value")),
        ),
        lambda x: x["key"].isin(*TIME_KEYS, *LEVEL_KEYS, *MESSAGE_KEYS),
    )

    def reading(x: Column) -> Column:
        key, val = x["key"], F.coalesce(x["value"], F.lit(""))
        return F.struct(
            x["i"].alias("i"), val.alias("val"),
            F.when(key.isin(*TIME_KEYS), parse_micros(val)).alias("us"),
            F.when(key.isin(*LEVEL_KEYS), parse_level(val)).alias("level"),
            key.isin(*MESSAGE_KEYS).alias("is_msg"),
        )

    return F.transform(named, reading)


def _first(candidates: Column, cond) -> Column:
    return F.get(F.filter(candidates, cond), F.lit(0))


def _is_taken(c: Column) -> Column:
    """Whether a candidate is used up by the record's time, level or message.

    Blank messages before the one taken are dropped, as are "no time" stamps
    before the time; failing and later aliases stay ordinary fields.
    """
    taken = c["i"].eqNullSafe(F.col("_t.i")) | c["i"].eqNullSafe(F.col("_l.i"))
    message = c["is_msg"] & (c["i"] <= F.coalesce(F.col("_m.i"), F.lit(_LAST)))
    no_time = F.coalesce(c["us"] == ZERO_US, F.lit(False)) & (
        c["i"] < F.coalesce(F.col("_t.i"), F.lit(_LAST))
    )
    return taken | message | no_time


def normalize(lines: DataFrame, format: str = "auto") -> DataFrame:
    """``stream_id, pos, raw`` -> the decoded part of ``LOG_SCHEMA``.

    A line that its format cannot decode, or of no known format, is kept with
    ``parsed = false`` and nothing but ``raw``. ``format`` other than "auto"
    applies one decoder to every line; "text" decodes none.
    """
    chosen = decode.format_of_name(format)
    fmt = detect_format(F.col("raw")) if chosen == "auto" else F.lit(chosen)
    pairs, named = F.col("_pairs"), F.col("_named")
    decoded = computed(
        _with_pairs(lines.withColumn("format", fmt)), {"_named": _candidates(pairs)}
    )
    picked = computed(
        decoded,
        {
            "_t": _first(named, lambda c: c["us"] != ZERO_US),
            "_l": _first(named, lambda c: c["level"] != UNKNOWN),
            "_m": _first(named, lambda c: c["is_msg"] & (c["val"] != "")),
        },
    )
    taken = F.transform(F.filter(named, _is_taken), lambda c: c["i"])
    fields = let(
        taken,
        lambda used: F.transform(
            F.filter(pairs, lambda p, i: ~F.array_contains(used, i)),
            lambda p: F.struct(
                p["key"].alias("key"), F.coalesce(p["value"], F.lit("")).alias("val"),
                F.lit(False).alias("demoted"),
            ),
        ),
    )
    return (
        picked
        .select(
            *[c for c in lines.columns if c != "format"],
            pairs.isNotNull().alias("parsed"),
            F.when(pairs.isNotNull(), F.col("format")).otherwise("text").alias("format"),
            F.timestamp_micros(F.col("_t.us")).alias("ts"),
            F.when(F.col("_t").isNotNull(), clock_of_text(F.col("_t.val"), F.col("_t.us")))
            .alias("clock"),
            F.coalesce(F.col("_l.level"), F.lit(UNKNOWN)).alias("level"),
            F.coalesce(F.col("_l.level"), F.lit(UNKNOWN)).alias("effective"),
            F.coalesce(F.col("_m.val"), F.lit("")).alias("message"),
            F.coalesce(fields, F.array().cast(FIELDS_TYPE)).alias("fields"),
        )
    )
