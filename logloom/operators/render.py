"""Records and summaries as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import flatten, quote
from logloom.operators.frames import packages_note, stack_blocks
from logloom.operators.identity import record_text
from logloom.operators.stack import PROJECT
from logloom.schema import ERROR, WARN, level_label


def badge() -> Column:
    """The level; "INFO→ERR" where the effective level differs."""
    declared = level_label(F.col("level"))
    return F.when(F.col("level") == F.col("effective"), declared).otherwise(
        F.concat(declared, F.lit("→"), level_label(F.col("effective")))
    )


def order_fields(fields: Column) -> Column:
    """Telling fields first, constant ones after them, source order in both."""
    return F.concat(
        F.filter(fields, lambda f: ~f["demoted"]), F.filter(fields, lambda f: f["demoted"])
    )


def fields_text(fields: Column) -> Column:
    def shown(f: Column) -> Column:
        val = flatten(f["val"])
        val = F.when(val.rlike('[ \t"]'), quote(val)).otherwise(val)
        mark = F.when(f["demoted"], "·").otherwise("")
        return F.concat(mark, f["key"], F.lit("="), val)

    return F.array_join(F.transform(order_fields(fields), shown), " ")


def related_note() -> Column:
    at = F.when(
        F.col("related.ts").isNotNull(), F.concat(F.lit(" @"), F.col("related.clock"))
    ).otherwise("")
    return F.concat(F.lit("    ↳ likely related: "), F.col("related.summary"), at)


def location(frame: Column) -> Column:
    base = F.substring_index(frame["file"], "/", -1)
    line, col = frame["line"].cast("string"), frame["col"].cast("string")
    return (
        F.when(frame["line"] == 0, base)
        .when(frame["col"] > 0, F.concat_ws(":", base, line, col))
        .otherwise(F.concat_ws(":", base, line))
    )


def stack_text(frames: Column, expand: bool = False) -> Column:
    """Project frames one per line, framework runs as a note."""
    def shown(b: Column) -> Column:
        f = b["frame"]
        marker = F.when(f["kind"] == PROJECT, "►").otherwise("  ")
        own = F.concat(
            F.lit("    "), marker, F.lit(" "), location(f), F.lit("  "), f["func"]
        )
        note = F.concat(
            F.lit("    … "), b["n"].cast("string"), F.lit(" framework frames ("),
            packages_note(b["packages"]), F.lit(")"),
        )
        return F.when(b["project"], own).otherwise(note)

    return F.array_join(F.transform(stack_blocks(frames, expand), shown), "\n")


def line_text(columns: list[str], expand_stack: bool = False) -> Column:
    """Text of one record; ``corr``, ``related``, ``repeat`` and ``stack`` are
    shown if they are among ``columns``."""
    has = set(columns)
    text = flatten(record_text() if "stack" in has else F.col("message"))
    parts = [
        F.coalesce("clock", F.lit("--:--:--")), F.lit(" "), badge(), F.lit("  "),
    ]
    if "corr" in has:
        parts.append(
            F.when(F.coalesce("corr", F.lit("")) != "",
                   F.concat(F.lit("⟨"), F.col("corr"), F.lit("⟩ "))).otherwise("")
        )
    parts.append(text)
    if "repeat" in has:
        parts.append(
            F.when(F.col("repeat") > 1, F.concat(F.lit("  ×"), F.col("repeat").cast("string")))
            .otherwise("")
        )
    parts.append(
        F.when(F.size("fields") > 0, F.concat(F.lit("  "), fields_text(F.col("fields"))))
        .otherwise("")
    )
    lines = [F.concat(*parts)]
    if "related" in has:
        lines.append(F.when(F.col("related").isNotNull(), related_note()))
    if "stack" in has:
        lines.append(
            F.when(F.col("stack").isNotNull(), stack_text(F.col("stack.frames"), expand_stack))
        )
    return F.when(F.col("parsed"), F.concat_ws("\n", *lines)).otherwise(F.col("raw"))


def format_lines(df: DataFrame, expand_stack: bool = False) -> DataFrame:
    """``stream_id, pos, line``."""
    return df.select("stream_id", "pos", line_text(df.columns, expand_stack).alias("line"))


def _count(n: Column, noun: str, unique: Column) -> Column:
    unique = F.coalesce(unique, F.lit(0))
    return F.concat(
        n.cast("string"), F.lit(" " + noun), F.when(n == 1, "").otherwise("s"),
        F.when(n > 0, F.concat(F.lit(" ("), unique.cast("string"), F.lit(" unique)")))
        .otherwise(""),
    )


def report_text(shown: int) -> Column:
    """Summary of one stream from its counts, totals and top templates."""

    def tally(name: str, noun: str) -> Column:
        n = F.col(name)
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + noun)))

    verdict = F.concat_ws(
        " · ",
        _count(F.col("errors"), "error", F.col("unique_errors")),
        _count(F.col("warns"), "warn", F.col("unique_warns")),
        tally("infos", "info"), tally("unknown", "unknown"), tally("passthrough", "passthrough"),
    )
    span = F.when(
        F.col("first_ts").isNotNull(),
        F.concat(
            F.lit("span "), F.col("first_clock"),
            F.when(F.col("first_ts") == F.col("last_ts"), "")
            .otherwise(F.concat(F.lit("–"), F.col("last_clock"))),
        ),
    )

    def level_lines(level: int, unique: str) -> list[Column]:
        mine = F.filter("top", lambda t: t["order"] == -level)
        label = F.rpad(level_label(F.lit(level)), 4, " ")
        lines = F.transform(
            mine,
            lambda t: F.concat(
                F.lit("  "), label, F.lit(" ×"), t["n"].cast("string"), F.lit("  "),
                flatten(t["text"]),
            ),
        )
        more = F.col(unique) - shown
        return [
            F.when(F.size(mine) > 0, F.array_join(lines, "\n")),
            F.when(
                more > 0, F.concat(F.lit("  … +"), more.cast("string"), F.lit(" more"))
            ),
        ]

    untracked = F.when(
        F.col("untracked") > 0,
        F.concat(
            F.lit("  … +"), F.col("untracked").cast("string"),
            F.lit(" more warn/error lines beyond the tracked templates"),
        ),
    )
    return F.concat_ws(
        "\n",
        F.lit("── summary " + "─" * 45), verdict, span,
        F.when(F.size("top") > 0, F.lit("")),
        *level_lines(ERROR, "unique_errors"), *level_lines(WARN, "unique_warns"), untracked,
    )
