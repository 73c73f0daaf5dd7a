"""``extract_stack``: lift stack traces out of messages and fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.stage import computed, let
from logloom.functions.text import SPACE_CLASS, non_empty, trim_space
from logloom.schema import STACK_TYPE

STDLIB, THIRDPARTY, PROJECT = "stdlib", "thirdparty", "project"

# Signs that a field value may hold a trace.
TRACE_MARKERS = ("goroutine ", "\n\tat ", "\n    at ")


def _frame(func: Column, file: Column, line: Column, col: Column, kind: Column) -> Column:
    return F.struct(
        func.alias("func"), file.alias("file"), line.alias("line"),
        col.alias("col"), kind.alias("kind"),
    )


def _int(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


# --- Go ----------------------------------------------------------------------

# Fixed value: the line that heads a goroutine's trace.
_GO_HEADER = r"(?md)^goroutine \d+ \[[^\]]*\]:$"


def _go_before(s: Column) -> Column:
    return F.get(F.split(s, _GO_HEADER, 2), F.lit(0))


def classify_go(func: Column, file: Column, module: str) -> Column:
    """Project code by module name; else a dot before the first slash is a domain."""
    lead = F.substring_index(func, "/", 1)
    foreign = F.contains(func, F.lit("/")) & F.contains(lead, F.lit("."))
    kind = F.when(foreign, THIRDPARTY).otherwise(STDLIB)
    if not module:
        return kind
    own = F.contains(func, F.lit(module)) | F.contains(file, F.lit(module))
    return F.when(own, PROJECT).otherwise(kind)


def _go_frames(s: Column, module: str) -> Column:
    """A frame is an unindented line followed by a tab-indented location."""

    def calls(lines: Column) -> Column:
        steps = F.transform(
            lines,
            lambda l, i: F.struct(
                l.alias("call"), F.get(lines, i + 1).alias("at"), i.alias("i")
            ),
        )
        return F.filter(
            steps,
            lambda x: (x["i"] > 0) & (x["call"] != "")
            & ~F.startswith(x["call"], F.lit("\t"))
            & F.coalesce(F.startswith(x["at"], F.lit("\t")), F.lit(False)),
        )

    def frame(x: Column) -> Column:
        call = F.regexp_replace(x["call"], "^created by ", "")
        call = trim_space(F.substring_index(call, " in goroutine ", 1))
        func = F.regexp_replace(call, r"(?s)\([^(]*\)\z", "")
        spot = F.get(F.split(trim_space(x["at"]), SPACE_CLASS + "+"), F.lit(0))
        file = F.regexp_replace(spot, r"(?s):[^:]*\z", "")
        line = F.when(F.contains(spot, F.lit(":")), _int(F.substring_index(spot, ":", -1)))
        return _frame(
            func, file, F.coalesce(line, F.lit(0)), F.lit(0), classify_go(func, file, module)
        )

    # Bound once: inside the lambdas they would be made again for every line.
    after = let(_go_before(s), lambda before: F.substring(s, F.length(before) + 1, F.length(s)))
    return F.transform(let(F.split(after, "\n"), calls), frame)


# --- Node / Bun ----------------------------------------------------------------

# Fixed value: a frame's line.
_NODE_FRAME = r"(?d)^[\t\n\f\r ]+at (?:(.+) \()?(.+):(\d+):(\d+)\)?$"


def classify_node(file: Column) -> Column:
    return (
        F.when(F.startswith(file, F.lit("node:")), STDLIB)
        .when(F.contains(file, F.lit("node_modules/"))
              | F.contains(file, F.lit("node_modules\\")), THIRDPARTY)
        .otherwise(PROJECT)
    )


def _node_groups(line: Column) -> Column:
    """Function, file, line and column by one search; other lines stay one part.

    A line with the separator in it takes a search for each.
    """
    joined = F.regexp_replace(line, _NODE_FRAME, "$1\x00$2\x00$3\x00$4")
    each = F.array(*[F.regexp_extract(line, _NODE_FRAME, i) for i in (1, 2, 3, 4)])
    # The plain test spares most lines the search.
    return (
        F.when(~F.contains(line, F.lit("at ")), F.array(line))
        .when(~F.contains(line, F.lit("\x00")), F.split(joined, "\x00"))
        .when(line.rlike(_NODE_FRAME), each).otherwise(F.array(line))
    )


def _node_is_frame(parts: Column) -> Column:
    file = F.get(parts, F.lit(1))
    return (F.size(parts) == 4) & (file.rlike("[./]") | F.startswith(file, F.lit("node:")))


def _node_frames(s: Column, module: str) -> Column:
    def frame(part: Column) -> Column:
        func = non_empty(trim_space(F.get(part, F.lit(0))))
        file = F.get(part, F.lit(1))
        return _frame(
            F.coalesce(func, F.lit("<anonymous>")), file,
            _int(F.get(part, F.lit(2))), _int(F.get(part, F.lit(3))), classify_node(file),
        )

    return F.transform(F.filter(F.transform(F.split(s, "\n"), _node_groups), _node_is_frame), frame)


def _node_header(s: Column) -> Column:
    lines = F.split(s, "\n")
    found = F.transform(F.transform(lines, _node_groups), _node_is_frame)
    first = F.array_position(found, F.lit(True))
    return trim_space(F.array_join(
        F.slice(lines, F.lit(1), F.when(first > 0, (first - 1).cast("int")).otherwise(F.size(lines))), "\n"))


# --- registry ------------------------------------------------------------------


@dataclass(frozen=True)
class TraceGrammar:
    """One language's traces. ``claims`` decides whether this grammar owns a
    value; ``frames`` and ``header`` then read it, an empty array meaning none."""

    lang: str
    claims: Callable[[Column], Column]
    frames: Callable[[Column, str], Column]
    header: Callable[[Column], Column]


GRAMMARS: list[TraceGrammar] = [
    TraceGrammar(
        "go",
        lambda s: F.contains(s, F.lit("goroutine ")) & s.rlike(_GO_HEADER),
        _go_frames,
        lambda s: F.rtrim(_go_before(s), F.lit("\n")),
    ),
    TraceGrammar(
        "node",
        lambda s: F.contains(s, F.lit("at ")) & F.exists(
            F.transform(F.split(s, "\n"), _node_groups), _node_is_frame),
        _node_frames,
        _node_header,
    ),
]


def register_grammar(grammar: TraceGrammar) -> None:
    """Add a trace grammar after the known ones."""
    GRAMMARS.append(grammar)


def parse_trace(s: Column, module: str = "") -> Column:
    """Trace in ``s`` by the first grammar that claims it; NULL without frames."""
    out = None
    for g in GRAMMARS:
        trace = F.struct(
            g.header(s).alias("header"), F.lit(g.lang).alias("lang"),
            g.frames(s, module).alias("frames"),
        )
        out = F.when(g.claims(s), trace) if out is None else out.when(g.claims(s), trace)
    # A claim without frames yields no trace, and no other grammar is asked.
    return out


def _found(trace: Column) -> Column:
    return trace.isNotNull() & (F.size(trace["frames"]) > 0)


def _looks_like_trace(s: Column) -> Column:
    marked = F.contains(s, F.lit(TRACE_MARKERS[0]))
    for m in TRACE_MARKERS[1:]:
        marked = marked | F.contains(s, F.lit(m))
    return F.contains(s, F.lit("\n")) & marked


def _first_line(s: Column) -> Column:
    lines = F.filter(F.transform(F.split(s, "\n"), trim_space), lambda l: l != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def extract_stack(df: DataFrame, module: str = "") -> DataFrame:
    """Add ``stack``; a field that held the trace is taken out of ``fields``.

    The message is tried first, then the fields in source order. ``module`` is
    the import path that marks a frame as project code.
    """
    message = F.col("message")
    in_message = F.when(
        F.col("parsed")
        & (F.contains(message, F.lit("goroutine ")) | F.contains(message, F.lit("at "))),
        parse_trace(message, module),
    )
    in_fields = F.when(
        F.col("parsed")
        & ~F.coalesce(_found(F.col("_msg_trace")), F.lit(False))
        & F.exists("fields", lambda f: _looks_like_trace(f["val"])),
        F.get(
            F.filter(
                F.transform(
                    "fields",
                    lambda f, i: F.struct(
                        i.alias("i"), f["val"].alias("source"),
                        F.when(_looks_like_trace(f["val"]), parse_trace(f["val"], module))
                        .alias("trace"),
                    ),
                ),
                lambda x: F.coalesce(_found(x["trace"]), F.lit(False)),
            ),
            F.lit(0),
        ),
    )
    from_message = F.coalesce(_found(F.col("_msg_trace")), F.lit(False))
    trace = F.when(from_message, F.col("_msg_trace")).otherwise(F.col("_field_trace.trace"))
    source = F.when(from_message, message).otherwise(F.col("_field_trace.source"))
    header = F.coalesce(
        non_empty(trace["header"]),
        F.when((message != "") & (message != source), message),
        _first_line(source),
    )
    lifted = computed(
        computed(df, {"_msg_trace": in_message}), {"_field_trace": in_fields}
    )
    stack = F.struct(
        header.alias("header"), trace["lang"].alias("lang"), trace["frames"].alias("frames")
    )
    kept = F.filter("fields", lambda f, i: i != F.col("_field_trace.i"))
    return computed(
        lifted,
        {
            "stack": F.when(trace.isNotNull(), stack).cast(STACK_TYPE),
            "fields": F.when(F.col("_field_trace").isNull(), F.col("fields")).otherwise(kept),
        },
    ).drop("_msg_trace", "_field_trace")
