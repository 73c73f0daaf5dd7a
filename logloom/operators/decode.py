"""Line decoders: each turns a line into its ordered key/value pairs.

A decoder is a Column of ``array<struct<key,value>>``, NULL where the line is not
of its format. Everything is built-in expressions, so parsing stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.stage import let
from logloom.functions.text import SPACE_CHARS, SPACE_CLASS, strip_ansi, trim_space, unescape
from logloom.schema import UNKNOWN, parse_level

PAIRS_TYPE = "array<struct<key:string,value:string>>"


def _pair(key: str, val: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), val.alias("value"))


def _after(c: Column, needle: str) -> Column:
    """The text after the first ``needle``, which must be present."""
    return F.substring(c, F.instr(c, needle) + len(needle), F.length(c))


# --- JSON ------------------------------------------------------------------

_JSON_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_END = "\\u0001"

# A value that the JSON reader would rewrite: a fraction, an exponent, minus
# zero; or an escape that may sit inside a nested value, or half a surrogate.
_VALUE_START = r'(?:"\s*+:|[\[,])\s*+'
_REWRITTEN_NUMBER = _VALUE_START + r"-?+(?:\d++[.eE]|(?<=-)0)"
_NESTED = _VALUE_START + r"[\[{]"
_SURROGATE = r"\\u[dD][89a-fA-F]"

# Guarded text: every backslash escape, and every number, is spelled with MARK
# and a letter, so that the JSON reader hands it back as it was written.
MARK = "\uffff"
_NUMBER = r"-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?"


def _guard_json(raw: Column) -> Column:
    c = F.replace(raw, F.lit(MARK), F.lit(MARK + "f"))
    c = F.replace(c, F.lit("\\\\"), F.lit(MARK + "b"))
    c = F.replace(c, F.lit('\\"'), F.lit(MARK + "q"))
    c = F.regexp_replace(c, r"\\([/bfnrt]|u[0-9a-fA-F]{4})", MARK + "e$1")
    # Only quotes that open or close a string are left, so strings can be
    # skipped; a number in place of a key is not followed by , } or ] and stays.
    skipped = '\\G((?:"[^"]*+"|[^"0-9-])*+)'
    return F.regexp_replace(c, skipped + f"({_NUMBER})(?=\\s*+[,}}\\]])", f'$1"{MARK}n$2"')


def _unguard_json(val: Column) -> Column:
    def escapes(c: Column) -> Column:
        c = F.replace(c, F.lit(MARK + "q"), F.lit('\\"'))
        c = F.replace(c, F.lit(MARK + "b"), F.lit("\\\\"))
        return F.replace(c, F.lit(MARK + "e"), F.lit("\\"))

    def mark(c: Column) -> Column:
        return F.replace(c, F.lit(MARK + "f"), F.lit(MARK))

    # A plain quote can only come from a nested value: those of strings are marked.
    nested = F.regexp_replace(val, f'"{MARK}n([^"]*+)"', "$1")
    return (
        F.when(F.startswith(val, F.lit(MARK + "n")), F.substring(val, 3, 2_000_000_000))
        .when(F.contains(val, F.lit('"')), mark(escapes(nested)))
        .when(F.contains(val, F.lit(MARK)), mark(unescape(escapes(val))))
        .otherwise(val)
    )


def json_needs_guard(raw: Column) -> Column:
    """Whether the JSON reader, left alone, would not give values as written."""
    return raw.rlike(_REWRITTEN_NUMBER) | (
        F.contains(raw, F.lit("\\"))
        & (raw.rlike(_NESTED) | raw.rlike(_SURROGATE) | F.contains(raw, F.lit(_END)))
    )


def json_parts(raw: Column, guarded: Column) -> Column:
    """A line read as the first element of an array that ends with a fixed object.

    Anything after the line's own object shows up as a changed array.
    """
    text = F.when(guarded, _guard_json(raw)).otherwise(raw)
    doc = F.concat(F.lit("["), text, F.lit(f',{{"{_END}":""}}]'))
    return F.from_json(doc, "array<map<string,string>>", _JSON_STRICT)


def json_members(parts: Column, guarded: Column) -> Column:
    """Members of a line that is exactly one JSON object.

    Strings are decoded, null is NULL, other values are their compact JSON text.
    """
    whole = (
        (F.size(parts) == 2)
        & F.get(parts, F.lit(0)).isNotNull()
        & F.get(parts, F.lit(1))["\x01"].isNotNull()
    )
    entries = F.map_entries(F.get(parts, F.lit(0)))
    as_written = F.transform(
        entries,
        lambda e: F.struct(
            _unguard_json(e["key"]).alias("key"), _unguard_json(e["value"]).alias("value")
        ),
    )
    return F.when(whole, F.when(guarded, as_written).otherwise(entries))


def json_pairs(raw: Column) -> Column:
    guarded = json_needs_guard(raw)
    return let(json_parts(raw, guarded), lambda parts: json_members(parts, guarded))


# --- logfmt ----------------------------------------------------------------

_IDENT_LEAD = r"^[A-Za-z0-9._/@:-]+="
_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
_LOGFMT_TOKEN = rf"(?s)[^= \t]++(?:=(?:{_QUOTED}|[^ \t]*+))?"
# Escapes a quoted value may hold; with any other one it is kept as written.
_VALID_ESCAPES = (
    r'(?s)^(?:[^\\]++|\\(?:[abfnrtv\\"]|[0-3][0-7]{2}|x[0-9A-Fa-f]{2}'
    r"|u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}"
    r"|U(?:0000(?![dD][89a-fA-F])|000[1-9a-fA-F]|0010)[0-9A-Fa-f]{4}))*+\z"
)


def _sniff_logfmt(trimmed: Column) -> Column:
    return trimmed.rlike(_IDENT_LEAD)


def logfmt_pairs(raw: Column) -> Column:
    """Pairs of a logfmt line; an unterminated quote makes it none."""

    def text(val: Column) -> Column:
        inner = F.substring(val, 2, F.length(val) - 2)
        plain = F.when(~F.contains(val, F.lit("\\")), inner).when(
            inner.rlike(_VALID_ESCAPES), unescape(inner)
        ).otherwise(inner)
        # NULL marks a quote that never ends.
        return F.when(~F.startswith(val, F.lit('"')), val).when(
            val.rlike(rf"(?s)^{_QUOTED}\z"), plain
        )

    def pair(t: Column) -> Column:
        val = F.when(F.contains(t, F.lit("=")), _after(t, "=")).otherwise(F.lit(""))
        return F.struct(
            F.substring_index(t, "=", 1).alias("key"), let(val, text).alias("value")
        )

    def usable(pairs: Column) -> Column:
        broken = F.contains(raw, F.lit('="')) & F.exists(pairs, lambda p: p["value"].isNull())
        return F.when((F.size(pairs) > 0) & ~broken, pairs)

    tokens = F.regexp_extract_all(raw, F.lit(_LOGFMT_TOKEN), F.lit(0))
    return let(F.transform(tokens, pair), usable)


# --- glog / klog -----------------------------------------------------------

# Severity letters of the header.
_GLOG_LEVELS = {"I": "info", "W": "warn", "E": "error", "F": "fatal"}


def _sniff_glog(trimmed: Column) -> Column:
    return trimmed.rlike(r"^[IWEF]\d{4} \d\d:\d\d:\d\d")


def glog_pairs(raw: Column) -> Column:
    def of_parts(parts: Column) -> Column:
        head, clock, thread, caller = (F.get(parts, F.lit(i)) for i in range(4))
        letter = F.substring(head, 1, 1)
        level = F.when(letter == "I", _GLOG_LEVELS["I"])
        for k in "WEF":
            level = level.when(letter == k, _GLOG_LEVELS[k])
        usable = (
            F.contains(raw, F.lit("]"))
            & (F.size(parts) >= 4)
            & (F.octet_length(head) == 5)
            & letter.isin(*_GLOG_LEVELS)
        )
        return F.when(
            usable,
            F.array(
                _pair("time", F.concat_ws(" ", F.substring(head, 2, 4), clock)),
                _pair("level", level),
                _pair("msg", trim_space(_after(raw, "]"))),
                _pair("thread", thread),
                _pair("caller", caller),
            ),
        )

    header = trim_space(F.substring_index(raw, "]", 1))
    return let(F.split(header, SPACE_CLASS + "+"), of_parts)


# --- Python logging ----------------------------------------------------------


def _sniff_pylog(trimmed: Column) -> Column:
    return trimmed.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3} - ")


def pylog_pairs(raw: Column) -> Column:
    # The stamp is 23 bytes wide, so the cut is made on bytes.
    line = F.ltrim(raw, F.lit(" \t")).cast("binary")
    stamp = F.substring(line, 1, 23).cast("string")
    rest = F.substring(line, 27, 2_000_000_000).cast("string")

    def of_parts(parts: Column) -> Column:
        name, level, msg = (F.get(parts, F.lit(i)) for i in range(3))
        usable = (
            (F.substring(line, 24, 3).cast("string") == " - ")
            & (F.size(parts) == 3)
            & (parse_level(level) != UNKNOWN)
        )
        return F.when(
            usable,
            F.array(
                _pair("time", F.regexp_replace(stamp, "^([^,]*),", "$1.")),
                _pair("level", level),
                _pair("logger", name),
                _pair("msg", msg),
            ),
        )

    return let(F.split(rest, " - ", 3), of_parts)


# --- logrus ------------------------------------------------------------------

# Level tokens, four letters or whole words.
_LOGRUS_LEVELS = {
    "TRAC": "trace", "TRACE": "trace",
    "DEBU": "debug", "DEBUG": "debug",
    "INFO": "info",
    "WARN": "warn", "WARNING": "warn",
    "ERRO": "error", "ERROR": "error",
    "FATA": "fatal", "FATAL": "fatal",
    "PANI": "panic", "PANIC": "panic",
}
_LOGRUS_LEAD = "^(?:" + "|".join(_LOGRUS_LEVELS) + r")\["


def _sniff_logrus(trimmed: Column) -> Column:
    return strip_ansi(trimmed).rlike(_LOGRUS_LEAD + r"\d[^\]]*\]")


def logrus_pairs(raw: Column) -> Column:
    none = F.array().cast(PAIRS_TYPE)

    def of_rest(lead: Column, rest: Column) -> Column:
        gap = F.instr(rest, "  ")
        tail = F.ltrim(F.substring(rest, gap, F.length(rest)), F.lit(" "))
        tail_pairs = F.when((gap > 0) & _sniff_logfmt(tail), logfmt_pairs(tail))
        head = F.substring(rest, F.lit(1), gap - 1)

        def with_message(found: Column) -> Column:
            msg = F.rtrim(F.when(found.isNotNull(), head).otherwise(rest), F.lit(" "))
            return F.concat(lead, F.array(_pair("msg", msg)), F.coalesce(found, none))

        return let(tail_pairs, with_message)

    def of_line(s: Column) -> Column:
        token = F.substring_index(s, "[", 1)
        level = F.when(token == "INFO", "info")
        for spelled, word in _LOGRUS_LEVELS.items():
            level = level.when(token == spelled, word)
        stamp = F.substring_index(_after(s, "["), "]", 1)
        at = (
            F.when(stamp.rlike("[:T-]"), F.array(_pair("time", stamp)))
            .when(stamp != "", F.array(_pair("elapsed", stamp)))
            .otherwise(none)
        )
        lead = F.concat(at, F.array(_pair("level", level)))
        rest = F.ltrim(_after(s, "]"), F.lit(" "))
        return F.when(
            s.rlike(r"(?s)" + _LOGRUS_LEAD + r"[^\]]*\]"),
            let(rest, lambda r: of_rest(lead, r)),
        )

    return let(F.ltrim(strip_ansi(raw), F.lit(" \t")), of_line)


# --- registry ----------------------------------------------------------------


@dataclass(frozen=True)
class LineFormat:
    """A named format: ``sniff`` gets the trimmed line, ``pairs`` the raw one."""

    name: str
    sniff: Callable[[Column], Column]
    pairs: Callable[[Column], Column]


#: Tried in this order; the first sniff that matches owns the line.
FORMATS: list[LineFormat] = [
    LineFormat("json", lambda c: F.startswith(c, F.lit("{")), json_pairs),
    LineFormat("glog", _sniff_glog, glog_pairs),
    LineFormat("pylog", _sniff_pylog, pylog_pairs),
    LineFormat("logrus", _sniff_logrus, logrus_pairs),
    LineFormat("logfmt", _sniff_logfmt, logfmt_pairs),
]

# Accepted names of the format argument.
FORMAT_NAMES = {
    "": "auto", "auto": "auto", "json": "json", "logfmt": "logfmt",
    "glog": "glog", "klog": "glog", "python": "pylog", "pylog": "pylog",
    "logrus": "logrus", "text": "text",
}


def register_format(
    name: str, sniff: Callable[[Column], Column], pairs: Callable[[Column], Column]
) -> None:
    """Add a line format after the known ones."""
    if name in FORMAT_NAMES:
        raise ValueError(f"format {name!r} is already known")
    FORMATS.append(LineFormat(name, sniff, pairs))
    FORMAT_NAMES[name] = name


def format_of_name(name: str) -> str:
    try:
        return FORMAT_NAMES[name]
    except KeyError:
        known = ", ".join(sorted(k for k in FORMAT_NAMES if k))
        raise ValueError(f"unknown format {name!r}, want one of: {known}") from None
