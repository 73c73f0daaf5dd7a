"""String helpers: trimming, flattening, quoting and unescaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = "[" + SPACE_CHARS + "]"


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse_space(c: Column) -> Column:
    """Every white-space run becomes one blank; none at either end."""
    return trim_space(F.regexp_replace(c, SPACE_CLASS + "+", " "))


def flatten(c: Column) -> Column:
    """Bring a multi-line value onto one line; other values stay as they are."""
    return F.when(c.rlike("[\n\r\t]"), collapse_space(c)).otherwise(c)


def strip_ansi(c: Column) -> Column:
    """Remove terminal control sequences (ESC [ ... final byte)."""
    return F.when(
        F.contains(c, F.lit("\x1b[")),
        F.regexp_replace(c, "\x1b\\[[^\x40-\x7e]*+[\x40-\x7e]?", ""),
    ).otherwise(c)


def non_empty(c: Column) -> Column:
    """NULL for the empty string, so that ``coalesce`` can chain fallbacks."""
    return F.nullif(c, F.lit(""))


def char_code(c: Column) -> Column:
    """Eight hex digits: the code point of a one-character string."""
    return F.hex(F.encode(c, "UTF-32"))


def _utf16(hex_digits: Column) -> Column:
    """UTF-8 hex of text given as UTF-16 hex digits."""
    return F.hex(F.decode(F.unhex(hex_digits), "UTF-16BE"))


_TOKENS = (
    r"(?s)\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    r"|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}|\\[0-7]{3}|\\.|[^\\]+"
)

# One-letter escapes and the byte each stands for, in hex.
_LETTER_ESCAPES = {
    "a": "07", "b": "08", "f": "0C", "n": "0A", "r": "0D", "t": "09", "v": "0B",
}


def unescape(c: Column) -> Column:
    """Resolve backslash escapes.

    Escapes may name single bytes, so the text is rebuilt as bytes: each token
    contributes its UTF-8 hex, and the joined bytes are read as UTF-8 again.
    An unpaired surrogate or a broken byte sequence reads as U+FFFD.
    """

    def token_hex(t: Column) -> Column:
        kind = F.substring(t, 1, 2)
        out = (
            F.when(~F.startswith(t, F.lit("\\")), F.hex(t))
            .when((kind == "\\u") & (F.length(t) == 12),
                  _utf16(F.concat(F.substring(t, 3, 4), F.substring(t, 9, 4))))
            .when((kind == "\\u") & t.rlike("^..[dD][89a-fA-F]"), F.lit("EFBFBD"))
            .when((kind == "\\u") & (F.length(t) == 6), _utf16(F.substring(t, 3, 4)))
            .when((kind == "\\U") & (F.length(t) == 10),
                  F.hex(F.decode(F.unhex(F.substring(t, 3, 8)), "UTF-32")))
            .when((kind == "\\x") & (F.length(t) == 4), F.upper(F.substring(t, 3, 2)))
            .when(t.rlike("^.[0-7]{3}$"), F.lpad(F.conv(F.substring(t, 2, 3), 8, 16), 2, "0"))
        )
        for letter, byte in _LETTER_ESCAPES.items():
            out = out.when(kind == "\\" + letter, F.lit(byte))
        return out.otherwise(F.hex(F.substring(t, 2, 1)))

    tokens = F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(0))
    joined = F.unhex(F.array_join(F.transform(tokens, token_hex), ""))
    return F.when(
        F.contains(c, F.lit("\\")), F.make_valid_utf8(joined.cast("string"))
    ).otherwise(c)


_PRINTABLE = r"\p{L}\p{M}\p{N}\p{P}\p{S} "


def quote(c: Column) -> Column:
    """Double-quote a value, escaping quotes, backslashes and unprintables."""

    def token(t: Column) -> Column:
        code = F.lower(char_code(t))
        out = F.when(t.rlike("^[" + _PRINTABLE + "]"), t)
        for letter, byte in _LETTER_ESCAPES.items():
            out = out.when(code == "000000" + byte.lower(), F.lit("\\" + letter))
        return (
            out.when((code < "00000020") | (code == "0000007f"),
                     F.concat(F.lit("\\x"), F.substring(code, 7, 2)))
            .when(code < "00010000", F.concat(F.lit("\\u"), F.substring(code, 5, 4)))
            .otherwise(F.concat(F.lit("\\U"), code))
        )

    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    tokens = F.regexp_extract_all(plain, F.lit("(?s)[" + _PRINTABLE + "]+|."), F.lit(0))
    shown = F.when(
        c.rlike("[^" + _PRINTABLE + "]"), F.array_join(F.transform(tokens, token), "")
    ).otherwise(plain)
    return F.concat(F.lit('"'), shown, F.lit('"'))
