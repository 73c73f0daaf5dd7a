"""What a record is about: its template, component, request key and method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.fields import first_field, pick_fields
from logloom.functions.stage import computed
from logloom.functions.text import collapse_space, non_empty
from logloom.operators.stack import PROJECT
from logloom.schema import level_label

# ``\b`` as ASCII word boundaries: Java's own also counts accented letters.
_B, _E = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
IPV4 = _B + r"\d{1,3}(?:\.\d{1,3}){3}" + _E

# The variable parts of a text, masked in this order.
MASK_RULES = (
    (r"0x[0-9a-fA-F]+", "<hex>"),
    (_B + r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}" + _E,
     "<uuid>"),
    (IPV4, "<ip>"),
    (r"\[[0-9a-fA-F:]*::[0-9a-fA-F:]*\]", "<ip6>"),
    (r"\d+", "<n>"),
)

# Field names of a request id, most telling first.
CORR_ID_KEYS = (
    "trace_id", "trace.id", "traceID", "traceId",
    "request_id", "request.id", "requestID", "requestId", "req_id",
    "correlation_id", "correlationID", "x-request-id",
)

SUMMARY_BYTES = 60


def mask(text: Column, rules: tuple[tuple[str, str], ...] = MASK_RULES) -> Column:
    masked = text
    for pattern, name in rules:
        masked = F.regexp_replace(masked, pattern, name)
    if rules != MASK_RULES:
        return masked
    # Each of the standard rules needs a digit, a dash or a double colon.
    return F.when(text.rlike("[0-9-]|::"), masked).otherwise(text)


def record_text() -> Column:
    """The text a record is known by: its trace's header, else its message."""
    return F.coalesce(F.col("stack.header"), F.col("message"))


def component() -> Column:
    return F.coalesce(non_empty(first_field("component")), first_field("service"), F.lit(""))


def template(text: Column, rules: tuple[tuple[str, str], ...] = MASK_RULES) -> Column:
    """Event key: effective level, component and masked text, NUL between them."""
    return F.concat(
        level_label(F.col("effective")), F.lit("\x00"), component(), F.lit("\x00"),
        mask(text, rules),
    )


def corr_key(text: Column) -> Column:
    return F.coalesce(pick_fields(CORR_ID_KEYS), non_empty(F.regexp_extract(text, IPV4, 0)))


def method() -> Column:
    """RPC method, else the method of the innermost project frame; NULL for none."""
    own = F.get(F.filter("stack.frames", lambda f: f["kind"] == PROJECT), F.lit(0))
    return F.coalesce(
        non_empty(first_field("rpc.method")),
        non_empty(F.substring_index(own["func"], ".", -1)),
    )


def summarize(text: Column) -> Column:
    """One short line: white space collapsed, cut at 60 bytes."""
    line = collapse_space(text)
    cut = F.make_valid_utf8(F.substring(line.cast("binary"), 1, SUMMARY_BYTES).cast("string"))
    return F.when(
        F.octet_length(line) > SUMMARY_BYTES, F.concat(cut, F.lit("…"))
    ).otherwise(line)


def corr_tag(key: Column) -> Column:
    """Short group tag: "c" and, in base 36, the 32-bit FNV-1a hash modulo 1000."""
    data = key.cast("binary")
    # Offset basis and prime of the 32-bit hash.
    basis, prime, width = 2166136261, 16777619, 0xFFFFFFFF

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
        return (h.bitwiseXOR(byte) * F.lit(prime)).bitwiseAND(F.lit(width))

    places = F.when(
        F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))
    ).otherwise(F.array().cast("array<int>"))
    digest = F.aggregate(places, F.lit(basis).cast("long"), step)
    return F.concat(F.lit("c"), F.lower(F.conv((digest % 1000).cast("string"), 10, 36)))


def identify(df: DataFrame, mask_rules: tuple[tuple[str, str], ...] = MASK_RULES) -> DataFrame:
    """Add ``text, template, corr_key, method``; NULL on passthrough rows."""
    known = F.col("parsed")
    text = F.col("text")
    return computed(
        computed(df, {"text": F.when(known, record_text())}),
        {
            "template": F.when(known, template(text, mask_rules)),
            "corr_key": F.when(known, corr_key(text)),
            "method": F.when(known, method()),
        },
    )
