"""Formats, decoding and the taking of time, level and message."""

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import lines, lit_rows, ordered, pairs, scalar
from logloom.functions.text import quote, strip_ansi, unescape
from logloom.functions.times import parse_micros
from logloom.operators.decode import FORMAT_NAMES, FORMATS, register_format
from logloom.operators.normalize import normalize

ESC = "\x1b"
NOT_PARSED = None

# line, level, message, fields
CASES = [
    # JSON: order, scalars, nesting, duplicates, null
    ('{"q":[1, {"z":0}],"msg":"tide at 4","level":"critical","q":null,"wet":true}',
     4, "tide at 4", [("q", '[1,{"z":0}]'), ("q", ""), ("wet", "true")]),
    ('{"x":1.50,"y":1e3,"z":-0,"deep":{"q":[1.0,"\\u00e9\\/"]},"s":"{ \\"a\\": 1 }"}',
     0, "", [("x", "1.50"), ("y", "1e3"), ("z", "-0"), ("deep", '{"q":[1.0,"\\u00e9\\/"]}'),
             ("s", '{ "a": 1 }')]),
    ("{}", 0, "", []),
    ('{"a":"\\ud83d\\ude00 \\ud800."}', 0, "", [("a", "\U0001f600 \ufffd.")]),
    ('{"a":1} {"b":2}', NOT_PARSED, None, None),
    ('{"a":1},{"\\u0001":""}]x', NOT_PARSED, None, None),
    ('{"a":01.5}', NOT_PARSED, None, None),
    ('{1.5:2}', NOT_PARSED, None, None),
    ("{'a':1}", NOT_PARSED, None, None),
    ('{"a":', NOT_PARSED, None, None),
    # aliases: first that reads well; later and failing ones stay
    ('{"time":"at dusk","ts":"2031-01-02T03:04:05Z","t":"2031-01-02T03:04:06Z","lvl":"Warning",'
     '"severity":"warn","message":"","msg":"lamp lit","message":"lamp out"}',
     3, "lamp lit", [("time", "at dusk"), ("t", "2031-01-02T03:04:06Z"), ("lvl", "Warning"),
                     ("message", "lamp out")]),
    # logfmt
    ('time="2031-01-02T03:04:05Z" level=warning msg="buoy \\"nine\\" adrift" towed chart=sea://n?grid=7',
     3, 'buoy "nine" adrift', [("towed", ""), ("chart", "sea://n?grid=7")]),
    ('level=error msg="hull\\n\\tkeel \\x51\\303\\274"', 4, "hull\n\tkeel Q\u00fc", []),
    ('mast="f\\jg" sail= =rope', 0, "", [("mast", "f\\jg"), ("sail", ""), ("rope", "")]),
    ('level=info msg="the rest is missing', NOT_PARSED, None, None),
    ("harbour: 3 boats in, 2 out", NOT_PARSED, None, None),
    # glog
    ("E1130 05:06:07.000008   9 winch.cc:31] cable {len:12} slack",
     4, "cable {len:12} slack", [("thread", "9"), ("caller", "winch.cc:31")]),
    ("W1130 05:06:07.654321 9 winch.cc without its end", NOT_PARSED, None, None),
    ("Every 1130 boats make a fleet", NOT_PARSED, None, None),
    # Python logging
    ("2031-01-02 03:04:05,067 - dock.crane - WARNING - lift - half way", 3, "lift - half way", [("logger", "dock.crane")]),
    ("2031-01-02 03:04:05,067 - dock.crane - LOUD - lift", NOT_PARSED, None, None),
    # logrus
    (f"{ESC}[33mWARN{ESC}[0m[0412] kiln door open  kiln=east temp=940",
     3, "kiln door open", [("elapsed", "0412"), ("kiln", "east"), ("temp", "940")]),
    (f"{ESC}[31mERRO{ESC}[0m[2031-01-02T03:04:05Z] rope  frayed  twice", 4, "rope  frayed  twice", []),
    ("WARN[east pier] flooded", NOT_PARSED, None, None),
    ("TIDE[0007] turns", NOT_PARSED, None, None),
    ("", NOT_PARSED, None, None),
    ("   ", NOT_PARSED, None, None),
]


def test_lines_of_every_format(spark):
    got = ordered(normalize(lines(spark, [c[0] for c in CASES])))
    for row, (raw, level, message, fields) in zip(got, CASES, strict=True):
        assert row.raw == raw
        if level is NOT_PARSED:
            assert (row.parsed, row.message, row.fields, row.ts) == (False, "", [], None), raw
        else:
            assert (row.parsed, row.level, row.effective) == (True, level, level), raw
            assert (row.message, pairs(row)) == (message, fields), raw


def test_forced_formats(spark):
    df = lines(spark, ["level=debug msg=moored", '{"msg":"moored"}', "W1130 05:06:07.8 9 winch.cc:2] moored"])
    want = {"json": [1], "logfmt": [0, 1, 2], "glog": [2], "klog": [2], "text": [], "": [0, 1, 2]}
    for name, parsed in want.items():
        got = normalize(df, name).filter("parsed").select("pos").collect()
        assert sorted(r.pos for r in got) == parsed, name
    with pytest.raises(ValueError, match="unknown format"):
        normalize(df, "csv")


def _us(*parts, micros=0, east=0):
    """Microseconds of a UTC time that reads ``parts`` on a clock ``east`` minutes ahead."""
    at = dt.datetime(*parts, tzinfo=dt.timezone.utc) - dt.timedelta(minutes=east)
    return int(at.timestamp()) * 10**6 + micros


def test_times(spark):
    cases = {
        "2031-07-08T09:10:11.121314156Z": _us(2031, 7, 8, 9, 10, 11, micros=121314),
        "2031-07-08T09:10:11,9-03:30": _us(2031, 7, 8, 9, 10, 11, micros=900000, east=-210),
        "2031-07-08T9:10:11Z": _us(2031, 7, 8, 9, 10, 11),
        "2031-07-08T09:10:11": _us(2031, 7, 8, 9, 10, 11),
        "2031-07-08  09:10:11.75": _us(2031, 7, 8, 9, 10, 11, micros=750000),
        "0229 22:33:44.000055": _us(2000, 2, 29, 22, 33, 44, micros=55),
        "1940827272": 1940827272 * 10**6,
        "1940827272606": 1940827272606 * 10**3,
        "-940827272": -940827272 * 10**6,
        "2031-07-08": None,
        "2031-06-31T00:00:00Z": None,
        "2031-07-08T24:00:00Z": None,
        "2031-07-08 09:10:11Z": None,
        "19408272726": None,
        "": None,
    }
    got = scalar(lit_rows(spark, list(cases)), parse_micros(F.col("s")))
    assert dict(zip(cases, got, strict=True)) == cases


def test_clock_is_the_producers(spark):
    got = ordered(normalize(lines(spark, [
        '{"ts":"2031-07-08T21:22:23-09:00"}', '{"ts":1940827272}',
        "I1130 05:06:07.8 9 winch.cc:2] slack", '{"ts":"0001-01-01T00:00:00Z","t":"1940827272"}',
    ])))
    assert [r.clock for r in got] == ["21:22:23", "06:41:12", "05:06:07", "06:41:12"]
    assert pairs(got[3]) == []


def test_text_helpers(spark):
    assert scalar(lit_rows(spark, ["plain", f"{ESC}[1;31mERR{ESC}[0m done"]),
                  strip_ansi(F.col("s"))) == ["plain", "ERR done"]
    assert scalar(lit_rows(spark, ['a "b" \\c', "x\x07\u200b\x7f"]), quote(F.col("s"))) == [
        '"a \\"b\\" \\\\c"', '"x\\a\\u200b\\x7f"'
    ]
    assert scalar(lit_rows(spark, ["\\U0001f600\\v\\101"]), unescape(F.col("s"))) == [
        "\U0001f600\x0bA"
    ]


_json_value = st.recursive(
    st.none() | st.booleans() | st.integers(-10**12, 10**12) | st.text(max_size=8)
    | st.floats(allow_nan=False, allow_infinity=False).filter(lambda x: x == x),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=3), inner, max_size=3),
    max_leaves=6,
)


def _shown(value):
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


@settings(max_examples=3, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text(max_size=4).map(lambda k: "k" + k), _json_value, max_size=4),
                min_size=40, max_size=60),
       st.lists(st.text(max_size=30), min_size=20, max_size=40))
def test_any_object_decodes_and_any_line_is_kept(spark, objects, noise):
    docs = [json.dumps(o) for o in objects]
    noise = [n.replace("\n", " ") for n in noise]
    got = ordered(normalize(lines(spark, docs + noise)))
    for row, obj in zip(got, objects, strict=False):
        assert row.parsed and pairs(row) == [(k, _shown(v)) for k, v in obj.items()], row.raw
    for row, line in zip(got[len(docs):], noise, strict=True):
        assert row.raw == line
        assert row.parsed or (row.message, row.fields, row.ts) == ("", [], None)


def test_register_format(spark):
    register_format(
        "bar", lambda c: c.rlike("^[A-Z]+\\|"),
        lambda raw: F.array(
            F.struct(F.lit("level").alias("key"), F.substring_index(raw, "|", 1).alias("value")),
            F.struct(F.lit("msg").alias("key"), F.substring_index(raw, "|", -1).alias("value")),
        ),
    )
    try:
        row = ordered(normalize(lines(spark, ["WARN|careful"])))[0]
        assert (row.format, row.level, row.message) == ("bar", 3, "careful")
    finally:
        FORMATS.pop()
        del FORMAT_NAMES["bar"]
