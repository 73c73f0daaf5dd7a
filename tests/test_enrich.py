"""Severity, stacks, templates, keys and filters."""

import pytest
from pyspark.sql import functions as F

from helpers import lit_rows, ordered, pairs, records, scalar
from logloom.operators.identity import corr_tag, identify, mask, summarize
from logloom.operators.severity import rerank_severity
from logloom.operators.stack import extract_stack
from logloom.operators.where import where

GO = (
    "fatal: ledger 10.9.8.7 is torn\n"
    "goroutine 4096 [sleep]:\n"
    "time.Sleep(0x3b9aca00)\n"
    "\ttime/sleep.go:12 +0x5\n"
    "github.com/acme/mill/grind.(*wheel).Turn(0x7, [0x1])\n"
    "\tgithub.com/acme/mill/grind/wheel.go:301\n"
    "dev.corp.io/pump.Drive[...](0x2)\n"
    "\tdev.corp.io/pump@v0.9.2/drive.go:18 +0x44\n"
    "dev.corp.io/pump.(*Rod).push({0x8, 0x3})\n"
    "\tdev.corp.io/pump@v0.9.2/rod.go:77 +0x10\n"
    "created by sync.spawn in goroutine 6\n"
    "\tsync/spawn.go:9 +0x1b"
)
NODE = (
    "RangeError: too deep\n"
    "    at new Tree (/srv/mill/lib/tree.mjs:8:20)\n"
    "    at D:\\mill\\node_modules\\walk\\step.js:61:4\n"
    "    at /srv/mill/lib/root.mjs:17:1\n"
    "    at Walker.go (/srv/mill/node_modules/walk/index.js:230:33)\n"
    "    at runMain (node:internal/modules/run_main:154:12)"
)


def test_severity(spark):
    rows = [
        (dict(message="PANIC: the keel split"), 4),
        (dict(message="pilot boat failed to answer"), 3),
        (dict(message="berth 9", fields=[("error", "crane: error")]), 3),
        (dict(message="berth 9", fields=[("error", ""), ("error", "fatal")]), 2),
        (dict(message="calm sea", level=4), 4),
        (dict(message="casting off"), 2),
        (dict(message="lock gate timeout", level=0), 3),
        (dict(parsed=False, raw="panic on the pier", level=0), 0),
    ]
    got = ordered(rerank_severity(records(spark, [r for r, _ in rows])))
    assert [r.effective for r in got] == [e for _, e in rows]


def test_stacks(spark):
    bare = "goroutine 9 [IO wait]:\nmain.poll()\n\tgithub.com/acme/mill/poll.go:5 +0x3"
    got = ordered(extract_stack(records(spark, [
        dict(message=GO),
        dict(message="order lost", fields=[("queue", "q4"), ("cause", GO), ("trace", NODE)]),
        dict(message="order lost", fields=[("trace", bare)]),
        dict(message="", fields=[("trace", NODE)]),
        # marked like a trace, but without a header line of one
        dict(message="report", fields=[("body", "each goroutine sleeps\nnone woke up")]),
        dict(message="agenda\n    at noon: lunch\n    at 17:45: end"),
        dict(message="    at g (/x/y.mjs:3:4)"),
        # a Go header without frames is no trace, and Node is not asked
        dict(message="goroutine 9 [IO wait]:\n    at g (/x/y.mjs:3:4)"),
        dict(message=bare.replace("\n", "\r\n")),
        dict(message=GO, parsed=False),
    ]), module="github.com/acme"))
    kinds = [f.kind for f in got[0].stack.frames]
    assert kinds == ["stdlib", "project", "thirdparty", "thirdparty", "stdlib"]
    assert got[0].stack.header == "fatal: ledger 10.9.8.7 is torn"
    assert tuple(got[0].stack.frames[1])[:4] == (
        "github.com/acme/mill/grind.(*wheel).Turn", "github.com/acme/mill/grind/wheel.go", 301, 0,
    )
    assert got[0].stack.frames[4].func == "sync.spawn"
    assert [k for k, _ in pairs(got[1])] == ["queue", "trace"] and got[1].stack.lang == "go"
    assert got[2].stack.header == "order lost"
    assert tuple(got[2].stack.frames[0]) == (
        "main.poll", "github.com/acme/mill/poll.go", 5, 0, "project"
    )
    assert got[3].stack.header == "RangeError: too deep" and got[3].fields == []
    assert [tuple(f) for f in got[3].stack.frames] == [
        ("new Tree", "/srv/mill/lib/tree.mjs", 8, 20, "project"),
        ("<anonymous>", "D:\\mill\\node_modules\\walk\\step.js", 61, 4, "thirdparty"),
        ("<anonymous>", "/srv/mill/lib/root.mjs", 17, 1, "project"),
        ("Walker.go", "/srv/mill/node_modules/walk/index.js", 230, 33, "thirdparty"),
        ("runMain", "node:internal/modules/run_main", 154, 12, "stdlib"),
    ]
    assert got[4].stack is None and len(got[4].fields) == 1
    assert got[5].stack is None
    assert got[6].stack.header == "at g (/x/y.mjs:3:4)"
    assert [got[i].stack for i in (7, 8, 9)] == [None, None, None]


def test_long_traces(spark):
    """A dump of many goroutines is read in one pass over its lines."""
    n = 4000
    dump = "all stuck\ngoroutine 2 [select]:\n" + "".join(
        f"lib{i % 7}.example.org/a.F{i}(0x{i})\n\tlib/a{i}.go:{i} +0x1\n" for i in range(1, n + 1))
    row = extract_stack(records(spark, [dict(message=dump)])).first()
    assert len(row.stack.frames) == n
    assert tuple(row.stack.frames[n - 1])[:3] == (f"lib{n % 7}.example.org/a.F{n}", f"lib/a{n}.go", n)


def test_masks(spark):
    cases = {
        # the digit in the name of the address mask is masked in turn
        "dial [::1]:4317 in 0xfF": "dial <ip<n>>:<n> in <hex>",
        "id 123e4567-e89b-12d3-a456-426614174000.": "id <uuid>.",
        "\u00e910.0.0.1 x10.0.0.1 10.0.0.1": "\u00e9<ip> x<n>.<n>.<n>.<n> <ip>",
        "abcdefab-abcd-abcd-abcd-abcdefabcdef": "<uuid>",
        "no variable part": "no variable part",
    }
    got = scalar(lit_rows(spark, list(cases)), mask(F.col("s")))
    assert dict(zip(cases, got, strict=True)) == cases


def test_identity(spark):
    got = ordered(identify(extract_stack(records(spark, [
        dict(message="call 7", level=3, fields=[("component", ""), ("service", "s"),
                                                ("req_id", "r"), ("trace.id", "t")]),
        dict(message=GO, level=4),
        dict(message="x", fields=[("trace_id", ""), ("trace_id", "late"), ("rpc.method", "M")]),
        dict(parsed=False, raw="10.0.0.1"),
    ]), module="github.com/acme")))
    assert [r.template for r in got] == [
        "WARN\x00s\x00call <n>", "ERR\x00\x00fatal: ledger <ip> is torn", "INFO\x00\x00x", None
    ]
    assert [r.corr_key for r in got] == ["t", "10.9.8.7", None, None]
    assert [r.method for r in got] == [None, "Turn", "M", None]


def test_tag_and_summary(spark):
    # The published 32-bit FNV-1a values of these two, modulo 1000, in base 36.
    got = scalar(lit_rows(spark, ["a", "foobar"]), corr_tag(F.col("s")))
    want = [0xE40C292C % 1000, 0xBF9CF968 % 1000]
    assert [int(t[1:], 36) for t in got] == want and all(t[0] == "c" for t in got)
    got = scalar(lit_rows(spark, [" a\n\t b ", "x" * 61, "x" * 60]), summarize(F.col("s")))
    assert got == ["a b", "x" * 60 + "\u2026", "x" * 60]


def test_filters(spark):
    df = records(spark, [
        dict(message="call Tally", effective=2, fields=[("m", "TallySheet"), ("m", "other")]),
        dict(message="crack", level=2, effective=4, fields=[("e", "bad Ledger")]),
        dict(message="?", level=0),
        dict(parsed=False, raw="plain xyz"),
    ])

    def kept(**kw):
        return [r.pos for r in ordered(where(df, **kw))]

    assert kept() == [0, 1, 2, 3]
    assert kept(level="error") == [1, 3]
    assert kept(level="debug") == [0, 1, 3]
    assert kept(fields=["m=tally"]) == [0, 3]
    assert kept(fields=["m=other"]) == [3]
    assert kept(fields=["e="]) == [1, 3]
    assert kept(fields=["m=tally", "e="]) == [3]
    assert kept(pattern="Ledger|xyz") == [1, 3]
    assert kept(pattern="Sheet") == [0]
    assert kept(level="warn", pattern="nothing") == []
    for bad in (dict(level="verbose"), dict(pattern="(open"), dict(fields=["none"]),
                dict(fields=["=x"])):
        with pytest.raises(ValueError):
            where(df, **bad)
