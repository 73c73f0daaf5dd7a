"""Chunked look-back windows against plain loops over each stream."""

import random

from pyspark.sql import functions as F

from logloom.operators.columns import constant_fields
from logloom.operators.correlate import corr_groups, related_events
from logloom.operators.ordinals import with_ordinal

START = 1_780_000_000_000_000


def test_ordinals_are_dense_per_stream(spark):
    rnd = random.Random(1)
    rows = [(s, p) for s in "ab" for p in rnd.sample(range(5_000), 700)]
    df = spark.createDataFrame(rows, "stream_id string, pos long").repartition(3)
    got = sorted(tuple(r) for r in with_ordinal(df, "q", size=64).collect())
    want = sorted(
        (s, p, i) for s in "ab" for i, p in enumerate(sorted(p for t, p in rows if t == s))
    )
    assert got == want


def test_constant_fields_match_a_plain_ring(spark):
    rnd = random.Random(2)
    rows = []
    for stream in ("hot", "b"):
        for pos in range(900 if stream == "hot" else 200):
            fields = [("svc", "x" if pos % 300 > 5 else "y"), ("id", str(pos % 7))]
            if rnd.random() < 0.3:
                fields.append(("dup", rnd.choice("pq") if pos < 300 else "p"))
                fields.append(("dup", "p"))
            if rnd.random() < 0.1:
                fields = []
            rows.append((stream, pos, True, [(k, v, False) for k, v in fields]))
    df = spark.createDataFrame(
        rows,
        "stream_id string, pos long, parsed boolean, "
        "fields array<struct<key:string,val:string,demoted:boolean>>",
    ).repartition(3)
    want = []
    for stream in ("hot", "b"):
        ring = []
        for s, pos, _, fields in rows:
            if s != stream or not fields:
                continue
            ring = (ring + [fields])[-40:]
            for i, (key, _, _) in enumerate(fields):
                vals = [v for rec in ring for k, v, _ in rec if k == key]
                if len(vals) >= 3 and len(set(vals)) == 1:
                    want.append((stream, pos, i))
    got = constant_fields(df, window=40, chunk=64, size=100).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert want


def _records(spark, rnd, n, key_of):
    rows = []
    us = START
    for pn in range(n):
        us += rnd.choice([0, 200_000, 900_000, 4_000_000])
        shown = us + rnd.choice([0, 0, 0, -9_000_000, 70_000_000])
        rows.append(
            (
                "s", pn * 3, None if rnd.random() < 0.08 else shown, "00:00:00",
                rnd.choice([2, 2, 3, 4]), f"text {pn}", rnd.choice("TUV"),
                key_of(), rnd.choice(["m1", "m1", "m1", "m2", None]), pn,
            )
        )
    return rows, spark.createDataFrame(
        rows,
        "stream_id string, pos long, us long, clock string, effective int, text string, "
        "template string, corr_key string, method string, pn long",
    ).repartition(3)


def _close(a, b, span):
    return a is None or b is None or abs(a - b) <= span


def test_corr_groups_match_a_plain_window(spark):
    rnd = random.Random(3)
    rows, df = _records(spark, rnd, 700, lambda: rnd.choice(["hot", "hot", None, str(rnd.random())[:3]]))
    want = []
    for r in rows:
        recent = [e for e in rows[max(0, r[9] - 30): r[9]]]
        if r[7] and any(e[7] == r[7] and _close(e[2], r[2], 6_000_000) for e in recent):
            want.append(r[1])
    got = corr_groups(df, window=30, span_us=6_000_000, chunk=50)
    assert sorted(r.pos for r in got.collect()) == want
    assert want


def test_related_events_match_a_plain_window(spark):
    rnd = random.Random(4)
    rows, df = _records(spark, rnd, 700, lambda: None)
    want = {}
    for r in rows:
        for e in reversed(rows[max(0, r[9] - 30): r[9]]):
            if (
                r[8] and e[8] == r[8] and e[4] >= 3 and e[6] != r[6]
                and _close(e[2], r[2], 3_000_000)
            ):
                want[r[1]] = (e[1], e[5])
                break
    got = related_events(df, window=30, span_us=3_000_000, chunk=50).select(
        "pos", F.col("related.pos").alias("rel"), "related.summary"
    )
    assert {r.pos: (r.rel, r.summary) for r in got.collect()} == want
    assert want
