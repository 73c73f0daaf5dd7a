"""Exact top-k search and WARC archives."""

import base64
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import registry, topk, warc

_LONG = 2**63 - 1


@pytest.mark.parametrize("cell", [(16, 4, 16), (1, 1, 2), (2, 3, 2)])
def test_top_k_equals_brute_force(spark, monkeypatch, cell):
    for name, value in zip(("BLOCKS", "SHARDS", "FAN"), cell):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)], "q") for i in range(137)]
    rows += [
        (200, None, "a"), (201, [1.0, None, 2.0, 3.0], "a"), (202, [float("nan")] * 4, "a"),
        (203, [float("inf")] * 4, "b"), (250, [1.0, 2.0], "x"), (251, [3.0, 4.0], "y"),
        (300, [1e30, 0.0, 0.0, 1.0], "h"), (301, [1e30, 0.0, 0.0, 1.0], "h"), (None, [1.0] * 4, "n"),
        (7, rows[7][1], "repeated"), (302, rows[3][1], "tie"), (303, [], "e"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard=16, block=2).collect())
    able = [
        (i, [math.floor(256 * x) if abs(256 * x) < 2**52 else int(256 * x) for x in v]) for i, v, _ in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in able:
        if q % 50 == 0:
            found = [(-max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(v, w)))), i)
                     for i, w in able if i != q and len(w) == len(v)]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:5], 1)]
    assert got == sorted(want) and got
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_tiles_are_bounded_by_bytes(spark):
    rows = spark.range(64).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(1.0), 100).alias("embedding"))
    tiles = topk._gathered(topk.usable(rows.coalesce(1)), 50, 8000).select("ids", "data").collect()
    assert sum(len(t.ids) for t in tiles) == 64 * 8 and max(len(t.data) for t in tiles) <= 16_000 and len(tiles) >= 4


def _pages(rows):
    first = {}
    for i, _, html in rows:
        first.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        lead = min(first[body])
        out.append((i, len(body), digest, "response" if i == lead else "revisit", None if i == lead else lead))
    return sorted(out)


ROWS = [
    (7, "http://a", "x"), (3, "http://b", "x"), (9, None, None), (8, "u\r\nv", ""), (14, "z", "x"),
    # Payloads and addresses that hold the line by which records are told apart.
    (11, "q", "abc WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nfoo\r\n\r\nWARC/1.1\r\n"),
    (12, "q", "WARC/1.1\r\nWARC/1.1\r\n"), (15, "zz", "WARC/1.1"), (17, "aWARC/1.1", "y"),
    (13, "z", "é\U0001f600\r\n\r\n" * 1000), (16, "zz", "\r\n"),
]


def test_archives_round_trip(spark, tmp_path):
    folder = str(tmp_path)
    schema = "page_id long, url string, html string, digest string"
    spark.createDataFrame([(*r, "extra") for r in ROWS], schema).write.parquet(f"{folder}/pages.parquet")
    got = registry.op2_warc_assembly(spark, folder)
    order = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == _pages(ROWS)


def test_transactions_are_nested(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    found = warc.payloads(warc.read(spark, path))
    assert found.where("block is null").count() == 0
    rows = warc.assembled(found).collect()
    assert len(rows) == len(ROWS)
    assert all(r.request.type == "request" and r.metadata.type == "metadata" for r in rows)
    assert all(r.request.concurrent_to == r.response.record_id == r.metadata.concurrent_to for r in rows)
    bodies = {bytes(r.response.payload).decode() for r in rows if r.response.type == "response"}
    assert bodies == {html or "" for _, _, html in ROWS}
    # A request whose response is lost is a capture by itself.
    part = found.where("type <> 'response' or digest is null")
    assert warc.assembled(part).where("response is null").count() > 0


def test_repeated_and_small_pages(spark, tmp_path):
    df = spark.createDataFrame([(2, "a", "same"), (2, "a", "same"), (4, "b", "same"), (5, "c", "s"), (6, "d", "s")],
                               "page_id long, url string, html string")
    got = warc.captures(df, min_bytes=2).groupBy("page_id").agg(
        F.count_if(F.col("refers_to_id").isNull()).alias("r"), F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(2, 1, 2), (4, 0, 1), (5, 1, 1), (6, 1, 1)]
    path = str(tmp_path / "none")
    warc.write(df.limit(0), path)
    assert warc.assembled(warc.read(spark, path)).count() == 0
