"""Summaries, frames, links, text, files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import ordered, records
from logloom.operators import summary
from logloom.operators.frames import github_url, resolve_frames, resolve_paths
from logloom.operators.identity import identify
from logloom.operators.render import format_lines
from logloom.operators.stack import extract_stack
from logloom.plans.pipeline import Options, run
from logloom.sources.lines import join_files, kafka_lines, read_lines, split_long
from logloom.sources.sinks import (
    read_streams,
    stream_index,
    write_lines,
    write_records,
    write_streams,
    write_summary,
)

RULE = "── summary " + "─" * 45


def _letters(i):
    return chr(97 + i // 26) + chr(97 + i % 26)


def _report(spark, rows):
    df = identify(extract_stack(records(spark, rows)))
    return [r.report for r in summary.summary_report(df).orderBy("stream_id").collect()]


def test_report(spark):
    at = dt.datetime(2026, 7, 21, 14, 29, 1)
    rows = (
        [dict(message="write failed after 3 tries", level=4, ts=at, clock="14:29:01")]
        + [dict(message="rare", level=4), dict(message="slow\nreply", level=3)]
        + [dict(message="write failed after 17 tries", level=4,
                ts=at + dt.timedelta(seconds=226), clock="14:32:47")]
        + [dict(message="fine")] * 2 + [dict(message="?", level=0)]
        + [dict(parsed=False, raw="x")] * 3
        + [dict(stream="t", message="fine")]
    )
    assert _report(spark, rows) == [
        RULE + "\n3 errors (2 unique) · 1 warn (1 unique) · 2 info · 1 unknown · 3 passthrough\n"
        "span 14:29:01–14:32:47\n\n"
        "  ERR  ×2  write failed after 3 tries\n  ERR  ×1  rare\n  WARN ×1  slow reply",
        RULE + "\n0 errors · 0 warns · 1 info",
    ]


def test_report_caps(spark):
    rows = [dict(message="failure " + _letters(i), level=4) for i in range(67)]
    rows.append(dict(message="failure " + _letters(1), level=4))
    lines = _report(spark, rows)[0].split("\n")
    assert lines[1] == "68 errors (64 unique) · 0 warns"
    assert lines[3] == "  ERR  ×2  failure ab" and lines[4] == "  ERR  ×1  failure aa"
    assert lines[11:] == [
        "  … +56 more", "  … +3 more warn/error lines beyond the tracked templates"
    ]


def test_line_text(spark):
    df = records(spark, [
        dict(message="boom\n now", level=2, effective=4, clock="04:29:01",
             fields=[("svc", "a", True), ("q", 'say "x"'), ("k", "v")]),
        dict(parsed=False, raw="keep — me"),
        dict(message="fine"),
    ])
    related = F.struct(
        F.lit(1).cast("long").alias("pos"), F.lit(None).cast("timestamp").alias("ts"),
        F.lit(None).cast("string").alias("clock"), F.lit("a tear").alias("summary"),
    )
    df = df.withColumns({
        "corr": F.when(F.col("pos") == 0, "c7"), "repeat": F.lit(3),
        "related": F.when(F.col("pos") == 2, related),
    })
    assert [r.line for r in ordered(format_lines(df))] == [
        '04:29:01 INFO→ERR  ⟨c7⟩ boom now  ×3  q="say \\"x\\"" k=v ·svc=a',
        "keep — me",
        "--:--:-- INFO  fine  ×3\n    ↳ likely related: a tear",
    ]


def test_stack_text(spark):
    trace = (
        "oops\ngoroutine 1 [x]:\na/one.F()\n\ta/one.go:1\nb/two.F()\n\tb/two.go:2\n"
        "c/three.F()\n\tc/three.go:3\nd/four.F()\n\td/four.go:4\nmain.run(0x1)\n\t/src/shop/m.go:9 +0x1"
    )
    df = extract_stack(records(spark, [dict(message=trace, level=4)]), module="shop")
    folded, opened = (ordered(format_lines(df, expand_stack=e))[0].line for e in (False, True))
    assert folded.split("\n") == [
        "--:--:-- ERR  oops", "    … 4 framework frames (a, b, c, …)", "    ► m.go:9  main.run",
    ]
    assert opened.split("\n")[1] == "       one.go:1  a/one.F" and len(opened.split("\n")) == 6


def test_urls(spark):
    df = spark.createDataFrame(
        [(0, "github.com/acme/shop/internal/a.go", 72), (1, "acme/shop/b.go", 0),
         (2, "/srv/notacme/shop/c.go", 1), (3, "example.com/mod/d.go", 5), (4, "/x/app/e.py", 6)],
        "i int, file string, line int",
    )
    file, line = F.col("file"), F.col("line")

    def urls(spec, **kw):
        return [r[0] for r in df.select(github_url(spec, file, line, **kw), "i").orderBy("i").collect()]

    base = "https://github.com/acme/shop/blob/"
    resolved = F.when(F.col("i") == 4, "app/e.py")
    assert urls("acme/shop", module="example.com/mod", resolved=resolved) == [
        base + "main/internal/a.go#L72", base + "main/b.go", None, base + "main/d.go#L5",
        base + "main/app/e.py#L6",
    ]
    assert urls("acme/shop@v1")[0] == base + "v1/internal/a.go#L72"
    for bad in ("noslash", "owner/", "/repo", "owner/repo@"):
        with pytest.raises(ValueError):
            github_url(bad, file, line)


def test_longest_suffix(spark):
    files = spark.createDataFrame(
        [("github.com/x/internal/rpc/a.go",), ("/app/none.go",), ("/srv//internal/./b.go",)],
        "file string",
    )
    inventory = spark.createDataFrame(
        [("rpc/a.go",), ("internal/rpc/a.go",), ("a.go",), ("internal/b.go",)], "path string"
    )
    got = {r.file: r.path for r in resolve_paths(files, inventory).collect()}
    assert got == {
        "github.com/x/internal/rpc/a.go": "internal/rpc/a.go",
        "/srv//internal/./b.go": "internal/./b.go",
    }


def test_files(spark, tmp_path):
    one, two = tmp_path / "in" / "a.log", tmp_path / "in" / "b.log"
    one.parent.mkdir()
    body = [f"line {i}" for i in range(2_000)]
    one.write_bytes(("\n".join(body) + "\n").encode())
    two.write_bytes(b"x\r\ny\rz\n\nlast")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_lines(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by_file = {}
    for r in sorted(got, key=lambda r: (r.stream_id, r.pos)):
        by_file.setdefault(r.stream_id[-5:], []).append((r.pos, r.raw))
    assert [raw for _, raw in by_file["a.log"]] == body
    assert [raw for _, raw in by_file["b.log"]] == ["x", "y\rz", "", "last"]
    assert len({p for p, _ in by_file["a.log"]}) == len(body)
    joined = ordered(join_files(
        read_lines(spark, str(tmp_path / "in")), F.lit("both"), size=300
    ))
    assert [r.raw for r in joined] == body + ["x", "y\rz", "", "last"]
    assert [r.pos for r in joined] == list(range(len(joined)))
    short, long = split_long(read_lines(spark, str(two)), limit=3)
    assert (short.count(), long.count()) == (2, 2)


def test_kafka_columns(spark):
    df = spark.createDataFrame(
        [("app", 3, 41, bytearray(b"hello\r"))],
        "topic string, partition int, offset long, value binary",
    )
    assert [tuple(r) for r in kafka_lines(df).collect()] == [("app-3", 41, "hello")]


def test_whole_pipeline_to_files(spark, tmp_path):
    source = tmp_path / "app.log"
    call = '{"time":"2026-06-29T04:29:0%dZ","level":"INFO","msg":"%s","svc":"a","rpc.method":"M"}'
    source.write_text("\n".join([
        call % (1, "fatal tear in M at 10.0.0.1:5"), call % (2, "call ended"),
        call % (3, "call ended"), "plain", call % (4, "fatal tear in M at 10.0.0.1:6"),
    ]))
    lines = read_lines(spark, str(source))
    out = run(lines, Options(folding="runs")).cache()
    text = [r.line for r in ordered(format_lines(out))]
    tag = text[3].split("⟨")[1].split("⟩")[0]
    assert text == [
        "04:29:01 INFO→ERR  fatal tear in M at 10.0.0.1:5  svc=a rpc.method=M",
        "04:29:02 INFO  call ended  ×2  svc=a rpc.method=M\n"
        "    ↳ likely related: fatal tear in M at 10.0.0.1:5 @04:29:01",
        "plain",
        f"04:29:04 INFO→ERR  ⟨{tag}⟩ fatal tear in M at 10.0.0.1:6  ·svc=a ·rpc.method=M",
    ]
    islands = run(lines, Options(folding="islands", level="warn", columns=False))
    assert [(r.pos - ordered(out)[0].pos, r.repeat) for r in ordered(islands)] == [
        (0, 1), (3, 0), (4, 1)
    ]
    write_lines(format_lines(out), str(tmp_path / "text"), partitions=1)
    (written,) = (tmp_path / "text").glob("*.txt")
    assert written.read_text().rstrip("\n") == "\n".join(text)
    write_records(out, str(tmp_path / "records"))
    assert spark.read.parquet(str(tmp_path / "records")).count() == 4
    report = summary.summary_report(out)
    write_summary(report, str(tmp_path / "summary"))
    (stream, text), = report.collect()
    assert [r.report for r in read_streams(spark, str(tmp_path / "summary"), stream).collect()] == [text]


def test_summary_aggregates_by_hash(spark):
    df = records(spark, [{"level": 4, "message": f"m{i % 3}", "stream": "ab"[i % 2]} for i in range(9)]).withColumns(
        {"template": F.col("message"), "text": F.concat("message", F.lit(" "), F.col("pos").cast("string"))})
    narrow = summary.narrowed(df)
    for out in (summary.tallies(narrow), summary.summary_counts(df)):
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = summary.template_counts(df)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    first = {}
    for r in df.orderBy("pos").collect():
        first.setdefault((r.stream_id, r.template), (r.pos, r.text))
    assert {(r.stream_id, r.template): (r.first_pos, r.text) for r in got.collect()} == first


def test_many_streams_in_few_folders(spark, tmp_path):
    rows = spark.range(3_000).select(
        F.concat(F.lit("stream/"), (F.col("id") % 500).cast("string")).alias("stream_id"), F.col("id").alias("pos"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    path = str(tmp_path / "streams")
    write_streams(rows, path, folders=7, partitions=4)
    assert len(list((tmp_path / "streams").glob("folder=*"))) == 7
    assert sorted(map(tuple, read_streams(spark, path).select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    one = read_streams(spark, path, "stream/123")
    assert [r.pos for r in one.orderBy("pos").collect()] == list(range(123, 3_000, 500))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(folder#", "folder#").replace("(folder", "folder")
    index = {r.stream_id: (r.rows, r.first_pos, r.last_pos) for r in stream_index(spark, path).collect()}
    assert len(index) == 500 and index["stream/123"] == (6, 123, 2_623)
    assert read_streams(spark, path, "absent").count() == 0


def test_heavy_files_stay_where_they_are(spark):
    """Half of the frames in one file, the rest in many; null files have no path."""
    frames = spark.range(4_000).select(
        F.col("id").alias("i"),
        F.when(F.col("id") % 2 == 0, "/app/src/hot.go").when(F.col("id") % 500 == 1, None)
        .otherwise(F.concat(F.lit("/app/src/f"), (F.col("id") % 997).cast("string"), F.lit(".go"))).alias("file"))
    inventory = spark.createDataFrame([("src/hot.go",), ("f7.go",), ("src/f9.go",)], "path string")
    plain = {"/app/src/hot.go": "src/hot.go", "/app/src/f7.go": "f7.go", "/app/src/f9.go": "src/f9.go"}
    got = resolve_frames(frames, inventory)
    assert got.columns == ["i", "file", "path"]
    rows = got.collect()
    assert len(rows) == 4_000 and all(r.path == plain.get(r.file) for r in rows)
    # What is joined by file holds no heavy one.
    assert resolve_frames(frames.limit(0), inventory).count() == 0
