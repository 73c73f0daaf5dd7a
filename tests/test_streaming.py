"""Streams read to their end give what the batch operators give."""

import time

from pyspark.sql import functions as F

from logloom.operators.columns import constant_fields
from logloom.operators.correlate import corr_groups, related_events, remembered
from logloom.operators.fold import fold_session
from logloom.plans.derived import log_lines
from logloom.plans.pipeline import enrich
from logloom.sources.sinks import write_stream
from logloom.streaming.live import (
    LateRows,
    latest,
    live_counts,
    live_sessions,
    live_templates,
    split_timed,
    upserted,
)
from logloom.streaming.stateful import fold_stream, mark_stream

SF = "/root/testdata/sf0.001"


def _stream(spark, tmp_path, rows, name, parts=3):
    """A stream of files, in three batches by position."""
    folder = str(tmp_path / name)
    rows = rows.orderBy("pos").coalesce(1)
    step = rows.agg(F.max("pos")).first()[0] // parts + 1
    for i in range(parts):
        part = rows.filter((F.col("pos") >= i * step) & (F.col("pos") < (i + 1) * step))
        part.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _drain(stream, tmp_path, name):
    out = str(tmp_path / f"{name}-out")
    query = write_stream(stream, out, str(tmp_path / f"{name}-cp"), available_now=True)
    query.awaitTermination(180)
    assert query.exception() is None
    return stream.sparkSession.read.parquet(out), query


def test_stateless_counts_and_marks(spark, tmp_path):
    lines = log_lines(spark, SF).filter("pos < 400").cache()
    records = enrich(lines).cache()
    source = _stream(spark, tmp_path, lines, "lines")

    got, _ = _drain(mark_stream(enrich(source)), tmp_path, "marks")
    marks = {(r.stream_id, r.pos): r for r in got.collect()}
    known = remembered(records)
    groups = {(r.stream_id, r.pos): r.corr_key for r in corr_groups(known).collect()}
    links = {(r.stream_id, r.pos): r.related for r in related_events(known).collect()}
    flags = {}
    for r in constant_fields(records).collect():
        flags.setdefault((r.stream_id, r.pos), set()).add(r.i)
    assert len(marks) == records.filter("parsed").count()
    assert {k: m.corr_key for k, m in marks.items() if m.corr_key} == groups and groups
    assert {k: m.related_pos for k, m in marks.items() if m.related_pos is not None} == {
        k: v.pos for k, v in links.items()
    }
    assert {k: set(m.constant) for k, m in marks.items() if len(m.constant)} == flags and flags


def _updating(stream, tmp_path, name, keys):
    out = str(tmp_path / f"{name}-out")
    query = (
        stream.writeStream.outputMode("update").foreachBatch(lambda rows, b: upserted(rows, b, out))
        .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    return latest(stream.sparkSession.read.parquet(out), keys), query


def test_untimed_lines_do_not_move_event_time(spark, tmp_path):
    """All formats in three batches: nothing is lost, and nothing is late."""
    lines = log_lines(spark, SF)
    records = enrich(lines).cache()
    source = _stream(spark, tmp_path, lines, "mixed")
    keys = ["start", "timed", "stream_id"]
    total = {}
    for n, part in enumerate(split_timed(enrich(source), "1 minute")):
        got, _ = _updating(live_counts(part, "10 seconds"), tmp_path, f"part{n}", keys)
        counts = ("errors", "warns", "infos", "unknown", "passthrough")
        for r in got.collect():
            total[r.timed] = total.get(r.timed, 0) + sum(r[c] for c in counts)
    full = records.filter("ts is not null and format <> 'glog'").count()
    assert total == {True: full, False: records.count() - full} and full > 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    import datetime as dt

    def at(minute):
        return dt.datetime(2026, 3, 1, 9, minute)

    rows = spark.createDataFrame(
        # The second batch lifts the watermark to 9:20; rows are held against that of the
        # batch before, so the row of 9:02 in the fourth is late.
        [("s", 0, at(1)), ("s", 1, at(2)), ("s", 2, at(20)), ("s", 3, at(21)),
         ("s", 4, at(22)), ("s", 5, at(23)), ("s", 6, at(2)), ("s", 7, at(24))],
        "stream_id string, pos long, ts timestamp",
    ).selectExpr("*", "true as parsed", "4 as effective", "'json' as format", "'T' as template", "'t' as text")
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        source = _stream(spark, tmp_path, rows, "late", parts=4)
        timed, _ = split_timed(source, "1 minute")
        got, query = _updating(live_counts(timed, "1 minute"), tmp_path, "late", ["start", "timed", "stream_id"])
        want = {at(1): 1, at(2): 1, at(20): 1, at(21): 1, at(22): 1, at(23): 1, at(24): 1}
        assert {r.start: r.errors for r in got.collect()} == want
        end = time.time() + 30
        while time.time() < end and not listener.dropped.get(str(query.id)):
            time.sleep(0.2)
        assert listener.dropped[str(query.id)] == 1
    finally:
        spark.streams.removeListener(listener)


def test_live_sessions(spark, tmp_path):
    records = enrich(log_lines(spark, SF)).filter(
        (F.col("format") == "json") & F.col("ts").isNotNull()
    ).select("stream_id", "pos", "ts", "parsed", "effective", "template", "text").cache()
    source = _stream(spark, tmp_path, records, "json")
    sessions, _ = _drain(live_sessions(source), tmp_path, "sessions")
    every = {tuple(r) for r in fold_session(records).collect()}
    ended = {tuple(r) for r in sessions.collect()}
    assert ended <= every and len(ended) > len(every) // 2
    # Narrow time slices give the same runs.
    assert {tuple(r) for r in fold_session(records, slices=2).collect()} == every


def test_fold_on_a_timer(spark, tmp_path):
    rows = spark.createDataFrame(
        [("s", 0, True, "a"), ("s", 1, True, "b"), ("s", 2, True, "a"), ("s", 3, False, None),
         ("s", 4, True, "c"), ("s", 5, True, "c")],
        "stream_id string, pos long, parsed boolean, template string",
    )
    source = _stream(spark, tmp_path, rows, "runs", parts=1)
    out = str(tmp_path / "runs-out")
    query = write_stream(fold_stream(source), out, str(tmp_path / "runs-cp"), every="500 milliseconds")
    want = {("s", 0, 2, "a"), ("s", 1, 1, "b"), ("s", 4, 2, "c")}
    got = set()
    end = time.time() + 90
    while time.time() < end and got != want:
        time.sleep(1)
        try:
            got = {tuple(r) for r in spark.read.parquet(out).collect()}
        except Exception:  # nothing written yet
            got = set()
    query.stop()
    assert got == want


def test_templates_per_window(spark):
    records = enrich(log_lines(spark, SF, "json")).withColumns(
        {"at": F.col("ts"), "timed": F.lit(True)})
    got = live_templates(records, "1 minute")
    want = records.filter("effective >= 3")
    assert got.agg(F.sum("n")).first()[0] == want.count() > 0
    assert got.select("start", "stream_id", "template").distinct().count() == got.count()


def test_batches_of_a_followed_folder_grow_with_it(spark, tmp_path, monkeypatch):
    from logloom.plans import catalog

    monkeypatch.setattr(catalog, "_PER_BATCH", (100, 1000))
    counts = []
    for lines in (20, 200, 2000):
        logs = tmp_path / f"logs{lines}"
        (logs / "s").mkdir(parents=True)
        for i in range(2):
            (logs / "s" / f"{i}").write_text("123456789\n" * (lines // 2))
        seen = []
        catalog._read_to_end(
            catalog._followed_lines(spark, str(logs)).writeStream
            .foreachBatch(lambda rows, batch, seen=seen: seen.append(rows.count()))
            .option("checkpointLocation", str(tmp_path / f"done{lines}")))
        assert sum(seen) == lines
        counts.append(len(seen))
    assert counts[0] == 2 and max(counts) <= 26


def test_state_has_a_partition_a_core_at_most(spark):
    from logloom.streaming.stateful import state_store

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        with state_store(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
