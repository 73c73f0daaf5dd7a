"""States merged batch by batch: the report, and late rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from helpers import records
from logloom.operators import runs
from logloom.operators.runs import fold_runs
from logloom.operators.summary import summary_report
from logloom.sources.sinks import write_stream
from logloom.streaming.live import live_report, merge_report, split_late
from logloom.streaming.stateful import fold_stream, open_runs


def _records(spark, n=300):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        level = rng.choice([0, 1, 2, 3, 4, 4])
        kind = min(int(rng.expovariate(0.08)), 90)
        rows.append({
            "stream": rng.choice("ab"), "level": level, "parsed": rng.random() < 0.9,
            "ts": dt.datetime(2031, 1, 1, 0, 0, i % 60) if rng.random() < 0.8 else None,
            "clock": f"00:{i // 60:02}:{i % 60:02}", "message": f"kind {kind} number {i}",
        })
    df = records(spark, rows)
    return df.withColumns({
        "template": F.concat("effective", F.lit("|"), F.regexp_extract("message", r"kind \d+", 0)),
        "text": F.col("message")}).cache()


def test_report_of_batches_equals_the_whole(spark, tmp_path):
    df = _records(spark)
    for cap, name in ((5, "few"), (64, "all")):
        path = str(tmp_path / name)
        for batch, low in enumerate(range(0, 300, 75)):
            merge_report(df.where((F.col("pos") >= low) & (F.col("pos") < low + 75)), batch, path, cap)
            if batch == 2:  # runs again, as after a failure
                merge_report(df.where((F.col("pos") >= low) & (F.col("pos") < low + 75)), batch, path, cap)
        got = {r.stream_id: r.report for r in live_report(spark, path).collect()}
        assert got == {r.stream_id: r.report for r in summary_report(df, cap).collect()}
        state = spark.read.parquet(f"{path}/batch={3:012d}")
        assert state.where("tracked").groupBy("stream_id").count().agg(F.max("count")).first()[0] <= cap


def test_empty_batches(spark, tmp_path):
    df, path = _records(spark, 40), str(tmp_path / "s")
    for batch in range(3):
        merge_report(df if batch == 1 else df.limit(0), batch, path)
    assert live_report(spark, path).count() == 2


def test_late_rows_are_kept(spark, tmp_path):
    def at(minute):
        return dt.datetime(2031, 1, 1, 9, minute)

    minutes = [[1, 2], [20, 2, 21], [21, 19, 18, 2], [3, 30]]
    path = str(tmp_path)
    for batch, some in enumerate(minutes):
        rows = spark.createDataFrame([(batch, i, at(m)) for i, m in enumerate(some)], "b int, i int, ts timestamp")
        for _ in range(2):
            split_late(rows, batch, path, "2 minutes")
    late = sorted((r.b, r.i) for r in spark.read.parquet(f"{path}/late").collect())
    fine = sorted((r.b, r.i) for r in spark.read.parquet(f"{path}/on_time").collect())
    # Held against the batches before: 2:00 is late from the third batch on, 19:00 is not.
    assert late == [(2, 2), (2, 3), (3, 0)]
    assert sorted(late + fine) == [(b, i) for b, some in enumerate(minutes) for i in range(len(some))]


def test_fold_by_records_alone_leaves_open_runs_in_the_state(spark, tmp_path):
    rng = random.Random(6)
    rows = [(s, i, t is not None, t) for s in "xy" for i, t in enumerate(
        rng.choice(["a", "b", "c", "d", None] if i % 50 == 0 else list("abcdefghijkl"[: 3 + i // 40])) for i in range(400))]
    df = spark.createDataFrame(rows, "stream_id string, pos long, parsed boolean, template string")
    folder, out, done = (str(tmp_path / n) for n in ("in", "out", "done"))
    for low in range(0, 400, 100):
        df.where((F.col("pos") >= low) & (F.col("pos") < low + 100)).repartition(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = write_stream(fold_stream(source, held=False), out, done, available_now=True)
    query.awaitTermination(180)
    columns = ["stream_id", "head_pos", "repeat", "template"]
    got = spark.read.parquet(out).unionByName(open_runs(spark, done)).select(*columns)
    want = fold_runs(df, chunk=runs.LOOKBACK + 2, size=64).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
