"""Files to lines, limits, patterns and folders by day."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import records
from logloom.operators.where import where
from logloom.plans.pipeline import Options, run
from logloom.sources.lines import read_lines
from logloom.sources.sinks import write_records


def test_file_filters_reach_the_scan(spark, tmp_path):
    for day, text in (("1", "a\nb\n"), ("2", "c\r\n\nd")):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "x.log").write_bytes(text.encode())
    got = read_lines(spark, str(tmp_path), keep=F.col("day") == 2)
    assert [r.raw for r in got.orderBy("pos").collect()] == ["c", "", "d"] and "day" in got.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_long_lines_are_set_apart(spark, tmp_path):
    lines = spark.createDataFrame(
        [("s", 0, "level=info msg=short"), ("s", 1, "x" * 500), ("s", 2, "level=warn msg=also")],
        "stream_id string, pos long, raw string")
    path = str(tmp_path / "long")
    out = run(lines, Options(max_line=500, rejects=path))
    assert sorted(r.pos for r in out.collect()) == [0, 2]
    assert [r.pos for r in spark.read.parquet(path).collect()] == [1]
    assert run(lines).count() == 3


def test_patterns_know_one_line_end(spark):
    df = records(spark, [dict(message="end\n"), dict(message="end"), dict(message="a\rb"), dict(message="cost$")])
    kept = lambda p: [r.pos for r in where(df, pattern=p).orderBy("pos").collect()]
    assert kept("end$") == [1] and kept("a.b") == [2] and kept(r"cost\$") == [3]


def test_days_are_utc(spark, tmp_path):
    rows = [("s", i, dt.datetime(2026, 6, 29, 23, 59, 59)) for i in range(3)] + [("s", 9, None)]
    df = spark.createDataFrame(rows, "stream_id string, pos long, ts timestamp")
    path = str(tmp_path / "days")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        write_records(df, path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = {str(r.day): r.n for r in spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n")).collect()}
    assert len(got) == 2 and got.pop("none") == 1 and list(got.values()) == [3]


def test_derived_lines_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    from logloom.plans import derived

    events = derived.table(spark, "/root/testdata/sf0.001", "events")
    rows = events.count()
    monkeypatch.setattr(derived, "ROWS", 50)
    got = derived.spread(events).rdd.glom().map(len).collect()
    assert sum(got) == rows and max(got) <= 2 * 50 and len(got) >= rows / 50


def test_batches_of_lines_are_parsed_in_many_tasks(spark, tmp_path, monkeypatch):
    from logloom.plans import catalog

    rows = 1000
    monkeypatch.setattr(catalog, "ROWS", 10)
    lines = spark.range(rows).selectExpr("'s' as stream_id", "id as pos", "cast(id as string) as raw").coalesce(1)
    batches = []

    def took(df, _):
        sizes = df.rdd.glom().map(len).collect()
        batches.append((sum(sizes), max(sizes)))

    query = (
        catalog._in_batches(lines).writeStream.foreachBatch(took)
        .option("checkpointLocation", str(tmp_path / "done")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    assert sum(n for n, _ in batches) == rows and len(batches) == 3 and max(most for _, most in batches) <= 20


def test_written_lines_are_made_once(spark, tmp_path):
    from logloom.sources.sinks import read_streams, write_lines, write_streams

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    lines = spark.range(500).selectExpr("'s' as stream_id", "id as pos", "cast(id as string) as line")
    lines = lines.mapInArrow(count, lines.schema)
    write_lines(lines, str(tmp_path / "text"))
    assert made.value == 500 and spark.read.text(str(tmp_path / "text")).count() == 500
    write_streams(lines, str(tmp_path / "streams"))
    assert made.value == 1000 and read_streams(spark, str(tmp_path / "streams"), "s").count() == 500
