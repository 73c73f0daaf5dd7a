from pyspark.sql import functions as F

RECORD = (
    "stream_id string, pos long, raw string, parsed boolean, ts timestamp, clock string, "
    "level int, effective int, message string, "
    "fields array<struct<key:string,val:string,demoted:boolean>>"
)


def lines(spark, rows):
    return spark.createDataFrame(
        [("s", i, r) for i, r in enumerate(rows)], "stream_id string, pos long, raw string"
    )


def records(spark, rows):
    """Rows of dicts with ``message, fields, level, parsed, raw``, all optional."""
    out = []
    for i, r in enumerate(rows):
        level = r.get("level", 2)
        out.append((
            r.get("stream", "s"), i, r.get("raw", ""), r.get("parsed", True), r.get("ts"),
            r.get("clock"), level, r.get("effective", level), r.get("message", ""),
            [(k, v, d[0] if d else False) for k, v, *d in r.get("fields", [])],
        ))
    return spark.createDataFrame(out, RECORD)


def ordered(df):
    return df.orderBy("stream_id", "pos").collect()


def pairs(row):
    return [(f.key, f.val) for f in row.fields]


def lit_rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")


def scalar(df, column):
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


__all__ = ["F", "lines", "records", "ordered", "pairs", "lit_rows", "scalar"]
