"""Log lines derived from the given tables.

The tables hold no log lines, so every event is written as one, in one of the
known formats, and every part and supplier as a stack trace. Positions are event
ids, which rise with time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("json", "logfmt", "glog", "pylog", "logrus", "text")
DAY = "2026-06-29"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task makes lines of, at most.
ROWS = 1 << 16


def spread(df: DataFrame) -> DataFrame:
    """Over all cores and in tasks of bounded size, where the files hold fewer splits than that.

    Lines cost much more to parse than to move, and a split of the narrow tables holds millions
    of rows. The rows are counted from the files' footers.
    """
    least = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def _two(c: Column, width: int = 2) -> Column:
    return F.lpad(c.cast("long").cast("string"), width, "0")


def event_facts(events: DataFrame) -> DataFrame:
    """What each line is going to say, as plain columns."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, F.col("ts"))
    u, e = F.col("user_id"), F.col("event_id")
    # A second becomes a millisecond; users' clocks differ by up to four seconds.
    ms = F.floor(micros / 1_000_000) + (u * 37) % 4001
    panic = F.floor(e / 6) % 2 == 0
    kind = F.col("event_type")
    message = (
        F.when((kind == "error") & panic,
               F.concat(F.lit("lease table corrupt on 172.20."), (u % 256).cast("string"),
                        F.lit("."), F.col("k"), F.lit(":"), (1024 + e % 5000).cast("string"),
                        F.lit(", fatal: node fenced")))
        .when(kind == "error",
              F.concat(F.lit("ledger shard 10.42."), (u % 4).cast("string"), F.lit("."), F.col("k"),
                       F.lit(":7421 is unavailable, write parked")))
        .when(kind == "signup", F.concat(F.lit("account "), u.cast("string"), F.lit(" opened")))
        .when(kind == "purchase", "basket settled")
        .otherwise(F.concat(F.lit("rendered "), kind))
    )
    level = F.when(kind == "click", "DEBUG").when((kind == "error") & ~panic, "WARN").otherwise(
        "INFO"
    )
    return (
        events.withColumn("k", F.regexp_extract("props", r"(\d+)", 1))
        .select(
            # A third of the users share one stream.
            F.when(u % 3 == 0, "s0").otherwise(F.concat(F.lit("s"), (u % 8).cast("string")))
            .alias("stream_id"),
            e.alias("pos"), ms.cast("long").alias("ms"), kind.alias("kind"), "k",
            message.alias("message"), level.alias("level"),
            F.concat(F.lit("svc"), (u % 2).cast("string")).alias("service"),
            F.concat(F.lit("M"), (u % 5).cast("string")).alias("method"),
            F.concat(F.lit("t"), (F.floor(e / 40) % 50).cast("string")).alias("trace"),
        )
    )


def _lines_of(fmt: Column) -> Column:
    ms = F.col("ms")
    clock = F.concat_ws(
        ":", _two(F.floor(ms / 3_600_000) % 24), _two(F.floor(ms / 60_000) % 60),
        _two(F.floor(ms / 1_000) % 60),
    )
    milli = _two(ms % 1_000, 3)
    lower = F.when(F.col("level") == "WARN", "warning").otherwise(F.lower("level"))
    pairs = F.concat(
        F.lit("service="), F.col("service"), F.lit(" rpc.method="), F.col("method"),
        F.lit(" trace_id="), F.col("trace"), F.lit(" k="), F.col("k"),
    )

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    message = F.col("message")
    return (
        F.when(fmt == "json",
               text(f'{{"time":"{DAY}T', clock, ".", milli, 'Z","level":"', F.col("level"),
                    '","msg":"', message, '","service":"', F.col("service"),
                    '","rpc.method":"', F.col("method"), '","trace_id":"', F.col("trace"),
                    '","k":', F.col("k"), "}"))
        .when(fmt == "logfmt",
              text(f'time="{DAY} ', clock, ".", milli, '" level=', lower, ' msg="', message,
                   '" ', pairs))
        .when(fmt == "glog",
              text(F.when(F.col("level") == "WARN", "W").otherwise("I"), "0629 ", clock, ".",
                   milli, "000   77 rpc.go:", F.col("k"), "] ", message))
        .when(fmt == "pylog",
              text(f"{DAY} ", clock, ",", milli, " - ", F.col("service"), " - ",
                   F.when(F.col("level") == "WARN", "WARNING").otherwise(F.col("level")),
                   " - ", message))
        .when(fmt == "logrus",
              text("\x1b[36m", F.substring("level", 1, 4), f"\x1b[0m[{DAY}T", clock, "Z] ",
                   message, "  ", pairs))
        .otherwise(text("plain note on ", F.col("kind"), " ", F.col("k")))
    )


def log_lines(spark: SparkSession, sf_dir: str, fmt: str = "mixed") -> DataFrame:
    """Every event as a line: ``stream_id, pos, raw``.

    "mixed" takes the six formats in turn, else every line has format ``fmt``.
    """
    facts = event_facts(spread(table(spark, sf_dir, "events")))
    names = F.array(*[F.lit(f) for f in FORMATS])
    chosen = F.get(names, (F.col("pos") % 6).cast("int")) if fmt == "mixed" else F.lit(fmt)
    return facts.select("stream_id", "pos", _lines_of(chosen).alias("raw"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, the document being the stream."""
    return (
        spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        .select(
            F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("stream_id"),
            F.col("pos").cast("long").alias("pos"), "raw",
        )
    )


MODULE = "example.com/shop"


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Go trace per part, in the message, and a Node trace per supplier, in a field."""
    p = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    go = F.concat(
        F.lit('{"time":"2026-06-29T01:02:03Z","level":"INFO","msg":"fatal: part '), p,
        F.lit(r' lost its shelf\ngoroutine 512 [chan receive]:\nsync.(*WaitGroup).Wait(0xb4)\n'
              r'\tsync/waitgroup.go:118 +0x71\nexample.com/shop/internal/part.(*store).Load'), size,
        F.lit(r'(0xe2, {0x6, 0x9})\n\texample.com/shop/internal/part/store_'), size,
        F.lit(r'.go:'), p,
        F.lit(r' +0x2f\nencoding/csv.(*Reader).Read({0x5, 0x5})\n\tencoding/csv/reader.go:251\n'
              r'lib.example.org/batch.(*Feeder).next(...)\n\tlib.example.org/batch@v2.7.1/feed.go:66 '
              r'+0x1e3\ncreated by os/signal.watch in goroutine 77\n\tos/signal/watch.go:15 +0x98"'
              r',"service":"parts"}'),
    )
    s = F.col("s_suppkey").cast("string")
    node = F.concat(
        F.lit('{"level":"error","msg":"quote refused","service":"api","stack":'
              r'"RangeError: supplier '), s,
        F.lit(r"\n    at rate (/srv/app/src/supplier/"), F.col("s_nationkey").cast("string"),
        F.lit(r".js:"), s, F.lit(r":21)\n    at /srv/app/src/queue.mjs:310:9"
              r"\n    at Pool.lease (/srv/app/node_modules/pool-x/dist/index.js:12:40)"
              r'\n    at tickTimers (node:internal/timers:581:17)"}'),
    )
    parts = spread(table(spark, sf_dir, "part")).select(
        F.lit("parts").alias("stream_id"), F.col("p_partkey").alias("pos"), go.alias("raw")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lit("suppliers").alias("stream_id"), F.col("s_suppkey").alias("pos"), node.alias("raw")
    )
    return parts.unionByName(suppliers)


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that exist, by path: for even sizes and nations only."""
    sizes = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(
        F.concat(F.lit("internal/part/store_"), F.col("p_size").cast("string"), F.lit(".go"))
        .alias("path")
    )
    nations = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(
        F.concat(F.lit("src/supplier/"), F.col("n_nationkey").cast("string"), F.lit(".js"))
        .alias("path")
    )
    return sizes.unionByName(nations).distinct()
