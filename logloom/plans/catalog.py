"""Registered queries, each with its check in plain SQL where SQL can say it.

The SQL never parses a log line: it computes the expected answer from the columns
that the lines were made of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import decode, frames, render, summary
from logloom.operators.columns import constant_fields
from logloom.operators.correlate import NARROW, corr_groups, related_events, remembered
from logloom.operators.fold import fold_islands, fold_session
from logloom.operators.identity import corr_tag, identify, mask
from logloom.operators.normalize import normalize
from logloom.operators.ordinals import with_ordinal
from logloom.operators.runs import fold_runs
from logloom.operators.severity import rerank_severity
from logloom.operators.stack import extract_stack
from logloom.operators.where import where
from logloom.plans.derived import (
    FORMATS,
    MODULE,
    ROWS,
    document_lines,
    log_lines,
    source_inventory,
    spread,
    table,
    trace_lines,
)
from logloom.plans.pipeline import Options, enrich, run
from logloom.schema import level_label
from logloom.sources.materialize import materialize, new_folder
from logloom.sources.lines import read_lines, split_long
from logloom.sources.sinks import read_streams, write_lines, write_stream, write_summary
from logloom.sources.tail import folder_bytes, positioned_lines, tail_lines
from logloom.streaming.live import (
    latest,
    live_counts,
    live_report,
    live_templates,
    merge_report,
    split_late,
    split_timed,
    upserted,
)
from logloom.streaming.stateful import fold_stream, mark_stream, open_runs, related_stream, state_store

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


# --- the SQL side: what every line says ---------------------------------------

_FACTS = r"""
facts AS (
  SELECT *,
    CASE WHEN kind = 'error' AND panic THEN 4 WHEN kind = 'error' THEN 3
         WHEN kind = 'click' THEN 1 ELSE 2 END AS eff,
    CASE WHEN kind = 'click' THEN 1 WHEN kind = 'error' AND NOT panic THEN 3 ELSE 2 END AS lvl,
    CASE WHEN kind = 'error' AND panic THEN 'lease table corrupt on ' || ip || ':' ||
           (1024 + pos % 5000) || ', fatal: node fenced'
         WHEN kind = 'error' THEN 'ledger shard ' || ip || ':7421 is unavailable, write parked'
         WHEN kind = 'signup' THEN 'account ' || u || ' opened'
         WHEN kind = 'purchase' THEN 'basket settled' ELSE 'rendered ' || kind END AS message,
    CASE WHEN kind = 'error' AND panic THEN 'lease table corrupt on <ip>:<n>, fatal: node fenced'
         WHEN kind = 'error' THEN 'ledger shard <ip>:<n> is unavailable, write parked'
         WHEN kind = 'signup' THEN 'account <n> opened'
         WHEN kind = 'purchase' THEN 'basket settled' ELSE 'rendered ' || kind END AS masked
  FROM (
    SELECT *, CASE WHEN kind <> 'error' THEN NULL
                   WHEN panic THEN '172.20.' || (u % 256) || '.' || k
                   ELSE '10.42.' || (u % 4) || '.' || k END AS ip
    FROM (
      SELECT CASE WHEN user_id % 3 = 0 THEN 's0' ELSE 's' || (user_id % 8) END AS stream_id,
        event_id AS pos, user_id AS u, event_type AS kind,
        regexp_extract(props, '(\d+)', 1) AS k,
        (epoch_us(ts) - 1704067200000000) // 1000000 + (user_id * 37) % 4001 AS ms,
        (event_id // 6) % 2 = 0 AS panic,
        'svc' || (user_id % 2) AS service, 'M' || (user_id % 5) AS method,
        't' || ((event_id // 40) % 50) AS trace
      FROM events))
)"""


def _records(fmt: str = "pos % 6") -> str:
    """CTEs up to ``rec``: the decoded records when line formats go by ``fmt``."""
    return (
        "WITH "
        + _FACTS
        + rf""",
rec AS (
  SELECT *,
    f <> 5 AS parsed,
    CASE WHEN f = 2 THEN 962236800000000 + ms * 1000
         WHEN f = 4 THEN 1782691200000000 + (ms // 1000) * 1000000
         WHEN f <> 5 THEN 1782691200000000 + ms * 1000 END AS ts_us,
    lpad(((ms // 3600000) % 24)::VARCHAR, 2, '0') || ':' ||
      lpad(((ms // 60000) % 60)::VARCHAR, 2, '0') || ':' ||
      lpad(((ms // 1000) % 60)::VARCHAR, 2, '0') AS clock,
    CASE WHEN kv THEN service ELSE '' END AS comp,
    CASE WHEN kv THEN trace ELSE ip END AS corr_key,
    CASE WHEN kv THEN method END AS rpc,
    CASE WHEN kv THEN 'service=' || service || ' rpc.method=' || method || ' trace_id=' ||
           trace || ' k=' || k
         WHEN f = 2 THEN 'thread=77 caller=rpc.go:' || k
         WHEN f = 3 THEN 'logger=' || service ELSE '' END AS fields_text,
    ['?', 'DEBUG', 'INFO', 'WARN', 'ERR'][eff + 1] AS label,
    ['?', 'DEBUG', 'INFO', 'WARN', 'ERR'][lvl + 1] AS declared
  FROM (SELECT * REPLACE (CASE WHEN f = 2 THEN greatest(lvl, 2) ELSE lvl END AS lvl,
                          CASE WHEN f = 2 THEN greatest(eff, 2) ELSE eff END AS eff),
          f IN (0, 1, 4) AS kv
        FROM (SELECT *, {fmt} AS f FROM facts))
),
par AS (
  SELECT *, label || '|' || comp || '|' || masked AS tmpl,
    row_number() OVER (PARTITION BY stream_id ORDER BY pos) - 1 AS pn
  FROM rec WHERE parsed
)
"""
    )


def _plain(c: str | Column) -> Column:
    """Template with a bar in place of NUL, for comparing."""
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\x00"), F.lit("|"))


def _fields_text() -> Column:
    return F.array_join(
        F.transform("fields", lambda f: F.concat(f["key"], F.lit("="), f["val"])), " "
    )


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(log_lines(spark, sf_dir))


# --- normalise ------------------------------------------------------------------


def _normalized(lines: DataFrame, format: str = "auto") -> DataFrame:
    return normalize(lines, format).select(
        "stream_id", "pos", "parsed", "format",
        F.unix_micros("ts").cast("string").alias("ts_us"), "clock",
        "level", "message", _fields_text().alias("fields_text"),
    )


def _normalized_sql(fmt: str) -> str:
    return _records(fmt) + """
SELECT stream_id, pos, parsed,
  ['json', 'logfmt', 'glog', 'pylog', 'logrus', 'text'][f + 1] AS format,
  ts_us::VARCHAR AS ts_us,
  CASE WHEN parsed THEN clock END AS clock, CASE WHEN parsed THEN lvl ELSE 0 END AS level,
  CASE WHEN parsed THEN message ELSE '' END AS message, fields_text
FROM rec"""


for _i, _name in enumerate(FORMATS):
    query(_normalized_sql(str(_i)), f"normalize_{_name}")(
        lambda spark, sf_dir, fmt=_name: _normalized(log_lines(spark, sf_dir, fmt))
    )
    if _name != "text":
        # The decoder alone, told its format.
        query(_normalized_sql(str(_i)), f"forced_{_name}")(
            lambda spark, sf_dir, fmt=_name: _normalized(log_lines(spark, sf_dir, fmt), fmt)
        )


@query(_normalized_sql("5"))
def forced_text(spark, sf_dir):
    """Told to be text, even JSON is kept as it is."""
    return _normalized(log_lines(spark, sf_dir, "json"), "text")


@query(r"""
WITH e AS (SELECT 's' AS stream_id, event_id AS pos, event_id::VARCHAR AS n FROM events),
v AS (SELECT stream_id, pos, unnest([
    {i: 0, format: 'json', us: ((1782691200 + pos) * 1000 + 7) * 1000, level: 3, message: 'v ' || n,
     f: 'lvl=Warning meta={"n":1.50,"t":[' || n || ',null],"s":"\u00e9"} q='},
    {i: 1, format: 'json', us: 1782700133500000, level: 4, message: 'a"b\c é ' || n, f: 'late=WARN'},
    {i: 2, format: 'logfmt', us: (1782691200 + pos) * 1000000, level: 2,
     message: 'say "' || n || '"' || chr(9) || 'x', f: 'bare= url=a?b=c'},
    {i: 3, format: 'logrus', us: NULL, level: 3, message: 'kiln ' || n, f: 'elapsed=0007 heat=' || n},
    {i: 4, format: 'text', us: NULL, level: 0, message: '', f: ''},
    {i: 5, format: 'text', us: NULL, level: 0, message: '', f: ''}]) AS x FROM e)
SELECT stream_id, pos * 6 + x.i AS pos, x.format <> 'text' AS parsed, x.format AS format,
  x.us::VARCHAR AS ts_us, x.level AS level, x.message AS message, x.f AS fields_text FROM v""")
def normalize_variants(spark, sf_dir):
    """Nested values and number literals, escapes, several aliases, offsets and epochs,
    elapsed seconds, and lines that only look like a format."""
    n = F.col("event_id").cast("string")
    second = (F.lit(1782691200) + F.col("event_id")).cast("string")

    def line(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    raws = F.array(
        line('{"ts":', second, '007,"lvl":"Warning","severity":"warn","msg":"","message":"v ', n,
             '","meta":{"n": 1.50, "t":[', n, r', null],"s":"\u00e9"},"q":null}'),
        line(r'{"time":"2026-06-29T04:28:53.5+02:00","level":"error","msg":"a\"b\\c \u00e9 ', n,
             '","late":"WARN"}'),
        line("ts=", second, r' level=info msg="say \"', n, r'\"\tx" bare url=a?b=c'),
        line("WARN[0007] kiln ", n, "  heat=", n),
        line('level=info msg="open ', n),
        line('{"a":', n, "} x"),
    )
    events = table(spark, sf_dir, "events").select("event_id", F.posexplode(raws).alias("i", "raw"))
    lines = events.select(
        F.lit("s").alias("stream_id"), (F.col("event_id") * 6 + F.col("i")).alias("pos"), "raw")
    return _normalized(lines).drop("clock")


@query(_normalized_sql("pos % 6"))
def normalize_mixed(spark, sf_dir):
    return _normalized(log_lines(spark, sf_dir))


# --- severity, filters ------------------------------------------------------------


@query(_records() + """
SELECT stream_id, count(*) FILTER (parsed AND eff = 4) AS errors,
  count(*) FILTER (parsed AND eff = 3) AS warns,
  count(*) FILTER (parsed AND eff IN (1, 2)) AS infos,
  count(*) FILTER (parsed AND eff = 0) AS unknown,
  count(*) FILTER (NOT parsed) AS passthrough
FROM rec GROUP BY stream_id""")
def severity_counts(spark, sf_dir):
    records = rerank_severity(normalize(log_lines(spark, sf_dir)))
    return summary.summary_counts(records).select(
        "stream_id", "errors", "warns", "infos", "unknown", "passthrough"
    )


@query(_records() + """
SELECT stream_id, pos, declared AS declared, label AS effective FROM par WHERE lvl <> eff""")
def reranked_lines(spark, sf_dir):
    records = rerank_severity(normalize(log_lines(spark, sf_dir)))
    return records.filter(F.col("parsed") & (F.col("level") != F.col("effective"))).select(
        "stream_id", "pos", level_label(F.col("level")).alias("declared"),
        level_label(F.col("effective")).alias("effective"),
    )


@query(_records() + "SELECT stream_id, pos FROM rec WHERE NOT parsed OR eff >= 3")
def filter_min_level(spark, sf_dir):
    records = rerank_severity(normalize(log_lines(spark, sf_dir)))
    return where(records, level="warn").select("stream_id", "pos")


@query(_records() + """
SELECT stream_id, pos FROM rec
WHERE NOT parsed OR (kv AND method = 'M1' AND contains(service, '0'))""")
def filter_field(spark, sf_dir):
    records = normalize(log_lines(spark, sf_dir))
    return where(records, fields=["rpc.method=m1", "service=VC0"]).select("stream_id", "pos")


@query(_records() + """
SELECT stream_id, pos FROM rec
WHERE CASE WHEN parsed THEN kind = 'signup' OR (kv AND trace = 't1') ELSE kind = 'view' END""")
def filter_grep(spark, sf_dir):
    records = normalize(log_lines(spark, sf_dir))
    return where(records, pattern="opened|^t1$|note on view").select("stream_id", "pos")


# --- templates and the summary ------------------------------------------------------

_B = r"(^|[^0-9A-Za-z_])"


@query(r"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT masked, count(*) AS n FROM (
  SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '0x[0-9a-fA-F]+', '<hex>', 'g'),
    '\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b',
    '<uuid>', 'g'),
    '\b\d{1,3}(\.\d{1,3}){3}\b', '<ip>', 'g'),
    '\[[0-9a-fA-F:]*::[0-9a-fA-F:]*\]', '<ip6>', 'g'), '\d+', '<n>', 'g') AS masked FROM l)
GROUP BY masked""")
def template_documents(spark, sf_dir):
    lines = document_lines(spark, sf_dir).select(mask(F.col("raw")).alias("masked"))
    return lines.groupBy("masked").agg(F.count(F.lit(1)).alias("n"))


@query(_records() + """
SELECT stream_id, pos, tmpl AS template, corr_key, rpc AS method FROM par""")
def identities(spark, sf_dir):
    return _mixed(spark, sf_dir).filter("parsed").select(
        "stream_id", "pos", _plain("template").alias("template"), "corr_key", "method"
    )


@query(_records() + """
SELECT stream_id, tmpl AS template, eff AS level, count(*) AS n, min(pos) AS first_pos,
  arg_min(message, pos) AS text
FROM par WHERE eff >= 3 GROUP BY ALL""")
def template_counts(spark, sf_dir):
    return summary.template_counts(_mixed(spark, sf_dir)).withColumn(
        "template", _plain("template")
    )


@query(_records() + """
SELECT stream_id, min_by(ts_us, pos) AS first_us, max_by(ts_us, pos) AS last_us,
  min_by(clock, pos) AS first_clock, max_by(clock, pos) AS last_clock
FROM par GROUP BY stream_id""")
def summary_span(spark, sf_dir):
    return summary.summary_counts(normalize(log_lines(spark, sf_dir))).select(
        "stream_id", F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"), "first_clock", "last_clock",
    )


def _part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failure per part; names make many templates."""
    text = F.concat(
        F.lit('level='), F.when(F.col("p_size") % 5 == 0, "warning").otherwise("error"),
        F.lit(' msg="failed to price '), F.col("p_name"), F.lit(" "), F.col("p_type"),
        F.lit(" "), F.col("p_partkey").cast("string"), F.lit('"'),
    )
    return spread(table(spark, sf_dir, "part")).select(
        F.concat(F.lit("line"), (F.col("p_size") % 3).cast("string")).alias("stream_id"),
        F.col("p_partkey").alias("pos"), text.alias("raw"),
    )


def _part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(_part_lines(spark, sf_dir))


_PARTS = """
WITH p AS (
  SELECT 'line' || (p_size % 3) AS stream_id, p_partkey AS pos,
    CASE WHEN p_size % 5 = 0 THEN 3 ELSE 4 END AS level,
    'failed to price ' || p_name || ' ' || p_type || ' ' || p_partkey AS message,
    'failed to price ' || p_name || ' ' || p_type || ' <n>' AS masked FROM part),
t AS (
  SELECT stream_id, level, masked, count(*) AS n, min(pos) AS first_pos,
    arg_min(message, pos) AS text FROM p GROUP BY ALL),
tracked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY first_pos) AS seen
                 FROM t) WHERE seen <= 64),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stream_id, level ORDER BY n DESC, first_pos) AS rank
  FROM tracked),
totals AS (
  SELECT stream_id, count(*) FILTER (level = 4 AND own) AS unique_errors,
    count(*) FILTER (level = 3 AND own) AS unique_warns,
    coalesce(sum(n) FILTER (NOT own), 0)::BIGINT AS untracked
  FROM (SELECT t.*, k.seen IS NOT NULL AS own FROM t
        LEFT JOIN tracked k ON k.stream_id = t.stream_id AND k.first_pos = t.first_pos)
  GROUP BY stream_id)
"""


@query(_PARTS + """
SELECT stream_id, level, rank, n, first_pos, text FROM ranked WHERE rank <= 8""")
def top_templates(spark, sf_dir):
    counts = summary.template_counts(_part_records(spark, sf_dir))
    return summary.top_templates(counts).drop("template")


@query(_PARTS + "SELECT * FROM totals")
def untracked_templates(spark, sf_dir):
    counts = summary.template_counts(_part_records(spark, sf_dir))
    return summary.template_totals(counts)


@query(_PARTS + """
, c AS (SELECT stream_id, count(*) FILTER (level = 4) AS errors,
          count(*) FILTER (level = 3) AS warns FROM p GROUP BY stream_id),
shown AS (
  SELECT stream_id, level,
    string_agg('  ' || rpad(CASE level WHEN 4 THEN 'ERR' ELSE 'WARN' END, 4, ' ') || ' ×' || n ||
               '  ' || text, chr(10) ORDER BY rank) AS lines
  FROM ranked WHERE rank <= 8 GROUP BY ALL)
SELECT c.stream_id, concat_ws(chr(10), '── summary ' || repeat('─', 45),
    errors || ' error' || CASE WHEN errors = 1 THEN '' ELSE 's' END ||
    CASE WHEN errors > 0 THEN ' (' || unique_errors || ' unique)' ELSE '' END || ' · ' ||
    warns || ' warn' || CASE WHEN warns = 1 THEN '' ELSE 's' END ||
    CASE WHEN warns > 0 THEN ' (' || unique_warns || ' unique)' ELSE '' END, '',
    e.lines, CASE WHEN unique_errors > 8 THEN '  … +' || (unique_errors - 8) || ' more' END,
    w.lines, CASE WHEN unique_warns > 8 THEN '  … +' || (unique_warns - 8) || ' more' END,
    CASE WHEN untracked > 0 THEN '  … +' || untracked ||
      ' more warn/error lines beyond the tracked templates' END) AS report
FROM c JOIN totals USING (stream_id)
LEFT JOIN shown e ON e.stream_id = c.stream_id AND e.level = 4
LEFT JOIN shown w ON w.stream_id = c.stream_id AND w.level = 3""")
def summary_report(spark, sf_dir):
    return summary.summary_report(_part_records(spark, sf_dir))


# --- neighbourhood ---------------------------------------------------------------------


@query("""
SELECT CASE WHEN user_id % 3 = 0 THEN 's0' ELSE 's' || (user_id % 8) END AS stream_id,
  event_id AS pos, row_number() OVER (PARTITION BY CASE WHEN user_id % 3 = 0 THEN 's0'
    ELSE 's' || (user_id % 8) END ORDER BY event_id) - 1 AS q
FROM events""")
def ordinals(spark, sf_dir):
    return with_ordinal(log_lines(spark, sf_dir).select("stream_id", "pos"), "q")


_CONSTANT = """
, fr AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pos) AS fn FROM par),
kvs AS (
  SELECT stream_id, pos, fn, generate_subscripts(string_split(fields_text, ' '), 1) - 1 AS i,
    unnest(string_split(fields_text, ' ')) AS kv FROM fr),
j AS (
  SELECT *, count(*) OVER w AS n, min(kv) OVER w AS lo, max(kv) OVER w AS hi FROM kvs
  WINDOW w AS (PARTITION BY stream_id, split_part(kv, '=', 1) ORDER BY fn
               RANGE BETWEEN 255 PRECEDING AND CURRENT ROW))
"""


@query(_records() + _CONSTANT + "SELECT stream_id, pos, i FROM j WHERE n >= 3 AND lo = hi",
       name="constant_fields")
def constant_fields_query(spark, sf_dir):
    records = materialize(
        normalize(log_lines(spark, sf_dir)).select("stream_id", "pos", "parsed", "fields")
    )
    return constant_fields(records).withColumn("i", F.col("i").cast("long"))


_CORR = """
SELECT stream_id, pos, corr_key, 'c' || CASE
    WHEN h >= 36 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', (h // 36)::INT + 1, 1)
    ELSE '' END || substr('0123456789abcdefghijklmnopqrstuvwxyz', (h % 36)::INT + 1, 1) AS corr
FROM (
  SELECT stream_id, pos, corr_key, list_reduce(list_prepend(2166136261::BIGINT,
      list_transform(string_split(corr_key, ''), lambda x: ascii(x)::BIGINT)),
      lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 1000 AS h
  FROM par a
  WHERE corr_key IS NOT NULL AND EXISTS (
    SELECT 1 FROM par b WHERE b.stream_id = a.stream_id AND b.corr_key = a.corr_key
      AND b.pn < a.pn AND b.pn >= a.pn - 512 AND abs(a.ts_us - b.ts_us) <= 60000000))"""


@query(_records() + _CORR, name="corr_groups")
def corr_groups_query(spark, sf_dir):
    records = remembered(materialize(_mixed(spark, sf_dir).select("parsed", *NARROW)))
    return corr_groups(records).withColumn("corr", corr_tag(F.col("corr_key")))


_RELATED = """
SELECT a.stream_id, a.pos, max(b.pos) AS related_pos, arg_max(b.clock, b.pn) AS related_clock,
  arg_max(CASE WHEN strlen(b.message) > 60 THEN substr(b.message, 1, 60) || '…'
          ELSE b.message END, b.pn) AS summary
FROM par a JOIN par b ON b.stream_id = a.stream_id AND b.rpc = a.rpc AND b.eff >= 3
  AND b.tmpl <> a.tmpl AND b.pn < a.pn AND b.pn >= a.pn - 512
  AND abs(a.ts_us - b.ts_us) <= 5000000
GROUP BY a.stream_id, a.pos"""


@query(_records() + _RELATED, name="related_events")
def related_events_query(spark, sf_dir):
    records = remembered(materialize(_mixed(spark, sf_dir).select("parsed", *NARROW)))
    return related_events(records).select(
        "stream_id", "pos", F.col("related.pos").alias("related_pos"),
        F.col("related.clock").alias("related_clock"), "related.summary",
    )


_ISLANDS = """
, q AS (
  SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pos) AS q,
    label || '|' || comp || '|' || masked AS tmpl FROM rec),
r AS (
  SELECT *, max(CASE WHEN NOT parsed THEN q END) OVER (PARTITION BY stream_id ORDER BY q) AS reset
  FROM q),
s AS (
  SELECT *, lag(q) OVER (PARTITION BY stream_id, tmpl ORDER BY q) AS before FROM r WHERE parsed),
i AS (
  SELECT *, sum(CASE WHEN q - before <= 10 AND coalesce(before > reset, TRUE) THEN 0 ELSE 1 END)
    OVER (PARTITION BY stream_id, tmpl ORDER BY q) AS island FROM s)
"""
_RUNS = """SELECT stream_id, min(pos) AS head_pos, max(pos) AS last_pos, count(*) AS repeat,
  tmpl AS template FROM i GROUP BY stream_id, tmpl, island"""


@query(_records() + _ISLANDS + _RUNS, name="fold_islands")
def fold_islands_query(spark, sf_dir):
    runs = fold_islands(materialize(_mixed(spark, sf_dir).select(
        "stream_id", "pos", "parsed", "template"
    )))
    return runs.withColumn("template", _plain("template"))


@query(_records("0") + _ISLANDS + _RUNS)
def fold_islands_unbroken(spark, sf_dir):
    """No passthrough lines, so that runs cross many chunks."""
    records = enrich(log_lines(spark, sf_dir, "json"))
    runs = fold_islands(
        materialize(records.select("stream_id", "pos", "parsed", "template")), chunk=1 << 8
    )
    return runs.withColumn("template", _plain("template"))


_SESSIONS = """
, s AS (
  SELECT *, lag(ts_us) OVER (PARTITION BY stream_id, tmpl ORDER BY ts_us, pos) AS before
  FROM par),
i AS (
  SELECT *, sum(CASE WHEN ts_us - before <= {gap} THEN 0 ELSE 1 END)
    OVER (PARTITION BY stream_id, tmpl ORDER BY ts_us, pos) AS island FROM s)
"""
#: Seconds after which ``fold_session_held`` ends and cuts a run.
HELD_IDLE, HELD_FOR = 30, 120
_SESSION_RUNS = """
SELECT stream_id, min(pos) AS head_pos, max(pos) AS last_pos, count(*) AS repeat,
  tmpl AS template, min(ts_us) AS first_us, max(ts_us) AS last_us
"""


def _timed_runs(runs: DataFrame) -> DataFrame:
    return runs.select(
        "stream_id", "head_pos", "last_pos", "repeat", _plain("template").alias("template"),
        F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"),
    )


@query(_records() + _SESSIONS.format(gap=750_000) + _SESSION_RUNS + "FROM i GROUP BY stream_id, tmpl, island",
       name="fold_session")
def fold_session_query(spark, sf_dir):
    return _timed_runs(fold_session(_mixed(spark, sf_dir)))


@query(_records() + _SESSIONS.format(gap=HELD_IDLE * 1_000_000) + """
, h AS (SELECT *, ts_us - min(ts_us) OVER (PARTITION BY stream_id, tmpl, island) AS since FROM i)
""" + _SESSION_RUNS + f"FROM h GROUP BY stream_id, tmpl, island, since // {HELD_FOR * 1_000_000}")
def fold_session_held(spark, sf_dir):
    """Runs cut by length; spans as long as those between the records of the tables."""
    return _timed_runs(fold_session(_mixed(spark, sf_dir), f"{HELD_IDLE} seconds", hold=f"{HELD_FOR} seconds"))


@query(_records("0").replace("WITH ", "WITH RECURSIVE ", 1) + """
, f AS (SELECT stream_id, pos, tmpl, row_number() OVER (PARTITION BY stream_id ORDER BY pos) AS p FROM par),
-- Open runs, oldest head first: template, last record, head and count. Each step takes one
-- record of every stream: runs up to the newest that ended are done, then the record
-- continues a run or opens one, for which the oldest of eight makes room.
steps AS (
  SELECT stream_id, 0::BIGINT AS p, [{t: '', l: 0::BIGINT, h: 0::BIGINT, c: 0::BIGINT}][2:] AS open,
    [{t: '', l: 0::BIGINT, h: 0::BIGINT, c: 0::BIGINT}][2:] AS done FROM f GROUP BY stream_id
  UNION ALL
  SELECT stream_id, p,
    CASE WHEN known THEN list_transform(rest, lambda r: CASE WHEN r.t = tmpl
           THEN {t: r.t, l: p, h: r.h, c: r.c + 1} ELSE r END)
         ELSE list_append(rest[1 + crowded:], {t: tmpl, l: p, h: pos, c: 1::BIGINT}) END,
    CASE WHEN known THEN ended ELSE list_concat(ended, rest[:crowded]) END
  FROM (
    SELECT *, len(list_filter(rest, lambda r: r.t = tmpl)) > 0 AS known,
      CASE WHEN len(rest) = 8 THEN 1 ELSE 0 END AS crowded
    FROM (
      SELECT stream_id, p, tmpl, pos, open[:n] AS ended, open[n + 1:] AS rest
      FROM (
        SELECT s.stream_id, f.p, f.tmpl, f.pos, s.open, coalesce(list_max(list_filter(
            range(1, len(s.open) + 1), lambda i: f.p - s.open[i].l > 10)), 0) AS n
        FROM steps s JOIN f ON f.stream_id = s.stream_id AND f.p = s.p + 1)))),
runs AS (
  SELECT stream_id, unnest(done) AS r FROM steps
  UNION ALL SELECT stream_id, unnest(open) FROM (
    SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY p DESC) AS k FROM steps) WHERE k = 1)
SELECT stream_id, r.h AS head_pos, r.c AS repeat, r.t AS template FROM runs""", name="fold_runs")
def fold_runs_query(spark, sf_dir):
    records = enrich(log_lines(spark, sf_dir, "json"))
    narrow = materialize(records.select("stream_id", "pos", "parsed", "template"))
    return fold_runs(narrow).withColumn("template", _plain("template"))


# --- stacks -------------------------------------------------------------------------------

_FRAMES = """
WITH g AS (
  SELECT 'parts' AS stream_id, p_partkey AS pos, 'go' AS lang, unnest([
    {i: 0, func: 'sync.(*WaitGroup).Wait', file: 'sync/waitgroup.go', line: 118, col: 0,
     kind: 'stdlib'},
    {i: 1, func: 'example.com/shop/internal/part.(*store).Load' || p_size,
     file: 'example.com/shop/internal/part/store_' || p_size || '.go', line: p_partkey,
     col: 0, kind: 'project'},
    {i: 2, func: 'encoding/csv.(*Reader).Read', file: 'encoding/csv/reader.go', line: 251, col: 0,
     kind: 'stdlib'},
    {i: 3, func: 'lib.example.org/batch.(*Feeder).next',
     file: 'lib.example.org/batch@v2.7.1/feed.go', line: 66, col: 0, kind: 'thirdparty'},
    {i: 4, func: 'os/signal.watch', file: 'os/signal/watch.go', line: 15, col: 0,
     kind: 'stdlib'}]) AS f FROM part
  UNION ALL
  SELECT 'suppliers', s_suppkey, 'node', unnest([
    {i: 0, func: 'rate', file: '/srv/app/src/supplier/' || s_nationkey || '.js',
     line: s_suppkey, col: 21, kind: 'project'},
    {i: 1, func: '<anonymous>', file: '/srv/app/src/queue.mjs', line: 310, col: 9, kind: 'project'},
    {i: 2, func: 'Pool.lease', file: '/srv/app/node_modules/pool-x/dist/index.js', line: 12,
     col: 40, kind: 'thirdparty'},
    {i: 3, func: 'tickTimers', file: 'node:internal/timers', line: 581, col: 17,
     kind: 'stdlib'}]) FROM supplier),
fr AS (
  SELECT stream_id, pos, lang, f.i AS i, f.func AS func, f.file AS file, f.line::INT AS line,
    f.col::INT AS col, f.kind AS kind FROM g),
inv AS (
  SELECT DISTINCT 'internal/part/store_' || p_size || '.go' AS path FROM part
  WHERE p_size % 2 = 0
  UNION ALL SELECT 'src/supplier/' || n_nationkey || '.js' FROM nation WHERE n_nationkey % 2 = 0),
res AS (
  SELECT fr.*, inv.path FROM fr LEFT JOIN inv ON fr.file LIKE '%/' || inv.path)
"""


def _stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(trace_lines(spark, sf_dir), Options(module=MODULE))


@query(_FRAMES + "SELECT * FROM fr")
def stack_frames(spark, sf_dir):
    return frames.explode_frames(_stacks(spark, sf_dir))


@query("""
SELECT 'parts' AS stream_id, p_partkey AS pos, 'go' AS lang, 'fatal: part ' || p_partkey || ' lost its shelf' AS header,
  4 AS effective, 'Load' || p_size AS method, 'ERR|parts|fatal: part <n> lost its shelf' AS template,
  'service=parts' AS fields_text FROM part
UNION ALL
SELECT 'suppliers', s_suppkey, 'node', 'RangeError: supplier ' || s_suppkey, 4, 'rate',
  'ERR|api|RangeError: supplier <n>', 'service=api' FROM supplier""")
def stack_headers(spark, sf_dir):
    return _stacks(spark, sf_dir).select(
        "stream_id", "pos", F.col("stack.lang").alias("lang"),
        F.col("stack.header").alias("header"), "effective", "method",
        _plain("template").alias("template"), _fields_text().alias("fields_text"),
    )


@query("""
SELECT 'parts' AS stream_id, p_partkey AS pos, unnest([0, 2]) AS start, unnest([1, 3]) AS n,
  unnest(['sync', 'encoding, lib.example.org, os']) AS packages FROM part
UNION ALL SELECT 'suppliers', s_suppkey, 2, 2, 'Pool, tickTimers' FROM supplier""")
def framework_runs(spark, sf_dir):
    return frames.framework_runs(_stacks(spark, sf_dir))


@query(_FRAMES + "SELECT stream_id, pos, i, file, path FROM res")
def resolve_frames(spark, sf_dir):
    exploded = materialize(frames.explode_frames(_stacks(spark, sf_dir)))
    found = frames.resolve_frames(exploded, source_inventory(spark, sf_dir))
    return found.select("stream_id", "pos", "i", "file", "path")


@query(_FRAMES + """
SELECT stream_id, pos, i, 'https://github.com/acme/shop/blob/v2/' || rel ||
  CASE WHEN line > 0 THEN '#L' || line ELSE '' END AS url
FROM (SELECT *, CASE WHEN starts_with(file, 'example.com/shop/') THEN substr(file, 18)
                ELSE path END AS rel FROM res)""")
def frame_urls(spark, sf_dir):
    exploded = materialize(frames.explode_frames(_stacks(spark, sf_dir)))
    found = frames.resolve_frames(exploded, source_inventory(spark, sf_dir))
    url = frames.github_url(
        "acme/shop@v2", F.col("file"), F.col("line"), MODULE, resolved=F.col("path")
    )
    return found.select("stream_id", "pos", "i", url.alias("url"))


# --- text --------------------------------------------------------------------------------


@query(_records() + """
SELECT stream_id, pos, CASE WHEN NOT parsed THEN 'plain note on ' || kind || ' ' || k
  ELSE clock || ' ' || declared || CASE WHEN lvl = eff THEN '' ELSE '→' || label END || '  ' ||
    message || '  ' || fields_text END AS line
FROM rec""")
def format_lines(spark, sf_dir):
    return render.format_lines(rerank_severity(normalize(log_lines(spark, sf_dir))))


@query("""
SELECT 'parts' AS stream_id, p_partkey AS pos, '01:02:03 INFO→ERR  fatal: part ' || p_partkey ||
  ' lost its shelf  service=parts' || chr(10) || '    … 1 framework frames (sync)' || chr(10) ||
  '    ► store_' || p_size || '.go' || CASE WHEN p_partkey > 0 THEN ':' || p_partkey ELSE '' END ||
  '  example.com/shop/internal/part.(*store).Load' || p_size || chr(10) ||
  '    … 3 framework frames (encoding, lib.example.org, os)' AS line FROM part
UNION ALL
SELECT 'suppliers', s_suppkey, '--:--:-- ERR  RangeError: supplier ' || s_suppkey ||
  '  service=api' || chr(10) || '    ► ' || s_nationkey || '.js' ||
  CASE WHEN s_suppkey > 0 THEN ':' || s_suppkey || ':21' ELSE '' END || '  rate' || chr(10) ||
  '    ► queue.mjs:310:9  <anonymous>' || chr(10) || '    … 2 framework frames (Pool, tickTimers)'
FROM supplier""")
def format_stack_lines(spark, sf_dir):
    return render.format_lines(_stacks(spark, sf_dir))


def _pipeline_sql(shown: str) -> str:
    """All parts of the pipeline together, over the records that ``shown`` keeps."""
    seen = _records().replace("FROM rec WHERE parsed", f"FROM rec WHERE parsed AND ({shown})")
    islands = _ISLANDS.replace("AS tmpl FROM rec)", f"AS tmpl FROM rec WHERE {shown})")
    return seen + _CONSTANT + f"""
, const AS (SELECT stream_id, pos, i FROM j WHERE n >= 3 AND lo = hi),
corr AS ({_CORR}), rel AS ({_RELATED})
""" + islands + f"""
, runs AS ({_RUNS}),
marked AS (
  SELECT v.stream_id, v.pos, string_agg(CASE WHEN c.i IS NULL THEN v.kv ELSE '·' || v.kv END, ' '
    ORDER BY c.i IS NOT NULL, v.i) AS marked
  FROM kvs v LEFT JOIN const c ON c.stream_id = v.stream_id AND c.pos = v.pos AND c.i = v.i
  GROUP BY v.stream_id, v.pos)
SELECT o.stream_id, o.pos, CASE WHEN NOT parsed THEN 'plain note on ' || kind || ' ' || k
  ELSE clock || ' ' || declared || CASE WHEN lvl = eff THEN '' ELSE '→' || label END || '  ' ||
    coalesce('⟨' || corr.corr || '⟩ ', '') || message ||
    CASE WHEN runs.repeat > 1 THEN '  ×' || runs.repeat ELSE '' END || '  ' || marked.marked ||
    coalesce(chr(10) || '    ↳ likely related: ' || rel.summary || ' @' || rel.related_clock, '')
  END AS line
FROM rec o LEFT JOIN corr ON corr.stream_id = o.stream_id AND corr.pos = o.pos
LEFT JOIN rel ON rel.stream_id = o.stream_id AND rel.pos = o.pos
LEFT JOIN marked ON marked.stream_id = o.stream_id AND marked.pos = o.pos
LEFT JOIN runs ON runs.stream_id = o.stream_id AND runs.head_pos = o.pos
WHERE ({shown}) AND (NOT parsed OR runs.head_pos IS NOT NULL)"""


@query(_pipeline_sql("TRUE"))
def pipeline_lines(spark, sf_dir):
    """Everything at once, as text: tags, links, constant fields and counts."""
    return render.format_lines(run(log_lines(spark, sf_dir)))


@query(_pipeline_sql("NOT parsed OR (eff >= 2 AND kv AND method <> 'M2')"))
def pipeline_filtered(spark, sf_dir):
    """The filter comes before every window, which then sees shown records only."""
    return render.format_lines(
        run(log_lines(spark, sf_dir), Options(level="info", fields=["rpc.method="],
                                              pattern=r"^M[0134]$|note"))
    )


@query(_normalized_sql("pos % 6"))
def stream_normalize(spark, sf_dir):
    """The lines as a stream of files, decoded on the way and appended to a table."""
    written = f"{new_folder(spark)}/lines"
    lines = log_lines(spark, sf_dir)
    lines.write.parquet(written)
    source = spark.readStream.schema(lines.schema).parquet(written)
    out = new_folder(spark)
    stream = write_stream(
        _normalized(source), f"{out}/rows", f"{out}/progress", available_now=True
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _in_batches(lines: DataFrame, batches: int = 3) -> DataFrame:
    """Lines as a stream of so many batches, each over all cores and in tasks of bounded size."""
    spark, written = lines.sparkSession, f"{new_folder(lines.sparkSession)}/lines"
    lines = materialize(lines)
    files = max(1, -(-lines.count() // (batches * ROWS)))
    lines.repartitionByRange(batches * files, "pos").write.parquet(written)
    source = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(written)
    # Small files are read by one task, which is too much to parse for one.
    return source.repartition(max(files, spark.sparkContext.defaultParallelism))


def _live(spark: SparkSession, sf_dir: str, summarise, keys: list[str]) -> DataFrame:
    """A live summary of mixed lines, read in several batches to their end."""
    source = _in_batches(log_lines(spark, sf_dir))
    out = None
    # Files are met in the order they were written, so the delay spans all of them.
    for name, part in zip(("timed", "untimed"), split_timed(enrich(source), "1 day"), strict=True):
        path = new_folder(spark)
        with state_store(spark):
            stream = (
                summarise(part).writeStream.outputMode("update")
                .foreachBatch(lambda rows, batch, path=path: upserted(rows, batch, f"{path}/rows"))
                .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
            )
            stream.awaitTermination()
        got = latest(spark.read.parquet(f"{path}/rows"), keys)
        # Arrival differs by run; its windows are summed up.
        got = got.withColumn("start", F.unix_micros("start") if name == "timed" else F.lit(None).cast("long"))
        out = got if out is None else out.unionByName(got)
    return out


_TIMED = "coalesce(f IN (0, 1, 3, 4), false)"


@query(_records() + f"""
SELECT CASE WHEN {_TIMED} THEN ts_us // 60000000 * 60000000 END AS start, {_TIMED} AS timed, stream_id,
  count(*) FILTER (parsed AND eff = 4) AS errors, count(*) FILTER (parsed AND eff = 3) AS warns,
  count(*) FILTER (parsed AND eff IN (1, 2)) AS infos, 0::BIGINT AS unknown,
  count(*) FILTER (NOT parsed) AS passthrough
FROM rec GROUP BY ALL""")
def stream_counts(spark, sf_dir):
    keys = ["start", "timed", "stream_id"]
    counts = ("errors", "warns", "infos", "unknown", "passthrough")
    got = _live(spark, sf_dir, live_counts, keys)
    return got.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


@query(_records() + f"""
SELECT CASE WHEN {_TIMED} THEN ts_us // 60000000 * 60000000 END AS start, {_TIMED} AS timed, stream_id,
  tmpl AS template, eff AS level, count(*) AS n
FROM par WHERE eff >= 3 GROUP BY ALL""")
def stream_templates(spark, sf_dir):
    keys = ["start", "timed", "stream_id", "template"]
    got = _live(spark, sf_dir, live_templates, keys)
    return got.groupBy(*keys, "level").agg(F.sum("n").alias("n")).withColumn(
        "template", _plain("template"))


# --- files --------------------------------------------------------------------------------


@query(f"""
SELECT row_number() OVER (ORDER BY stream_id, pos) - 1 AS n, line FROM ({ORACLES["format_lines"]})""")
def written_order(spark, sf_dir):
    """Lines of text files in the order they were written."""
    path = f"{new_folder(spark)}/text"
    write_lines(format_lines(spark, sf_dir), path)
    lines = positioned_lines(spark, path, stream="folder")
    return with_ordinal(lines, "n", size=1 << 20).select("n", F.col("raw").alias("line"))


_DOCUMENT_LINES = "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(f"""
SELECT lang, count(*) AS lines, count(*) AS places,
  sum(length(CASE WHEN line LIKE '%' || chr(13) THEN left(line, -1) ELSE line END))::BIGINT AS chars
FROM ({_DOCUMENT_LINES}) WHERE lang <> 'en' GROUP BY lang""")
def read_kept_files(spark, sf_dir):
    """Lines of the files that a filter on their folder keeps, each in a place of its own."""
    path = f"{new_folder(spark)}/documents"
    table(spark, sf_dir, "documents").where("text is not null").select("text", "lang").write.partitionBy("lang").text(path)
    lines = read_lines(spark, path, keep=F.col("lang") != "en")
    return lines.groupBy("lang").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("stream_id", "pos").alias("places"),
        F.sum(F.length("raw")).alias("chars"))


@query(f"""
SELECT 'doc' || doc_id AS stream_id, strlen(line) >= 300 AS long, count(*) AS lines, sum(strlen(line))::BIGINT AS bytes
FROM ({_DOCUMENT_LINES}) GROUP BY ALL""")
def split_long_lines(spark, sf_dir):
    """Lines that are short enough to take, and those set apart."""
    short, long = split_long(document_lines(spark, sf_dir), 300)
    both = short.withColumn("long", F.lit(False)).unionByName(long.withColumn("long", F.lit(True)))
    return both.groupBy("stream_id", "long").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("raw")).alias("bytes"))


@query(ORACLES["summary_report"])
def summary_folders(spark, sf_dir):
    """Reports written to a bounded number of folders and read back."""
    path = f"{new_folder(spark)}/reports"
    write_summary(summary.summary_report(_part_records(spark, sf_dir)), path)
    return read_streams(spark, path).drop("pos")


@query(r"""
SELECT 'parts' AS stream_id, p_partkey AS pos, '--:--:-- INFO  part  body="' ||
  trim(regexp_replace(p_name || ' ' || p_type, '\s+', ' ', 'g')) || '"' AS line FROM part""")
def flattened_fields(spark, sf_dir):
    """Values of several lines come out on one."""
    body = F.concat("p_name", F.lit("\n\t "), "p_type")
    raw = F.to_json(F.struct(F.lit("INFO").alias("level"), F.lit("part").alias("msg"), body.alias("body")))
    lines = spread(table(spark, sf_dir, "part")).select(
        F.lit("parts").alias("stream_id"), F.col("p_partkey").alias("pos"), raw.alias("raw"))
    return render.format_lines(normalize(lines))


@query("""
SELECT 'suppliers' AS stream_id, s_suppkey AS pos, 'tilde' AS format, 3 AS level,
  'late crate ' || s_suppkey || ' of ' || s_nationkey AS message, 'WARN||late crate # of #' AS template FROM supplier""")
def registered_format(spark, sf_dir):
    """Lines of a format, and masks, that the caller brings along."""
    part = lambda raw, i: F.get(F.split(raw, "~"), F.lit(i))
    decode.register_format("tilde", lambda raw: raw.rlike("^[A-Z]+~"), lambda raw: F.array(
        F.struct(F.lit("level").alias("key"), part(raw, 0).alias("value")),
        F.struct(F.lit("msg").alias("key"), part(raw, 1).alias("value"))))
    try:
        raw = F.concat(F.lit("WARN~late crate "), F.col("s_suppkey").cast("string"), F.lit(" of "),
                       F.col("s_nationkey").cast("string"))
        lines = spread(table(spark, sf_dir, "supplier")).select(
            F.lit("suppliers").alias("stream_id"), F.col("s_suppkey").alias("pos"), raw.alias("raw"))
        records = enrich(lines, Options(mask_rules=(("[0-9]+", "#"),)))
    finally:
        decode.FORMATS.pop()
        del decode.FORMAT_NAMES["tilde"]
    return records.select("stream_id", "pos", "format", "level", "message", _plain("template").alias("template"))


# --- growing files ------------------------------------------------------------------------

#: Bytes of a stream that a batch takes: a part of all there are, within these.
_PER_BATCH, _PARTS = (1 << 18, 1 << 25), 24
#: Bytes that a task of a batch reads at least, if there are as many.
_PER_TASK = 1 << 21


def _log_folder(lines: DataFrame) -> str:
    """Lines written as log files, a folder per stream."""
    path = f"{new_folder(lines.sparkSession)}/logs"
    write_lines(lines.withColumnRenamed("raw", "line"), path, by_stream=True)
    return path


def _followed_lines(spark: SparkSession, logs: str) -> DataFrame:
    """The lines of a log folder as a stream, several batches of it.

    Batches grow with the files until a task has enough to do and no more than it can hold: each
    has a fixed cost, so small ones of one size would be as many as the files are long.
    """
    return tail_lines(spark, logs, stream="folder", **_batch_sizes(
        folder_bytes(logs), spark.sparkContext.defaultParallelism))


def _batch_sizes(total: int, cores: int) -> dict[str, str]:
    """Bytes of a stream in a batch, and of a task: one stream alone keeps all cores busy."""
    least, most = _PER_BATCH
    size = min(most, max(least, total // _PARTS))
    return {"maxBytesPerStream": str(size), "split": str(max(_PER_TASK, -(-size // cores)))}


def _ordinals(spark: SparkSession, logs: str) -> DataFrame:
    """The place of every line in its stream, by its position in the files."""
    lines = positioned_lines(spark, logs, stream="folder").select("stream_id", "pos")
    return materialize(with_ordinal(lines, "n", size=1 << 20))


def _read_to_end(writer) -> None:
    """Run batches until there is nothing new."""
    running = writer.start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()


def _followed(spark: SparkSession, logs: str, operator) -> tuple[DataFrame, str]:
    """What a stateful operator makes of the enriched lines of growing files, and its checkpoint."""
    out = new_folder(spark)
    records = enrich(_followed_lines(spark, logs))
    with state_store(spark):
        _read_to_end(operator(records).writeStream.format("parquet").option("path", f"{out}/rows")
                     .option("checkpointLocation", f"{out}/progress"))
    return spark.read.parquet(f"{out}/rows"), f"{out}/progress"


@query(ORACLES["fold_runs"].replace("h: pos, c: 1", "h: p - 1, c: 1"))
def stream_fold(spark, sf_dir):
    """The stream fold over growing files: runs that ended, and those open at the end."""
    logs = _log_folder(log_lines(spark, sf_dir, "json"))
    ended, progress = _followed(spark, logs, lambda records: fold_stream(records, held=False))
    runs = ended.unionByName(open_runs(spark, progress)).withColumnRenamed("head_pos", "pos")
    return runs.join(_ordinals(spark, logs), ["stream_id", "pos"]).select(
        "stream_id", F.col("n").alias("head_pos"), "repeat", _plain("template").alias("template"))


@query(_records() + _CONSTANT + f"""
, o AS (SELECT stream_id, pos, row_number() OVER (PARTITION BY stream_id ORDER BY pos) - 1 AS n FROM rec),
g AS ({_CORR}),
l AS ({_RELATED}),
k AS (SELECT stream_id, pos, string_agg(i::VARCHAR, ',' ORDER BY i) AS constant FROM j WHERE n >= 3 AND lo = hi GROUP BY ALL)
SELECT o.stream_id, o.n, g.corr_key, r.n AS related_n, l.related_clock, l.summary AS related_summary,
  coalesce(k.constant, '') AS constant
FROM o JOIN par ON par.stream_id = o.stream_id AND par.pos = o.pos
LEFT JOIN g ON g.stream_id = o.stream_id AND g.pos = o.pos
LEFT JOIN l ON l.stream_id = o.stream_id AND l.pos = o.pos
LEFT JOIN o r ON r.stream_id = l.stream_id AND r.pos = l.related_pos
LEFT JOIN k ON k.stream_id = o.stream_id AND k.pos = o.pos""")
def stream_marks(spark, sf_dir):
    """Groups, links and constant fields of the lines of growing files."""
    logs = _log_folder(log_lines(spark, sf_dir))
    marks, _ = _followed(spark, logs, mark_stream)
    places = _ordinals(spark, logs)
    targets = places.select("stream_id", F.col("pos").alias("related_pos"), F.col("n").alias("related_n"))
    return marks.join(places, ["stream_id", "pos"]).join(targets, ["stream_id", "related_pos"], "left").select(
        "stream_id", "n", "corr_key", "related_n", "related_clock", "related_summary",
        F.array_join(F.array_sort("constant"), ",").alias("constant"))


@query(_records() + f"""
, o AS (SELECT stream_id, pos, row_number() OVER (PARTITION BY stream_id ORDER BY pos) - 1 AS n FROM rec),
l AS ({_RELATED})
SELECT o.stream_id, o.n, r.n AS related_n, l.related_clock, l.summary AS related_summary
FROM l JOIN o ON o.stream_id = l.stream_id AND o.pos = l.pos
JOIN o r ON r.stream_id = l.stream_id AND r.pos = l.related_pos""")
def stream_related(spark, sf_dir):
    """Links to the latest related failure in growing files, state by method."""
    logs = _log_folder(log_lines(spark, sf_dir))
    links, _ = _followed(spark, logs, related_stream)
    places = _ordinals(spark, logs)
    targets = places.select("stream_id", F.col("pos").alias("related_pos"), F.col("n").alias("related_n"))
    return links.join(places, ["stream_id", "pos"]).join(targets, ["stream_id", "related_pos"]).select(
        "stream_id", "n", "related_n", "related_clock", "related_summary")


@query(ORACLES["summary_report"])
def stream_report(spark, sf_dir):
    """The report from a state that is merged batch by batch."""
    logs = _log_folder(_part_lines(spark, sf_dir))
    out = new_folder(spark)
    records = enrich(_followed_lines(spark, logs))
    _read_to_end(records.writeStream.foreachBatch(lambda rows, batch: merge_report(rows, batch, f"{out}/state"))
                 .option("checkpointLocation", f"{out}/progress"))
    return live_report(spark, f"{out}/state")


@query(_records() + """
SELECT o.stream_id, o.n, ts_us AS us FROM rec
JOIN (SELECT stream_id, pos, row_number() OVER (PARTITION BY stream_id ORDER BY pos) - 1 AS n FROM rec) o
  ON o.stream_id = rec.stream_id AND o.pos = rec.pos WHERE ts_us IS NOT NULL""")
def stream_late_kept(spark, sf_dir):
    """Timed lines on time and late ones, which together are all."""
    logs = _log_folder(log_lines(spark, sf_dir))
    out = new_folder(spark)
    lines = _followed_lines(spark, logs)
    records = normalize(lines).where("ts is not null").select("stream_id", "pos", "ts")
    _read_to_end(records.writeStream.foreachBatch(lambda rows, batch: split_late(rows, batch, out, "2 seconds"))
                 .option("checkpointLocation", f"{out}/progress"))
    both = spark.read.parquet(f"{out}/on_time").unionByName(spark.read.parquet(f"{out}/late"))
    return both.join(_ordinals(spark, logs), ["stream_id", "pos"]).select(
        "stream_id", "n", F.unix_micros("ts").alias("us"))
