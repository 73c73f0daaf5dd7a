"""Operators that look at neighbouring records, on a live stream.

Count windows and the stream fold need the records of a stream one after the other, so
their state is keyed by ``stream_id``; streams run in parallel. State is one entry per run,
per request key and per method; a batch reads and writes only the entries it touches. Of
a batch's records a task holds what the operator needs of them, as columns; bound the
batch at the source (``maxBytesPerStream`` of ``tail_lines``, ``maxFilesPerTrigger``,
``maxOffsetsPerTrigger``).

They need the RocksDB state store: see :func:`state_store`. Lines of growing files come
with positions from ``sources.tail``.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logloom.operators.columns import MIN_SEEN
from logloom.operators.columns import WINDOW as FIELD_WINDOW
from logloom.operators.correlate import GROUP_SPAN_US, LINK_SPAN_US
from logloom.operators.correlate import WINDOW as RECORD_WINDOW
from logloom.operators.fold import IDLE_MS, MAX_HOLD_MS
from logloom.operators.identity import summarize
from logloom.operators.runs import OpenRuns
from logloom.schema import WARN

RUNS_SCHEMA = "stream_id string, head_pos long, repeat long, template string"
MARKS_SCHEMA = (
    "stream_id string, pos long, corr_key string, related_pos long, related_clock string, "
    "related_summary string, constant array<int>"
)
RELATED_SCHEMA = "stream_id string, pos long, related_pos long, related_clock string, related_summary string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Start stateful queries inside; the session's own state store comes back after.

    State lies in one partition a core at most: Spark does not merge partitions of state, and
    in every batch each of them costs a task, a commit and a Python worker, empty or not.
    A query that goes on from a checkpoint keeps the number it began with.
    """
    old = {name: spark.conf.get(name) for name in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, _ROCKSDB)
    spark.conf.set(_PARTITIONS, min(int(old[_PARTITIONS]), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def _none(value):
    """None for a missing value of any kind."""
    return None if value is None or value is pd.NaT or value != value else value


def _in_order(rows: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple]:
    """A batch's records by position, from columns; frames are dropped as they are read."""
    parts: dict[str, list[np.ndarray]] = {n: [] for n in names}
    for frame in rows:
        for n in names:
            parts[n].append(frame[n].to_numpy(dtype=np.int64 if n == "pos" else object))
    columns = {n: np.concatenate(parts.pop(n)) for n in names}
    for i in np.argsort(columns["pos"], kind="stable"):
        yield tuple(columns[n][i] for n in names)


class _Cached:
    """A map state whose entries are read when first asked for, and written once a batch."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: str, value: str) -> None:
        self.state = handle.getMapState(name, key, value)
        self.start()

    def start(self) -> None:
        self.held: dict = {}
        self.changed: set = set()

    def get(self, key):
        if key not in self.held:
            self.held[key] = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
        return self.held[key]

    def put(self, key, value: tuple | None) -> None:
        self.held[key] = value
        self.changed.add(key)

    def write(self) -> None:
        for key in self.changed:
            if self.held[key] is not None:
                self.state.updateValue((key,), self.held[key])
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))
        self.start()


class FoldStream(StatefulProcessor):
    """The stream fold: a state entry per open run, and a timer where one is held.

    With ``held`` paused and long-held runs, and older ones before them, come out by
    processing time; a timer that a run has outlived does nothing but set the next.
    """

    def __init__(self, held: bool = True) -> None:
        self.held = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState(
            "runs", "template string", "rank long, head long, count long, last long, opened long, at long")
        self.seen = handle.getValueState("seen", "p long, heads long, recent array<string>")

    def _load(self) -> None:
        self.fold = OpenRuns()
        self.ranks: dict[str, int] = {}
        self.times: dict[str, tuple[int, int]] = {}
        self.heads = 0
        if self.seen.exists():
            self.fold.p, self.heads, recent = self.seen.get()
            self.fold.recent = deque(recent)
            for (template,), (rank, head, count, last, opened, at) in sorted(
                    self.runs.iterator(), key=lambda e: e[1][0]):
                self.fold.open[template] = [head, count]
                self.fold.last[template] = last
                self.ranks[template] = rank
                self.times[template] = (opened, at)
        self.before = {t: tuple(r) for t, r in self.fold.open.items()}

    def _save(self) -> None:
        fold = self.fold
        for t in self.before.keys() - fold.open.keys():
            self.runs.removeKey((t,))
        for t, run in fold.open.items():
            if self.before.get(t) != tuple(run):
                self.runs.updateValue((t,), (self.ranks[t], *run, fold.last[t], *self.times[t]))
        self.seen.update((fold.p, self.heads, list(fold.recent)))
        if self.held and fold.open:
            due = min(min(at + IDLE_MS, opened + MAX_HOLD_MS) for opened, at in (self.times[t] for t in fold.open))
            if due not in list(self.handle.listTimers()):
                self.handle.registerTimer(due)

    @staticmethod
    def _rows(key, runs) -> pd.DataFrame:
        out = [(key[0], head, count, template) for template, head, count in runs]
        return pd.DataFrame(out, columns=["stream_id", "head_pos", "repeat", "template"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        now = timerValues.getCurrentProcessingTimeInMs() if self.held else 0
        self._load()
        done: list[tuple] = []
        for pos, template in _in_order(rows, ["pos", "template"]):
            template = _none(template)
            done += self.fold.add(template, int(pos))
            if template is not None:
                if self.fold.open[template][1] == 1:
                    self.heads += 1
                    self.ranks[template] = self.heads
                    self.times[template] = (now, now)
                else:
                    self.times[template] = (self.times[template][0], now)
        self._save()
        yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentProcessingTimeInMs()
        self._load()
        ripe = [
            t for t in self.fold.open
            if now - self.times[t][1] >= IDLE_MS or now - self.times[t][0] >= MAX_HOLD_MS
        ]
        done = self.fold.flush(ripe[-1]) if ripe else []
        self._save()
        yield self._rows(key, done)

    def close(self) -> None:
        pass


class MarkStream(StatefulProcessor):
    """Groups, links and constant fields by look-up.

    Per request key: places and times of its records inside the window, times also
    sorted. Per method: its warnings and errors inside the window. Per field: how often each
    value stands in the window. The ring of places says what leaves a window, and where from.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "record long, fields long")
        # What a place of the window holds: its key, and its method if it can be pointed at.
        self.ring = _Cached(handle, "ring", "place int", "key string, method string")
        self.keys = _Cached(handle, "keys", "key string", "places array<long>, times array<long>")
        self.failed = _Cached(
            handle, "failed", "method string",
            "entries array<struct<place:long,us:long,template:string,pos:long,clock:string,summary:string>>")
        self.fields = _Cached(handle, "fields", "place int", "names array<string>, vals array<string>")
        self.values = _Cached(handle, "vals", "name string", "vals array<string>, counts array<long>")
        self.parts = (self.ring, self.keys, self.failed, self.fields, self.values)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        place, seen = self.at.get() if self.at.exists() else (0, 0)
        for part in self.parts:
            part.start()
        self.groups: dict[str, _Group] = {}
        self.links: dict[str, deque] = {}
        self.counts: dict[str, dict[str, int]] = {}
        names = ["pos", "us", "corr_key", "method", "template", "effective", "summary", "clock", "fields"]
        out = []
        for pos, us, corr_key, method, template, effective, summary, clock, fields in _in_order(rows, names):
            us, corr_key, method = _none(us), _none(corr_key), _none(method)
            us = None if us is None else int(us)
            self._leave(place)
            grouped = corr_key is not None and self._group(corr_key).near(us)
            link = self._link(method, us, template)
            if corr_key is not None:
                self._group(corr_key).add(place, us)
            points = method is not None and effective >= WARN
            if points:
                self._links(method).append((place, us, template, int(pos), _none(clock), _none(summary)))
            self.ring.put(place % RECORD_WINDOW, (corr_key, method if points else None))
            place += 1
            flags: list[int] = []
            fields = [(f["key"], f["val"]) for f in fields]
            if fields:
                flags = self._constant(seen, fields)
                seen += 1
            out.append((
                key[0], int(pos), corr_key if grouped else None,
                link[3] if link else None, link[4] if link else None, link[5] if link else None, flags,
            ))
        for k, group in self.groups.items():
            self.keys.put(k, group.stored())
        for m, entries in self.links.items():
            self.failed.put(m, ([*entries],) if entries else None)
        for n, counts in self.counts.items():
            self.values.put(n, (list(counts), list(counts.values())) if counts else None)
        for part in self.parts:
            part.write()
        self.at.update((place, seen))
        columns = [c.split()[0] for c in MARKS_SCHEMA.split(", ")]
        pdf = pd.DataFrame(out, columns=columns)
        pdf["related_pos"] = pdf["related_pos"].astype("Int64")
        yield pdf

    def _leave(self, place: int) -> None:
        """What the window loses when ``place`` comes in."""
        old = self.ring.get(place % RECORD_WINDOW)
        if old is None:
            return
        if old[0] is not None:
            self._group(old[0]).drop(place - RECORD_WINDOW)
        if old[1] is not None:
            links = self._links(old[1])
            if links and links[0][0] == place - RECORD_WINDOW:
                links.popleft()

    def _group(self, key: str) -> _Group:
        if key not in self.groups:
            self.groups[key] = _Group(self.keys.get(key))
        return self.groups[key]

    def _links(self, method: str) -> deque:
        if method not in self.links:
            found = self.failed.get(method)
            self.links[method] = deque(tuple(e) for e in found[0]) if found else deque()
        return self.links[method]

    def _link(self, method: str | None, us: int | None, template: str) -> tuple | None:
        if method is None:
            return None
        return next(
            (e for e in reversed(self._links(method)) if e[2] != template
             and (e[1] is None or us is None or abs(e[1] - us) <= LINK_SPAN_US)), None)

    def _count(self, name: str) -> dict[str, int]:
        if name not in self.counts:
            found = self.values.get(name)
            self.counts[name] = dict(zip(*found, strict=True)) if found else {}
        return self.counts[name]

    def _constant(self, seen: int, fields: list[tuple[str, str]]) -> list[int]:
        old = self.fields.get(seen % FIELD_WINDOW)
        for name, val in zip(*old, strict=True) if old else ():
            counts = self._count(name)
            counts[val] -= 1
            if not counts[val]:
                del counts[val]
        self.fields.put(seen % FIELD_WINDOW, ([n for n, _ in fields], [v for _, v in fields]))
        for name, val in fields:
            counts = self._count(name)
            counts[val] = counts.get(val, 0) + 1
        return [
            i for i, (name, _) in enumerate(fields)
            if len(self._count(name)) == 1 and sum(self._count(name).values()) >= MIN_SEEN
        ]

    def close(self) -> None:
        pass


class RelatedStream(StatefulProcessor):
    """Links of one method's records to the latest failure before them, by event time.

    State is an entry per failure that a record to come may still point at: failures
    older than the latest time seen by the span and ``delay`` go.
    """

    def __init__(self, span_us: int, delay_us: int) -> None:
        self.span, self.delay = span_us, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failed = handle.getMapState(
            "failed", "pos long", "us long, template string, clock string, summary string")
        self.latest = handle.getValueState("latest", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        latest = self.latest.get()[0] if self.latest.exists() else -(2**62)
        stored = {pos: tuple(e) for (pos,), e in self.failed.iterator()}
        # By template: most records meet another template's newest failure at once.
        recent: dict[str, deque] = {}
        for pos in sorted(stored):
            recent.setdefault(stored[pos][1], deque()).append((pos, *stored[pos]))
        out = []
        for pos, us, template, effective, summary, clock in _in_order(
                rows, ["pos", "us", "template", "effective", "summary", "clock"]):
            pos, us = int(pos), int(us)
            latest = max(latest, us)
            found = None
            for other, entries in recent.items():
                while entries and entries[0][1] < latest - self.span - self.delay:
                    entries.popleft()
                if other != template:
                    near = next((e for e in reversed(entries) if abs(e[1] - us) <= self.span), None)
                    if near and (found is None or near[0] > found[0]):
                        found = near
            if found:
                out.append((key[0], pos, found[0], found[3], found[4]))
            if effective >= WARN:
                recent.setdefault(template, deque()).append((pos, us, template, _none(clock), _none(summary)))
        kept = {e[0]: e[1:] for entries in recent.values() for e in entries
                if e[1] >= latest - self.span - self.delay}
        for pos in stored.keys() - kept.keys():
            self.failed.removeKey((pos,))
        for pos in kept.keys() - stored.keys():
            self.failed.updateValue((pos,), kept[pos])
        self.latest.update((latest,))
        columns = [c.split()[0] for c in RELATED_SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass


class _Group:
    """Records of a request key inside the window."""

    def __init__(self, stored: tuple | None) -> None:
        self.entries = deque(zip(*stored, strict=True)) if stored else deque()
        self.times = sorted(us for _, us in self.entries if us is not None)

    def near(self, us: int | None) -> bool:
        """Whether one of them lies within the span; a missing time does not separate two."""
        if not self.entries or us is None or len(self.times) < len(self.entries):
            return bool(self.entries)
        at = bisect_left(self.times, us - GROUP_SPAN_US)
        return at < len(self.times) and self.times[at] <= us + GROUP_SPAN_US

    def add(self, place: int, us: int | None) -> None:
        self.entries.append((place, us))
        if us is not None:
            insort(self.times, us)

    def drop(self, place: int) -> None:
        if self.entries and self.entries[0][0] == place:
            _, us = self.entries.popleft()
            if us is not None:
                del self.times[bisect_left(self.times, us)]

    def stored(self) -> tuple | None:
        return ([p for p, _ in self.entries], [us for _, us in self.entries]) if self.entries else None


def fold_stream(records: DataFrame, held: bool = True) -> DataFrame:
    """Runs of a live stream of identified records, as they end: append mode.

    Without ``held`` only the records end a run; :func:`open_runs` has those still open.
    """
    return (
        records.select(
            "stream_id", "pos", F.when(F.col("parsed"), F.col("template")).alias("template")
        )
        .groupBy("stream_id")
        .transformWithStateInPandas(
            FoldStream(held), RUNS_SCHEMA, outputMode="Append", timeMode="ProcessingTime" if held else "None"
        )
    )


def open_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Runs that ``fold_stream`` holds open, from the checkpoint of its last batch."""
    with state_store(spark):
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "runs").load()
    return state.select(
        F.col("key.stream_id").alias("stream_id"), F.col("user_map_value.head").alias("head_pos"),
        F.col("user_map_value.count").alias("repeat"), F.col("user_map_key.template").alias("template"))


def mark_stream(records: DataFrame) -> DataFrame:
    """Group key, link and constant fields of each parsed record of a live stream."""
    return (
        records.filter("parsed")
        .select(
            "stream_id", "pos", F.unix_micros("ts").alias("us"), "clock", "effective",
            "template", "corr_key", "method", "fields",
            F.when(F.col("effective") >= WARN, summarize(F.col("text"))).alias("summary"),
        )
        .groupBy("stream_id")
        .transformWithStateInPandas(
            MarkStream(), MARKS_SCHEMA, outputMode="Append", timeMode="None"
        )
    )


def related_stream(records: DataFrame, span_us: int = LINK_SPAN_US, delay: str = "10 seconds") -> DataFrame:
    """``stream_id, pos, related_pos, ...``: the latest failure of the same method before a record.

    Keyed by stream and method, so a stream is spread over its methods. Records without a
    time or a method are left out, and event time in place of a count of records bounds
    what is looked back on: out of order by at most ``delay``. A join of the two sides by
    interval would list every failure in the span for each record; the state gives the
    latest by look-up.
    """
    number, unit = delay.split()
    scale = {"millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6}[unit.rstrip("s")]
    return (
        records.filter(F.col("parsed") & F.col("method").isNotNull() & F.col("ts").isNotNull())
        .select(
            "stream_id", "method", "pos", F.unix_micros("ts").alias("us"), "clock", "effective", "template",
            F.when(F.col("effective") >= WARN, summarize(F.col("text"))).alias("summary"),
        )
        .groupBy("stream_id", "method")
        .transformWithStateInPandas(
            RelatedStream(span_us, int(float(number) * scale)), RELATED_SCHEMA, outputMode="Append", timeMode="None"
        )
    )
