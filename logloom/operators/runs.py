"""The stream fold, exact and in parallel.

What happens in the fold depends on all records before: which runs are open, and in what
order their heads came. A stream's chunks are folded side by side nevertheless:

1. Every chunk is folded once from the state that the few records before it suggest. The
   order of the runs it inherits is kept symbolic: the fold notes which of them were open
   (all ended by a rule or go on) and only those facts about their order that a decision
   hung on. The outcome, a *case*, then holds for every order in which these facts hold:
   what inherited runs are still open, in inherited order, and which new ones follow.
2. A case's outcome must be covered by a case of the next chunk. Where it is not, because
   the records before suggested other runs, that chunk is folded from it as well. Every
   flush ends the oldest inherited run, so outcomes coincide after a few flushes, and
   without a flush no fact is needed: steady traffic is covered at once in any order.
3. Cases compose: one after the other is a case again. They are merged in a tree of
   ``FAN`` chunks a node, and the one true start of every chunk is read off on the way down.
4. Each chunk is folded from its true start for its runs, which are joined at the edges.

So records are read twice, plus the chunks asked for in 2; all else is a few values a chunk,
in steps that grow with the logarithm of the chunks. A true start that contradicts the
facts of every case is folded like an outcome that was not covered; the result is exact.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.ordinals import CHUNK, SLICE, with_chunks, with_ordinal
from logloom.sources.materialize import materialize, new_folder

# Records a run survives without a match, and open runs at most.
FOLD_WINDOW = 10
MAX_OPEN_RUNS = 8
#: Records before a chunk that suggest the state it starts in; more than the window.
LOOKBACK = 48
#: Chunks, or nodes, that are merged at a time.
FAN = 256


class OpenRuns:
    """Open runs of one stream, oldest head first: ``open[template] = [head, count]``.

    ``add`` returns the runs that ended, in head order, as ``(template, head, count)``.
    """

    def __init__(self) -> None:
        self.open: dict[str, list] = {}
        self.last: dict[str, int] = {}
        self.recent: deque[str] = deque()
        self.p = 0

    @classmethod
    def resumed(cls, open_: list[str], before: list[str]):
        """Inherited runs without a head; ``before`` holds the templates of the records before."""
        out = cls()
        out.p = len(before)
        out.recent.extend(before[-(FOLD_WINDOW + 1):])
        last = {t: p for p, t in enumerate(before, 1)}
        out.open = {t: [None, 0] for t in open_}
        out.last = {t: last[t] for t in open_}
        return out

    def flush(self, upto: str | None = None) -> list[tuple]:
        """End runs from the oldest to that of template ``upto``, or all."""
        done = []
        for t in list(self.open):
            done.append((t, *self.open.pop(t)))
            del self.last[t]
            if t == upto:
                break
        return done

    def add(self, template: str | None, head) -> list[tuple]:
        if template is None:
            return self.flush()
        self.p += 1
        done: list[tuple] = []
        if len(self.recent) > FOLD_WINDOW:
            old = self.recent.popleft()
            # One template at most is out of reach for the first time.
            if self.last.get(old) == self.p - FOLD_WINDOW - 1:
                done = self.flush(old)
        self.recent.append(template)
        run = self.open.get(template)
        if run is not None:
            run[1] += 1
        else:
            if len(self.open) == MAX_OPEN_RUNS:
                done = done + self.flush(next(iter(self.open)))
            self.open[template] = [head, 1]
        self.last[template] = self.p
        return done


class _Noted(OpenRuns):
    """Also notes the facts about the order of inherited runs that flushes hang on."""

    def __init__(self) -> None:
        super().__init__()
        self.facts: set[tuple[str, str]] = set()

    def flush(self, upto: str | None = None) -> list[tuple]:
        if upto is not None and self.open[upto][0] is None:
            inherited = [t for t, run in self.open.items() if run[0] is None]
            at = inherited.index(upto)
            self.facts.update((t, upto) for t in inherited[:at])
            self.facts.update((upto, t) for t in inherited[at + 1:])
        return super().flush(upto)


def _templates(rows: pd.DataFrame) -> tuple[list, list, list]:
    """A chunk's rows in order: templates before it that count, then its own, and their places."""
    rows = rows.sort_values("q")
    own = rows["own"].to_numpy()
    templates = [None if pd.isna(t) else t for t in rows["template"]]
    before = [t for t, mine in zip(templates, own, strict=True) if not mine]
    mine = [t for t, m in zip(templates, own, strict=True) if m]
    return before, mine, rows["pos"][own].tolist()


_CASE = "stream_id string, chunk long, start array<string>, facts array<array<string>>, out array<string>, kept int"


def _cases(key: tuple, rows: pd.DataFrame, starts: pd.DataFrame | None) -> pd.DataFrame:
    """A case of a chunk from each start; without starts, from what the rows before suggest."""
    before, mine, _ = _templates(rows)
    if starts is None:
        guess = OpenRuns()
        for t in before:
            guess.add(t, 0)
        wanted = [list(guess.open)]
    else:
        wanted = [list(s) for s in starts["start"]]
    parsed = [t for t in before if t is not None]
    out = []
    for start in wanted:
        state = _Noted.resumed(start, parsed)
        for t in mine:
            state.add(t, 0)
        kept = sum(run[0] is None for run in state.open.values())
        out.append((key[0], key[1], start, sorted(map(list, state.facts)), list(state.open), kept))
    return pd.DataFrame(out, columns=["stream_id", "chunk", "start", "facts", "out", "kept"])


def _holds(case: tuple, state: list[str]) -> bool:
    """Whether a case ``(start, facts, out, kept)`` is about this state."""
    place = {t: i for i, t in enumerate(state)}
    return place.keys() == set(case[0]) and all(place[a] < place[b] for a, b in case[1])


def _after(case: tuple, state: list[str]) -> tuple[list[str], int]:
    """The state behind a case that holds, and how many of its runs are inherited."""
    kept = set(case[2][:case[3]])
    inherited = [t for t in state if t in kept]
    return inherited + list(case[2][case[3]:]), len(inherited)


def _composed(first: tuple, then: tuple) -> tuple:
    """Two cases one after the other, as a case of the first one's start."""
    start, facts, out, kept = first
    inherited = set(out[:kept])
    both = {(a, b) for a, b in then[1] if a in inherited and b in inherited}
    state, _ = _after(then, out)
    goes_on = set(then[2][:then[3]])
    return start, [*facts, *map(list, both)], state, sum(t in goes_on for t in out[:kept])


def _by_chunk(pdf: pd.DataFrame) -> dict[int, list[tuple]]:
    found: dict[int, list[tuple]] = {}
    for r in pdf.sort_values("chunk").itertuples():
        case = (list(r.start), [list(f) for f in r.facts], list(r.out), int(r.kept))
        found.setdefault(int(r.chunk), []).append(case)
    return found


def _merged(key: tuple, cases: pd.DataFrame) -> pd.DataFrame:
    """Cases of a node: those of its first chunk, carried through all others."""
    chunks = list(_by_chunk(cases).values())
    out = []
    for case in chunks[0]:
        for following in chunks[1:]:
            case = _composed(case, next(c for c in following if _holds(c, case[2])))
        facts = sorted({tuple(f) for f in case[1]})
        out.append((key[0], key[1], case[0], [list(f) for f in facts], case[2], case[3]))
    return pd.DataFrame(out, columns=["stream_id", "chunk", "start", "facts", "out", "kept"])


def _descended(key: tuple, starts: pd.DataFrame, cases: pd.DataFrame) -> pd.DataFrame:
    """True starts of a node's children; ``met`` is false where no case is about one."""
    out = []
    state = list(starts["start"].iloc[0]) if len(starts) else None
    if state is not None:
        for chunk, known in _by_chunk(cases).items():
            case = next((c for c in known if _holds(c, state)), None)
            out.append((key[0], chunk, state, case is not None))
            if case is None:
                break
            state, _ = _after(case, state)
    return pd.DataFrame(out, columns=["stream_id", "chunk", "start", "met"])


def _uncovered(asked: DataFrame, cases: DataFrame) -> DataFrame:
    """Starts that no case of their chunk is about."""
    place = lambda t: F.array_position("a.start", t)
    about = (
        (F.col("a.stream_id") == F.col("c.stream_id")) & (F.col("a.chunk") == F.col("c.chunk"))
        & (F.array_sort("a.start") == F.array_sort("c.start"))
        & F.forall("c.facts", lambda f: place(f[0]) < place(f[1]))
    )
    return asked.alias("a").join(cases.alias("c"), about, "left_anti")


def _true_starts(cases: DataFrame, last: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """``stream_id, chunk, start, met``: up through the tree of merged cases, and down again."""
    node = F.floor(F.col("chunk") / fan).cast("long")
    levels = [cases]
    while last >= fan:
        nodes = levels[-1].withColumn("_node", node).groupBy("stream_id", "_node").applyInPandas(_merged, _CASE)
        levels.append(materialize(nodes))
        last //= fan
    starts = levels[-1].select("stream_id").distinct().select(
        "stream_id", F.lit(0).cast("long").alias("chunk"), F.array().cast("array<string>").alias("start"),
        F.lit(True).alias("met"))
    missed = None
    for depth, level in reversed(list(enumerate(levels))):
        starts = materialize(
            starts.where("met").groupBy("stream_id", "chunk")
            .cogroup(level.withColumn("_node", node).groupBy("stream_id", "_node"))
            .applyInPandas(_descended, "stream_id string, chunk long, start array<string>, met boolean"))
        here = starts.where("not met").select("stream_id", (F.col("chunk") * fan**depth).alias("chunk"), "start")
        missed = here if missed is None else missed.unionByName(here)
    return starts, missed


def _fold_parts(key: tuple, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """A chunk's run parts from its true start.

    A part without a head continues the run of its template from the chunk before; an
    open part goes on in the next.
    """
    names = ["stream_id", "chunk", "n", "template", "head_pos", "repeat", "open"]
    if not len(starts):  # the copies of a stream's last rows
        return pd.DataFrame(columns=names)
    before, mine, places = _templates(rows)
    fold = OpenRuns.resumed(list(starts["start"].iloc[0]), [t for t in before if t is not None])
    done = [(*run, False) for t, pos in zip(mine, places, strict=True) for run in fold.add(t, pos)]
    done += [(t, *run, True) for t, run in fold.open.items()]
    pdf = pd.DataFrame([(key[0], key[1], n, *part) for n, part in enumerate(done)], columns=names)
    return pdf.astype({c: "Int64" for c in ("chunk", "n", "head_pos", "repeat")})


def fold_runs(
    df: DataFrame, chunk: int = CHUNK, size: int = SLICE, fan: int = FAN, max_rounds: int | None = None
) -> DataFrame:
    """The stream fold, exact: ``stream_id, head_pos, repeat, template``.

    ``max_rounds`` makes it an error to fold chunks anew more often.
    """
    template = F.when(F.col("parsed"), F.col("template")).alias("template")
    numbered = with_ordinal(df.select("stream_id", "pos", template), "q", size=size)
    rows = materialize(with_chunks(numbered, "q", LOOKBACK, chunk))
    at = ["stream_id", "chunk"]
    chunks = materialize(rows.where("own").groupBy(*at).count())
    spark, folder = df.sparkSession, new_folder(df.sparkSession)
    last = chunks.agg(F.max("chunk")).first()[0] or 0

    def folded(asked: DataFrame | None, number: int) -> DataFrame:
        """Cases of a round, written to the folder of all."""
        if asked is None:
            got = rows.groupBy(*at).applyInPandas(lambda key, pdf: _cases(key, pdf, None), _CASE)
        else:
            some = rows.join(asked.select(*at).distinct(), at, "left_semi")
            got = some.groupBy(*at).cogroup(asked.groupBy(*at)).applyInPandas(_cases, _CASE)
        # The copies of a stream's last rows make a chunk without rows of its own.
        got.join(chunks.select(*at), at, "left_semi").write.parquet(f"{folder}/round={number}")
        return spark.read.schema(_CASE).parquet(f"{folder}/round={number}")

    number, fresh = 0, folded(None, 0)
    while True:
        everything = spark.read.schema(f"{_CASE}, round int").parquet(folder)
        asked = fresh.select("stream_id", (F.col("chunk") + 1).alias("chunk"), F.col("out").alias("start")).distinct()
        asked = materialize(_uncovered(asked.join(chunks.select(*at), at, "left_semi"), everything))
        if asked.isEmpty():
            starts, missed = _true_starts(everything.drop("round"), last, fan)
            if missed.isEmpty():
                break
            asked = missed
        number += 1
        if max_rounds is not None and number >= max_rounds:
            raise RuntimeError(f"fold states did not settle in {number} rounds")
        fresh = folded(asked, number)
    parts = rows.groupBy(*at).cogroup(starts.groupBy(*at)).applyInPandas(
        _fold_parts,
        "stream_id string, chunk long, n long, template string, head_pos long, repeat long, open boolean")
    return _joined(materialize(parts))


def _joined(parts: DataFrame) -> DataFrame:
    """Whole runs from the parts of all chunks."""
    edged = F.col("head_pos").isNull() | F.col("open")
    chain = Window.partitionBy("stream_id", "template").orderBy("chunk", "n").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # A template is open once at most, so a headless part continues the part
    # of its template that the chunk before left open.
    linked = (
        parts.filter(edged)
        .withColumn("_run", F.count("head_pos").over(chain))
        .groupBy("stream_id", "template", "_run")
        .agg(F.min("head_pos").alias("head_pos"), F.sum("repeat").alias("repeat"))
    )
    columns = ["stream_id", "head_pos", "repeat", "template"]
    return parts.filter(~edged).select(*columns).unionByName(linked.select(*columns))
