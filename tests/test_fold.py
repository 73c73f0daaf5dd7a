"""Folding against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import runs
from logloom.operators.fold import RUN_COLUMNS, fold, fold_islands, fold_session
from logloom.operators.runs import FOLD_WINDOW, MAX_OPEN_RUNS, OpenRuns, fold_runs

SCHEMA = "stream_id string, pos long, parsed boolean, template string"


def _stream(rnd, name, n, templates, plain):
    out, pos = [], 0
    for i in range(n):
        pos += rnd.choice([1, 1, 2, 5])
        some = templates[: 1 + (i // 40) % len(templates)]
        out.append((name, pos, None if rnd.random() < plain else rnd.choice(some)))
    return out


def _fixture():
    rnd = random.Random(5)
    return (
        _stream(rnd, "many", 500, "abcdefghijklmnop", 0.003)
        + _stream(rnd, "two", 400, "ab", 0)
        + _stream(rnd, "broken", 200, "abcdefghijklmnopqrstuvwxyz", 0.05)
    )


def _frame(spark, rows):
    return spark.createDataFrame(
        [(s, p, t is not None, t) for s, p, t in rows], SCHEMA
    ).repartition(4)


def _plain_islands(rows):
    out = []
    for stream in {r[0] for r in rows}:
        p, open_ = 0, {}
        for s, pos, t in rows:
            if s != stream:
                continue
            if t is None:
                out += [(s, *v[:3], k) for k, v in open_.items()]
                open_ = {}
                continue
            p += 1
            if t in open_ and p - open_[t][3] <= FOLD_WINDOW:
                v = open_[t]
                v[1], v[2], v[3] = pos, v[2] + 1, p
            else:
                if t in open_:
                    out.append((s, *open_[t][:3], t))
                open_[t] = [pos, pos, 1, p]
        out += [(stream, *v[:3], k) for k, v in open_.items()]
    return sorted(out)


def _plain_runs(rows):
    """Rules of the stream fold, written apart from the class under test."""
    out = []
    for stream in {r[0] for r in rows}:
        p, runs = 0, []  # run: template, last p, head, count

        def close(n, runs=runs, stream=stream):
            out.extend((stream, r[2], r[3], r[0]) for r in runs[:n])
            del runs[:n]

        for s, pos, t in rows:
            if s != stream:
                continue
            if t is None:
                close(len(runs))
                continue
            p += 1
            late = [i for i, r in enumerate(runs) if p - r[1] > FOLD_WINDOW]
            close(max(late) + 1 if late else 0)
            mine = next((r for r in runs if r[0] == t), None)
            if mine:
                mine[1], mine[3] = p, mine[3] + 1
                continue
            close(1 if len(runs) >= MAX_OPEN_RUNS else 0)
            runs.append([t, p, pos, 1])
        close(len(runs))
    return sorted(out)


def test_islands(spark):
    rows = _fixture()
    got = fold_islands(_frame(spark, rows), chunk=16, size=64)
    assert sorted(tuple(r) for r in got.collect()) == _plain_islands(rows)


def test_runs_in_chunks(spark):
    rows = _fixture()
    got = fold_runs(_frame(spark, rows), chunk=60, size=64)
    assert sorted(tuple(r) for r in got.collect()) == _plain_runs(rows)


def _emitted(templates):
    f = OpenRuns()
    done = [r for i, t in enumerate(templates) for r in f.add(t, i)]
    return done, f.flush()


def _blocks(rnd, n, templates):
    """Templates in shuffled blocks: runs that never end."""
    out = []
    while len(out) < n:
        out += rnd.sample(templates, len(templates))
    return out[:n]


def test_interleaved_runs_fold_side_by_side():
    before, after = _emitted("ababab")
    assert before == []
    assert [r[1:] for r in after] == [(0, 3), (1, 3)]


def test_rare_run_ends_after_the_window():
    before, after = _emitted("r" + "s" * (FOLD_WINDOW + 1))
    assert [(r[0], r[2]) for r in before] == [("r", 1)]
    assert [(r[0], r[2]) for r in after] == [("s", FOLD_WINDOW + 1)]


def test_an_ended_run_takes_older_ones_along():
    before, after = _emitted("ab" + "a" * 11)
    assert [(r[0], r[2]) for r in before] == [("a", 11), ("b", 1)]
    assert [(r[0], r[2]) for r in after] == [("a", 1)]


def test_ninth_template_pushes_out_the_oldest():
    before, _ = _emitted("abcdefghi")
    assert [r[0] for r in before] == ["a"]


def test_fold_keeps_heads_and_plain_lines(spark):
    rows = [("s", 0, "a"), ("s", 1, "a"), ("s", 2, None), ("s", 3, "a")]
    df = _frame(spark, rows)
    got = fold(df, fold_islands(df)).select("pos", "repeat").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, 2), (2, 0), (3, 1)]


def test_steady_interleaving_settles_in_few_rounds(spark):
    rows = [("s", i, "ba"[i % 2]) for i in range(1_001)]
    got = fold_runs(_frame(spark, rows), chunk=50, size=64, max_rounds=2).collect()
    assert sorted(tuple(r) for r in got) == [("s", 0, 501, "b"), ("s", 1, 500, "a")]


def test_shuffled_blocks_need_no_rounds_per_chunk(spark):
    """Orders of five runs differ at every edge; a tree of three levels finds them."""
    rnd = random.Random(8)
    rows = [("s", i, t) for i, t in enumerate(_blocks(rnd, 3_000, list("abcde")))]
    rows += [("u", i, t) for i, t in enumerate(_blocks(rnd, 700, list("abcdefgh")))]
    got = fold_runs(_frame(spark, rows), chunk=50, size=64, fan=4, max_rounds=3)
    assert sorted(tuple(r) for r in got.collect()) == _plain_runs(rows)


def test_rare_events_between_shuffled_blocks(spark):
    """A rare template takes all older runs along when it ends; crowded streams push out the oldest."""
    rnd = random.Random(9)
    rows = []
    for name, some, rare in (("r", "abcd", 0.02), ("c", "abcdefghij", 0.05), ("p", "abc", 0.004)):
        for i, t in enumerate(_blocks(rnd, 900, list(some))):
            t = rnd.choice("xyz") if rnd.random() < rare else t
            rows.append((name, i, None if name == "p" and rnd.random() < 0.004 else t))
    got = fold_runs(_frame(spark, rows), chunk=50, size=64, fan=3)
    assert sorted(tuple(r) for r in got.collect()) == _plain_runs(rows)


def test_cases_hold_for_every_order_of_what_they_inherit():
    """A case, alone and composed, against the plain state in all orders its facts allow."""
    rnd = random.Random(10)

    def end(state, before, records):
        plain = OpenRuns.resumed(state, before)
        for t in records:
            plain.add(t, 0)
        return list(plain.open)

    def case(state, before, records):
        noted = runs._Noted.resumed(state, before)
        for t in records:
            noted.add(t, 0)
        kept = sum(r[0] is None for r in noted.open.values())
        return state, sorted(map(list, noted.facts)), list(noted.open), kept

    held = failed = 0
    for _ in range(300):
        names = "abcdefghijk"[: rnd.randint(3, 10)]
        before = _blocks(rnd, 20, list(names))
        start = list(dict.fromkeys(reversed(before[-10:])))[:MAX_OPEN_RUNS]
        one, two = ([rnd.choice(names + "z") if rnd.random() < 0.1 else t for t in _blocks(rnd, 30, list(names))] for _ in "12")
        first = case(start, before, one)
        then = case(first[2], before + one, two)
        both = runs._composed(first, then)
        for _ in range(10):
            state = rnd.sample(start, len(start))
            if runs._holds(first, state):
                assert runs._after(first, state)[0] == end(state, before, one)
            if runs._holds(both, state):
                held += 1
                assert runs._after(both, state)[0] == end(state, before, one + two)
            else:
                failed += 1
    assert held > 500 and failed > 100


def test_empty_stream(spark):
    assert fold_runs(_frame(spark, [("s", 0, "a")]).limit(0), chunk=50, size=64).count() == 0


def _cut_sessions(rows, idle, hold):
    """Runs by a loop over each template's records in time order."""
    runs, last = [], {}
    for us, pos, stream, template in sorted((us, pos, s, t) for s, pos, t, us in rows):
        run = last.get((stream, template))
        if not run or us - run["end"] > idle:
            run = last[stream, template] = {"from": us, "end": us, "part": None}
        part = (us - run["from"]) // hold
        if part != run["part"]:
            run["part"], run["own"] = part, [stream, pos, pos, 0, template, us, us]
            runs.append(run["own"])
        own, run["end"] = run["own"], us
        own[1], own[2], own[3], own[6] = min(own[1], pos), max(own[2], pos), own[3] + 1, us
    return sorted(map(tuple, runs))


@pytest.mark.parametrize("slices", [1, 3, 1024])
def test_sessions_are_cut_by_length(spark, slices):
    rng, rows, at = random.Random(slices), [], {}
    for pos in range(3000):
        stream, template = rng.choice("xy"), rng.choice("aaab")
        # Gaps at and beside the limit, equal times, and times out of order.
        at[stream] = at.get(stream, 1_700_000_000_000_000) + rng.choice([0, 1000, 90_000, 150_000, 200_000, 200_001, 350_000])
        rows.append((stream, pos, template, at[stream] - rng.choice([0, 0, 0, 120_000])))
    rows += [("storm", p, "s", 1_700_000_000_000_000 + p * 100_000) for p in range(500)]
    frame = spark.createDataFrame(rows, "stream_id string, pos long, template string, us long").select(
        "stream_id", "pos", "template", F.timestamp_micros("us").alias("ts"), F.lit(True).alias("parsed"))
    frame = frame.unionByName(frame.limit(5).withColumns({"ts": F.lit(None).cast("timestamp"), "pos": F.col("pos") + 10**6}))
    got = fold_session(frame, "200 milliseconds", slices=slices, hold="3 seconds").select(
        *RUN_COLUMNS[:4], "template", F.unix_micros("first_ts"), F.unix_micros("last_ts"))
    got = sorted(map(tuple, got.collect()))
    assert got == _cut_sessions(rows, 200_000, 3_000_000)
    assert all(r[6] - r[5] < 3_000_000 for r in got)
    assert len([r for r in got if r[0] == "storm"]) == 17
    # Without a storm's length to cut, runs are those of the idle time alone.
    whole = fold_session(frame, "200 milliseconds", slices=slices).select("stream_id", "head_pos", "repeat")
    held = fold_session(frame, "200 milliseconds", slices=slices, hold="1 day").select("stream_id", "head_pos", "repeat")
    assert sorted(held.collect()) == sorted(whole.collect())


def test_sessions_by_length_of_no_records(spark):
    none = spark.createDataFrame([], "stream_id string, pos long, template string, ts timestamp, parsed boolean")
    assert fold_session(none, hold="3 seconds").collect() == []
