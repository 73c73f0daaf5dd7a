"""Growing files: positions, splits, unfinished lines, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.plans.catalog import _batch_sizes
from logloom.sources import tail
from logloom.sources.sinks import write_stream
from logloom.sources.tail import _Files, positioned_lines, tail_lines


def plain(data: bytes, base=0):
    out, at = [], 0
    for line in data.split(b"\n"):
        out.append((base + at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    return out[:-1] if data.endswith(b"\n") or not data else out


def rows(df):
    return sorted(tuple(r) for r in df.select("stream_id", "pos", "raw").collect())


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_every_line_once_whatever_the_splits(tmp_path, monkeypatch, split):
    monkeypatch.setattr(tail, "READ", 16)
    rng = random.Random(split)
    data = b"".join(b"x" * rng.choice([0, 1, 5, 40]) + rng.choice([b"\n", b"\r\n"]) for _ in range(200))
    data += "é\n".encode() + b"\xff bad\n" + b"a\rb\n"
    (tmp_path / "a.log").write_bytes(data)
    files = _Files({"path": str(tmp_path), "split": str(split)})
    got = [tuple(r.values()) for s in files.splits({}, files.offset({})) for b in files.lines(s) for r in b.to_pylist()]
    assert sorted((p, t) for _, p, t in got) == plain(data)


def test_table_of_folders(spark, tmp_path):
    for name, text in (("stream_id=a%2Fb/part-1", "1\n2\n"), ("stream_id=a%2Fb/part-0", "0\n"), ("c/x.log", "c\nend"), ("c/_tmp", "no\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    one = 1 << tail.FILE_BITS
    assert rows(positioned_lines(spark, str(tmp_path), stream="folder")) == [
        ("a/b", 0, "0"), ("a/b", one, "1"), ("a/b", one + 2, "2"), ("c", 0, "c")]
    assert rows(positioned_lines(spark, f"file://{tmp_path}/c/x.log", unfinished="take")) == [
        (f"{tmp_path}/c/x.log", 0, "c"), (f"{tmp_path}/c/x.log", 2, "end")]


def test_limits_end_behind_lines(tmp_path):
    (tmp_path / "a").write_bytes(b"123\n" * 5 + b"y" * 50 + b"\nz\nunfinished")
    files = _Files({"path": str(tmp_path), "maxbytesperfile": "10"})
    path, known, ends = str(tmp_path / "a"), {}, []
    for _ in range(6):
        known = files.offset(known)
        ends.append(known[path]["end"])
    assert ends == [8, 16, 20, 71, 73, 73]


def test_files_of_a_stream_are_read_one_after_the_other(tmp_path):
    for i in range(3):
        (tmp_path / f"{i}").write_bytes(b"abc\n" * 5 + (b"rest" if i == 1 else b""))
    files = _Files({"path": str(tmp_path), "stream": "folder", "maxbytesperfile": "12"})
    known, got = {}, []
    while True:
        new = files.offset(known)
        if new == known:
            break
        got += [r["pos"] for s in files.splits(known, new) for b in files.lines(s) for r in b.to_pylist()]
        known = new
    assert got == sorted(got) and len(got) == 16


def test_growing_files_and_a_restart(spark, tmp_path):
    logs, out, done = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "done")
    logs.mkdir()

    def drain():
        query = write_stream(tail_lines(spark, str(logs), stream="folder"), out, done, available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None

    (logs / "1.log").write_text("a\nb\nhalf")
    drain()
    assert [(p, t) for _, p, t in rows(spark.read.parquet(out))] == [(0, "a"), (2, "b")]
    with open(logs / "1.log", "a") as f:
        f.write(" done\n")
    (logs / "2.log").write_text("c\n")
    drain()
    drain()
    one = 1 << tail.FILE_BITS
    assert [(p, t) for _, p, t in rows(spark.read.parquet(out))] == [(0, "a"), (2, "b"), (4, "half done"), (one, "c")]
    assert spark.read.parquet(out).agg(F.count("*")).first()[0] == 4


def test_empty_folder(spark, tmp_path):
    assert positioned_lines(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("most", [12, 25, 1000])
def test_a_batch_is_bounded_over_all_files_of_a_stream(tmp_path, most):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        for i in range(6):
            (tmp_path / folder / f"{i}").write_bytes(b"abc\n" * 2 + (b"rest" if i == 1 else b""))
    files = _Files({"path": str(tmp_path), "stream": "folder", "maxbytesperstream": str(most)})
    known, got, taken = {}, [], []
    while True:
        new = files.offset(known)
        if new == known:
            break
        splits = files.splits(known, new)
        taken += [sum(s.end - s.start for s in splits if s.stream == folder) for folder in "ab"]
        got += [(s.stream, r["pos"]) for s in splits for b in files.lines(s) for r in b.to_pylist()]
        known = new
    assert max(taken) <= most and len(got) == len(set(got)) == 26
    for folder in "ab":
        mine = [pos for stream, pos in got if stream == folder]
        assert mine == sorted(mine)


def test_a_batch_of_one_long_stream_is_work_for_all_cores():
    cores = 12
    sizes = _batch_sizes(1 << 30, cores)
    batch = int(sizes["maxBytesPerStream"])
    files = _Files({"path": "/logs", "stream": "folder", "split": sizes["split"]})
    splits = files.splits({}, {"/logs/a/f": {"end": batch, "number": 0}})
    assert len(splits) == cores
    assert [s.end for s in splits[:-1]] == [s.start for s in splits[1:]] and splits[-1].end == batch
    # A small batch is not cut into tasks that have nothing to do.
    assert int(_batch_sizes(1 << 20, cores)["split"]) >= int(_batch_sizes(1 << 20, cores)["maxBytesPerStream"])
