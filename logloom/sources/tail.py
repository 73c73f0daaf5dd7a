"""Growing log files as a stream, or a table, of lines with positions.

Spark's own file stream takes a file once and gives its lines no place. This source
follows files as they grow: a batch covers, for every file, the bytes between two
committed offsets, ending behind a line, cut into splits that tasks read side by side.
A line's position is the byte it starts at, so it is the same whenever a batch runs again.

``stream`` says what a stream is: with "file" every file is one, named by its path;
with "folder" the files of a folder are one, in the order in which they were first
seen, by name among those seen at once, and are named by the folder, without the
``name=`` that partitioned writers put before a value. Positions then start at
``number << FILE_BITS``.

The offset names all files that lie below the path. Move or delete closed ones; they drop
out. A file that became shorter is read from its start. Paths are opened by ``pyarrow.fs``,
on the driver and the executors: local or shared folders, and the stores it knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "stream_id string, pos long, raw string"
#: Bits of a position within a file, below the file's number.
FILE_BITS = 40
#: Bytes of a file in a split, of a read, and lines of an emitted batch.
SPLIT, READ, ROWS = 32 << 20, 1 << 20, 8192


@dataclass
class Split(InputPartition):
    """Lines of a file that start in ``start <= byte < end``."""

    path: str
    stream: str
    base: int
    start: int
    end: int


class _Files:
    """The files below a path and where their lines end."""

    def __init__(self, options: dict[str, str]) -> None:
        path = options["path"]
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.by_folder = options.get("stream", "file") == "folder"
        #: Bytes of a file in one batch, in folders of a stream; 0 for all there are.
        self.most = int(options.get("maxbytesperfile", "0"))
        #: Bytes of all files of a stream in one batch; 0 for all there are.
        self.per_stream = int(options.get("maxbytesperstream", "0"))
        #: Whether a last line without its end counts.
        self.unfinished = options.get("unfinished", "wait") == "take"
        self.split = int(options.get("split", str(SPLIT)))

    def sizes(self) -> dict[str, int]:
        info = self.fs.get_file_info(self.root)
        found = [info]
        if info.type == pafs.FileType.Directory:
            found = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True))
        return {
            f.path: f.size for f in sorted(found, key=lambda f: f.path)
            if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))
        }

    def line_end(self, path: str, start: int, size: int, take: bool, most: int) -> int:
        """The end of the last line that ends by ``size``, or by the limit; else ``start``.

        ``take`` says whether a last line without its end counts.
        """
        if start == size:
            return size
        limit = min(size, start + most) if most else size
        if take and limit == size:
            return size
        with self.fs.open_input_file(path) as f:
            upto = limit
            while upto > start:
                at = max(start, upto - READ)
                f.seek(at)
                cut = f.read(upto - at).rfind(b"\n")
                if cut >= 0:
                    return at + cut + 1
                upto = at
            # No line ends within the limit: on to the first end behind it.
            at = limit
            while at < size:
                f.seek(at)
                block = f.read(min(READ, size - at))
                cut = block.find(b"\n")
                if cut >= 0:
                    return at + cut + 1
                at += len(block)
        return size if take else start

    def offset(self, known: dict) -> dict:
        """Ends of whole lines and numbers of the files, going on from what is known."""
        folders: dict[str, list[tuple[int | float, str, int]]] = {}
        for path, size in self.sizes().items():
            number = known[path]["number"] if path in known else float("inf")
            folders.setdefault(path.rpartition("/")[0], []).append((number, path, size))
        used: dict[str, int] = {}
        for path, entry in known.items():
            folder = path.rpartition("/")[0]
            used[folder] = max(used.get(folder, 0), entry["number"] + 1)
        out: dict[str, dict[str, int]] = {}
        for folder, files in folders.items():
            files.sort()
            waits = False
            left = self.per_stream
            for number, path, size in files:
                if path not in known:
                    number = used.get(folder, 0)
                    used[folder] = number + 1
                old = known.get(path, {"end": 0})["end"]
                start = end = old if size >= old else 0
                most = min(filter(None, (self.most, left)), default=0)
                if not waits:
                    # A file that another one follows is closed.
                    closed = self.by_folder and path != files[-1][1]
                    end = self.line_end(path, start, size, self.unfinished or closed, most)
                # In one stream a file is begun when all before it are read.
                waits = waits or (self.by_folder and most > 0 and start + most < size)
                if self.by_folder and self.per_stream:
                    left -= end - start
                    waits = waits or left <= 0
                out[path] = {"end": end, "number": number}
        return out

    def splits(self, start: dict, end: dict) -> list[Split]:
        out = []
        for path, entry in end.items():
            at = start.get(path, {"end": 0})["end"]
            at = 0 if at > entry["end"] else at
            stream, base = path, 0
            if self.by_folder:
                folder = path.rpartition("/")[0].rpartition("/")[2]
                stream, base = unquote(folder.partition("=")[2] or folder), entry["number"] << FILE_BITS
            while at < entry["end"]:
                out.append(Split(path, stream, base, at, min(at + self.split, entry["end"])))
                at += self.split
        return out

    def lines(self, split: Split) -> Iterator[pa.RecordBatch]:
        """Lines that start in the split, whatever their length."""
        places: list[int] = []
        texts: list[str] = []

        def made() -> pa.RecordBatch:
            n = len(places)
            return pa.RecordBatch.from_arrays(
                [pa.array([split.stream] * n), pa.array(places, pa.int64()), pa.array(texts, pa.string())],
                ["stream_id", "pos", "raw"])

        with self.fs.open_input_file(split.path) as f:
            # The line under way at the start belongs to the split before.
            at = split.start - 1 if split.start else 0
            skip = split.start > 0
            held: list[bytes] = []
            f.seek(at)
            done = False
            while not done:
                block = f.read(READ)
                if not block:
                    break
                begin = 0
                while (cut := block.find(b"\n", begin)) >= 0:
                    held.append(block[begin:cut])
                    line = b"".join(held)
                    held, begin = [], cut + 1
                    if skip:
                        skip = False
                    else:
                        places.append(split.base + at)
                        texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1
                    if at >= split.end:
                        done = True
                        break
                    if len(places) >= ROWS:
                        yield made()
                        places, texts = [], []
                else:
                    held.append(block[begin:])
            rest = b"".join(held)
            if not done and rest and not skip and at < split.end:
                places.append(split.base + at)
                texts.append(rest.removesuffix(b"\r").decode("utf-8", "replace"))
        if places:
            yield made()


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = _Files(options)
        self.known: dict = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        self.known = self.files.offset(self.known)
        return {"files": self.known}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        # After a restart this tells where the query was.
        if not self.known:
            self.known = end["files"]
        return self.files.splits(start["files"], end["files"])

    def commit(self, end: dict) -> None:
        self.known = self.known or end["files"]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.files.lines(partition)


class _Table(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = _Files(options)

    def partitions(self) -> list[Split]:
        self.files.most = self.files.per_stream = 0
        return self.files.splits({}, self.files.offset({}))

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        # Without files there is one task that is given nothing.
        return self.files.lines(partition) if partition else iter(())


class LogFiles(DataSource):
    """``format("log_files")``: ``stream_id, pos, raw``.

    Options: ``path`` (a file, or a folder with all below it), ``stream``, ``maxBytesPerFile``
    (bytes that a batch takes of each file; all by default), ``maxBytesPerStream`` (the same of
    all files of a stream together, however small they are), ``split`` (bytes a task reads)
    and ``unfinished``: a last line without its end waits, or with "take" counts. Where
    files form one stream, a file is begun when all before it are read, and what another
    one follows is closed, so its last line counts.
    """

    @classmethod
    def name(cls) -> str:
        return "log_files"

    def schema(self) -> str:
        return SCHEMA

    def _low(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> DataSourceReader:
        return _Table(self._low())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self._low())


def tail_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of files as they grow, with positions: feeds ``fold_stream`` and ``mark_stream``."""
    spark.dataSource.register(LogFiles)
    return spark.readStream.format("log_files").option("path", path).options(**options).load()


def positioned_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same lines and positions as a table."""
    spark.dataSource.register(LogFiles)
    return spark.read.format("log_files").option("path", path).options(**options).load()


def folder_bytes(path: str) -> int:
    """Bytes of all files below a path."""
    return sum(_Files({"path": path}).sizes().values())
