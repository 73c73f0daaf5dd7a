"""Stack frames as data: folded framework runs, source links, path lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.stage import let
from logloom.operators.stack import PROJECT
from logloom.sources.materialize import materialize

_BLOCK = "struct<project:boolean,start:int,n:int,packages:array<string>,frame:{frame}>"
_FRAME = "struct<func:string,file:string,line:int,col:int,kind:string>"

# Fixed value: packages named in the note of a folded run.
PACKAGES_SHOWN = 3


def top_package(func: Column) -> Column:
    """Leading part of a function name, before the first slash, else dot."""
    return F.when(
        F.contains(func, F.lit("/")), F.substring_index(func, "/", 1)
    ).otherwise(F.substring_index(func, ".", 1))


def stack_blocks(frames: Column, expand: bool = False) -> Column:
    """Frames in order, every run of framework frames drawn into one block.

    Works inside the row, so no frame is ever shuffled.
    """
    def shown(f: Column) -> Column:
        return F.lit(True) if expand else f["kind"] == PROJECT

    def begins(f: Column, i: Column) -> Column:
        before = F.get(frames, i - 1)
        return F.when((i == 0) | shown(f) | F.coalesce(shown(before), F.lit(False)), i)

    def blocks(starts: Column) -> Column:
        def block(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(frames))
            first = F.get(frames, start)
            run = F.transform(F.slice(frames, start + 1, end - start), lambda f: top_package(f["func"]))
            # One more than is shown tells that there are more.
            packages = F.slice(
                F.array_distinct(F.filter(run, lambda p: p != "")), 1, PACKAGES_SHOWN + 1)
            return F.struct(
                shown(first).alias("project"), start.alias("start"), (end - start).alias("n"),
                packages.alias("packages"), first.alias("frame"))

        return F.transform(starts, block)

    # Where blocks begin follows from neighbours, so the work is linear in the frames.
    found = let(F.array_compact(F.transform(frames, begins)), blocks)
    return found.cast(f"array<{_BLOCK.format(frame=_FRAME)}>")


def packages_note(packages: Column) -> Column:
    named = F.array_join(F.slice(packages, 1, PACKAGES_SHOWN), ", ")
    return F.when(F.size(packages) > PACKAGES_SHOWN, F.concat(named, F.lit(", …"))).otherwise(named)


def framework_runs(df: DataFrame) -> DataFrame:
    """One row per run of framework frames: where it starts, length, packages."""
    blocks = F.filter(stack_blocks(F.col("stack.frames")), lambda b: ~b["project"])
    return df.select("stream_id", "pos", F.explode(blocks).alias("b")).select(
        "stream_id", "pos", F.col("b.start").alias("start"), F.col("b.n").alias("n"),
        packages_note(F.col("b.packages")).alias("packages"),
    )


def explode_frames(df: DataFrame) -> DataFrame:
    """One row per frame of every trace."""
    return df.select(
        "stream_id", "pos", F.col("stack.lang").alias("lang"),
        F.posexplode("stack.frames").alias("i", "f"),
    ).select("stream_id", "pos", "lang", "i", "f.func", "f.file", "f.line", "f.col", "f.kind")


# --- links -----------------------------------------------------------------------


def _after_prefix(file: Column, prefix: str) -> Column:
    """Path behind ``prefix/`` where it starts a path segment; else NULL."""
    prefix = prefix.strip("/")
    if not prefix:
        return F.lit(None).cast("string")
    prefix += "/"
    at = F.instr(file, prefix)
    on_edge = (at == 1) | ((at > 1) & (F.substring(file, at - 1, F.lit(1)) == "/"))
    rest = F.substring(file, at + len(prefix), F.length(file))
    return F.when(on_edge & (rest != ""), rest)


def github_url(
    spec: str, file: Column, line: Column, module: str = "", resolved: Column | None = None
) -> Column:
    """Link to a frame's source line in the repository ``owner/repo[@ref]``.

    The path inside the repository is what follows ``owner/repo/`` in the frame's
    file, else what follows ``module/``, else ``resolved``; NULL without any.
    """
    slug, at, ref = spec.partition("@")
    ref = ref if at else "main"
    owner, slash, repo = slug.partition("/")
    if not (owner and slash and repo and ref):
        raise ValueError(f"invalid repository {spec!r}, want owner/repo or owner/repo@ref")
    paths = [_after_prefix(file, f"{owner}/{repo}"), _after_prefix(file, module)]
    if resolved is not None:
        paths.append(resolved)
    anchor = F.when(line > 0, F.concat(F.lit("#L"), line.cast("string"))).otherwise("")
    return F.concat(
        F.lit(f"https://github.com/{owner}/{repo}/blob/{ref}/"), F.coalesce(*paths), anchor
    )


def resolve_paths(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """``file, path``: the longest suffix of each file that the inventory lists.

    ``files`` has ``file``, ``inventory`` has ``path``. Distinct files are looked
    up once, by an equi-join of their suffixes; frames then join the answer.
    """
    segments = F.split("file", "/")
    suffixes = F.transform(
        segments,
        lambda s, i: F.struct(
            i.alias("start"), (s != "").alias("usable"),
            F.slice(segments, i + 1, F.size(segments)).alias("parts"),
        ),
    )
    parts = F.col("x.parts")
    tried = (
        files.select("file").filter(F.col("file").isNotNull()).distinct()
        .select("file", F.explode(F.filter(suffixes, lambda x: x["usable"])).alias("x"))
        .select(
            "file", F.col("x.start").alias("start"), F.array_join(parts, "/").alias("suffix"),
            F.array_join(F.filter(parts, lambda p: ~p.isin("", ".")), "/").alias("path"),
        )
    )
    return (
        tried.join(inventory.select("path").distinct(), "path")
        .groupBy("file").agg(F.min_by("suffix", "start").alias("path"))
    )


#: A file is heavy if it holds more than one in so many frames; so there are fewer of them.
HEAVY = 200


def resolve_frames(frames: DataFrame, inventory: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Exploded frames with ``path``, NULL where the inventory has no such file.

    Distinct files are counted where they are read and resolved once. The answers for
    heavy files, fewer than ``heavy`` rows, are sent to every task, so that their frames
    need not move; all other frames join theirs by file.
    """
    files = materialize(frames.where(F.col("file").isNotNull()).groupBy("file").count())
    every = files.agg(F.sum("count")).first()[0] or 0
    known = materialize(files.join(resolve_paths(files, inventory), "file", "left").withColumn(
        "heavy", F.col("count") * heavy > every))
    columns = frames.columns
    few = known.where("heavy").select(F.col("file").alias("_file"), F.col("path").alias("_path"))
    marked = frames.join(F.broadcast(few), F.col("file").eqNullSafe(F.col("_file")), "left")
    moved = marked.where("_file is null and file is not null").drop("_file", "_path").join(
        known.where("not heavy").select("file", "path"), "file", "left")
    still = marked.where("_file is not null or file is null").withColumn("path", F.col("_path"))
    return still.select(*columns, "path").unionByName(moved.select(*columns, "path"))
