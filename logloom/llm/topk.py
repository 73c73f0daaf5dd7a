"""Exact top-k search by tiled matrix products.

Vectors are gathered into shards, queries into blocks, each a matrix in one row of
a table, of a bounded number of rows and bytes. The grid of blocks and shards is cut
into cells of ``BLOCKS`` by ``SHARDS``: a cell is a task's group, which multiplies
tile by tile. A shard is sent once per ``BLOCKS`` blocks, a block once per ``SHARDS``
shards. From each tile the best ``k`` per query are selected and merged within the
cell; lists of cells are merged as a tree, ``FAN`` at a time, so no task gets all
lists of a query.

Components are integers, ``floor(scale * x)``; products are exact: in floating
point while all sums stay below 2^53, else with integers of any size.

Defined results: vectors that are null, empty of components, or hold a null or
non-finite one take no part, nor do those without an id; vectors of another length
than a query's are no candidates for it; ties go to the smaller id; with fewer
candidates than ``k`` all are listed; a component beyond the doubles when scaled counts
as the largest of them; scores beyond 64 bits are cut to them. A
query id that occurs twice is searched once, with the smallest of its vectors;
rows that repeat a candidate's id are candidates each. Extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a shard, and of a block of queries.
SHARD, BLOCK = 8192, 2048
#: Bytes after which either is full.
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20
#: Blocks and shards of a cell, which then holds 128 MB (256 at worst).
BLOCKS, SHARDS = 16, 4
#: Lists merged at a time.
FAN = 16
#: Bits of the numbers of shards within a task.
_TASK = 32
_EXACT = 2.0**53
_LONG = 2**63 - 1


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, dim, v``: the vectors that take part, as integral doubles."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(fine)
    # floor() of a double would be cut to 64 bits; rounding down by hand is not.
    most = sys.float_info.max
    down = F.transform(x, lambda c: F.when(
        F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("double")
    ).otherwise(F.greatest(F.least(c * scale, F.lit(most)), F.lit(-most))))
    return rows.select(F.col("vec_id").cast("long"), F.size("embedding").alias("dim"), down.alias("v"))


def _gathered(vectors: DataFrame, rows: int, size: int) -> DataFrame:
    """Tiles ``tile, dim, ids`` (ascending), ``data`` (doubles, row by row), of under twice ``rows`` and ``size`` bytes."""
    names = ["tile", "dim", "ids", "data"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, tuple[list, list]] = {}
        tile = TaskContext.get().partitionId() << _TASK

        def made(dim: int):
            nonlocal tile
            ids, data = (np.concatenate(x) for x in held.pop(dim))
            order = np.argsort(ids, kind="stable")
            out = pa.RecordBatch.from_arrays([
                pa.array([tile], pa.int64()), pa.array([dim], pa.int32()),
                pa.array([ids[order].tobytes()], pa.binary()),
                pa.array([data.reshape(-1, dim)[order].tobytes()], pa.binary())], names)
            tile += 1
            return out

        for b in batches:
            ids, dims = b.column(0).to_numpy(), b.column(1).to_numpy()
            v = b.column(2)
            flat, ends = v.flatten().to_numpy(), np.cumsum(dims)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                most = max(1, min(rows, size // (8 * int(dim))))
                for i in range(0, len(mine), most):
                    at = mine[i:i + most]
                    cells = (ends[at] - dim)[:, None] + np.arange(dim)
                    own = held.setdefault(int(dim), ([], []))
                    own[0].append(ids[at])
                    own[1].append(flat[cells].ravel())
                    if sum(map(len, own[0])) >= most:
                        yield made(int(dim))
        for dim in list(held):
            yield made(dim)

    return vectors.mapInArrow(gather, "tile long, dim int, ids binary, data binary")


def best(queries: np.ndarray, q_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int):
    """Per query the ids and scores of the ``k`` best rows; ``ids`` ascend."""
    reach = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1]
    if reach < _EXACT:
        scores = queries @ data.T
    else:
        whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
        scores = np.clip(whole(queries) @ whole(data).T, -_LONG - 1, _LONG)
    out = []
    for q, row in zip(q_ids, scores):
        allowed = np.flatnonzero(ids != q)
        row = row[allowed]
        if len(row) > k:
            # The k-th best score; better rows all stay, equal ones by smaller id.
            least = np.partition(row, len(row) - k)[len(row) - k]
            over = np.flatnonzero(row > least)
            keep = np.concatenate([over, np.flatnonzero(row == least)[: k - len(over)]])
            allowed, row = allowed[keep], row[keep]
        out.append((ids[allowed], [int(s) for s in row]))
    return out


def _rows_of(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    return [
        (np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(d.as_buffer()).reshape(-1, dim.as_py()))
        for i, d, dim in zip(table["ids"], table["data"], table["dim"])]


def _multiplied(blocks: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """``query_id, part, vec_id, score``: the best of each cell; ``part`` numbers its shards."""
    cell = ("dim", "part", "column")

    def multiply(blocks: pa.Table, shards: pa.Table) -> pa.Table:
        tiles, out = _rows_of(shards), []
        for q_ids, queries in _rows_of(blocks):
            lists = []
            for ids, data in tiles:
                found = best(queries, q_ids, data, ids, k)
                lists.append((
                    np.repeat(q_ids, [len(s) for _, s in found]),
                    np.concatenate([i for i, _ in found]),
                    np.array([s for _, row in found for s in row], np.int64)))
            query, vec, score = (np.concatenate(x) for x in zip(*lists))
            # The complement orders scores downwards and has no overflow.
            order = np.lexsort((vec, ~score, query))
            starts = np.searchsorted(query[order], query[order])
            out.append([c[order[np.arange(len(order)) - starts < k]] for c in (query, vec, score)])
        query, vec, score = (np.concatenate(x) for x in zip(*out))
        part = np.full(len(query), shards["part"][0].as_py(), np.int64) if len(shards) else query
        return pa.table({"query_id": query, "part": part, "vec_id": vec, "score": score})

    return blocks.groupBy(*cell).cogroup(shards.groupBy(*cell)).applyInArrow(
        multiply, "query_id long, part long, vec_id long, score long")


def _dealt(tiles: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``tile, dim, name`` (``size`` tiles a number, from 0, per length), and the numbers by length."""
    order = Window.partitionBy("dim").orderBy("tile")
    places = tiles.select("tile", "dim", F.floor((F.row_number().over(order) - 1) / size).alias(name))
    return places, places.groupBy("dim").agg((F.max(name) + 1).alias("_n"))


def _shortened(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256,
          shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the best of all other ids.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` says which rows are
    queries. Work is queries times vectors; tiles bound the memory of a task.
    """
    every = usable(vectors, scale)
    chosen = usable(vectors.where(is_query), scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    chosen = chosen.select("vec_id", F.size("v").alias("dim"), "v")
    blocks = materialize(_gathered(chosen, block, BLOCK_BYTES))
    shards = materialize(_gathered(every, shard, SHARD_BYTES))
    # One narrow row for each block and shard.
    columns, across = _dealt(blocks, BLOCKS, "column")
    parts, down = _dealt(shards, SHARDS, "part")
    count = down.agg(F.max("_n")).first()[0] or 0

    def copies(tiles: DataFrame, places: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
        each = places.join(numbers, "dim").select(
            "tile", *[c for c in places.columns if c not in ("tile", "dim")],
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias(name))
        return tiles.join(each, "tile").drop("tile")

    lists = _multiplied(copies(blocks, columns, down, "part"), copies(shards, parts, across, "column"), k)
    lists = lists.withColumnRenamed("part", "group")
    while count > FAN:
        count = -(-count // FAN)
        lists = lists.withColumn("group", F.floor(F.col("group") / FAN))
        lists = _shortened(lists, k, "query_id", "group").drop("rank")
    return _shortened(lists, k, "query_id").select("query_id", "rank", "vec_id", "score")


SQL = """
WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM f q JOIN f c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
