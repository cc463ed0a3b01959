"""Exact search for the best inner products, by matrix products of blocks.

Candidates are dealt evenly into shards and queries into tiles, one row each, as
matrices of integers.  A tile meets every shard once; the shards come in groups, and
one task holds one tile and one group: it multiplies the tile with every shard, selects
the best of each product partially and keeps one running list per query.  The lists of
the groups are merged as a tree, a bounded number of them per task, so neither the
scores nor the lists of all shards are ever in one place.

With ``n`` candidates and ``q`` queries the shuffle moves ``q / tile_queries`` copies of
the candidates and ``n / (shard_rows * fan)`` copies of the queries; the products grow
as ``n * q``, as an exact search has to.  Larger tiles and shards move less and need
more memory (a task holds ``fan`` shards, a tile and a few lists per query).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultatlas.llm.vectors import lists_of, scaled, usable
from faultatlas.plans.layout import cut

BLOCK = "ids binary, vectors binary, dim int, n long"
LISTS = "tile int, span int, dim int, ids binary, owners binary, found binary, scores binary"
RESULT = "query_id long, rank int, vec_id long, score long"
# Scores that one partial selection looks at.
_SCORES = 1 << 21
_EXACT = 1 << 53


def _packed(rows: DataFrame, scale: float) -> DataFrame:
    """One row per partition and vector length: sorted ids and the integer matrix."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, values = [], [], []
        for batch in batches:
            size, flat = lists_of(batch.column("vector"))
            ids.append(batch.column("vec_id").to_numpy())
            lengths.append(size)
            values.append(scaled(flat, scale))
        if not ids:
            return
        number, size, flat = (np.concatenate(x) for x in (ids, lengths, values))
        starts = np.cumsum(size) - size
        for dim in np.unique(size).tolist():
            own = np.flatnonzero(size == dim)
            own = own[np.argsort(number[own], kind="stable")]
            matrix = flat[starts[own][:, None] + np.arange(dim)]
            yield pa.RecordBatch.from_pydict(
                {
                    "ids": [number[own].astype("<i8").tobytes()],
                    "vectors": [_shrunk(matrix).tobytes()],
                    "dim": pa.array([dim], pa.int32()),
                    "n": [len(own)],
                }
            )

    return rows.mapInArrow(pack, BLOCK)


def _shrunk(matrix: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest of the types that a block may have."""
    most = max(-int(matrix.min()) - 1, int(matrix.max())) if matrix.size else 0
    return matrix.astype("<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _matrix(body: bytes, rows: int, dim: int) -> np.ndarray:
    width = len(body) // (rows * dim) if rows * dim else 8
    return np.frombuffer(body, f"<i{width}").reshape(rows, dim)


class Shard:
    """Candidates of one shard: ids in order, repeated rows once."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
            order = np.lexsort((*matrix.T[::-1], ids))
            ids, matrix = ids[order], matrix[order]
            fresh = np.append(True, (ids[1:] != ids[:-1]) | (matrix[1:] != matrix[:-1]).any(axis=1))
            ids, matrix = ids[fresh], matrix[fresh]
        self.ids, self.matrix = ids, matrix


def products(queries: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where every sum is an exact one, by integers of any size else."""
    most = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (queries, matrix)]
    if most[0] * most[1] * queries.shape[1] < _EXACT:
        return queries.astype(np.float64) @ matrix.astype(np.float64).T
    return queries.astype(object) @ matrix.astype(object).T


def best_of(queries: np.ndarray, owners: np.ndarray, shard: Shard, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, id and score of its ``k`` best candidates in a shard, ties to the smaller id.

    Only scores from the ``k``-th largest one on are sorted.
    """
    size = len(shard.ids)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, _SCORES // max(1, size))
    for begin in range(0, len(queries), step):
        scores = products(queries[begin : begin + step], shard.matrix)
        own = owners[begin : begin + step]
        low, high = np.searchsorted(shard.ids, own, "left"), np.searchsorted(shard.ids, own, "right")
        for row in np.flatnonzero(high > low):
            scores[row, low[row] : high[row]] = -np.inf
        if size > k:
            least = np.partition(scores, size - k, axis=1)[:, size - k]
            row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        else:
            row, column = np.nonzero(scores > -np.inf)
        value = scores[row, column]
        if value.dtype == object:
            value = np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in value], np.int64)
        found.append(_first(row + begin, shard.ids[column], value.astype(np.int64), k))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _places(row: np.ndarray) -> np.ndarray:
    """Place from 0 of every element in its run of equal values."""
    begins = np.flatnonzero(np.diff(row, prepend=row[:1] - 1))
    return np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))


def _first(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` different (score, id) of every row, the largest scores first, then the smallest ids."""
    # The complement turns the order round without an overflow.
    order = np.lexsort((ids, ~scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    if len(row):
        same = (row[1:] == row[:-1]) & (ids[1:] == ids[:-1]) & (scores[1:] == scores[:-1])
        fresh = np.append(True, ~same)
        row, ids, scores = row[fresh], ids[fresh], scores[fresh]
        near = _places(row) < k
        row, ids, scores = row[near], ids[near], scores[near]
    return row, ids, scores


def _lists(tile: int, span: int, dim: int, owners: bytes, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    row, ids, scores = found
    columns = {
        "tile": pa.array([tile], pa.int32()), "span": pa.array([span], pa.int32()), "dim": pa.array([dim], pa.int32()),
        "ids": [ids.astype("<i8").tobytes()], "owners": [owners], "found": [row.astype("<i8").tobytes()],
        "scores": [scores.astype("<i8").tobytes()],
    }
    return pa.table(columns)


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _first(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)


def top_products(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, tile_queries: int = 2048, shard_rows: int = 4096,
    fan: int = 4, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of every query, of all rows but its own.

    Components become ``floor(scale * x)``; the score is their inner product, ties go
    to the smaller id.  ``queries`` are rows of the same form as ``vectors``.  Rows
    without an id, and vectors that are null or hold a null or a non-finite component
    take no part.  Only vectors of equal length are compared; empty ones have score 0.
    A repeated row counts once; rows that share an id but not the vector are candidates
    each, and each has a list of its own as a query.  A score beyond 64 bits is taken
    at the bound.  An empty table gives no row; other columns are not read.
    """

    def clean(rows: DataFrame) -> DataFrame:
        held = rows.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
        return held.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))

    def blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        """Rows dealt evenly, whatever their ids, and the number of blocks."""
        parts = max(1, -(-rows.count() // size))
        dealt = rows.repartition(parts).withColumn("part", F.spark_partition_id())
        # The place of a block comes from a written table, so a repeated task sees the same one.
        packed = _packed(dealt, scale).withColumn(name, F.spark_partition_id())
        return cut(packed), parts

    shards, n_shards = blocks(clean(vectors), shard_rows, "shard")
    tiles, n_tiles = blocks(clean(queries).distinct(), tile_queries, "tile")
    spans = -(-n_shards // fan)
    span = F.floor(F.col("shard") / fan).cast("int").alias("span")
    left = tiles.select("*", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"))
    right = shards.select("*", span, F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("tile"))

    def multiply(key: tuple, tile: pa.Table, group: pa.Table) -> pa.Table:
        out = []
        for one in tile.to_pylist():
            owners = np.frombuffer(one["ids"], "<i8")
            body = _matrix(one["vectors"], len(owners), one["dim"])
            best = (np.empty(0, np.int64),) * 3
            for ids, matrix, n, dim in zip(*(group.column(c) for c in ("ids", "vectors", "n", "dim")), strict=True):
                if dim.as_py() == one["dim"]:
                    shard = Shard(np.frombuffer(ids.as_py(), "<i8"), _matrix(matrix.as_py(), n.as_py(), one["dim"]))
                    best = _merged([best, best_of(body, owners, shard, k)], k)
            out.append(_lists(one["tile"], one["span"], one["dim"], one["ids"], best))
        return pa.concat_tables(out) if out else _lists(0, 0, 0, b"", (np.empty(0, np.int64),) * 3).slice(1)

    keys = ["tile", "span"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, LISTS)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [tuple(np.frombuffer(r[c], "<i8") for c in ("found", "ids", "scores")) for r in rows]
        first = rows[0]
        return _lists(first["tile"], first["span"], first["dim"], first["owners"], _merged(parts, k))

    while spans > 1:
        spans = -(-spans // fan)
        lists = lists.withColumn("span", F.floor(F.col("span") / fan).cast("int"))
        lists = lists.groupBy("tile", "span", "dim").applyInArrow(merge, LISTS)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                row, ids, scores, owners = (np.frombuffer(one[c], "<i8") for c in ("found", "ids", "scores", "owners"))
                columns = [pa.array(owners[row]), pa.array((_places(row) + 1).astype(np.int32)), pa.array(ids), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "rank", "vec_id", "score"])

    return lists.select("found", "ids", "scores", "owners").mapInArrow(unpack, RESULT)
