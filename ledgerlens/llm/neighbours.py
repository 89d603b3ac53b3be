"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks of bounded size, and each pair of blocks is one tile: its int8 matrices are multiplied
(in floats, where sums of int8 products are exact), which gives every cosine with a bound of its quantisation error. Pairs whose
upper bound reaches the k-th best lower bound are recomputed in double precision, and heaps of k merge tiles of one task; a ranking
merges the blocks. Only the stated queries meet all rows, block by block.

Of rows with the same vector only the k + 1 smallest ids can be among anyone's k nearest, so a vector that a third of all rows
share is cut to those before the join, already in front of the shuffle.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows of null id; a
vector meets only vectors of its own length; rows that repeat id and vector count once, rows of the query's own id are not its
neighbours; ties go to the smaller id; with fewer than k candidates all are returned. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..ship import ship

NEAREST = 5
#: Rows of a block on either side, and how many queries a task multiplies at once.
BLOCK = 8192
STRIP = 512
#: Pairs recomputed at once.
PAIRS = 1 << 16
#: What rounding in single precision may add to a quantised cosine.
ROUNDING = 4e-6


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    ship(vectors.sparkSession)
    vector = F.col(vector_column).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
            .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
            .filter(F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
            .dropDuplicates(["vec_id", "vector"]))


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("vector").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Quantised:
    """Rows scaled to length one and rounded to int8: `q` with scale `s` each; `off` is the length of what rounding took away."""

    def __init__(self, raw: np.ndarray):
        # Scaled first, so that squares neither overflow nor vanish.
        top = np.abs(raw).max(axis=1)
        self.raw = raw
        self.length = top * np.linalg.norm(raw / top[:, None], axis=1)
        unit = (raw / top[:, None]) / (self.length / top)[:, None]
        self.s = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.s[:, None]).astype(np.int8)
        back = self.q * self.s[:, None]
        self.off, self.kept = np.linalg.norm(unit - back, axis=1), np.linalg.norm(back, axis=1)


def _tile(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not queries.num_rows or not candidates.num_rows:
        return schema.empty_table()
    a, b = Quantised(_matrix(queries)), Quantised(_matrix(candidates))
    a_id, b_id = queries.column("vec_id").to_numpy(), candidates.column("vec_id").to_numpy()
    whole = np.float32 if a.raw.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = b.q.astype(whole).T
    heaps: list[list[tuple[float, int]]] = [[] for _ in a_id]
    for low in range(0, len(a_id), STRIP):
        rows = slice(low, min(low + STRIP, len(a_id)))
        near = (a.q[rows].astype(whole) @ right) * a.s[rows, None] * b.s[None, :]
        error = a.off[rows, None] + a.kept[rows, None] * b.off[None, :] + ROUNDING
        near[a_id[rows, None] == b_id[None, :]] = -np.inf
        least = near - error
        kth = np.partition(least, -k, axis=1)[:, -k] if least.shape[1] > k else np.full(len(least), -np.inf)
        r, c = np.nonzero((near + error >= kth[:, None]) & (near > -np.inf))
        for at in range(0, len(r), PAIRS):
            i, j = r[at: at + PAIRS] + low, c[at: at + PAIRS]
            scores = (a.raw[i] * b.raw[j]).sum(axis=1) / (a.length[i] * b.length[j])
            bad = ~np.isfinite(scores)
            if bad.any():  # products beyond the range of doubles: scale both sides first
                x, y = a.raw[i[bad]] / a.length[i[bad], None], b.raw[j[bad]] / b.length[j[bad], None]
                scores[bad] = (x * y).sum(axis=1)
            for q, v, s in zip(i.tolist(), b_id[j].tolist(), scores.tolist(), strict=True):
                heap, entry = heaps[q], (s, -v)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
    hashes = queries.column("query_hash").to_pylist()
    found = [(int(a_id[q]), hashes[q], -v, s) for q, heap in enumerate(heaps) for s, v in heap]
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema) if found \
        else schema.empty_table()


def nearest(queries: DataFrame, candidates: DataFrame, k: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k largest cosines of each query. Both tables are as from `usable`."""
    same = Window.partitionBy("vector").orderBy("vec_id")
    candidates = candidates.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1).drop("place")
    queries = queries.withColumn("query_hash", F.xxhash64("vector"))
    left, right = (max(1, -(-side.count() // block)) for side in (queries, candidates))

    def dealt(side: DataFrame, own: str, own_parts: int, other: str, other_parts: int) -> DataFrame:
        mixed = F.xxhash64("vec_id", "vector", F.lit(own))
        return side.select("*", F.size("vector").alias("length"), F.pmod(mixed, F.lit(own_parts)).cast("int").alias(own),
                           F.explode(F.sequence(F.lit(0), F.lit(other_parts - 1))).alias(other))

    by = ["length", "left_block", "right_block"]
    tiles = (dealt(queries, "left_block", left, "right_block", right).groupBy(*by)
             .cogroup(dealt(candidates, "right_block", right, "left_block", left).groupBy(*by))
             .applyInArrow(lambda a, b: _tile(a, b, k), "query_id long, query_hash long, vec_id long, score double"))
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return (tiles.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
