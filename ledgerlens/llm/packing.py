"""Best-fit packing of tokenised documents into training sequences.

Each task packs what it reads, online and in bounded space: `OPEN` bins at most, found through a bitset keyed by free space (the
least sufficient space is a shift and a lowest set bit); when all are in use the fullest closes. Nothing is shuffled for that. The
bins left open at the ends of tasks, `OPEN` a task at most, are then packed into each other as wholes, largest first, so that many
tasks leave no more half-full sequences than few.

Defined results: null and empty texts are the closing id alone; repeated rows and null ids are packed each for itself; a document
of exactly the capacity is one piece; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..sources.files import stored
from .rows import kind, named
from .tokens import _library, by_pieces, raw, worker
from .words import slices

CAPACITY = 4096
END_ID = 1
OPEN = 512
#: Left-open bins that one task packs in the second round.
ROUND_ROWS = 200_000


class Bins:
    """Open bins by free space. `place` says which bin a piece goes to, and where in it."""

    def __init__(self, capacity: int, limit: int, first: int = 0, step: int = 1):
        self.capacity, self.limit, self.next, self.step = capacity, limit, first, step
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.spaces, self.open = 0, 0

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        taken = bins.pop()
        if not bins:
            self.spaces ^= 1 << space
        self.open -= 1
        return taken

    def place(self, size: int) -> tuple[int, int]:
        enough = self.spaces >> size
        if enough:
            space = size + (enough & -enough).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, chosen = self.capacity, self.next
            self.next += self.step
        left = space - size
        if left:
            self.by_space[left].append(chosen)
            self.spaces |= 1 << left
            self.open += 1
        return chosen, self.capacity - space

    def left_open(self) -> list[tuple[int, int]]:
        return [(b, self.capacity - space) for space, bins in enumerate(self.by_space) for b in bins]


def _little_endian(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _packed(batches, path: str, pieces: bool, capacity: int, limit: int, id_type: pa.DataType):
    """A row for each piece; then, with a null piece, one for each bin left open: its number and what it holds."""
    task = TaskContext.get().partitionId()
    lookup = worker(path, False) if pieces else None
    library = None if pieces else _library(path)
    bins, end = Bins(capacity, limit, task << 32), _little_endian([END_ID])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"]
    types = [id_type, pa.int32(), *[pa.int64()] * 5]
    for batch in batches:
        for part in slices(batch):
            texts, out = raw(part.column("text")), []
            ids = ((b"".join(t) for t in lookup.texts(texts)) if pieces
                   else map(_little_endian, library([t.decode("utf-8", "replace") for t in texts])))
            for doc_id, own in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                own += end
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    piece = own[at: at + 4 * capacity]
                    chosen, offset = bins.place(len(piece) // 4)
                    out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece), chosen, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
    left = bins.left_open()
    if left:
        none = [None] * len(left)
        columns = [none, none, none, [u for _, u in left], none, [b for b, _ in left], none]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _repacked(batches, capacity: int):
    """Places whole bins, largest first: bin, sequence_id, base. The numbers are below 0, so no first-round bin has them."""
    task = TaskContext.get().partitionId()
    rows = sorted(((u, b) for batch in batches for u, b in zip(batch.column("length").to_pylist(), batch.column("bin").to_pylist(),
                                                                strict=True)), key=lambda x: (-x[0], x[1]))
    bins = Bins(capacity, len(rows) + 1, -1 - (task << 32), -1)
    placed = [(b, *bins.place(u)) for u, b in rows]
    if placed:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*placed, strict=True)], ["bin", "sequence_id", "base"])


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, limit: int = OPEN) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    id_type, pieces = kind(docs), by_pieces(path)
    arrow = pa.int64() if id_type in ("bigint", "int") else pa.string()
    rows = named(docs)
    if id_type not in ("bigint", "string"):
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("long" if id_type == "int" else "string"))
        id_type = "bigint" if id_type == "int" else "string"
    first = stored(rows.select("doc_id", "text").mapInArrow(
        lambda batches: _packed(batches, path, pieces, capacity, limit, arrow),
        f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, bin long, offset long"))
    open_bins = first.filter("piece is null").select("bin", "length")
    parts = -(-open_bins.count() // ROUND_ROWS) or 1
    moved = stored(open_bins.repartition(parts).mapInArrow(lambda batches: _repacked(batches, capacity),
                                                           "bin long, sequence_id long, base long"))
    return (first.filter("piece is not null").join(moved, "bin", "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"),
                    (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")))
