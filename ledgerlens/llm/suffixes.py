"""Passages that repeat, by a sparse suffix array.

Of all suffixes of all texts only those at minimisers are kept: words whose 25-word seed has the least hash of some window of 26
seeds. A passage of 50 words holds a whole window, so wherever it stands the same suffixes are kept. They are sorted over the whole
cluster, by seed and then by what surrounds it, which splits even a seed of a third of all documents over many tasks; each is
compared with its neighbours. A suffix that no neighbour shares goes; the others are matches, to be extended left and right.

Two copies whose surroundings are the same, 25 words either way, are extended by that at once. For the rest the text is read again:
every 50-word window that holds the seed, from the one that ends with it to the one that begins with it, is compared with those of
all other copies, so that left and right may have different partners. Windows that occur twice or more, joined, are exactly the
maximal runs of at least 50 words that repeat.

Defined results: null, empty and shorter texts have no passage; a text that repeats itself counts, and so do rows that are equal in
every column; their spans are given once for each doc_id and text; a null id is an id; other columns are not read. Of all copies of
a window the first, by doc_id and place, is the original, the others are later copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.files import stored
from .rows import KEY, kind, merged, named
from .words import Words, minimisers, runs, slices

PASSAGE = 50
SEED = 25


def _kept(batches, passage: int, seed: int):
    """Suffixes at minimisers: key, place (word), the seed's hash, and a hash of it with its surroundings as far as the text goes."""
    reach = passage - seed
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            at, values = w.grams(seed)
            least = minimisers(values, w.doc[at], reach + 1) & (w.counts[w.doc[at]] >= passage)
            at, values = at[least], values[least]
            doc = w.doc[at]
            low, high = np.maximum(at - reach, w.first[doc]), np.minimum(at + seed + reach, w.first[doc + 1])
            around = runs(w.hash, low, high) + (at - low).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), part.column("text_hash").take(pa.array(doc)),
                 pa.array((at - w.first[doc]).astype(np.int32)), pa.array((at - low).astype(np.int32)),
                 pa.array((high - at).astype(np.int32)), pa.array(values.view(np.int64)), pa.array(around.view(np.int64))],
                [*KEY, "at", "left", "right", "seed", "around"])


def _compared(batches):
    """Sorted suffixes that share their seed with a neighbour. A task's first and last suffix stay: their neighbours are elsewhere."""
    before = None  # the last row, which waits for its neighbour
    matched = True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches(([before] if before is not None else []) + [batch]).combine_chunks().to_batches()[0]
        seeds = rows.column("seed").to_numpy()
        same = seeds[1:] == seeds[:-1]
        keep = np.concatenate([[matched if before is not None else True], same])
        keep[:-1] |= same
        matched = bool(keep[-1])
        yield rows.slice(0, len(seeds) - 1).filter(pa.array(keep[:-1]))
        before = rows.slice(len(seeds) - 1)
    if before is not None:
        yield before


def _windows(batches, passage: int, seed: int):
    """Hashes of all windows of a text that hold one of its marked seeds: key, place, hash."""
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            begins, values = w.grams(passage)
            marks = part.column("marks").to_pylist()
            # At each word, +1 where windows that hold a seed begin and -1 after the last of them.
            turns = np.zeros(len(w.hash) + 1, np.int64)
            for d, places in enumerate(marks):
                places = np.asarray(places, np.int64) + w.first[d]
                np.add.at(turns, np.maximum(places - (passage - seed), w.first[d]), 1)
                np.add.at(turns, places + 1, -1)
            own = np.cumsum(turns)[begins] > 0
            begins, values = begins[own], values[own]
            doc = w.doc[begins]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), part.column("text_hash").take(pa.array(doc)),
                 pa.array((begins - w.first[doc]).astype(np.int32)), pa.array(values.view(np.int64))], [*KEY, "start", "window"])


def repeated(docs: DataFrame, passage: int = PASSAGE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, start, stop (words), later: the maximal repeated runs (later is false), and again those parts of them
    that are later copies (later is true), which a dedup deletes."""
    id_kind, rows = kind(docs), named(docs)
    suffixes = stored(rows.mapInArrow(
        lambda batches: _kept(batches, passage, seed),
        f"doc_id {id_kind}, text_hash long, at int, left int, right int, seed long, around long"))
    order = ["seed", "around", *KEY, "at"]
    matches = stored(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compared, suffixes.schema))
    copies = stored(matches.groupBy("seed", "around")
                    .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*KEY, "at")).alias("original")))
    kinds = copies.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("all")).filter("all > 1")
    extended = stored(matches.join(copies.join(kinds, "seed"), ["seed", "around"])
                      .withColumn("later", F.col("original") != F.struct(*KEY, "at"))
                      .select(*KEY, "at", "left", "right", "later", "copies", "kinds"))
    at_once = (extended.filter("copies > 1")
               .select(*KEY, (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop"), "later"))
    # Of copies with the same surroundings the original stands for all.
    unclear = (extended.filter((F.col("kinds") > 1) & ~F.col("later"))
               .groupBy(*KEY).agg(F.collect_set("at").alias("marks")).select(F.struct(*KEY).alias("key"), "marks"))
    marked = rows.withColumn("key", F.struct(*KEY)).join(unclear, "key").select(*KEY, "text", "marks")
    windows = stored(marked.mapInArrow(lambda batches: _windows(batches, passage, seed),
                                       f"doc_id {id_kind}, text_hash long, start int, window long"))
    shared = (windows.groupBy("window").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*KEY, "start")).alias("original"))
              .filter("copies > 1"))
    in_windows = (windows.join(shared, "window").withColumn("later", F.col("original") != F.struct(*KEY, "start"))
                  .select(*KEY, "start", (F.col("start") + passage).alias("stop"), "later"))
    spans = stored(at_once.union(in_windows).distinct())
    runs_of_all = merged(spans.select(*KEY, "start", "stop").distinct(), *KEY).withColumn("later", F.lit(False))
    return runs_of_all.unionByName(merged(spans.filter("later"), *KEY).withColumn("later", F.lit(True)))
