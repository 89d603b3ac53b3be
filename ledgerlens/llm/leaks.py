"""Benchmark decontamination by winnowing.

Of every window of 10 words the least hashes of 5-word grams are kept as fingerprints, in documents and benchmark items alike, so
a shared window always shares a fingerprint. Documents' fingerprints pass a bit filter of fixed size made from the benchmark's,
are joined with them, and each hit is extended word by word, compared as text. Items shorter than a window are looked up whole.

Defined results: null and empty texts have no words, no hits and are not contaminated; items without words are ignored; items of
null id mark words but are not listed; repeated rows each get their result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..ship import ship
from ..sources.files import stored
from .rows import KEY, covered, decided, kind, named, same_row
from .words import LOWER, Words, minimisers, slices

WINDOW = 10
GRAM = 5
#: Bits of the filter: 8 MB, whatever the benchmark's size. A full filter lets more rows into the join and loses none.
FILTER_BITS = 1 << 26

_HIT = pa.struct([("mark", pa.int64()), ("size", pa.int32()), ("at", pa.int64()), ("before", pa.list_(pa.string())),
                  ("after", pa.list_(pa.string()))])
_HITS = "array<struct<mark: bigint, size: int, at: bigint, before: array<string>, after: array<string>>>"


def _fingerprints(w: Words, window: int, gram: int, short: list[int]):
    """(size, word numbers, hashes): winnowed grams, then all runs of each short length."""
    at, values = w.grams(gram)
    kept = minimisers(values, w.doc[at], window - gram + 1)
    yield gram, at[kept], values[kept]
    for n in short:
        at, values = w.grams(n)
        yield -n, at, values


def _scan(batches, window: int, gram: int, short: list[int], bits: np.ndarray | None):
    """One row a text: its number of words, and its fingerprints with their surroundings. Short runs have a negative size."""
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            hits: list[list] = [[] for _ in range(part.num_rows)]

            def word(i: int) -> str:
                return LOWER[w.data[w.start[i]: w.end[i]]].tobytes().decode("utf-8", "replace")

            for size, at, values in _fingerprints(w, window, gram, short):
                if bits is not None:
                    place = values & np.uint64(FILTER_BITS - 1)
                    known = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
                    at, values = at[known == 1], values[known == 1]
                elif size < 0:
                    whole = w.counts[w.doc[at]] == -size
                    at, values = at[whole], values[whole]
                for i, v in zip(at.tolist(), values.view(np.int64).tolist()):
                    d = int(w.doc[i])
                    low, high, reach = int(w.first[d]), int(w.first[d + 1]), window - gram if size > 0 else 0
                    hits[d].append({"mark": v, "size": size, "at": i - low,
                                    "before": [word(j) for j in range(i - 1, max(low, i - reach) - 1, -1)],
                                    "after": [word(j) for j in range(i, min(high, i + abs(size) + reach))]})
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(w.counts, pa.int64()), pa.array(hits, pa.list_(_HIT))],
                ["doc_id", "text_hash", "n_words", "hits"])


def _shared(a: str, b: str, most: int):
    """How many leading entries of two arrays are the same."""
    same = [F.when((F.size(a) >= i) & (F.size(b) >= i) & (F.slice(a, 1, i) == F.slice(b, 1, i)), 1).otherwise(0)
            for i in range(1, most + 1)]
    return sum(same[1:], same[0])


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): each text's key and n_words; and the shared runs [start, stop) of a text's words with the item they are in."""
    spark, id_kind = docs.sparkSession, kind(docs)
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("doc_id"), F.lit(0).cast("long").alias("text_hash"),
                             F.col("text").cast("string").alias("text"))
    every = list(range(1, window))
    marks = stored(items.mapInArrow(
        lambda batches: _scan(batches, window, gram, every, None),
        f"doc_id string, text_hash long, n_words long, hits {_HITS}").filter((F.col("n_words") > 0)))
    long_enough = F.col("n_words") >= window
    # A short item counts as a whole, a long one by its windows.
    marks = (marks.select(F.col("doc_id").alias("item_id"), "n_words", F.explode("hits").alias("h"))
             .filter(F.when(long_enough, F.col("h.size") > 0).otherwise(-F.col("h.size") == F.col("n_words")))
             .select("item_id", "h.*"))
    short = [-r[0] for r in marks.filter("size < 0").select("size").distinct().collect()]  # at most window - 1 numbers
    place = F.col("mark").bitwiseAND(F.lit(FILTER_BITS - 1))
    filled = (marks.select(F.shiftright(place, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(mark & 63 as int))").alias("bit"))
              .groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas())  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[filled["cell"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)
    texts = stored(named(docs).mapInArrow(lambda batches: _scan(batches, window, gram, short, shared.value),
                                          f"doc_id {id_kind}, text_hash long, n_words long, hits {_HITS}"))
    hits = texts.filter(F.size("hits") > 0).select(*KEY, F.explode("hits").alias("h")).select(*KEY, "h.*")
    marks = marks.select("item_id", "mark", "size", F.col("before").alias("item_before"), F.col("after").alias("item_after"))
    left, right = _shared("before", "item_before", window - gram), _shared("after", "item_after", window)
    spans = (hits.join(marks, ["mark", "size"])
             .withColumns({"left": left, "right": right})
             .filter(F.when(F.col("size") > 0, F.col("left") + F.col("right") >= window).otherwise(F.col("right") == -F.col("size")))
             .select(*KEY, (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop"), "item_id"))
    return texts.select(*KEY, "n_words"), spans


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_hash, n_words, n_hit (words inside shared windows), n_items, items_sha256
    (of the sorted item ids, joined by commas) and contaminated."""
    texts, spans = leaks(docs, benchmark, window, gram)
    spans = stored(spans.distinct())
    items = spans.groupBy(*KEY).agg(F.collect_set("item_id").alias("items"))
    words = covered(spans.select(*KEY, "start", "stop").distinct(), *KEY)
    both = items.join(words, same_row(items, words)).select(items["doc_id"], items["text_hash"], "items", "covered")
    joined = texts.join(both, same_row(texts, both), "left")
    listed = F.sort_array(F.coalesce("items", F.array().cast("array<string>")))
    return joined.select(
        texts["doc_id"], texts["text_hash"], "n_words", F.coalesce("covered", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        F.coalesce(F.col("covered") > 0, F.lit(False)).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that share no window with the benchmark, as they are. Repeated rows stay repeated."""
    found = contamination(docs, benchmark).filter("contaminated").select(*KEY).distinct().withColumn("leaked", F.lit(True))
    return decided(docs, found).filter("leaked is null").select("row.*")
