"""Ranked lexical search with pair-bound MaxScore.

The index holds, for each term that queries ask for, its postings with their impacts (whole numbers), their maximum and its best
`CHAMPIONS` documents. A query's champions are scored in full; the k-th best of them is a threshold that no answer falls below. The
terms are ordered by maximum, and neighbours in that order are paired: a pair's intersection list has the greatest sum of both
impacts in one document, so the pair adds at most the greatest of that and the two single maxima, where independent maxima would
add up both. The longest run of least terms whose combined bound stays below the threshold is left out of the search: a document
with only those cannot be an answer. Documents of the other terms are candidates. The least terms, whose combined bound is below
`LAST_SHARE` of the threshold, are the frequent ones: they are added to those candidates only that can reach the threshold by what
their other terms come to and that bound. The k best are returned. Bounds only skip: the answer is that of scoring everything.

Only a document's counts are made in Python, a text at a time; terms are told apart as text. Postings of a frequent term meet
the queries that need it in a join that is broadcast or split by size; nothing of a term or a query goes through one task, and
sums are taken before they are shuffled. Terms that no query asks for are left out by a bit filter of 1 MB, whatever the number of
queries; a full one lets more into the join and loses none.

Defined results: null and empty texts have no terms, count in no statistic and are never found; a query without terms gets no rows;
queries of null or equal ids each get theirs; repeated documents each have a place of their own; equal scores stand by ascending
doc_id, null last; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..ship import ship
from ..sources.files import stored
from .rows import kind
from .tokens import raw
from .words import SPACED, slices

BEST = 10
#: Documents of greatest impact that are kept for each term, to set thresholds; any number gives the same answers.
CHAMPIONS = 10
#: Pairs have an intersection list if the rarer term is in this share of the documents at most; others are bounded by their sum.
PAIR_SHARE = 1 / 64
FILTER_BITS = 1 << 23
#: Terms whose combined bound stays below this share of the threshold are added last, to candidates that can still make it up.
LAST_SHARE = 0.5
#: Bytes of a text that are split into words at once.
_PIECE = 1 << 20


def _counts(text: bytes) -> Counter:
    spaced, counts, at = text.translate(SPACED), Counter(), 0
    while at < len(spaced):
        stop = spaced.find(b" ", at + _PIECE)
        stop = len(spaced) if stop < 0 else stop
        counts.update(spaced[at:stop].split())
        at = stop
    return counts


_TERMS = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))


def _counted(docs: DataFrame, id_column: str, text_column: str, bits: bytes | None = None) -> DataFrame:
    """doc_id, n and terms (term, tf) of each row; with `bits`, only terms that it lets through."""
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches):
        known = None if shared is None else shared.value
        for batch in batches:
            for part in slices(batch):
                sizes, terms = [], []
                for text in raw(part.column("text")):
                    counts = _counts(text)
                    sizes.append(sum(counts.values()))
                    if known is not None:
                        counts = {t: c for t, c in counts.items()
                                  if known[(p := zlib.crc32(t) & (FILTER_BITS - 1)) >> 3] >> (p & 7) & 1}
                    terms.append([{"term": t.decode("utf-8", "replace"), "tf": c} for t, c in counts.items()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, _TERMS)],
                                                 ["doc_id", "n", "terms"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind(docs, id_column)}, n long, terms array<struct<term: string, tf: bigint>>")


def _bits(terms: DataFrame) -> bytes:
    """The filter of `terms`: at most FILTER_BITS / 64 rows reach the driver."""
    place = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(FILTER_BITS - 1))
    filled = (terms.select(F.shiftright(place, 6).cast("int").alias("cell"), place.bitwiseAND(F.lit(63)).cast("int").alias("at"))
              .groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits")).toPandas())
    cells = np.zeros(FILTER_BITS // 64, "<i8")
    cells[filled["cell"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64)
    return cells.tobytes()


def index(docs: DataFrame, terms: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, vocabulary, postings) of `docs` for the distinct `terms`: row and doc_id; term, tid, df and the largest impact; row,
    tid and impact. Impacts are the terms of a BM25 sum in whole numbers (k1 = 0.8, b = 0.9, scaled by 10^9)."""
    counted = stored(_counted(docs, id_column, text_column, _bits(terms)).withColumn("row", F.monotonically_increasing_id()))
    documents, words = counted.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    flat = counted.select("row", "n", F.explode("terms").alias("t")).select("row", "n", "t.*")
    weight = F.expr(f"cast(floor(1000 * ln((2L * {documents} + 2) / (2 * df + 1))) as bigint)")
    held = flat.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(terms, "term", "left_semi")
    known = stored(held.withColumns({"weight": weight, "tid": F.monotonically_increasing_id()}))
    m = f"(10 + (90 * n * {documents}) div {max(1, words)})"
    impact = F.expr(f"weight * ((1000000000 * tf) div (1000 * tf + 8 * {m}))")
    postings = stored(flat.join(known.select("term", "tid", "weight"), "term").select("row", "tid", impact.alias("impact")))
    most = postings.groupBy("tid").agg(F.max("impact").alias("most"))
    return counted.select("row", "doc_id"), stored(known.join(most, "tid").select("term", "tid", "df", "most")), postings


def _scores(pairs: DataFrame, wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """item, row and score of all pairs (item, row), over all terms of the item (wanted: item, tid)."""
    return (pairs.join(wanted, "item").join(postings, ["row", "tid"]).groupBy("item", "row").agg(F.sum("impact").alias("score")))


def _joint(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """The intersection list of each pair (rare, other): the greatest sum of both impacts in one document; no row if none holds both."""
    first = pairs.join(postings.select(F.col("tid").alias("rare"), "row", F.col("impact").alias("one")), "rare")
    both = first.join(postings.select(F.col("tid").alias("other"), "row", F.col("impact").alias("two")), ["other", "row"])
    return both.groupBy("rare", "other").agg(F.max(F.col("one") + F.col("two")).alias("joint"))


def plan(wanted: DataFrame, thresholds: DataFrame, postings: DataFrame, pair_df: int) -> DataFrame:
    """item, tid, essential, last, and for the item need (what a candidate's terms other than the last must add up to), of each row of
    `wanted` (item, tid, df, most); thresholds: item, threshold (0 if it has no row)."""
    order = Window.partitionBy("item").orderBy("most", "tid")
    placed = stored(wanted.withColumn("place", F.row_number().over(order)).withColumn("pair", F.shiftright(F.col("place") - 1, 1)))
    # The two of a pair as one row, the rarer first.
    two = placed.groupBy("item", "pair").agg(
        F.min(F.struct("df", "tid")).alias("low"), F.max(F.struct("df", "tid")).alias("high"), F.count(F.lit(1)).alias("size"),
        F.sum("most").alias("apart"), F.max("most").alias("alone"))
    two = two.withColumns({"rare": F.col("low.tid"), "other": F.col("high.tid"),
                           "listed": (F.col("size") == 2) & (F.col("low.df") <= pair_df)}).drop("low", "high")
    two = stored(two)
    joint = _joint(two.filter("listed").select("rare", "other").distinct(), postings)
    bound = F.when(F.col("listed"), F.greatest("alone", F.coalesce("joint", F.lit(0)))).otherwise(F.col("apart"))
    bounds = two.join(joint, ["rare", "other"], "left").select("item", "pair", bound.alias("bound"))
    pairs = Window.partitionBy("item").orderBy("pair").rowsBetween(Window.unboundedPreceding, -1)
    bounds = bounds.withColumn("before", F.coalesce(F.sum("bound").over(pairs), F.lit(0)))
    first = F.col("place") % 2 == 1
    upto = F.col("before") + F.when(first, F.col("most")).otherwise(F.col("bound"))
    told = (placed.join(bounds, ["item", "pair"]).join(thresholds, "item", "left")
            .withColumn("threshold", F.coalesce("threshold", F.lit(0))).withColumn("upto", upto))
    last = F.col("upto") < F.col("threshold") * LAST_SHARE
    rest = F.coalesce(F.max(F.when(last, F.col("upto"))).over(Window.partitionBy("item")), F.lit(0))
    return told.select("item", "tid", (F.col("upto") >= F.col("threshold")).alias("essential"), last.alias("last"),
                       (F.col("threshold") - rest).alias("need"))


def search(docs: DataFrame, queries: DataFrame, best: int = BEST, id_column: str = "doc_id", text_column: str = "text",
           query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the `best` documents of each query, of those with a score above 0."""
    ship(docs.sparkSession)
    asked = stored(_counted(queries, query_id, query_text).select(
        F.monotonically_increasing_id().alias("item"), F.col("doc_id").alias("item_id"), F.col("terms.term").alias("terms")))
    asked_terms = asked.select("item", F.explode("terms").alias("term"))
    texts, vocabulary, postings = index(docs, asked_terms.select("term").distinct(), id_column, text_column)
    wanted = stored(asked_terms.join(vocabulary, "term").select("item", "tid", "df", "most"))
    slim = wanted.select("item", "tid")

    greatest = Window.partitionBy("tid").orderBy(F.col("impact").desc(), "row")
    champions = postings.withColumn("place", F.row_number().over(greatest)).filter(F.col("place") <= CHAMPIONS).select("tid", "row")
    tried = _scores(slim.join(champions, "tid").select("item", "row").distinct(), slim, postings)
    by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), "row")
    thresholds = (tried.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= best)
                  .groupBy("item").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("threshold"))
                  .filter(F.col("found") == best).select("item", "threshold"))

    documents = texts.count()
    planned = stored(plan(wanted, thresholds, postings, int(documents * PAIR_SHARE)))
    partial = (planned.filter(~F.col("last")).join(postings, "tid").groupBy("item", "row", "need")
               .agg(F.sum("impact").alias("impact"), F.max("essential").alias("essential")))
    candidates = stored(partial.filter("essential and impact >= need").select("item", "row", "impact"))
    rest = (candidates.select("item", "row").join(planned.filter("last").select("item", "tid"), "item").join(postings, ["row", "tid"])
            .select("item", "row", "impact"))
    scored = (candidates.unionByName(rest).groupBy("item", "row").agg(F.sum("impact").alias("score"))
              .filter("score > 0").join(texts, "row"))
    last = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return (scored.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= best)
            .join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
