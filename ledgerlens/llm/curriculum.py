"""Mixing sources to target weights by a time-varying curriculum.

Training runs from time 0 to time 1. Each source has a weight, which sets how many words the mix takes from it in all (its target),
and a schedule, which says when: a rate over time, linear between knots. The schedule's integral is the source's cumulative demand.
A source's documents stand in an order drawn by hash, anew for each repeat; the middle of a copy's words is a demand, and the
time at which that demand falls due (the inverse of the integral, in closed form on each segment) is the copy's training position.
All copies are then range-sorted by position.

A source's documents may be a third of all: running sums are taken over ranges of the order, each a window of its own, and what
came before a range is added from the ranges' totals, of which there are as many as ranges. Nothing goes through one task.

Targets: sources ranked by code point (null last) have the weights in turn and share `share` times all words; no target passes
`most` times its source's words, and the excess is shared again by weight until none does. That has one solution: the sources
of least words for their weight are full, all others get the same words for their weight.

Defined results: null and empty texts have size 0, no copies and take 0; a source without words has target 0; rows that are the
same in all columns read count each for itself, and which of them is cut is not told apart; columns beyond the id, text and source
are carried through `mixed` whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.files import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: (time, rate) knots for each weight in turn: the first sources early, the second evenly, the third late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
WORD = r"[^\x20\x09-\x0D]+"

SOURCE = ("no_source", "source")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """`rows` and, as `name`, the sum of `value` over the rows of the same `keys` (none of them null) that come before in `order`.

    Rows are range-partitioned by (keys, order) and written; each range sums its own rows, and adds the totals of the ranges before.
    """
    cut = stored(rows.repartitionByRange(*keys, *order).withColumn("slice", F.spark_partition_id()))
    before = (Window.unboundedPreceding, -1)
    totals = cut.groupBy("slice", *keys).agg(F.sum(value).alias("total"))
    ahead = Window.partitionBy(*keys).orderBy("slice").rowsBetween(*before)
    carried = totals.select("slice", *keys, F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("slice", *keys).orderBy(*order).rowsBetween(*before)
    summed = cut.withColumn("own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (summed.join(carried, ["slice", *keys]).withColumn(name, F.col("own") + F.col("carried"))
            .drop("slice", "own", "carried"))


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
          **more: Column) -> DataFrame:
    """One row for each row of `docs`: row (a number of its own), doc_id, no_source, source, size and mark (of id and text), and
    what `more` names. Written, so that a row keeps its number."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    named = F.col(source_column).cast("string")
    mark = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    return stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), named.isNull().alias("no_source"),
        F.coalesce(named, F.lit("")).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(mark.cast("binary")).alias("mark"), *[c.alias(name) for name, c in more.items()]))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """no_source, source, source_size, turn (the place of its weight) and target of each source of `sizes` (no_source, source, size)."""
    if share > most:
        raise ValueError("the sources do not hold so many words, repeats counted")
    sources = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running(sources, [], SOURCE, "one", "place")
    turn = (F.col("place") % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    ranked = ranked.withColumns({"turn": turn, "weight": weight}).withColumns(
        {"most": (F.col("source_size") * most).cast("long"), "fill": F.col("source_size") * float(most) / F.col("weight")})
    # Sources fill up in the order of `fill`; a source is full if, with all before it full, its share passes its most.
    filled = running(ranked.select(*SOURCE, "source_size", "turn", "weight", "most", "fill"), [], ["fill", *SOURCE], "most", "full_before")
    filled = stored(running(filled, [], ["fill", *SOURCE], "weight", "weight_before"))
    whole = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    rest = (F.col("words") * float(share) - F.col("full_before")) / (F.col("weights") - F.col("weight_before"))
    told = filled.join(F.broadcast(whole)).withColumn("full", F.col("fill") <= rest)  # one row
    left = told.agg(F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).alias("full_words"),
                    F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).alias("open_weight"))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(
        F.try_divide(F.col("words") * float(share) - F.col("full_words"), "open_weight") * F.col("weight"))
    return told.join(F.broadcast(left)).select(*SOURCE, "source_size", "turn", target.alias("target"))  # one row


def due(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which `share` (0 to 1) of a source's target has been asked for: the schedule's integral, inverted."""
    times, rates = [k[0] for k in knots], [k[1] for k in knots]
    if times[0] != 0 or times[-1] != 1 or sorted(set(times)) != times or min(rates) < 0 or max(rates) <= 0:
        raise ValueError("knots run from time 0 to time 1, with rates of 0 or more")
    parts = [(times[i + 1] - times[i]) * (rates[i] + rates[i + 1]) / 2 for i in range(len(knots) - 1)]
    demand, at, reached = share * sum(parts), None, 0.0
    for i, part in enumerate(parts):
        if part == 0:
            continue
        slope = (rates[i + 1] - rates[i]) / (times[i + 1] - times[i])
        over = F.greatest(demand - reached, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(rates[i] * rates[i]) + over * (2 * slope), F.lit(0.0)))
        time = F.least(F.lit(times[i]) + over * 2 / (root + rates[i]), F.lit(times[i + 1]))
        time = F.when(over == 0, F.lit(times[i])).otherwise(time)
        at = time if at is None else F.when(demand > reached, time).otherwise(at)
        reached += part
    return at


def placed(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST,
           schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> tuple[DataFrame, DataFrame]:
    """(sources, copies) of the mix of `rows` (from `sized`): each source's target; and one row for each copy of a document that the
    mix takes: row, doc_id, copy, words (how many from its start; the copy that meets the target is cut there), position, and
    starts_at (the words of the mix before it)."""
    if len(schedules) != len(weights):
        raise ValueError("one schedule for each weight")
    sources = stored(targets(rows, weights, share, most))
    wanted = sources.filter("target >= 1").select(*SOURCE, "source_size", "turn", F.floor("target").alias("goal"))
    times = F.ceil(F.col("goal") / F.col("source_size")).cast("int")
    copies = (rows.filter("size > 0").join(wanted, list(SOURCE))
              .withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(times - 1, F.lit(0)))))
              .withColumn("drawn", F.md5(F.concat(F.col("copy").cast("string"), F.lit(":"), F.col("mark")).cast("binary"))))
    copies = running(copies, [*SOURCE, "copy"], ["drawn", "mark", "size", "row"], "size", "within")
    before = F.col("copy") * F.col("source_size") + F.col("within")
    words = F.least(F.col("size"), F.col("goal") - before)
    taken = copies.withColumns({"before": before, "words": words}).filter("words > 0")
    middle = (F.col("before") + F.col("words") / 2) / F.col("goal")
    position = due(middle, schedules[-1])
    for i, knots in enumerate(schedules[:-1]):
        position = F.when(F.col("turn") == i, due(middle, knots)).otherwise(position)
    taken = taken.select("row", "doc_id", *SOURCE, "mark", "copy", "words", position.alias("position"))
    taken = running(taken, [], ["position", *SOURCE, "copy", "mark", "row"], "words", "starts_at")
    return sources, taken.select("row", "doc_id", "copy", "words", "position", "starts_at")


def shares(docs: DataFrame, **mix) -> DataFrame:
    """One row for each row of `docs`: doc_id, size, source_size, target (its source's), taken (words, repeats counted), copies, and
    first_position and starts_at of the earliest copy (null if none is taken)."""
    rows = sized(docs)
    sources, copies = placed(rows, **mix)
    taken = copies.groupBy("row").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("copies"),
                                      F.min("position").alias("first_position"), F.min("starts_at").alias("starts_at"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sources, list(SOURCE)).join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", zero("taken"), zero("copies"), "first_position", "starts_at")


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **mix) -> DataFrame:
    """The training stream: a row for each copy, range-sorted by position: doc (the row of `docs` as a struct), text (what is taken of
    it), copy, words, position and starts_at."""
    text = F.col(text_column).cast("string")
    rows = sized(docs, id_column, text_column, source_column, doc=F.struct(*[docs[c] for c in docs.columns]), whole=text)
    _, copies = placed(rows.drop("doc", "whole"), **mix)
    part = F.array_join(F.slice(F.regexp_extract_all("whole", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    stream = rows.select("row", "size", "doc", "whole").join(copies.drop("doc_id"), "row").select(
        "doc", F.when(F.col("words") < F.col("size"), part).otherwise(F.col("whole")).alias("text"), "copy", "words", "position", "starts_at")
    return stream.repartitionByRange("position", "starts_at").sortWithinPartitions("position", "starts_at")
