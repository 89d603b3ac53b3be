"""Exact order statistics without gathering a group: values are counted first, and a running count
over the distinct values finds the ones at the wanted ranks. Ranked rows and global positions work
the same way; a long order is dealt into slices like a heavy account's timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.files import stored
from .timeline import Sum, running, slices_for

ALL = "_all"


def running_within(rows: DataFrame, by: list[str], order: list[str], measures: dict, kept: bool = False) -> DataFrame:
    """Running measures along the order of each group, or of the whole table. `kept` rows lie in a table and are not written again."""
    keyed = rows if by else rows.withColumn(ALL, F.lit(0))
    key = by or [ALL]
    return running(keyed, key, order, measures, slices_for(keyed, key) if kept else None).drop(ALL)


def value_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """How often each value occurs per group, counted before the shuffle."""
    return (rows.filter(F.col(value).isNotNull()).groupBy(*by, value)
            .agg(F.count(F.lit(1)).alias("n")))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float],
                    nearest: bool = False) -> DataFrame:
    """Exact quantiles per group, interpolated linearly, or the value at int(q*n) if `nearest`."""
    counts = stored(value_counts(rows, by, value))
    return quantiles_of_counts(counts, by, value, wanted, nearest)


def quantiles_of_counts(counts: DataFrame, by: list[str], value: str, wanted: dict[str, float], nearest: bool = False) -> DataFrame:
    """Exact quantiles from a table with one row a group and value, which occurs `n` times."""
    keyed = counts if by else counts.withColumn(ALL, F.lit(0))
    key = by or [ALL]
    ranked = running(keyed, key, [value], {"upto": Sum(F.col("n"))}, slices_for(keyed, key))
    totals = keyed.groupBy(*by).agg(F.sum("n").alias("total"))
    # One number for the whole table, or one row for each group.
    ranked = ranked.join(totals, by) if by else ranked.withColumn("total", totals.select("total").scalar())
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1      # ranks from 0
    at = lambda rank: F.max(F.when((first <= rank) & (rank <= last), F.col(value)))
    out = []
    for name, q in wanted.items():
        if nearest:
            rank = F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total")))
            out.append(at(rank).alias(name))
            continue
        spot = F.lit(q) * (F.col("total") - 1)
        low, high = at(F.floor(spot)), at(F.ceil(spot))
        part = F.max(spot - F.floor(spot))
        out.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(*out)


def with_position(rows: DataFrame, order: list[Column], name: str = "position", kept: bool = False) -> DataFrame:
    """`rows` with their place in one total order, from 0."""
    cols = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *[c.alias(n) for c, n in zip(order, cols)])
    placed = running_within(keyed, [], cols, {name: Sum(F.lit(1), before=True)}, kept)
    return placed.drop(*cols)
