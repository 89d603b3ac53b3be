"""Running measures along a key's timeline, whatever one key's share of the rows.

A window over a key puts the whole key into one task. Where no key has more rows than a task should hold, that is the plan used
here. Else the rows are dealt out by ranges of (key, order) and written once: what lies in one range is a slice, so that a heavy
key is as many slices as it needs and light keys share one. Each slice of a key is a window of its own, its totals are
pre-aggregated, and what all earlier slices add up to is joined back as a carry. Only keys that go on over a border have one, two
rows a border at most. Both ways give the same rows.

Sliding windows are running sums too: a row adds its value when it happens and a second entry takes it back once it has left the
window. Sums of whole numbers keep that exact, and a row costs the same in a busy account as in a quiet one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.files import stored

SLICE = "_slice"
#: Rows of one key that a task should hold at most (`ledgerlens.rowsPerSlice`).
ROWS_PER_SLICE = 2_000_000


# --- Measures -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Sum:
    """Sum of `value`, the row itself included unless `before`."""
    value: Column
    before: bool = False

    def local(self, w, name):
        return {name: F.coalesce(F.sum(self.value).over(_frame(w, self.before)), F.lit(0))}

    def partials(self, name):
        return {name: F.sum(self.value)}

    def fold(self, w, name):
        return {name: F.sum(name).over(_frame(w, True))}

    def merge(self, carried, name):
        return {name: F.col(name) + F.coalesce(carried(name), F.lit(0))}


@dataclass(frozen=True)
class Max:
    """Greatest `value` seen, nulls skipped."""
    value: Column
    before: bool = False

    def local(self, w, name):
        return {name: F.max(self.value).over(_frame(w, self.before))}

    def partials(self, name):
        return {name: F.max(self.value)}

    def fold(self, w, name):
        return {name: F.max(name).over(_frame(w, True))}

    def merge(self, carried, name):
        return {name: F.greatest(F.col(name), carried(name))}


@dataclass(frozen=True)
class Min:
    """Least `value` seen, nulls skipped."""
    value: Column
    before: bool = False

    def local(self, w, name):
        return {name: F.min(self.value).over(_frame(w, self.before))}

    def partials(self, name):
        return {name: F.min(self.value)}

    def fold(self, w, name):
        return {name: F.min(name).over(_frame(w, True))}

    def merge(self, carried, name):
        return {name: F.least(F.col(name), carried(name))}


@dataclass(frozen=True)
class Next:
    """`value` of the following row; it must not decrease along the order."""
    value: Column

    def local(self, w, name):
        return {name: F.lead(self.value).over(w)}

    def partials(self, name):
        return {name: F.min(self.value)}

    def fold(self, w, name):
        return {name: F.lead(name).over(w)}

    def merge(self, carried, name):
        return {name: F.coalesce(F.col(name), carried(name))}


@dataclass(frozen=True)
class Moments:
    """Count, mean and population deviation of the earlier rows' values (nulls skipped), as
    `<name>_n`, `<name>_mean` and `<name>_std`; exactly 0 spread for a constant history."""
    value: Column

    def local(self, w, name):
        f = _frame(w, True)
        return {f"{name}_n": F.count(self.value).over(f),
                f"{name}_mean": F.avg(self.value).over(f),
                f"{name}_std": F.stddev_pop(self.value).over(f),
                f"{name}_low": F.min(self.value).over(f),
                f"{name}_high": F.max(self.value).over(f)}

    def partials(self, name):
        return {f"{name}_n": F.count(self.value), f"{name}_sum": F.sum(self.value),
                f"{name}_m2": F.var_pop(self.value) * F.count(self.value),
                f"{name}_low": F.min(self.value), f"{name}_high": F.max(self.value)}

    def fold(self, w, name):
        f = _frame(w, True)
        n, total = F.col(f"{name}_n"), F.col(f"{name}_sum")
        n0 = F.coalesce(F.sum(n).over(f), F.lit(0))
        s0 = F.coalesce(F.sum(total).over(f), F.lit(0.0))
        # A slice's spread around its own mean, plus its mean's distance from the earlier ones'.
        shift = F.when((n > 0) & (n0 > 0),
                       F.pow(total / F.nullif(n, F.lit(0)) - s0 / F.nullif(n0, F.lit(0)), 2)
                       * n0 * n / (n0 + n)).otherwise(0.0)
        return {f"{name}_n": n0, f"{name}_sum": s0,
                f"{name}_low": F.min(f"{name}_low").over(f),
                f"{name}_high": F.max(f"{name}_high").over(f),
                f"{name}_term": F.coalesce(F.col(f"{name}_m2"), F.lit(0.0)) + shift}

    def finish(self, w, name):
        return {f"{name}_m2": F.coalesce(F.sum(f"{name}_term").over(_frame(w, True)), F.lit(0.0))}

    def merge(self, carried, name):
        n1, n0 = F.col(f"{name}_n"), F.coalesce(carried(f"{name}_n"), F.lit(0))
        mean1 = F.col(f"{name}_mean")
        s0 = F.coalesce(carried(f"{name}_sum"), F.lit(0.0))
        n = n1 + n0
        total = s0 + F.coalesce(mean1 * n1, F.lit(0.0))
        m2 = (F.coalesce(F.pow(F.col(f"{name}_std"), 2) * n1, F.lit(0.0))
              + F.coalesce(carried(f"{name}_m2"), F.lit(0.0))
              + F.when((n1 > 0) & (n0 > 0),
                       F.pow(mean1 - s0 / F.nullif(n0, F.lit(0)), 2) * n1 * n0 / F.nullif(n, F.lit(0)))
              .otherwise(0.0))
        low = F.least(F.col(f"{name}_low"), carried(f"{name}_low"))
        high = F.greatest(F.col(f"{name}_high"), carried(f"{name}_high"))
        cold = n0 == 0
        return {f"{name}_n": n,
                f"{name}_mean": F.when(cold, mean1).when(low == high, low)
                .otherwise(total / F.nullif(n, F.lit(0))),
                f"{name}_std": F.when(cold, F.col(f"{name}_std")).when(low == high, F.lit(0.0))
                .otherwise(F.sqrt(m2 / F.nullif(n, F.lit(0)))),
                f"{name}_low": low, f"{name}_high": high}


def _frame(w, before: bool):
    return w.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)


# --- Slices -------------------------------------------------------------------------------

def rows_per_slice(spark) -> int:
    return int(spark.conf.get("ledgerlens.rowsPerSlice", str(ROWS_PER_SLICE)))


def slices_for(rows: DataFrame, key: list[str]) -> int:
    """How many slices the rows need if a key has more rows than a task should hold, else 0. Counts are combined before the
    shuffle, and one row comes back."""
    limit = rows_per_slice(rows.sparkSession)
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return math.ceil(counts[1] / limit) if (counts[0] or 0) > limit else 0


def running(rows: DataFrame, key: list[str], order: list[str], measures: dict, slices: int | None = 0) -> DataFrame:
    """`rows` plus the measures, named by the dictionary; helper columns start with the name. With `slices` None they are counted here.
    Counting, sampling the ranges and dealing read the rows three times, so rows that cost something are written first."""
    if slices is None:
        rows = stored(rows)
        slices = slices_for(rows, key)
    of = lambda kind, *args: [c.alias(n) for name, m in measures.items() for n, c in getattr(m, kind)(*args, name).items()]
    if not slices:
        return rows.select("*", *of("local", Window.partitionBy(*key).orderBy(*order)))
    parts = max(slices, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = stored(rows.repartitionByRange(parts, *key, *order).withColumn(SLICE, F.spark_partition_id()))
    local = placed.select("*", *of("local", Window.partitionBy(*key, SLICE).orderBy(*order)))
    totals = placed.groupBy(*key, SLICE).agg(*of("partials"))
    # A key with one slice needs no carry. The others have two rows a border at most, and the slices in the middle.
    spans = totals.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(
        F.min(SLICE).alias("_low"), F.max(SLICE).alias("_high")).filter("_low < _high").drop("_low", "_high")
    same = [totals[k].eqNullSafe(spans[f"_k_{k}"]) for k in key]
    totals = totals.join(F.broadcast(spans), same, "left_semi")
    across = Window.partitionBy(*key).orderBy(SLICE)
    folded = totals.select(*key, SLICE, *of("fold", across))
    for name, m in measures.items():
        if isinstance(m, Moments):
            folded = folded.select("*", *[c.alias(n) for n, c in m.finish(across, name).items()])
    carried_names = [c for c in folded.columns if c not in key and c != SLICE]
    carry = folded.select(*[F.col(c).alias(f"_k_{c}") for c in [*key, SLICE]], *[F.col(c).alias(f"_c_{c}") for c in carried_names])
    # As many rows as slices and one for each border.
    joined = local.join(F.broadcast(carry), [local[c].eqNullSafe(carry[f"_k_{c}"]) for c in [*key, SLICE]], "left")
    merged = {n: c for name, m in measures.items()
              for n, c in m.merge(lambda x: F.col(f"_c_{x}"), name).items()}
    return joined.select(*[merged[c].alias(c) if c in merged else F.col(c)
                           for c in [*rows.columns, *merged]])
