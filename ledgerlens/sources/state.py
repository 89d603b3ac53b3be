"""Current state as bucketed tables: what a batch changes is merged into its own buckets, the others are not read or written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.decision import latest
from .files import stored
from .sinks import read_table

BUCKETS = 64


class Buckets:
    """One row a key, the first in `order`, in `count` buckets by the key's hash under root/table."""

    def __init__(self, root: str, table: str, keys: Sequence[str], order: Sequence[Column], count: int = BUCKETS):
        self.path, self.root, self.table = f"{root}/{table}", root, table
        self.keys, self.order, self.count = list(keys), list(order), count

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int"))

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The whole state, or None before the first merge."""
        rows = read_table(spark, self.root, self.table)
        return None if rows is None else rows.drop("bucket")

    def of(self, keys: DataFrame) -> DataFrame | None:
        """The state of some keys; other buckets are pruned."""
        kept = read_table(keys.sparkSession, self.root, self.table)
        if kept is None:
            return None
        wanted = self._bucketed(keys.select(*self.keys)).distinct()
        touched = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most `count`
        return kept.filter(F.col("bucket").isin(touched)).join(wanted, [*self.keys, "bucket"], "left_semi").drop("bucket")

    def merge(self, rows: DataFrame) -> None:
        """`rows` into their buckets. Running it again with the same rows changes nothing: the first in order stays first."""
        fresh = stored(latest(self._bucketed(rows), self.keys, self.order))
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most `count`
        kept = read_table(rows.sparkSession, self.root, self.table)
        if kept is not None:
            fresh = stored(latest(kept.filter(F.col("bucket").isin(touched)).unionByName(fresh), self.keys, self.order))
        (fresh.repartition(min(self.count, max(1, len(touched))), "bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path))
