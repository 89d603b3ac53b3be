"""How the operators name a row: its id and a hash of its text, so that null and repeated ids keep their own results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..ship import ship

KEY = ("doc_id", "text_hash")


def named(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash and text of each row; all other columns are left out, so none can clash."""
    ship(docs.sparkSession)
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def kind(docs: DataFrame, id_column: str = "doc_id") -> str:
    """The id column's type, as DDL."""
    return docs.schema[id_column].dataType.simpleString()


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Both sides' keys are the same; null is a value."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def decided(docs: DataFrame, decisions: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of `docs` as a struct `row`, beside the columns of its decision (null where there is none). `decisions` has one
    row for each KEY at most."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_column].alias("row_id"),
                       F.xxhash64(docs[text_column].cast("string")).alias("row_hash"))
    on = rows["row_id"].eqNullSafe(decisions["doc_id"]) & (rows["row_hash"] == decisions["text_hash"])
    return rows.join(decisions, on, "left").drop("row_id", "row_hash", *KEY)


def covered(spans: DataFrame, *by: str) -> DataFrame:
    """Total length of the union of the spans [start, stop) of each group; a group is one text's, so it is bounded by it."""
    from pyspark.sql import Window
    earlier = Window.partitionBy(*by).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(earlier), F.lit(0))
    fresh = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reach)))
    return fresh.groupBy(*by).agg(F.sum("fresh").alias("covered"))


def merged(spans: DataFrame, *by: str) -> DataFrame:
    """Overlapping and touching spans [start, stop) of each group joined into one."""
    from pyspark.sql import Window
    ordered = Window.partitionBy(*by).orderBy("start", "stop")
    reach = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = opened.withColumn("part", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")
