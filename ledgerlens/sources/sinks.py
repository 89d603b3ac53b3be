"""The warehouse: decisions, audit log, cases and quarantine as Parquet tables of batches.

A batch overwrites its own folders, so a replayed batch leaves what the first try left; readers see
the latest version per key in any case.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import settings as S
from ..functions import scalars
from ..operators.audit import append_chain, audit_core, chain_ends
from ..operators.cases import open_cases
from ..plans.dashboards import stage_columns


def scored_rows(records: DataFrame) -> DataFrame:
    """Decision records as warehouse rows: nothing null but untimed stages, gaps in features NaN."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    num = lambda c: scalars.number_or(F.col(c), 0.0).cast("float").alias(c)
    flag = lambda c: scalars.truthy(F.col(c)).cast("boolean").alias(c)
    nan = F.lit(float("nan")).cast("float")
    return records.select(
        text("transaction_id"), F.coalesce("event_time", F.current_timestamp()).alias("event_time"),
        text("sender_card"), text("receiver_card"),
        scalars.whole_or_zero(F.col("amount_uzs")).alias("amount_uzs"), text("sender_region"),
        flag("is_new_payee"), num("cep_score"), num("ml_score"), num("final_score"), text("decision"),
        text("predicted_type"), text("model_version"), flag("active_call"),
        num("secs_login_to_confirm"), num("secs_login_z"),
        scalars.stamp_or_epoch(F.col("ingested_at")).alias("ingested_at"),
        scalars.stamp_or_epoch(F.col("scored_at_job")).alias("scored_at_job"), num("scoring_ms"),
        *[c.cast("float").alias(n) for n, c in stage_columns().items()],
        F.transform(F.coalesce("features", F.array().cast("array<double>")),
                    lambda v: F.coalesce(v.cast("float"), nan)).alias("features"),
        F.current_timestamp().alias("scored_at"))


def _month(at: str) -> Column:
    return F.date_format(at, "yyyyMM")


def write_batch(rows: DataFrame, root: str, table: str, batch_id: int | str, by_month: str | None = None,
                sort: list[str] = ()) -> None:
    """One batch of a table, in a folder of its own."""
    path = f"{root}/{table}/batch={batch_id}"
    if by_month:
        rows = rows.withColumn("event_month", _month(by_month))
    if sort:
        rows = rows.sortWithinPartitions(*sort)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("event_month") if by_month else writer).parquet(path)


def read_table(spark: SparkSession, root: str, table: str, schema=None) -> DataFrame | None:
    """A table's batches, or None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    reader = spark.read.option("basePath", f"{root}/{table}")
    return (reader.schema(schema) if schema else reader).parquet(f"{root}/{table}")


def read_batch(spark: SparkSession, root: str, table: str, batch_id: int | str) -> DataFrame | None:
    """One batch of a table, or None if it was not written whole."""
    path = f"{root}/{table}/batch={batch_id}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done) else None


def store_decisions(records: DataFrame, root: str, batch_id: int, audit_all: bool = True, chains: int = 1,
                    source: str = "") -> None:
    """One batch of decisions into every table: decisions, the audit chain going on from its stored
    tail, a case per hold, and what waits for the second look. `source` tells writers apart that share
    the tables: each has its own batch folders and its own chains."""
    spark = records.sparkSession
    batch = f"{source}{batch_id}"
    write_batch(scored_rows(records), root, "decisions", batch, "event_time", ["event_time", "transaction_id"])
    audited = records if audit_all else records.filter(F.col("decision") == "REVIEW")
    log, ends = "audit" + source, "audit_tails" + source
    tails = newest_before(spark, root, ends, batch_id)
    if tails is None and batch_id and (before := read_table(spark, root, log)) is not None:
        # A log from before tails were kept. The batch's own earlier try is not part of the chain it goes on from.
        tails = chain_ends(before.filter(F.col("batch") < batch_id))
    write_batch(append_chain(audit_core(audited), ["event_time", "transaction_id"], chains, tails), root, log, batch_id)
    grown = chain_ends(spark.read.parquet(f"{root}/{log}/batch={batch_id}"))
    write_batch(chain_ends(grown if tails is None else tails.unionByName(grown)), root, ends, batch_id)
    forget_before(spark, root, ends, batch_id)
    write_batch(open_cases(records), root, "cases", batch)
    write_batch(records.filter(F.col("decision") == "SECOND_LOOK"), root, "second_look", batch)


def newest_before(spark: SparkSession, root: str, table: str, batch_id: int) -> DataFrame | None:
    """The newest batch of a table before this one: its folder alone is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    newest = max((n for n in done if n < batch_id), default=None)
    return None if newest is None else spark.read.parquet(f"{root}/{table}/batch={newest}")


def forget_before(spark: SparkSession, root: str, table: str, batch_id: int, keep: int = 2) -> None:
    """Delete a table's batches but the `keep` newest up to this one, which later batches go on from."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {int(f.getPath().getName().split("=")[1]): f.getPath() for f in fs.listStatus(path)}
    for n in sorted(n for n in found if n <= batch_id)[:-keep]:
        fs.delete(found[n], True)


# The columns of a retrain run, in order.
RUN_COLUMNS = {"run_at": "timestamp", "outcome": "string", "logged": "bigint", "known_fraud": "bigint",
               "settling": "bigint", "deciding_fraud": "bigint", "served_alerts": "bigint",
               "served_caught": "bigint", "served_f1": "double", "new_alerts": "bigint",
               "new_caught": "bigint", "new_f1": "double", "moved": "array<string>", "error": "string"}


#: Where a status holds what a column shows; all others are found under their own name.
_INSIDE = {f"{short}_{figure}": (model, figure) for short, model in (("served", "served"), ("new", "retrained"))
           for figure in ("alerts", "caught", "f1")}
_BLANK = {"bigint": 0, "double": 0.0, "string": "", "array<string>": []}


def run_rows(spark: SparkSession, runs: list[tuple[dict, datetime]]) -> DataFrame:
    """The table rows for the statuses of retrain runs and the moments they were started. Columns that a run never came to show a blank
    of their type. There is one status a run, so they are few."""
    def value(status: dict, column: str, kind: str):
        found = status
        for step in _INSIDE.get(column, (column,)):
            found = (found or {}).get(step)
        return (float(found) if kind == "double" else found) if found is not None else _BLANK[kind]
    rows = [[at if kind == "timestamp" else value(status, column, kind) for column, kind in RUN_COLUMNS.items()] for status, at in runs]
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in RUN_COLUMNS.items()))


def run_row(spark: SparkSession, status: dict, at: datetime) -> DataFrame:
    """The table row of one run."""
    return run_rows(spark, [(status, at)])
