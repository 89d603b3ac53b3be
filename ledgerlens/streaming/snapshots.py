"""What is known of accounts before a moment, so that a micro-batch need not read all history.

Windows reach back a week. Older transfers count only through what they add up to: a sender's moments,
its last transfer and place, its regions, and when a pair last met. A snapshot holds that as of a moment;
a batch reads the newest one a week or more before its first transfer, and the transfers since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import settings as S
from ..operators.features import Prior
from ..sources.sinks import read_table

WEEK_US = S.WEEK * S.SECOND_US
TABLES = ("senders", "regions", "pairs", "payers")
PLACE = "struct(event_us us, transaction_id id, sender_region region)"


def summarise(rows: DataFrame) -> Prior:
    """The summary of transfers; each part is one aggregate, combined before its shuffle."""
    amount, secs = F.col("amount"), F.log1p("secs_login")
    moments = lambda v, name: [F.count(v).alias(f"{name}_n"), F.sum(v).alias(f"{name}_sum"),
                               (F.var_pop(v) * F.count(v)).alias(f"{name}_m2"),
                               F.min(v).alias(f"{name}_low"), F.max(v).alias(f"{name}_high")]
    senders = rows.groupBy(F.col("sender_key").alias("account")).agg(
        *moments(amount, "hist"), *moments(secs, "login"), F.max("event_us").alias("last_sent"),
        F.max(F.expr(f"if(sender_region <> '', {PLACE}, null)")).alias("last_place"))
    regions = rows.groupBy("sender_key", F.expr("coalesce(sender_region, '')").alias("region_here")).agg(
        F.count(F.lit(1)).alias("region_count"), F.min(F.struct("event_us", "transaction_id")).alias("region_first"))
    last = F.max("event_us").alias("last")
    return Prior(senders, regions, rows.groupBy("payee_key", "sender_key").agg(last),
                 rows.groupBy("payee_key", "payer_id").agg(last))


def merge(old: Prior, new: Prior) -> Prior:
    """Two summaries of disjoint spans as one; `new` is the later."""
    def moments(name):
        n1, n2, s1, s2 = F.col(f"o.{name}_n"), F.col(f"n.{name}_n"), F.col(f"o.{name}_sum"), F.col(f"n.{name}_sum")
        zero = lambda c: F.coalesce(c, F.lit(0))
        gap = F.coalesce(F.pow(s1 / n1 - s2 / n2, 2) * n1 * n2 / (n1 + n2), F.lit(0.0))
        return [(zero(n1) + zero(n2)).alias(f"{name}_n"),
                (F.coalesce(s1, F.lit(0.0)) + F.coalesce(s2, F.lit(0.0))).alias(f"{name}_sum"),
                (F.coalesce(F.col(f"o.{name}_m2"), F.lit(0.0)) + F.coalesce(F.col(f"n.{name}_m2"), F.lit(0.0)) + gap)
                .alias(f"{name}_m2"),
                F.least(F.col(f"o.{name}_low"), F.col(f"n.{name}_low")).alias(f"{name}_low"),
                F.greatest(F.col(f"o.{name}_high"), F.col(f"n.{name}_high")).alias(f"{name}_high")]

    later = lambda c: F.greatest(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    senders = old.senders.alias("o").join(new.senders.alias("n"), "account", "full").select(
        "account", *moments("hist"), *moments("login"), later("last_sent"), later("last_place"))
    regions = old.regions.unionByName(new.regions).groupBy("sender_key", "region_here").agg(
        F.sum("region_count").alias("region_count"), F.min("region_first").alias("region_first"))
    last = lambda a, b, *key: a.unionByName(b).groupBy(*key).agg(F.max("last").alias("last"))
    return Prior(senders, regions, last(old.pairs, new.pairs, "payee_key", "sender_key"),
                 last(old.payers, new.payers, "payee_key", "payer_id"))


def _path(root: str, until_us: int, table: str) -> str:
    return f"{root}/snapshots/until={until_us}/{table}"


def newest(spark: SparkSession, root: str, at_us: int) -> int | None:
    """The latest complete snapshot up to a moment; its last table is written last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshots")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), f"{TABLES[-1]}/_SUCCESS"))]
    return max((u for u in done if u <= at_us), default=None)


def load(spark: SparkSession, root: str, until_us: int) -> Prior:
    return Prior(*[spark.read.parquet(_path(root, until_us, t)) for t in TABLES])


def forget(known: Prior, until_us: int, silent_days: int) -> Prior:
    """Leave out senders silent that long, with their regions and pairs, and payers older than the
    month in which a payer counts as known."""
    month = F.col("last") >= until_us - S.MONTH * S.SECOND_US
    active = known.senders.filter(F.col("last_sent") >= until_us - silent_days * S.DAY * S.SECOND_US)
    senders = active.select(F.col("account").alias("sender_key"))
    return Prior(active, known.regions.join(senders, "sender_key", "left_semi"),
                 known.pairs.join(senders, "sender_key", "left_semi"), known.payers.filter(month))


def roll(spark: SparkSession, root: str, until_us: int, silent_days: int | None = None) -> None:
    """Write the snapshot as of a moment: the one before it plus the transfers since. Run daily, once
    transfers up to then have settled; one that arrives later is read only by batches that go back
    beyond this snapshot. With `silent_days` a sender that has not paid for so long is forgotten, as
    the live job does after 90 days; a replay forgets nobody."""
    history = read_table(spark, root, "transfers").filter(F.col("event_us") < until_us)
    base = newest(spark, root, until_us - 1)
    summary = summarise(history if base is None else history.filter(F.col("event_us") >= base))
    if base is not None:
        summary = merge(load(spark, root, base), summary)
    if silent_days is not None:
        summary = forget(summary, until_us, silent_days)
    for name in TABLES:
        getattr(summary, name).write.mode("overwrite").parquet(_path(root, until_us, name))


def context_of(fresh: DataFrame, history: DataFrame, root: str) -> tuple[DataFrame, Prior | None]:
    """The earlier transfers of the accounts a batch touches, and what came before those."""
    spark = fresh.sparkSession
    accounts = fresh.select(F.explode(F.array("sender_key", "payee_key")).alias("account")).distinct()
    first, last = fresh.agg(F.min("event_us"), F.max("event_us")).first()
    base = None if first is None else newest(spark, root, first - WEEK_US)
    if last is not None:
        history = history.filter(F.col("event_us") <= last)
    if base is not None:
        history = history.filter(F.col("event_us") >= base)
    by = lambda side, how: (F.col(side) == F.col("account"), how)
    mine = history.join(accounts, *by("sender_key", "left_semi"))
    paid = history.join(accounts, *by("sender_key", "left_anti")).join(accounts, *by("payee_key", "left_semi"))
    if base is None:
        return mine.unionByName(paid), None
    known = load(spark, root, base)
    touched = lambda df, key: df.join(accounts, F.col(key) == F.col("account"), "left_semi")
    senders = known.senders.join(accounts, "account", "left_semi")
    return mine.unionByName(paid), Prior(senders, touched(known.regions, "sender_key"),
                                         touched(known.pairs, "payee_key").unionByName(
                                             touched(known.pairs.join(accounts, F.col("payee_key") == F.col("account"), "left_anti"), "sender_key")),
                                         touched(known.payers, "payee_key"))
