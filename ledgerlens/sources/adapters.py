"""Other tables as transfers: public-dataset shapes and the repository's test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import settings as S
from ..contract import with_keys
from ..functions import scalars
from ..functions.geo import REGIONS
from ..operators.quantiles import exact_quantiles
from ..profile import FULL, Profile, foreign

US = S.SECOND_US
EVENTS_EPOCH = 1_704_067_200 * US        # 2024-01-01
ORDERS_EPOCH_DAY = "1995-01-01"


def _transfers(rows: DataFrame, profile: Profile, **columns: Column) -> DataFrame:
    """The contract's columns in order; what the source lacks is null, 0 or empty."""
    none = lambda t: F.lit(None).cast(t)
    defaults = {
        "transaction_id": none("string"), "event_us": none("bigint"), "sender_id": none("string"),
        "sender_card": none("string"), "receiver_id": none("string"), "receiver_card": none("string"),
        "amount": none("double"), "sender_region": none("string"), "active_call": F.lit(0),
        "secs_login": F.lit(0.0), "label": none("int"), "label_type": none("string"),
    }
    unknown = set(columns) - set(defaults) - {"currency", "fmt"}
    if unknown:
        raise KeyError(f"not in the contract: {sorted(unknown)}")
    cols = {**defaults, **columns}
    cols["amount_tiyin"] = scalars.tiyin(cols["amount"])
    return with_keys(rows.select(*[c.alias(n) for n, c in cols.items()]), profile)


def region_name(number: Column) -> Column:
    """A region by its number in the list's order."""
    return F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (number + 1).cast("int"))


def from_events(spark: SparkSession, sf_dir: str, compress: int = 60, per_value: int = 60_000,
                profile: Profile = FULL) -> DataFrame:
    """The `events` table read as transfers; time is compressed so that windows fill."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    u, i = F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    raw_us = F.unix_micros(F.col("ts").cast("timestamp"))
    at = F.lit(EVENTS_EPOCH) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {EVENTS_EPOCH}) div {compress}") \
        if compress != 1 else raw_us
    away = k % 10 == 0
    region = F.when(away, (u + F.floor(k / 10) + 1) % 14).otherwise(u % 14)
    signup = F.col("event_type") == "signup"
    secs = (20 + (i * 37) % 60) * F.when(signup & (k % 3 == 0), 5).otherwise(1)
    fraud = (k % 25 == 0) & (F.col("event_type") == "error")
    kind = F.element_at(F.array(*[F.lit(t) for t in S.SCHEME_RULES]), (F.floor(k / 25) % 4 + 1).cast("int"))
    account = lambda c: F.concat(F.lit("A"), c.cast("string"))
    return _transfers(
        e, profile, transaction_id=i.cast("string"), event_us=at,
        sender_id=account(u), sender_card=account(u), receiver_id=account(k), receiver_card=account(k),
        amount=F.col("value") * per_value, sender_region=region_name(region),
        active_call=signup.cast("int"), secs_login=secs.cast("double"),
        label=fraud.cast("int"), label_type=F.when(fraud, kind).otherwise("NONE"))


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `orders` table read as transfers: many share an instant, and currencies differ."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit(ORDERS_EPOCH_DAY).cast("date"))
    sender = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    payee = F.concat(F.lit("P"), (F.col("o_orderkey") % 40).cast("string"))
    joined = o.join(c, o.o_custkey == c.c_custkey, "left")
    return _transfers(
        joined, FULL, transaction_id=F.col("o_orderkey").cast("string"),
        event_us=days.cast("bigint") * 60 * US, sender_id=sender, sender_card=sender,
        receiver_id=payee, receiver_card=payee, amount=F.col("o_totalprice") * 20,
        currency=F.col("c_nationkey").cast("string"))


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `copy`: equal rows are counted before the shuffle and come back numbered from 1."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def _told_apart(ident: Column) -> Column:
    return F.when(F.col("copy") == 1, ident).otherwise(F.concat_ws("-", ident, F.col("copy").cast("string")))


def paysim(rows: DataFrame, transfers_only: bool = True) -> DataFrame:
    """PaySim-shaped rows: hourly steps, accounts, no cards; amounts rescaled by the median."""
    if transfers_only:
        rows = rows.filter(F.col("type") == "TRANSFER")
    scaled = rescaled(numbered(rows), rows, "amount", [])
    ident = F.concat_ws("-", F.col("step").cast("string"), F.col("nameOrig"), F.col("nameDest"),
                        F.col("amount").cast("string"))
    return _transfers(
        scaled, foreign("geo_telemetry", "session_telemetry"), transaction_id=_told_apart(ident),
        event_us=F.col("step").cast("bigint") * S.HOUR * US,
        sender_id=F.col("nameOrig"), receiver_id=F.col("nameDest"),
        amount=F.col("scaled_amount"), label=F.col("isFraud").cast("int"))


# The released bank-transfer file's header, the second `Account` renamed.
BANK_FILE = {"Timestamp": "timestamp", "Account": "sender", "Account.1": "receiver",
             "Amount Paid": "amount", "Payment Currency": "currency", "Payment Format": "fmt",
             "Is Laundering": "label"}


def bank_rows(raw: DataFrame) -> DataFrame:
    """Rows of the bank-transfer file under short names; raises when a column is missing."""
    names, seen = [], {}
    for column in raw.columns:
        name = column.strip()
        # Spark numbers repeated headers itself (Account2, Account4); other readers do not.
        base = "Account" if name.rstrip("0123456789.") == "Account" else name
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}.{seen[base] - 1}")
    rows = raw.toDF(*names)
    missing = [c for c in BANK_FILE if c not in names]
    if missing:
        raise ValueError(f"the file lacks {missing}")
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in BANK_FILE.items()]).withColumn(
        "at", F.to_timestamp("timestamp", "yyyy/MM/dd HH:mm"))


def bank_transfers(rows: DataFrame) -> DataFrame:
    """Bank-transfer rows as transfers: one scale per currency, from its median."""
    scaled = rescaled(numbered(rows), rows, "amount", ["currency"])
    ident = F.sha2(F.concat_ws("\x1f", "timestamp", "sender", "receiver", F.col("amount").cast("string"),
                               "currency", "fmt"), 256)
    return _bank(scaled, transaction_id=_told_apart(ident), amount=F.col("scaled_amount"))


def bank_parties(rows: DataFrame) -> DataFrame:
    """Every bank-transfer row as a transfer that has neither id nor rescaled amount: what `describe` reads. Equal rows need no
    numbers then, and nothing is shuffled."""
    return _bank(rows)


def _bank(rows: DataFrame, **columns: Column) -> DataFrame:
    return _transfers(
        rows, foreign("geo_telemetry", "session_telemetry"), **{"amount": F.lit(None).cast("double"), **columns},
        event_us=F.unix_micros("at"), sender_id=F.col("sender"), receiver_id=F.col("receiver"),
        label=F.col("label").cast("int"), currency=F.col("currency"), fmt=F.col("fmt"))


def scale_factors(rows: DataFrame, amount: str, by: list[str]) -> DataFrame:
    """One multiplier per group that brings its median amount to the target; 1 for a median of 0."""
    medians = exact_quantiles(rows.select(*by, F.col(amount).cast("double").alias("v")), by, "v",
                              {"median": 0.5})
    return medians.withColumn("scale", F.when(F.col("median") > 0,
                                              S.FOREIGN_TARGET_MEDIAN / F.col("median")).otherwise(1.0))


def rescaled(rows: DataFrame, plain: DataFrame, amount: str, by: list[str]) -> DataFrame:
    """`rows` with `scaled_amount`. There is one factor per group, whatever the group's size, from `plain`: the same amounts before
    anything was done to them that takes a shuffle."""
    factors = scale_factors(plain, amount, by)
    if not by:
        scale = factors.select("scale").scalar()
        return rows.withColumn("scaled_amount", F.col(amount).cast("double") * scale)
    return rows.join(factors.select(*by, "scale"), by, "left").withColumn(
        "scaled_amount", F.col(amount).cast("double") * F.col("scale"))


def describe(transfers: DataFrame) -> DataFrame:
    """One row on a dataset: size, frauds, span, accounts, currencies, payment formats, self-transfers.

    Sums are taken for each currency and format first. Distinct accounts come from one row per account, which says in which roles it
    was seen, so no task holds a set of them.
    """
    given = lambda c: F.col(c) if c in transfers.columns else F.lit(None).cast("string")
    base = transfers.withColumns({"currency": given("currency"), "fmt": given("fmt")})
    parts = base.groupBy("currency", "fmt").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("label", F.lit(0))).alias("f"),
        F.sum((F.col("sender_key") == F.col("payee_key")).cast("bigint")).alias("own"),
        F.min("event_us").alias("first"), F.max("event_us").alias("last"))
    facts = parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum("f").alias("frauds"), (F.sum("f") / F.sum("n")).alias("fraud_share"),
        F.sum("own").alias("self_transfers"), F.expr("(max(last) - min(first)) div 86400000000").alias("days"),
        F.count_distinct("currency").alias("currencies"), F.count_distinct("fmt").alias("formats"))
    seen = (base.select(F.expr("inline(array(struct(sender_key account, 1 sends, 0 is_paid), struct(payee_key account, 0 sends, 1 is_paid)))"))
            .filter(F.col("account").isNotNull()).groupBy("account").agg(F.max("sends").alias("sends"), F.max("is_paid").alias("is_paid"))
            .agg(F.struct(F.count(F.lit(1)).alias("accounts"), F.coalesce(F.sum("sends"), F.lit(0)).alias("senders"),
                          F.coalesce(F.sum("is_paid"), F.lit(0)).alias("payees")).alias("seen")))
    # Two one-row results side by side.
    return facts.withColumn("_seen", seen.scalar()).select(
        *[c for c in facts.columns if c not in ("currencies", "formats")],
        *[F.col(f"_seen.{c}").alias(c) for c in ("accounts", "senders", "payees")], "currencies", "formats")
