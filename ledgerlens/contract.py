"""The transfer contract: what every plan expects a transfer to look like, and how raw rows get there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .functions import scalars
from .profile import FULL, Profile

# The raw fields a switch sends, in order.
WIRE = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("sender_pinfl", T.StringType()),
    T.StructField("sender_card", T.StringType()),
    T.StructField("sender_network", T.StringType()),
    T.StructField("receiver_card", T.StringType()),
    T.StructField("receiver_network", T.StringType()),
    T.StructField("amount_uzs", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("sender_region", T.StringType()),
    T.StructField("sender_balance_before", T.StringType()),
    T.StructField("active_call", T.StringType()),
    T.StructField("secs_login_to_confirm", T.StringType()),
])
WIRE_FIELDS = WIRE.fieldNames()
# On top of the raw fields: the arrival stamp, its hash, and the payee's identity in offline files.
EVENT = T.StructType(WIRE.fields + [
    T.StructField("receiver_pinfl", T.StringType()),
    T.StructField("ingested_at", T.StringType()),
    T.StructField("ingress_hash", T.StringType()),
])
LABELLED = T.StructType(EVENT.fields + [
    T.StructField("label_is_fraud", T.IntegerType()),
    T.StructField("label_fraud_type", T.StringType()),
])

KEYS = ["sender_key", "payer_id", "payee_key"]


def event_us(event_time: Column) -> Column:
    """Microseconds of a textual event time read in the session's zone (UTC); now when unreadable."""
    at = F.coalesce(F.try_to_timestamp(event_time), F.current_timestamp())
    return F.unix_micros(at)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def with_keys(rows: DataFrame, profile: Profile = FULL) -> DataFrame:
    """The accounts a transfer touches. By identity where the profile has it, else by card; a
    person whose identity is missing falls back to the card."""
    def account(person: str, card: str) -> Column:
        if profile.mode("payee_identity") == "pinfl":
            return F.when(_text(F.col(person)) != "", _text(F.col(person))).otherwise(_text(F.col(card)))
        return _text(F.col(card))

    return rows.withColumns({
        "sender_key": account("sender_id", "sender_card"),
        "payee_key": account("receiver_id", "receiver_card"),
        "payer_id": _text(F.col("sender_id")),
    })


def to_transfers(events: DataFrame, profile: Profile = FULL) -> DataFrame:
    """Usable wire events as transfers: typed, stamped, keyed. Other columns but `arrived` are left behind."""
    optional = {"receiver_pinfl": "string", "ingested_at": "double", "ingress_hash": "string",
                "label_is_fraud": "int", "label_fraud_type": "string"}
    get = lambda c: (F.col(c) if c in events.columns else F.lit(None)).cast(optional[c])
    amount = F.col("amount_uzs").try_cast("double")
    rows = events.select(
        "transaction_id",
        event_us(F.col("event_time").cast("string")).alias("event_us"),
        F.col("sender_pinfl").alias("sender_id"), "sender_card",
        get("receiver_pinfl").alias("receiver_id"), "receiver_card",
        amount.alias("amount"), scalars.tiyin(amount).alias("amount_tiyin"),
        "sender_region",
        scalars.truthy(F.col("active_call")).alias("active_call"),
        scalars.number_or(F.col("secs_login_to_confirm"), 0.0).alias("secs_login"),
        get("ingested_at").alias("ingested_at"), get("ingress_hash").alias("ingress_hash"),
        get("label_is_fraud").alias("label"), get("label_fraud_type").alias("label_type"),
        *[c for c in ("arrived",) if c in events.columns])
    return with_keys(rows, profile)
