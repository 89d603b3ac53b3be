"""Confirmed fraud accounts over time, and which of them an account dealt with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import settings as S
from .timeline import Next, running

US = S.SECOND_US


def confirmed_from_labels(transfers: DataFrame, delay_s: int = S.CONFIRMATION_DELAY) -> DataFrame:
    """Each fraud's payee is confirmed a delay after its first fraud and stays so."""
    return (transfers.filter((F.col("label") == 1) & (F.col("payee_key") != ""))
            .groupBy(F.col("payee_key").alias("account"))
            .agg((F.min("event_us") + delay_s * US).alias("from_us"))
            .withColumn("to_us", F.lit(None).cast("bigint")))


def known_by(confirmed: DataFrame, at_us) -> DataFrame:
    """The accounts confirmed at one moment: what a new deployment is seeded with."""
    return confirmed.filter((F.col("from_us") <= at_us)
                            & (F.col("to_us").isNull() | (F.col("to_us") > at_us))).select("account").distinct()


def contact_pieces(transfers: DataFrame, confirmed: DataFrame, heavy: bool = True) -> DataFrame:
    """Stretches of an account's timeline during which one of its recent counterparties counts as confirmed.

    A transfer makes either party the other's contact for seven days, or up to their next transfer. That time, cut to the
    contact's confirmed intervals, is one stretch. Pairs are ordered only for contacts that are confirmed at some time. With
    `heavy` False the caller vouches that no account, and so no pair, outgrows a task.
    """
    week = S.WEEK * US
    edges = (transfers.filter("payee_key <> '' and sender_key <> ''").select(
        "event_us", "transaction_id",
        F.expr("inline(array_distinct(array(struct(payee_key account, sender_key other), "
               "struct(sender_key account, payee_key other))))")))
    stretch = confirmed.select(F.col("account").alias("other"), "from_us", "to_us")
    edges = edges.join(stretch.select("other").distinct(), "other", "left_semi")
    pair, order = ["account", "other"], ["event_us", "transaction_id"]
    edges = running(edges, pair, order,
                    {"again": Next(F.struct("event_us", "transaction_id"))},
                    None if heavy else 0)
    meets = f"again.event_us <= event_us + {week}"
    lasts = edges.selectExpr(
        "account", "other", "event_us a_at", "transaction_id a_id",
        f"if({meets}, again.event_us, event_us + {week + 1}) b_at", f"if({meets}, 1, 0) b_rank",
        f"if({meets}, again.transaction_id, '') b_id")
    later, sooner = "from_us > a_at", "to_us <= b_at"
    return lasts.join(stretch, "other").selectExpr(
        "account", "other",
        f"if({later}, from_us, a_at) from_at", f"if({later}, 0, 1) from_rank",
        f"if({later}, '', a_id) from_id",
        f"if({sooner}, to_us, b_at) to_at", f"if({sooner}, 0, b_rank) to_rank",
        f"if({sooner}, '', b_id) to_id")
