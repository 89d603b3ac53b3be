"""Card lookups, label joins and episodes around a fraud."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import settings as S
from ..functions.scalars import spread
from .metrics import time_split
from .quantiles import running_within
from .timeline import Sum

EPISODE_US = 6 * 3600 * S.SECOND_US
HISTORY_ROWS = 8
UNKNOWN_BANK = {"code": "00000", "name": "UNKNOWN"}


def issuing_bank(rows: DataFrame, banks: DataFrame, card: str) -> DataFrame:
    """`rows` with the bank named by the card's first six digits. The registry has one row per BIN,
    a million at most; the optimizer broadcasts it when it is as small as it looks."""
    named = banks.select(F.col("bin").alias("_bin"), *[F.col(c).alias(f"bank_{c}") for c in UNKNOWN_BANK])
    return (rows.join(named, F.substring(card, 1, 6) == F.col("_bin"), "left").drop("_bin")
            .withColumns({f"bank_{c}": F.coalesce(f"bank_{c}", F.lit(v)) for c, v in UNKNOWN_BANK.items()}))


def labelled_by_verdicts(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """Decisions with what people called them: 1 for a confirmed fraud."""
    fraud = (cases.filter(F.col("disposition") == "CONFIRMED_FRAUD").select("transaction_id").distinct()
             .withColumn("label", F.lit(1)))
    return decisions.join(fraud, "transaction_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def without_replays(decisions: DataFrame, held_out: DataFrame) -> DataFrame:
    """Decisions that are no replay: neither marked as one nor of the held-out days."""
    return (decisions.filter(~F.col("transaction_id").startswith(S.REPLAY_PREFIX))
            .join(held_out.select("transaction_id"), "transaction_id", "left_anti"))


def held_out_ids(transfers: DataFrame) -> DataFrame:
    return time_split(transfers).filter("part = 'test'").select("transaction_id")


def picks(transfers: DataFrame) -> DataFrame:
    """The first held-out fraud of each kind: one row per kind."""
    test = time_split(transfers).filter("part = 'test' and label = 1")
    order = F.struct("event_us", "transaction_id")
    cols = F.struct("transaction_id", "event_us", "sender_key", "payee_key")
    return test.groupBy("label_type").agg(F.min_by(cols, order).alias("p")).select("label_type", "p.*")


def episodes(transfers: DataFrame, chosen: DataFrame) -> DataFrame:
    """Frauds of the same kind within six hours of each chosen one. For MULE: those through the
    account that recurs, whichever side it is on; for the others: the same sender's."""
    p = chosen.select(F.col("label_type").alias("kind"), F.col("event_us").alias("pick_us"),
                      F.col("sender_key").alias("pick_sender"), F.col("payee_key").alias("pick_payee"),
                      F.col("transaction_id").alias("pick_id"))
    frauds = transfers.filter("label = 1")
    near = frauds.join(p, (F.col("label_type") == F.col("kind"))
                       & (F.abs(F.col("event_us") - F.col("pick_us")) <= EPISODE_US))
    recurs = near.filter("payee_key = pick_payee").groupBy("pick_id").agg(F.count(F.lit(1)).alias("times"))
    hub = near.join(recurs, "pick_id", "left").withColumn(
        "hub", F.expr("if(times > 1, pick_payee, pick_sender)"))
    keep = F.when(F.col("kind") == "MULE", (F.col("sender_key") == F.col("hub")) | (F.col("payee_key") == F.col("hub"))) \
        .otherwise(F.col("sender_key") == F.col("pick_sender"))
    return hub.filter(keep).drop("times", "hub")


def sender_history(transfers: DataFrame, chosen: DataFrame, n: int = HISTORY_ROWS) -> DataFrame:
    """Each chosen transfer's last `n` earlier ones of the same sender, by place in its timeline:
    an equi-join on the place, no pairs of a sender's rows."""
    order = ["event_us", "transaction_id"]
    placed = running_within(transfers.select("sender_key", *order, "payee_key", "amount"), ["sender_key"], order,
                            {"place": Sum(F.lit(1).cast("bigint"), before=True)})
    wanted = (placed.join(chosen.select(F.col("transaction_id").alias("pick_id")),
                          F.col("transaction_id") == F.col("pick_id"))
              .select("pick_id", "sender_key", F.col("place").alias("_p"),
                      F.explode(F.sequence(F.lit(1), F.lit(n))).alias("back"))
              .select("pick_id", "sender_key", (F.col("_p") - F.col("back")).alias("place"), "back")
              .filter("place >= 0"))
    return placed.join(wanted, ["sender_key", "place"]).drop("place")


def test_transfer_probe(transfers: DataFrame, chosen: DataFrame, before_s: int = 60,
                        amount: float = 1000.0) -> DataFrame:
    """`transfers` with a small one to the same payee put before each chosen transfer: does a test
    payment hide a fraud? Rescore and compare."""
    probe = (transfers.join(chosen.select("transaction_id"), "transaction_id", "left_semi").withColumns({
        "transaction_id": F.concat(F.col("transaction_id"), F.lit("-probe")),
        "event_us": F.col("event_us") - before_s * S.SECOND_US,
        "amount": F.lit(amount), "amount_tiyin": F.lit(int(amount * 100)).cast("bigint"),
        "label": F.lit(0), "label_type": F.lit("NONE")}).select(*transfers.columns))
    return transfers.unionByName(probe)


def known_labels(decided: DataFrame, held_delay_s: int = S.CONFIRMATION_DELAY,
                 report_delay_s: int = S.REPORT_DELAY, reported_share: float = 0.5) -> DataFrame:
    """When each fraud becomes known: a held one after the verdict's delay, a share of the missed
    ones after the report's delay, the others never."""
    reported = spread(F.col("transaction_id"), 1000) < int(reported_share * 1000)
    known = (F.when((F.col("label") == 1) & (F.col("decision") == "REVIEW"),
                    F.col("event_us") + held_delay_s * S.SECOND_US)
             .when((F.col("label") == 1) & reported, F.col("event_us") + report_delay_s * S.SECOND_US))
    return decided.withColumn("known_us", known)
