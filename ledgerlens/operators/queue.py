"""What an analyst's screen asks of decisions and cases: filters, the queue, verdict and hold figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..functions import scalars
from .decision import by_second_look, held_by
from .quantiles import exact_quantiles

FILTER_KEYS = ("sender", "receiver", "min", "max", "since", "until", "decision", "type", "held")


def passes(flt: dict, at: str, cut: float | None = None) -> Column:
    """A filter's fields as one predicate, so that it reaches the scan. `at` names the time in epoch
    seconds. A decision filter of SECOND_LOOK also finds what the second look has decided."""
    unknown = set(flt) - set(FILTER_KEYS)
    if unknown:
        raise KeyError(f"unknown filter fields {sorted(unknown)}")
    ok = F.lit(True)
    if "sender" in flt:
        ok &= scalars.card_matches(F.col("sender_card"), flt["sender"])
    if "receiver" in flt:
        ok &= scalars.card_matches(F.col("receiver_card"), flt["receiver"])
    amount = F.coalesce(F.col("amount_uzs"), F.lit(0))
    for key, test in (("min", lambda v: amount >= v), ("max", lambda v: amount <= v),
                      ("since", lambda v: F.coalesce(F.col(at) >= v, F.lit(False))),
                      ("until", lambda v: F.coalesce(F.col(at) <= v, F.lit(False)))):
        if key in flt:
            ok &= test(flt[key])
    if "decision" in flt:
        match = F.col("decision") == flt["decision"]
        if flt["decision"] == "SECOND_LOOK":
            match |= by_second_look(F.col("model_version"))
        ok &= match
    if "type" in flt:
        kind = F.coalesce(F.nullif(F.col("predicted_type"), F.lit("")), F.lit("NONE"))
        ok &= kind == flt["type"]
    if "held" in flt:
        ok &= F.array_contains(held_by(2.0 if cut is None else cut), flt["held"])
    return ok


def open_queue(cases: DataFrame, limit: int | None = 20, since=None) -> DataFrame:
    """Holds without a verdict: the largest amount first, then score, then the oldest."""
    rows = cases.filter(F.col("disposition") == "NEW")
    if since is not None:
        rows = rows.filter(F.col("opened_at") >= since)
    rows = rows.orderBy(F.desc("amount_uzs"), F.desc("final_score"), F.asc("opened_at"), F.asc("case_id"))
    return rows if limit is None else rows.limit(limit)


def resolved_since(cases: DataFrame, since, limit: int = 20) -> DataFrame:
    """Verdicts from a moment on, the latest first."""
    return (cases.filter((F.col("disposition") != "NEW") & (F.col("resolved_at") >= since))
            .orderBy(F.desc("resolved_at"), F.asc("case_id")).limit(limit))


def latest_decisions(decisions: DataFrame, flt: dict, limit: int, at: str = "scored_at_job") -> DataFrame:
    """The newest decisions that pass a filter, each with the number that pass."""
    rows = decisions.filter(passes(flt, at))
    total = rows.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return rows.orderBy(F.desc(at), F.asc("transaction_id")).limit(limit).withColumn("passing", total)


def reason_text() -> Column:
    """One line on why a case is held: its rules, else the model's first reason, else what is missing."""
    text = (F.when(F.size("rule_hits") > 0, F.array_join("rule_hits", ", "))
            .when(F.size("explanation") > 0, F.concat(F.lit("model: "), F.get("explanation", F.lit(0))))
            .otherwise(F.concat(F.lit("(unexplained: "),
                                F.coalesce(F.nullif(F.col("explanation_status"), F.lit("")), F.lit("none")),
                                F.lit(")"))))
    return F.when(by_second_look(F.col("model_version")),
                  F.concat(F.lit("held by the second look; "), text)).otherwise(text)


def verdict_stats(cases: DataFrame) -> DataFrame:
    """Counts per verdict over holds and the precision of the resolved ones; what clients reported
    beside them; how many holds are explained; when the last was opened."""
    held = F.col("decision") == "REVIEW"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    of = lambda d: count(held & (F.col("disposition") == d))
    return cases.agg(
        of("NEW").alias("waiting"), of("CONFIRMED_FRAUD").alias("blocked"),
        of("FALSE_POSITIVE").alias("released"),
        count(held & (F.col("disposition") != "NEW")).alias("resolved"),
        count(~held & (F.col("disposition") == "CONFIRMED_FRAUD")).alias("reported"),
        count(held & (F.col("explanation_status") == "OK")).alias("explained"),
        F.max(F.when(held, F.col("opened_at"))).alias("last_opened"),
    ).withColumn("precision", F.col("blocked") / F.nullif(F.col("resolved"), F.lit(0)))


def explanation_coverage(cases: DataFrame) -> DataFrame:
    return (cases.filter(F.col("decision") == "REVIEW")
            .groupBy(F.when(F.col("explanation_status") == "", "(none)")
                     .otherwise(F.col("explanation_status")).alias("status"))
            .agg(F.count(F.lit(1)).alias("n")))


def hold_summary(cases: DataFrame, now_us: int) -> DataFrame:
    """Per disposition, all of them present: number, money, median and longest wait in seconds."""
    held = cases.filter((F.col("decision") == "REVIEW") & (F.unix_micros("opened_at") > 0))
    end = F.when(F.col("disposition") == "NEW", F.lit(now_us)).otherwise(F.unix_micros("resolved_at"))
    waits = held.select("disposition", "amount_uzs",
                        F.greatest(F.lit(0), end - F.unix_micros("opened_at")).alias("wait"))
    sums = waits.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_uzs").alias("amount"),
                                            (F.max("wait") / 1e6).alias("max_s"))
    medians = exact_quantiles(waits, ["disposition"], "wait", {"m": 0.5}).select(
        "disposition", (F.col("m") / 1e6).alias("median_s"))
    # One row per disposition on every side.
    all_of_them = cases.sparkSession.createDataFrame([(d,) for d in S.DISPOSITIONS], "disposition string")
    return (all_of_them.join(sums, "disposition", "left").join(medians, "disposition", "left")
            .withColumns({"n": F.coalesce("n", F.lit(0)), "amount": F.coalesce("amount", F.lit(0))}))
