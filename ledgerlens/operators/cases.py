"""Held transfers as cases: opened once, re-written by verdicts, the highest version counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..functions import scalars
from .decision import final_decisions, latest

# A case's columns, in order.
CASE_COLUMNS = ["case_id", "transaction_id", "event_time", "opened_at", "sender_card", "receiver_card",
                "amount_uzs", "final_score", "decision", "predicted_type", "rule_hits", "disposition",
                "resolved_by", "resolved_at", "version", "explanation", "explanation_status",
                "model_version", "ml_score"]
#: Their types.
CASE_ROWS = ("case_id string, transaction_id string, event_time timestamp, opened_at timestamp, sender_card string, receiver_card string, "
             "amount_uzs bigint, final_score double, decision string, predicted_type string, rule_hits array<string>, disposition string, "
             "resolved_by string, resolved_at timestamp, version bigint, explanation array<string>, explanation_status string, "
             "model_version string, ml_score double")
#: What the intervals of confirmed accounts read of a case version.
CASE_VERSIONS = "case_id string, receiver_card string, version bigint, resolved_at timestamp, disposition string"
TERMINAL = [d for d in S.DISPOSITIONS if d != "NEW"]


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _epoch() -> Column:
    return F.timestamp_micros(F.lit(0))


def open_cases(records: DataFrame) -> DataFrame:
    """A first case version for each REVIEW record. Its id is the transfer's, so a repeated record repeats the case; with reasons it
    has version 1, without them 0."""
    empty = F.array().cast("array<string>")
    reasons = F.coalesce("explanation", empty) if "explanation" in records.columns else empty
    status = _text("explanation_status") if "explanation_status" in records.columns else F.lit("")
    return records.filter(F.col("decision") == "REVIEW").select(
        _text("transaction_id").alias("case_id"), _text("transaction_id").alias("transaction_id"),
        F.coalesce("event_time", _epoch()).alias("event_time"),
        scalars.stamp_or_epoch(F.col("scored_at_job")).alias("opened_at"),
        _text("sender_card").alias("sender_card"), _text("receiver_card").alias("receiver_card"),
        scalars.whole_or_zero(F.col("amount_uzs")).alias("amount_uzs"),
        F.coalesce("final_score", F.lit(0.0)).alias("final_score"), "decision",
        _text("predicted_type").alias("predicted_type"), F.coalesce("rule_hits", empty).alias("rule_hits"),
        F.lit("NEW").alias("disposition"), F.lit("").alias("resolved_by"), _epoch().alias("resolved_at"),
        F.when(F.size(reasons) > 0, 1).otherwise(0).cast("bigint").alias("version"),
        reasons.alias("explanation"), status.alias("explanation_status"),
        _text("model_version").alias("model_version"), F.col("ml_score").cast("double").alias("ml_score"))


def latest_cases(versions: DataFrame) -> DataFrame:
    """The highest version per case."""
    return latest(versions, ["case_id"], [F.desc("version"), F.desc("resolved_at"), F.desc("explanation_status")]).select(*CASE_COLUMNS)


def _resolved_rows(cases: DataFrame, disposition: Column, by: Column, at: Column) -> DataFrame:
    return cases.withColumns({
        "disposition": disposition, "resolved_by": by,
        "resolved_at": F.timestamp_micros(F.round(at * 1e6).cast("bigint")),
        "version": F.floor(at * 1000).cast("bigint")}).select(*CASE_COLUMNS)


def verdict_problem() -> Column:
    """Why a verdict cannot stand, or null."""
    return (F.when(~F.coalesce(F.col("verdict"), F.lit("")).isin(*TERMINAL), "not a terminal disposition")
            .when(_text("by") == "", "nobody named"))


def resolve(versions: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts (case_id, verdict, by, at in epoch seconds) as new versions of their cases, and
    those that cannot stand with a reason: no terminal disposition, nobody named, no such case."""
    current = latest_cases(versions)
    judged = verdicts.withColumn("reason", verdict_problem())
    joined = judged.filter(F.col("reason").isNull()).drop("reason").join(
        current.withColumnRenamed("case_id", "_id"), F.col("case_id") == F.col("_id"), "left")
    rows = _resolved_rows(joined.filter(F.col("_id").isNotNull()).drop("_id"),
                          F.col("verdict"), F.col("by"), F.col("at"))
    unknown = joined.filter(F.col("_id").isNull()).select(*verdicts.columns, F.lit("no such case").alias("reason"))
    return rows, judged.filter(F.col("reason").isNotNull()).unionByName(unknown)


def report(versions: DataFrame, records: DataFrame, reports: DataFrame) -> DataFrame:
    """Case versions that follow from what clients report (transaction_id, by, at): a verdict of fraud on the transfer's case, or,
    where it was never held, on a new case that shows the decision as it was."""
    current = latest_cases(versions)
    named = reports.filter(_text("by") != "")
    fraud = F.lit("CONFIRMED_FRAUD")
    known = named.withColumnRenamed("transaction_id", "_t").join(current, F.col("_t") == F.col("case_id"))
    confirmed = _resolved_rows(known, fraud, F.col("by"), F.col("at"))
    fresh = named.join(current.select(F.col("case_id").alias("transaction_id")), "transaction_id", "left_anti")
    wanted = records.join(fresh.select("transaction_id"), "transaction_id", "left_semi")
    let_go = final_decisions(wanted).join(fresh, "transaction_id")
    empty = F.array().cast("array<string>")
    opened = let_go.withColumns({
        "case_id": F.col("transaction_id"), "opened_at": F.timestamp_micros(F.round(F.col("at") * 1e6).cast("bigint")),
        "amount_uzs": scalars.whole_or_zero(F.col("amount_uzs")), "rule_hits": empty, "explanation": empty,
        "explanation_status": F.lit(""), "predicted_type": _text("predicted_type"),
        "ml_score": F.col("ml_score").cast("double")})
    return confirmed.unionByName(_resolved_rows(opened, fraud, F.col("by"), F.col("at")))


def confirmed_now(versions: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The confirmed accounts: payees of cases whose latest verdict is fraud, and the history's. A
    release takes an account out only when neither still names it."""
    accounts = (latest_cases(versions).filter(F.col("disposition") == "CONFIRMED_FRAUD")
                .select(F.col("receiver_card").alias("account")))
    if history is not None:
        accounts = accounts.unionByName(history.select("account"))
    return accounts.filter(F.col("account") != "").distinct()


def confirmed_intervals(versions: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """When each account was confirmed, as disjoint half-open intervals, for as-of use.

    A case confirms from a fraud verdict until its next other verdict; the history from the start.
    The union of a payee's intervals is where the running count of open ones is above zero.
    """
    from .quantiles import running_within
    from .timeline import Next, Sum
    us = F.unix_micros("resolved_at")
    v = versions.filter(F.col("disposition") != "NEW").select(
        "case_id", F.col("receiver_card").alias("account"), "version", us.alias("us"), "disposition").distinct()
    v = running_within(v, ["case_id"], ["version"], {"until": Next(F.col("us"))})
    spans = v.filter((F.col("disposition") == "CONFIRMED_FRAUD") & (F.col("account") != "")).select(
        "account", F.col("us").alias("a"), F.col("until").alias("b"))
    if history is not None:
        spans = spans.unionByName(history.select("account", F.lit(0).cast("bigint").alias("a"),
                                                 F.lit(None).cast("bigint").alias("b")))
    steps = (spans.select("account", F.expr("inline(filter(array(struct(a us, 1 step), struct(b us, -1 step)), "
                                            "x -> x.us is not null))"))
             .groupBy("account", "us").agg(F.sum("step").alias("step")).filter("step <> 0"))
    steps = running_within(steps, ["account"], ["us"], {"held": Sum(F.col("step"))})
    edges = steps.filter("(held > 0) <> (held - step > 0)")
    edges = running_within(edges, ["account"], ["us"], {"to_us": Next(F.col("us"))})
    return edges.filter("held > 0").select("account", F.col("us").alias("from_us"), "to_us")
