"""Models over time: what each would have caught with the labels it could have had, and what a test payment would have hidden."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .. import settings as S
from ..operators import lookups
from ..operators.quantiles import running_within, with_position
from ..operators.timeline import Sum
from ..sources.files import stored

#: Fits on rows with a label and gives what adds `score` to others.
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]
MODELS = ("static", "retrained", "all labels")


def evidence(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Weights of evidence of the rules: how much likelier a hit is in a fraud than elsewhere, one more of each counted; a score adds
    up the logarithms of what hit. One row a rule reaches the driver."""
    fraud = F.col("label") == 1
    whole = rows.agg(F.count_if(fraud).alias("f"), F.count_if(~fraud).alias("g")).first()
    hits = rows.select("label", F.explode("rule_hits").alias("rule")).groupBy("rule").agg(
        F.count_if(fraud).alias("f"), F.count_if(~fraud).alias("g")).collect()
    seen = {r["rule"]: (r["f"], r["g"]) for r in hits}
    weight = {rule: F.log(F.lit((f + 1) / (whole["f"] + 2)) / F.lit((g + 1) / (whole["g"] + 2)))
              for rule, (f, g) in ((r, seen.get(r, (0, 0))) for r in S.RULE_WEIGHTS)}

    def score(df: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        for rule, w in weight.items():
            total = total + F.when(F.array_contains("rule_hits", rule), w).otherwise(0.0)
        return df.withColumn("score", F.round(total, 9))
    return score


def rolling(decided: DataFrame, fit: Fit = evidence, history: int = 2, parts: int = 5, held_delay_s: int = S.CONFIRMATION_DELAY,
            report_delay_s: int = S.REPORT_DELAY) -> DataFrame:
    """step, model, rows, fraud, alerts and caught for each part of the time after the first `history` of `parts` equal parts.

    The static model learned from the history, whose frauds are all known. The retrained one learns at each step's beginning from
    all rows before, with the frauds known by then: held ones after the verdict's delay, half of the missed ones after the report's.
    The third knows every label. All are read at as many alerts as the job itself raised in the step, ties in order of time. `decided`
    has label, decision, rule_hits, event_us, transaction_id and what `fit` and its scorer read.
    """
    known = stored(lookups.known_labels(decided, held_delay_s, report_delay_s))
    whole = known.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    order = [F.col("event_us"), F.col("transaction_id")]
    placed = with_position(known, order, kept=True).withColumn("_n", whole)
    # Part i begins at the whole part of n * i / parts.
    part = sum((F.when(F.col("position") >= F.floor(F.col("_n") * i / parts), 1).otherwise(0) for i in range(1, parts)), F.lit(0))
    rows = stored(placed.withColumn("step", part.cast("int")).drop("_n", "position"))
    begins = {r["step"]: r["at"] for r in rows.groupBy("step").agg(F.min("event_us").alias("at")).collect()}  # one row a part
    past = rows.filter(F.col("step") < history)
    static, scored = fit(past), []
    for at in range(history, parts):
        now, before = rows.filter(F.col("step") == at), rows.filter(F.col("step") < at)
        by_then = (F.col("label") == 1) & ((F.col("step") < history) | (F.col("known_us") <= begins.get(at, 0)))
        models = (static, fit(before.withColumn("label", F.coalesce(by_then, F.lit(False)).cast("int"))), fit(before))
        scored += [model(now).withColumn("model", F.lit(name)) for name, model in zip(MODELS, models)]
    both = scored[0]
    for s in scored[1:]:
        both = both.unionByName(s)
    both = both.select("step", "model", "label", "decision", "event_us", "transaction_id", (-F.col("score")).alias("falling"))
    ranked = running_within(both, ["step", "model"], ["falling", "event_us", "transaction_id"], {"place": Sum(F.lit(1).cast("bigint"))})
    alerts = both.groupBy("step", "model").agg(F.count_if(F.col("decision") == "REVIEW").alias("alerts"))
    return (ranked.join(alerts, ["step", "model"]).groupBy("step", "model", "alerts")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("label").cast("bigint")).alias("fraud"),
                 F.sum(F.when(F.col("place") <= F.col("alerts"), F.col("label")).otherwise(0).cast("bigint")).alias("caught")))


def with_test_payment(transfers: DataFrame, chosen: DataFrame, decide: Callable[[DataFrame], DataFrame], before_s: int = 60,
                      amount: float = 1000.0) -> DataFrame:
    """Each chosen transfer's decision as it was and as it would have been, had its sender made a small payment to the same payee first:
    transaction_id, score_before, decision_before, score_after, decision_after and hidden (held before and not after). `decide` takes
    transfers and gives transaction_id, final_score and decision. All payments are put in at once, so two chosen transfers of one
    sender see both."""
    # Read on both sides and by the probe; the choice may have cost an order over all transfers.
    ids = stored(chosen.select("transaction_id").distinct())
    names = lambda when: [F.col("final_score").alias(f"score_{when}"), F.col("decision").alias(f"decision_{when}")]
    was = decide(transfers).join(ids, "transaction_id", "left_semi").select("transaction_id", *names("before"))
    probed = decide(lookups.test_transfer_probe(transfers, ids, before_s, amount))
    would = probed.join(ids, "transaction_id", "left_semi").select("transaction_id", *names("after"))
    hidden = (F.col("decision_before") == "REVIEW") & (F.col("decision_after") != "REVIEW")
    return was.join(would, "transaction_id").withColumn("hidden", hidden)
