"""The learning loop: matrix, fit, cut-off, metrics, band, ablation, retrain decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import settings as S
from ..operators import metrics
from ..operators.confirmed import confirmed_from_labels
from ..operators.decision import latest
from ..operators.features import transfer_features
from ..operators.lookups import labelled_by_verdicts, without_replays
from ..operators.rules import with_rules
from ..profile import FULL, Profile
from ..sources.files import stored
from .model import Committee, fit_committee, score, second_look_scores


def training_matrix(transfers: DataFrame, profile: Profile = FULL,
                    confirmed: DataFrame | None = None) -> DataFrame:
    """Features, rule score and label of every transfer, as the job would have seen it. A fraud's
    payee is confirmed a day later unless `confirmed` says otherwise."""
    if confirmed is None and profile.has("confirmed_cases"):
        confirmed = confirmed_from_labels(transfers)
    rows = with_rules(transfer_features(transfers, confirmed, profile), profile)
    return rows.select("transaction_id", "event_us", *[F.col(f).cast("double") for f in profile.feature_names],
                       "cep_score", "rule_hits", F.coalesce("label", F.lit(0)).alias("label"), "label_type")


def logged_decisions(decisions: DataFrame, cases: DataFrame, held_out: DataFrame, width: int) -> DataFrame:
    """Every transfer's latest decision that has all `width` features, and the label that its case's verdict gives it; what was
    sent in again for a test is left out. Figures read all of them; `fitting_rows` bounds what a learner is fitted on."""
    whole = without_replays(decisions.filter(F.size("features") == width), held_out)
    return labelled_by_verdicts(latest(whole, ["transaction_id"], [F.desc("scored_at_job")]), cases)


def fitting_rows(logged: DataFrame, most: int = S.FITTING_ROWS, at: str = "scored_at_job") -> DataFrame:
    """The newest `most` decisions, the bound of a fit."""
    return logged.orderBy(F.desc(at), "transaction_id").limit(most)


def train(matrix: DataFrame, profile: Profile = FULL, **fit) -> tuple[Committee, float, DataFrame]:
    """(committee, F1-best cut-off of the tuning rows, scored test rows) by time."""
    rows = stored(metrics.time_split(matrix))
    model = fit_committee(rows.filter("part = 'fit'"), profile.feature_names, **fit)
    scored = stored(score(model, rows.filter("part <> 'fit'"), "score"))
    cutoff = metrics.best_f1_cutoff(scored.filter("part = 'tune'")).first()["cutoff"]
    return model, cutoff, scored.filter("part = 'test'")


def quality(test: DataFrame, cutoff: float, rule_cutoff: float = S.RULE_CUTOFF) -> dict[str, DataFrame]:
    """The test slice's figures; rules alone on the same slice."""
    return {"at_review": metrics.reading(test, F.col("score") >= cutoff),
            "cep_only": metrics.reading(test, F.col("cep_score") >= rule_cutoff),
            "ranking": metrics.ranking(test), "calibration": metrics.calibration(test, cutoff),
            "by_type": metrics.recall_by_type(test, cutoff)}


def choose_band(tune: DataFrame, fit_rows: DataFrame, review: float, features: list[str],
                size: int = S.BAND_SIZE) -> dict:
    """Where the second look's band begins, and its own cut-off just under its F1 peak."""
    band = metrics.second_look_band(tune, review, size)
    start = band.agg(F.min("score")).first()[0]
    looked = second_look_scores(fit_rows, band, features)
    own = looked.select("label", F.col("second_score").alias("score"))
    return {"from": start, "review": review,
            "cut": metrics.best_f1_cutoff(own).first()["cutoff"] - S.BAND_TIE}


def ablation(transfers: DataFrame, profiles: dict[str, Profile], **fit) -> DataFrame:
    """Each profile's model on the same split: what a data source is worth."""
    rows = []
    for name, profile in profiles.items():
        model, cutoff, test = train(training_matrix(transfers, profile), profile, **fit)
        read = metrics.reading(test, F.col("score") >= cutoff).withColumn("profile", F.lit(name))
        ap = metrics.ranking(test)
        rows.append(read.withColumn("average_precision", ap.select("average_precision").scalar()))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def retrain(history: DataFrame, logged: DataFrame, served: Committee, served_cut: float,
            features: list[str], min_rows: int = S.MIN_DRIFT_ROWS, min_fraud: int = S.MIN_FRAUD,
            delay_s: int = S.REPORT_DELAY, **fit) -> dict:
    """One retrain run's status: drift of the latest decisions against the served model's rows, then
    a fit on old and new rows, compared on decisions neither model learned from at the same number
    of alerts. Rows carry the features, label, transaction_id, event_us (the order they were decided
    in) and decided_at (epoch seconds)."""
    # Each is read several times below, so each is written once.
    parts = stored(metrics.time_split(logged))
    totals = parts.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"),
                       F.sum((F.col("part") != "fit").cast("bigint")).alias("recent")).first()
    status = {"logged": totals["n"], "known_fraud": int(totals["p"] or 0)}
    if (totals["recent"] or 0) < min_rows:
        return status | {"outcome": "too_few_rows", "recent": totals["recent"] or 0}
    recent = parts.filter("part <> 'fit'")
    past = stored(metrics.time_split(history))
    served_rows = past.filter("part <> 'test'")
    moved = metrics.psi(served_rows, recent, features).filter("moved").select("feature").collect()
    rates = metrics.alert_rates(score(served, past.filter("part = 'tune'"), "score"),
                                score(served, recent, "score"), served_cut).first()
    status |= {"recent": totals["recent"], "moved": [r["feature"] for r in moved],
               "alert_rate": {"then": rates["rate_then"], "now": rates["rate_now"]}}
    old_enough = metrics.time_split(metrics.settled(parts.drop("part", "position"), "decided_at", delay_s))
    counts = old_enough.agg(F.count(F.lit(1)).alias("n"), F.sum(
        F.when(F.col("part") == "test", F.col("label")).otherwise(0)).alias("known")).first()
    known = int(counts["known"] or 0)
    status |= {"settling": totals["n"] - counts["n"]}
    if known < min_fraud:
        return status | {"outcome": "too_few_fraud", "deciding_fraud": known}
    columns = [*features, "label"]
    new = fit_committee(past.filter("part = 'fit'").select(columns).unionByName(
        old_enough.filter("part = 'fit'").select(columns)), features, **fit)
    both = stored(score(new, score(served, old_enough, "old"), "new").select(
        "transaction_id", "part", "label", "old", "new"))
    new_cut = metrics.same_workload_cut(both.filter("part = 'tune'"), "old", "new", served_cut).first()["cutoff"]
    test = both.filter("part = 'test'")
    read = lambda c, cut: metrics.reading(test, F.col(c) >= cut).first().asDict()
    old_read, new_read = read("old", served_cut), read("new", new_cut)
    return status | {"outcome": "better" if new_read["f1"] > old_read["f1"] else "not_better",
                     "deciding_fraud": known, "served": old_read, "retrained": new_read, "cutoff": new_cut}
