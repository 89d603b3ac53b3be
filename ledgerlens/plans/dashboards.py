"""The overview dashboard's panels over decisions, cases and retrain runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..operators.decision import by_second_look, held_by
from ..operators.quantiles import exact_quantiles

LATENCY_LIMITS_MS = (25, 50, 100, 300)


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def top_row(decisions: DataFrame) -> DataFrame:
    """Checked, held, the share held, median and p99 decision time (nearest rank)."""
    held = F.col("decision") == "REVIEW"
    facts = decisions.agg(F.count(F.lit(1)).alias("checked"), _count(held).alias("held"))
    times = exact_quantiles(decisions, [], "decision_ms", {"median_ms": 0.5, "p99_ms": 0.99}, nearest=True)
    return facts.withColumns({"share_held": F.col("held") / F.nullif(F.col("checked"), F.lit(0)),
                              "median_ms": times.select("median_ms").scalar(),
                              "p99_ms": times.select("p99_ms").scalar()})


def last_hour(decisions: DataFrame, seconds: int = 3600) -> DataFrame:
    """The decisions of the last hour before the newest transfer."""
    newest = decisions.agg(F.max("event_time").alias("m")).select("m").scalar()
    return decisions.filter(F.unix_micros("event_time") > F.unix_micros(newest) - seconds * S.SECOND_US)


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Records and distinct transfers per decision, through one row per transfer and decision."""
    pairs = decisions.groupBy("decision", "transaction_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("decision").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("transfers"))


def speed(decisions: DataFrame) -> DataFrame:
    """The share of decisions under each limit."""
    return decisions.agg(*[F.avg(F.when(F.col("decision_ms").isNotNull(), (F.col("decision_ms") < ms).cast("double")))
                           .alias(f"under_{ms}_ms") for ms in LATENCY_LIMITS_MS])


def stage_means(decisions: DataFrame) -> DataFrame:
    """Where a decision's time goes: the mean of each timed stage."""
    return decisions.agg(*[F.avg(f"stage_{s}_ms").alias(s) for s in S.STAGES])


def stage_columns() -> dict[str, Column]:
    """A stage map as one nullable column per stage; a stage nobody timed stays null."""
    return {f"stage_{s}_ms": F.try_element_at("stage_ms", F.lit(s)).try_cast("double") for s in S.STAGES}


def before_operator(ingested: Column, appended: Column, arrived: Column) -> Column:
    """The two stages before scoring, from three stamps in seconds; a missing stamp leaves one out."""
    ms = lambda a, b: F.bround((b - a) * 1000.0, 3)
    stages = F.create_map(F.lit("kafka"), ms(ingested, appended), F.lit("handoff"), ms(appended, arrived))
    return F.map_filter(stages, lambda _, v: v.isNotNull())


def holder(cut: float) -> Column:
    """Who held a transfer: the rules by fraud type, the model, the second look, or no answer from it; none if nobody did."""
    unscored = F.col("model_version").endswith(S.UNSCORED_SUFFIX)
    return (F.when(F.col("decision") != "REVIEW", "none")
            .when(by_second_look(F.col("model_version")) & unscored, "no answer")
            .when(by_second_look(F.col("model_version")), "second look")
            .when(F.array_contains(held_by(cut), "RULE"), F.concat(F.lit("rules: "), F.coalesce("predicted_type", F.lit("other"))))
            .otherwise("model"))


def holds_over_time(decisions: DataFrame, cut: float, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Checked and held per interval, and who held. On a stream a decision counts if it is no later than `late`."""
    if decisions.isStreaming:
        decisions = decisions.withWatermark("event_time", late)
    return (decisions.groupBy(F.window("event_time", every), holder(cut).alias("holder")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("minute"), "holder", "n"))


def second_look_panel(decisions: DataFrame) -> DataFrame:
    """Sent to the second look, held by it, held because it did not answer."""
    second = by_second_look(F.col("model_version"))
    unscored = F.col("model_version").endswith(S.UNSCORED_SUFFIX)
    held = F.col("decision") == "REVIEW"
    return decisions.agg(_count(F.col("decision") == "SECOND_LOOK").alias("sent"),
                         _count(second & held & ~unscored).alias("held"),
                         _count(second & held & unscored).alias("unanswered"))


def last_retrains(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("run_at")).limit(n)


def rejected_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def dataset_makeup(split: DataFrame) -> DataFrame:
    """Rows, fraud and fraud share per part of a split."""
    return split.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("fraud"),
                                     F.avg("label").alias("fraud_share"))


def caught_by_band(decided: DataFrame, day_us: int, start_us: int, days: int = 10) -> DataFrame:
    """Caught frauds, holds and their precision by band of days."""
    band = F.floor((F.col("event_us") - start_us) / (day_us * days))
    held = F.col("decision") == "REVIEW"
    return (decided.groupBy(band.alias("band"))
            .agg(_count(held & (F.col("label") == 1)).alias("caught"), _count(F.col("label") == 1).alias("fraud"),
                 _count(held).alias("holds"))
            .withColumn("precision", F.col("caught") / F.nullif(F.col("holds"), F.lit(0))))


def travel_false_alarms(decided: DataFrame) -> DataFrame:
    """How often IMPOSSIBLE_TRAVEL held a legitimate move between regions. A move is a transfer
    whose distance from the sender's last located one is above zero."""
    moves = decided.filter((F.col("travel_distance_km") > 0) & (F.coalesce("label", F.lit(0)) == 0))
    hit = F.array_contains("rule_hits", "IMPOSSIBLE_TRAVEL")
    return (moves.agg(F.count(F.lit(1)).alias("moves"), _count(hit).alias("fired"))
            .withColumn("rate", F.col("fired") / F.nullif(F.col("moves"), F.lit(0))))
