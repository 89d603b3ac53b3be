"""The ten rules over the features, and the rule score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from .. import settings as S
from ..profile import FULL, Profile

CONDITIONS = {
    "NEW_PAYEE_HIGH_AMOUNT": f"is_new_payee = 1 and amount >= {S.NEW_PAYEE_FLOOR} and amount_gt_factor_mean = 1",
    "VELOCITY": f"vel_10m > {S.VELOCITY_OVER}",
    "STRUCTURING": f"sub_threshold_1h >= {S.STRUCTURING_COUNT}",
    "DISTINCT_PAYEE_BURST": f"distinct_payees_10m > {S.DISTINCT_OVER}",
    "GEO_ANOMALY": "geo_is_anomaly = 1",
    "IMPOSSIBLE_TRAVEL": f"travel_distance_km >= {S.TRAVEL_KM} and travel_kmh > {S.TRAVEL_KMH_OVER}",
    "AMOUNT_DEVIATION": f"has_history = 1 and amount_z > {S.SIGMA_OVER}",
    "COACHED_SESSION": f"active_call = 1 and secs_login_z > {S.SESSION_SIGMA_OVER}",
    "DAILY_LIMIT_BREACH": "daily_sum_ratio > 1",
    "MULE_FAN_IN": f"rcv_distinct_senders_1h >= {S.FAN_IN_SENDERS}",
}


def reads(profile: Profile = FULL) -> list[str]:
    """The features and the transfer's own columns that a profile's rules read."""
    return sorted({name for r in profile.rules for name in re.findall(r"\b[a-z_][a-z_0-9]*\b", CONDITIONS[r])} - {"and", "or"})


def with_rules(features: DataFrame, profile: Profile = FULL) -> DataFrame:
    """`features` plus `rule_hits` in the rules' fixed order and `cep_score`, at most 1, 4 places."""
    live = profile.rules
    hits = ", ".join(f"if({CONDITIONS[r]}, '{r}', null)" for r in live)
    weight = " + ".join(f"if(array_contains(rule_hits, '{r}'), {S.RULE_WEIGHTS[r]}D, 0D)" for r in live)
    return (features.withColumn("rule_hits", F.expr(f"array_compact(array({hits}))"))
            .withColumn("cep_score", F.expr(f"bround(least(1D, {weight}), 4)")))
