"""Which data a deployment has: each capability switches its features and rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import settings as S

# Capability -> (features, rules, modes). The order is the feature vector's.
CAPABILITIES = {
    "core_history": (
        ("log_amount", "amount_to_mean", "amount_z", "is_new_payee", "vel_10m", "vel_1h",
         "distinct_payees_10m", "sub_threshold_1h", "secs_since_last", "daily_sum_ratio", "hour"),
        ("NEW_PAYEE_HIGH_AMOUNT", "VELOCITY", "STRUCTURING", "DISTINCT_PAYEE_BURST",
         "AMOUNT_DEVIATION", "DAILY_LIMIT_BREACH"),
        ("on",)),
    "receiver_velocity": (
        ("rcv_distinct_senders_1h", "rcv_inflow_1h"), ("MULE_FAN_IN",), ("on", "off")),
    "geo_telemetry": (
        ("geo_is_anomaly",), ("GEO_ANOMALY", "IMPOSSIBLE_TRAVEL"), ("on", "off")),
    "session_telemetry": (
        ("active_call", "secs_login_z"), ("COACHED_SESSION",), ("on", "off")),
    "payee_identity": ((), (), ("card", "pinfl")),
    "counterparty_history": (
        ("payee_payers_24h", "payee_payers_7d", "sender_payees_24h", "sender_payees_7d",
         "secs_since_sender_inbound", "payee_inflow_24h", "payee_new_payers_24h",
         "sender_new_payees_24h", "sender_new_payee_sum_24h"), (), ("on", "off")),
    "confirmed_cases": (
        ("payee_flagged", "sender_flagged", "payee_flagged_contacts"), (), ("on", "off")),
}


@dataclass(frozen=True)
class Profile:
    """A choice of mode per capability; a misspelt key or mode raises."""

    modes: dict = field(default_factory=dict)

    def __post_init__(self):
        for key, mode in self.modes.items():
            if key not in CAPABILITIES:
                raise KeyError(f"unknown capability {key!r}, expected one of {sorted(CAPABILITIES)}")
            if mode not in CAPABILITIES[key][2]:
                raise ValueError(f"{key}: mode {mode!r} is not in {CAPABILITIES[key][2]}")

    def mode(self, key: str) -> str:
        return self.modes.get(key, CAPABILITIES[key][2][0])

    def has(self, key: str) -> bool:
        return self.mode(key) != "off"

    @property
    def feature_names(self) -> list[str]:
        return [f for key, (names, _, _) in CAPABILITIES.items() if self.has(key) for f in names]

    @property
    def rules(self) -> list[str]:
        live = {r for key, (_, rules, _) in CAPABILITIES.items() if self.has(key) for r in rules}
        return [r for r in S.RULE_WEIGHTS if r in live]

    def reachable(self, scheme: str) -> float:
        """What the scheme's rules add up to in this deployment, 1 at most."""
        live = set(self.rules)
        return min(1.0, sum(S.RULE_WEIGHTS[r] for r in S.SCHEME_RULES[scheme] if r in live))

    def weakest_scheme(self) -> float:
        return min(self.reachable(s) for s in S.SCHEME_RULES)

    def rule_cutoff(self, base: float = S.RULE_CUTOFF, scaled: bool = True) -> float:
        """The rule score's cut-off, lowered as far as the weakest scheme lost score."""
        full = FULL.weakest_scheme()
        if not scaled or full <= 0:
            return base
        return round(base * self.weakest_scheme() / full, 4)


FULL = Profile()


def foreign(*off: str, payee_identity: str = "pinfl") -> Profile:
    """The profile of a dataset without cards and verdicts; `off` names what else it lacks."""
    return Profile({**{k: "off" for k in off}, "confirmed_cases": "off",
                    "payee_identity": payee_identity})
