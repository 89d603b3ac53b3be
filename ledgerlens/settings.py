"""Windows, thresholds, weights and cut-offs; every plan takes them from here."""

SECOND_US = 1_000_000

# Fixed values ---------------------------------------------------------------
# Windows in seconds.
TEN_MINUTES = 600
HOUR = 3_600
DAY = 86_400
WEEK = 604_800
MONTH = 2_592_000

# Amounts in UZS.
STRUCTURING_THRESHOLD = 10_000_000
STRUCTURING_BAND_LOW = 0.80
DAILY_LIMIT = 100_000_000
NEW_PAYEE_FLOOR = 2_000_000
FOREIGN_TARGET_MEDIAN = 138_740.0

# Feature defaults.
NO_MEAN_RATIO = 4.0
FIRST_TRANSFER_GAP = 86_400.0
NEVER_PAID_GAP = 604_800.0
MIN_HISTORY = 5
MIN_REGION_HISTORY = 3
MIN_LOG_SPREAD = 1e-6

# Rule limits.
VELOCITY_OVER = 5
STRUCTURING_COUNT = 3
DISTINCT_OVER = 5
SIGMA_OVER = 4.0
MEAN_FACTOR = 3.0
SESSION_SIGMA_OVER = 2.0
TRAVEL_KM = 100.0
TRAVEL_KMH_OVER = 900.0
FAN_IN_SENDERS = 6

# Rule weights, in the order hits are listed.
RULE_WEIGHTS = {
    "NEW_PAYEE_HIGH_AMOUNT": 0.35,
    "VELOCITY": 0.30,
    "STRUCTURING": 0.40,
    "DISTINCT_PAYEE_BURST": 0.25,
    "GEO_ANOMALY": 0.20,
    "IMPOSSIBLE_TRAVEL": 0.45,
    "AMOUNT_DEVIATION": 0.25,
    "COACHED_SESSION": 0.35,
    "DAILY_LIMIT_BREACH": 0.30,
    "MULE_FAN_IN": 0.35,
}
MANDATORY_RULES = ("STRUCTURING", "DAILY_LIMIT_BREACH")

# Scheme -> its signature: rules whose weights add up to what the rule score reaches on it.
SCHEME_RULES = {
    "APP": ("NEW_PAYEE_HIGH_AMOUNT", "COACHED_SESSION"),
    "ATO": ("GEO_ANOMALY", "IMPOSSIBLE_TRAVEL", "VELOCITY"),
    "STRUCTURING": ("STRUCTURING", "VELOCITY"),
    "MULE": ("MULE_FAN_IN", "NEW_PAYEE_HIGH_AMOUNT"),
}

# Alert types, the first that matches names the alert.
ALERT_TYPES = (
    ("STRUCTURING", ("STRUCTURING",)),
    ("ATO", ("GEO_ANOMALY", "VELOCITY", "DISTINCT_PAYEE_BURST")),
    ("MULE", ("MULE_FAN_IN",)),
    ("APP", ("NEW_PAYEE_HIGH_AMOUNT", "AMOUNT_DEVIATION")),
)

# Decisions.
RULE_CUTOFF = 0.40
MODEL_VERSION = "cep+ml-fusion-v2"
RULES_ONLY_VERSION = "cep-only-fallback"
SECOND_LOOK_VERSION = "second-look"
UNSCORED_SUFFIX = ":unscored"
SECOND_LOOK_DEADLINE = 5.0
CONFIRMATION_DELAY = 86_400
FORGET_SENDER_DAYS = 90

# Cases.
DISPOSITIONS = ("NEW", "CONFIRMED_FRAUD", "FALSE_POSITIVE")

# Learning loop.
TRAIN_SHARE = 0.80
FIT_SHARE = 0.80
COMMITTEE_SEEDS = (42, 43, 44, 45, 46)
MIN_WEIGHTED_RATE = 0.005
PSI_MOVED = 0.25
MIN_DRIFT_ROWS = 1_000
MIN_FRAUD = 30
FITTING_ROWS = 1_000_000
REPORT_DELAY = 604_800
REPLAY_PREFIX = "replay-"
ALERT_BUDGET = 0.02
BAND_SIZE = 100
BAND_TIE = 1e-4
PIECE_ROWS = 5_000
EXPLAIN_TOLERANCE = 1e-4

# The job's stages, in order.
STAGES = ("kafka", "handoff", "decode", "state", "redis", "rules", "model", "decide")
