"""Reading scores against labels: cut-offs, ranking, calibration, workload, drift.

Everything works on one row per distinct score with running counts over them, so no score list is
gathered. Labels are 0/1 in `label`, scores in `score`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..sources.files import stored
from .quantiles import exact_quantiles, quantiles_of_counts, running_within, with_position
from .timeline import Sum


def time_split(rows: DataFrame, fit: float = S.TRAIN_SHARE * S.FIT_SHARE, train: float = S.TRAIN_SHARE,
               order: tuple = ("event_us", "transaction_id")) -> DataFrame:
    """`rows` with `position` in time order and `part`: fit, tune or test by position."""
    rows = stored(rows)
    n = rows.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    placed = with_position(rows, [F.col(c) for c in order], kept=True).withColumn("_n", n)
    cut = F.floor(F.col("_n") * train)
    # The shares multiply in two steps, each cut down to whole rows.
    mid = F.floor(cut * (fit / train))
    return placed.withColumn("part", F.when(F.col("position") < mid, "fit")
                             .when(F.col("position") < cut, "tune").otherwise("test")).drop("_n")


def split_at(rows: DataFrame, cut_us: int, fit: float = S.FIT_SHARE) -> DataFrame:
    """A split at a moment: what comes after it tests, the earlier rows fit and tune by position."""
    before = rows.filter(F.col("event_us") <= cut_us)
    early = time_split(before, fit=fit, train=1.0)
    late = rows.filter(F.col("event_us") > cut_us).withColumns(
        {"position": F.lit(None).cast("bigint"), "part": F.lit("test")})
    return early.unionByName(late)


def class_weight(rows: DataFrame, mode: str = "auto") -> DataFrame:
    """One row: positives, negatives and the weight of a positive."""
    if mode not in ("auto", "on", "off"):
        raise ValueError(f"mode is {mode!r}; it can be auto, on or off")
    pos, neg = F.col("pos"), F.col("neg")
    counts = rows.agg(F.sum((F.col("label") == 1).cast("bigint")).alias("pos"),
                      F.sum((F.col("label") == 0).cast("bigint")).alias("neg"))
    weight = neg / F.greatest(pos, F.lit(1))
    if mode == "off":
        weight = F.lit(1.0)
    elif mode == "auto":
        weight = F.when(pos / F.greatest(pos + neg, F.lit(1)) < S.MIN_WEIGHTED_RATE, 1.0).otherwise(weight)
    return counts.withColumn("weight", weight.cast("double"))


def score_points(rows: DataFrame) -> DataFrame:
    """Per distinct score: its rows and positives, counted before the shuffle."""
    return rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos"))


def score_curve(points: DataFrame) -> DataFrame:
    """The alerts and catches of a cut at each distinct score; the last ones are all rows and frauds."""
    falling = points.withColumn("falling", -F.col("score"))
    return running_within(falling, [], ["falling"], {"alerts": Sum(F.col("n")), "caught": Sum(F.col("pos"))}).drop("falling")


def best_f1_cutoff(rows: DataFrame) -> DataFrame:
    """The score whose cut has the best F1; the lowest of equals."""
    positives = rows.agg(F.sum("label").alias("p")).select("p").scalar()
    precision = F.col("caught") / F.col("alerts")
    recall = F.col("caught") / F.nullif(F.col("p"), F.lit(0))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    return (score_curve(score_points(rows)).withColumn("p", positives).withColumn("f1", F.coalesce(f1, F.lit(0.0)))
            .agg(F.max_by("score", F.struct("f1", -F.col("score"))).alias("cutoff"),
                 F.max("f1").alias("f1")))


def reading(rows: DataFrame, alert: Column, by: tuple = ()) -> DataFrame:
    """Alerts, catches, confusion, precision, recall and F1 of an alert condition."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    fraud = F.col("label") == 1
    r = rows.groupBy(*by).agg(count(alert & fraud).alias("tp"), count(alert & ~fraud).alias("fp"),
                              count(~alert & fraud).alias("fn"), count(~alert & ~fraud).alias("tn"))
    tp = F.col("tp")
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return r.withColumns({"alerts": tp + F.col("fp"), "caught": tp, "fraud": tp + F.col("fn"),
                          "precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn")),
                          "f1": ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))})


def ranking(rows: DataFrame) -> DataFrame:
    """Exact ROC-AUC (ties share their rank) and average precision."""
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    p, n = F.max("caught"), F.max("alerts")
    # A positive beats the negatives under its score, all but those at or above it, and half its equals.
    above = F.col("alerts") - F.col("caught")
    wins = p * (n - p) - F.sum(pos * (above - neg / 2))
    return score_curve(score_points(rows)).agg(
        (wins / F.nullif(p * (n - p), F.lit(0))).alias("roc_auc"),
        (F.sum(pos * F.col("caught") / F.col("alerts")) / F.nullif(p, F.lit(0))).alias("average_precision"))


def calibration(rows: DataFrame, cut: float) -> DataFrame:
    """Whether scores mean something as magnitudes: one row."""
    alerts = rows.filter(F.col("score") >= cut)
    facts = rows.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"),
                     F.sum((F.col("score") >= cut).cast("bigint")).alias("n_alerts"),
                     F.avg(F.when(F.col("score") >= cut, (F.col("score") >= 0.9995).cast("double")))
                     .alias("saturated_share"))
    distinct = alerts.select(F.bround("score", 3).alias("r")).distinct().agg(F.count("r").alias("c"))
    median = exact_quantiles(alerts, [], "score", {"m": 0.5})
    return facts.withColumns({"distinct_scores": distinct.select("c").scalar(),
                              "median_alert_score": median.select("m").scalar()})


def recall_by_type(rows: DataFrame, cut: float) -> DataFrame:
    return (rows.filter(F.col("label") == 1).groupBy("label_type")
            .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") >= cut).cast("bigint")).alias("caught"))
            .withColumn("recall", F.col("caught") / F.col("n")))


def alert_budget(rows: DataFrame, share: float = S.ALERT_BUDGET, tie: str = "transaction_id") -> DataFrame:
    """What the riskiest share of the rows holds, equal scores in a fixed order."""
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    size = F.greatest(F.lit(1), F.bround(totals.select("n").scalar() * share, 0).cast("bigint"))
    placed = with_position(rows, [-F.col("score"), F.col(tie)], "_place")
    top = placed.filter(F.col("_place") < size)
    return (top.agg(F.count(F.lit(1)).alias("budget_alerts"), F.sum("label").cast("bigint").alias("budget_caught"))
            .withColumn("fraud", totals.select("p").scalar().cast("bigint"))
            .withColumns({"budget_recall": F.col("budget_caught") / F.greatest("fraud", F.lit(1)),
                          "budget_precision": F.col("budget_caught") / F.col("budget_alerts")}))


def same_workload_cut(rows: DataFrame, old: str, new: str, old_cut: float) -> DataFrame:
    """The new score's cut that raises as many alerts as the old one's: its k-th largest value."""
    k = rows.agg(F.sum((F.col(old) >= old_cut).cast("bigint")).alias("k")).select("k").scalar()
    counts = rows.groupBy(F.col(new).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    curve = running_within(counts.withColumn("falling", -F.col("score")), [], ["falling"],
                           {"alerts": Sum(F.col("n"))}).withColumn("k", k)
    return curve.agg(F.max("k").alias("alerts"),
                     F.when(F.max("k") > 0, F.max(F.when(F.col("alerts") >= F.col("k"), F.col("score"))))
                     .otherwise(F.max("score") + 1e-9).alias("cutoff"))


def settled(rows: DataFrame, at: str, delay_s: int = S.REPORT_DELAY) -> DataFrame:
    """Decisions old enough for their reports: a delay before the newest one."""
    newest = rows.agg(F.max(at).alias("m")).select("m").scalar()
    return rows.filter(F.col(at) <= newest - delay_s)


def second_look_band(rows: DataFrame, review: float, size: int = S.BAND_SIZE) -> DataFrame:
    """The highest scores under the cut-off; the lowest of them is where the band begins."""
    return (rows.filter(F.col("score") < review)
            .orderBy(F.desc("score"), F.asc("transaction_id")).limit(size))


def training_pieces(rows: DataFrame, piece_rows: int = S.PIECE_ROWS, seed: int = 42, wanted: int | None = None) -> DataFrame:
    """Rows to fit one learner a piece: the ordinary rows dealt out evenly, and in each piece the frauds, `piece_rows` together at
    most. Frauds take half a piece at most: of more, those with the least hashes are the sample that every learner is fitted on.
    `wanted` builds only the first so many pieces."""
    counts = rows.agg(F.sum("label").alias("fraud"), F.sum(1 - F.col("label")).alias("legit")).first()
    fraud, legit = int(counts["fraud"] or 0), int(counts["legit"] or 0)
    fraud = min(fraud, max(1, piece_rows // 2))
    pieces = max(1, -(-legit // (piece_rows - fraud)))
    mixed = [F.xxhash64(F.lit(seed), "transaction_id"), F.col("transaction_id")]
    dealt = with_position(rows.filter("label = 0"), mixed, "_place")
    dealt = dealt.withColumn("piece", F.pmod(F.col("_place"), F.lit(pieces)).cast("int")).drop("_place")
    built = pieces if wanted is None else min(pieces, wanted)
    everywhere = (rows.filter("label = 1").orderBy(*mixed).limit(fraud)
                  .withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(built - 1)))))
    return dealt.filter(F.col("piece") < built).unionByName(everywhere)


def max_difference(left: DataFrame, right: DataFrame, key: str = "transaction_id") -> DataFrame:
    """How far two models' scores of the same rows are apart."""
    pairs = left.select(key, F.col("score").alias("a")).join(right.select(key, F.col("score").alias("b")), key)
    return pairs.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference"))


# --- Drift --------------------------------------------------------------------------------

def _long(rows: DataFrame, features: list[str]) -> DataFrame:
    pairs = ", ".join(f"struct('{f}' feature, cast({f} as double) value)" for f in features)
    return rows.select(F.expr(f"inline(array({pairs}))"))


def psi(ref: DataFrame, cur: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """Population stability index of each feature over the reference's deciles, the most moved
    first. NaN and null are a bin of their own; every bin is smoothed by half a row."""
    names = {f"q{i}": i / bins for i in range(1, bins)}
    sides = _long(ref, features).withColumn("cur", F.lit(0)).unionByName(_long(cur, features).withColumn("cur", F.lit(1)))
    # How often each value occurs on either side: the rows are read once.
    points = stored(sides.groupBy("feature", "value").agg(F.count_if(F.col("cur") == 0).alias("p"), F.count_if(F.col("cur") == 1).alias("q")))
    seen = points.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("p") > 0)).withColumnRenamed("p", "n")
    edges = stored(quantiles_of_counts(seen, ["feature"], "value", names).select(
        "feature", F.array_distinct(F.array(*names)).alias("edges")))
    placed = points.join(F.broadcast(edges), "feature", "left").withColumn(
        "edges", F.coalesce("edges", F.array().cast("array<double>")))
    gap = F.col("value").isNull() | F.isnan("value")
    bin_ = F.when(gap, -1).otherwise(F.size(F.filter("edges", lambda e: F.col("value") >= e)))
    counted = placed.groupBy("feature", bin_.alias("bin")).agg(
        F.sum("p").alias("p"), F.sum("q").alias("q"))
    # All bins, the empty ones too: at most `bins` + 1 per feature.
    frame = (counted.groupBy("feature").agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
             .join(edges, "feature", "left")
             .select("feature", "np", "nq", (F.coalesce(F.size("edges"), F.lit(0)) + 2).alias("bins"),
                     F.explode(F.sequence(F.lit(-1), F.coalesce(F.size("edges"), F.lit(0)))).alias("bin")))
    both = frame.join(counted, ["feature", "bin"], "left")
    share = lambda c, n: (F.coalesce(c, F.lit(0)) + 0.5) / (F.col(n) + 0.5 * F.col("bins"))
    p, q = share(F.col("p"), "np"), share(F.col("q"), "nq")
    return (both.groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
            .withColumn("moved", F.col("psi") > S.PSI_MOVED).orderBy(F.desc("psi"), "feature"))


def alert_rates(then: DataFrame, now: DataFrame, cut: float) -> DataFrame:
    """A model's share of alerts on its own rows and on the latest."""
    rate = lambda rows: rows.agg(F.avg((F.col("score") >= cut).cast("double")).alias("r"))
    return rate(then).select(F.col("r").alias("rate_then")).withColumn(
        "rate_now", rate(now).select("r").scalar())
