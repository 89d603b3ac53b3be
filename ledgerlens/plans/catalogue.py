"""Named queries over the repository's tables: one per operator or figure, each with its SQL twin."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import settings as S
from ..operators import decision, lookups, metrics, quantiles, queue
from ..operators.confirmed import confirmed_from_labels, known_by
from ..operators.features import transfer_features
from ..operators.rules import reads, with_rules
from ..profile import FULL, foreign
from ..sources import adapters
from ..sources.files import stored
from . import oracle as Q

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# The adapter compresses time by 60, so a day's delay is 24 minutes.
DELAY = S.CONFIRMATION_DELAY // 60


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


def events(spark, sf_dir, profile=FULL) -> DataFrame:
    return adapters.from_events(spark, sf_dir, profile=profile)


def features(spark, sf_dir, profile=FULL, wanted=None) -> DataFrame:
    t = events(spark, sf_dir, profile)
    if wanted is None:
        # Read by five stages, so it is taken apart once.
        t = stored(t)
    return transfer_features(t, confirmed_from_labels(t, DELAY), profile, wanted=wanted)


def ruled(spark, sf_dir, *own: str, profile=FULL) -> DataFrame:
    """Transfers with their rule hits, from the features that the rules read and no others; `own` are columns to keep."""
    return with_rules(features(spark, sf_dir, profile, wanted=[*reads(profile), *own]), profile)


def decided(spark, sf_dir, *own: str) -> DataFrame:
    return decision.decide(ruled(spark, sf_dir, *own).withColumn("ml_score", F.lit(None).cast("double")))


def _r(name: str, places: int = 6):
    return F.round(F.col(name), places).alias(name)


def _cols(*names: str, whole=()):
    return [F.col("transaction_id"), *[_r(n) for n in names], *[F.col(n).cast("bigint").alias(n) for n in whole]]


def _sql(ctes: str, names=(), whole=(), source: str = "f") -> str:
    cols = ", ".join(["tid transaction_id", *[f'round("{n}", 6) as "{n}"' for n in names],
                      *[f"cast({n} as bigint) as {n}" for n in whole]])
    return f"with {ctes} select {cols} from {source}"


ALL = Q.all_of(DELAY)


def _feature_query(name: str, reals=(), whole=()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features(spark, sf_dir, wanted=[*reals, *whole]).select(*_cols(*reals, whole=whole))
    run.__name__ = name
    run.__doc__ = ", ".join([*reals, *whole])
    query(_sql(ALL, reals, whole))(run)


_feature_query("sender_velocity", whole=("vel_10m", "vel_1h"))
_feature_query("sender_distinct_payees", whole=("distinct_payees_10m", "sender_payees_24h", "sender_payees_7d"))
_feature_query("sender_amount_stats", ("log_amount", "amount_to_mean", "amount_z"))
_feature_query("structuring_band", whole=("sub_threshold_1h",))
_feature_query("secs_since_last", ("secs_since_last", "hour"))
_feature_query("daily_sum", ("daily_sum_ratio",))
_feature_query("new_payees", ("sender_new_payee_sum_24h",), ("is_new_payee", "sender_new_payees_24h"))
_feature_query("session_z", ("secs_login_z",), ("active_call",))
_feature_query("home_region", whole=("geo_is_anomaly",))
_feature_query("impossible_travel", ("travel_distance_km", "travel_kmh"))
_feature_query("payee_fan_in", ("rcv_inflow_1h",), ("rcv_distinct_senders_1h",))
_feature_query("payee_day", ("payee_inflow_24h",), ("payee_payers_24h", "payee_payers_7d", "payee_new_payers_24h"))
_feature_query("sender_inbound_asof", ("secs_since_sender_inbound",))
_feature_query("confirmed_asof", whole=("payee_flagged", "sender_flagged"))
_feature_query("flagged_contacts", whole=("payee_flagged_contacts",))


@query(f"with {ALL} select tid transaction_id, hits rule_hits, round(raw, 4) cep_score from r")
def rule_hits(spark, sf_dir):
    """RU-1..11: the hits in order and the score."""
    return ruled(spark, sf_dir).select(
        "transaction_id", F.array_join("rule_hits", ",").alias("rule_hits"), "cep_score")


_DECIDED = f"""{ALL},
d as (select *, case when raw >= 0.4 - 1e-9 or a3 = 1 or a9 = 1 then 'REVIEW' else 'ALLOW' end decision,
             case when a3 = 1 then 'STRUCTURING' when a5 = 1 or a2 = 1 or a4 = 1 then 'ATO' when a10 = 1 then 'MULE'
                  when a1 = 1 or a7 = 1 then 'APP' end kind_of_alert from r)"""


@query(f"""with {_DECIDED} select tid transaction_id, round(raw, 4) final_score, decision,
case when decision <> 'ALLOW' then kind_of_alert end predicted_type, 'cep-only-fallback' model_version from d""")
def decisions(spark, sf_dir):
    """DE-1..5, DE-8 without a model."""
    return decided(spark, sf_dir).select("transaction_id", "final_score", "decision", "predicted_type", "model_version")


@contextmanager
def sliced(spark, transfers: DataFrame, parts: int):
    """Plans built inside deal every order into slices, as if a task held one part of the rows at most."""
    before = spark.conf.get("ledgerlens.rowsPerSlice", None)
    spark.conf.set("ledgerlens.rowsPerSlice", max(1, transfers.count() // parts))
    try:
        yield
    finally:
        spark.conf.unset("ledgerlens.rowsPerSlice") if before is None else spark.conf.set("ledgerlens.rowsPerSlice", before)


@query(ORACLE["decisions"])
def decisions_sliced(spark, sf_dir):
    """FS-*, FP-*, RU-*, DE-* as with keys too heavy for a task: the busiest accounts are dealt into slices."""
    with sliced(spark, events(spark, sf_dir), 110):
        return decisions(spark, sf_dir)


_SCORED_DECISION = f"""{_DECIDED},
m as (select *, cast(tid as bigint) * 7919 % 1000 / 1000 ml from d)"""


@query(f"""with {_SCORED_DECISION}, x as (select *, case when ml >= 0.9 or a3 = 1 or a9 = 1 then 'REVIEW'
when ml >= 0.8 then 'SECOND_LOOK' else 'ALLOW' end dec from m) select tid transaction_id, round(ml, 4) final_score,
dec decision, case when dec <> 'ALLOW' then kind_of_alert end predicted_type, 'cep+ml-fusion-v2' model_version from x""")
def decisions_with_model(spark, sf_dir):
    """DE-1..5 with a model score and a second-look band."""
    rows = ruled(spark, sf_dir).withColumn(
        "ml_score", F.col("transaction_id").cast("bigint") * 7919 % 1000 / 1000)
    cutoffs = decision.Cutoffs(0.9, 0.8, 0.9)
    return decision.decide(rows, cutoffs).select("transaction_id", F.round("final_score", 4).alias("final_score"),
                                                 "decision", "predicted_type", "model_version")


@query(f"""with {_SCORED_DECISION}, w as (select *, (cast(tid as bigint) % 80) / 10 waited,
case when cast(tid as bigint) % 3 <> 0 then cast(tid as bigint) * 104729 % 1000 / 1000 end s2 from m
where ml >= 0.8 and ml < 0.9 and a3 = 0 and a9 = 0), v as (select *, case when waited < 5 then s2 end sl from w)
select tid transaction_id, case when sl is null or sl >= 0.5 then 'REVIEW' else 'ALLOW' end decision,
round(coalesce(sl, ml), 4) final_score,
'second-look:m1' || case when sl is null then ':unscored' else '' end model_version from v""")
def second_look_verdicts(spark, sf_dir):
    """DE-6, ST-8: the band re-decided; no score or a wait past the deadline holds it."""
    i = F.col("transaction_id").cast("bigint")
    rows = ruled(spark, sf_dir).withColumn("ml_score", i * 7919 % 1000 / 1000)
    waiting = decision.decide(rows, decision.Cutoffs(0.9, 0.8, 0.9)).filter("decision = 'SECOND_LOOK'")
    waiting = waiting.withColumns({"scored_at_job": F.lit(1000.0) - i % 80 / 10,
                                   "second_score": F.when(i % 3 != 0, i * 104729 % 1000 / 1000),
                                   "stage_ms": F.lit(None).cast("map<string,double>")})
    return decision.second_look_verdict(waiting, 0.5, "m1", F.lit(1000.0)).select(
        "transaction_id", "decision", F.round("final_score", 4).alias("final_score"), "model_version")


_REDUCED = FULL.__class__({"geo_telemetry": "off", "session_telemetry": "off"})


@query(f"""with {ALL}, x as (select *, least(1, a1*.35 + a2*.3 + a3*.4 + a4*.25 + a7*.25 + a9*.3 + a10*.35) sc from r)
select tid transaction_id, round(sc, 4) cep_score, case when sc >= 0.1714 or a3 = 1 or a9 = 1 then 'REVIEW' else 'ALLOW' end decision from x""")
def reduced_profile(spark, sf_dir):
    """RU-12, RU-13, ML-25: without region and session data the rules' cut-off falls to 0.1714."""
    rows = ruled(spark, sf_dir, profile=_REDUCED).withColumn("ml_score", F.lit(None).cast("double"))
    return decision.decide(rows, profile=_REDUCED).select("transaction_id", "cep_score", "decision")


@query(f"""with {_DECIDED}, h as (select *, us // 3600000000 b from d) select b - {Q.EPOCH} // 3600000000 band,
count(*) filter (decision = 'REVIEW' and label = 1) caught, count(*) filter (label = 1) fraud,
count(*) filter (decision = 'REVIEW') holds, round(count(*) filter (decision = 'REVIEW' and label = 1)
/ nullif(count(*) filter (decision = 'REVIEW'), 0), 6) as precision from h group by b""")
def caught_by_band(spark, sf_dir):
    """AGG-15: caught, holds and precision by band of time."""
    from .dashboards import caught_by_band as panel
    return panel(decided(spark, sf_dir, "label"), 3_600_000_000, Q.EPOCH, 1).select(
        "band", *[F.col(c).cast("bigint").alias(c) for c in ("caught", "fraud", "holds")], _r("precision"))


@query(f"""with {ALL} select count(*) moves, count(*) filter (a6 = 1) fired, round(avg(a6), 6) rate from r
where travel_distance_km > 0 and label = 0""")
def travel_false_alarms(spark, sf_dir):
    """AGG-13."""
    from .dashboards import travel_false_alarms as panel
    return panel(ruled(spark, sf_dir, "label")).select(
        "moves", F.col("fired").cast("bigint").alias("fired"), _r("rate"))


# The same events at their own pace, so that weeks and months are not all in one window.
_NATIVE = ALL.replace("(us0 - " + str(Q.EPOCH) + ") // 60 us", "(us0 - " + str(Q.EPOCH) + ") us").replace(
    "value * 60000 amount, cast(round(value * 6000000)", "value * 20000 amount, cast(round(value * 2000000)").replace(
    f"+ {DELAY * 1_000_000} since", f"+ {S.CONFIRMATION_DELAY * 1_000_000} since")
_LONG = ("payee_payers_7d", "sender_payees_7d", "payee_payers_24h", "sender_payees_24h", "payee_new_payers_24h",
         "sender_new_payees_24h", "payee_flagged", "sender_flagged", "payee_flagged_contacts", "is_new_payee", "geo_is_anomaly")
_LONG_REAL = ("secs_since_sender_inbound", "secs_since_last", "amount_z", "secs_login_z", "travel_distance_km", "payee_inflow_24h")


def native(spark, sf_dir) -> DataFrame:
    return adapters.from_events(spark, sf_dir, compress=1, per_value=20_000)


@query(_sql(_NATIVE, _LONG_REAL, _LONG))
def native_pace(spark, sf_dir):
    """FS-*, FP-* over a month: windows of days and weeks that do not all hold everything."""
    t = native(spark, sf_dir)
    return transfer_features(t, confirmed_from_labels(t)).select(*_cols(*_LONG_REAL, whole=_LONG))


_FRESH = Q.EPOCH + 20 * S.DAY * 1_000_000


@query(_sql(_NATIVE, _LONG_REAL, _LONG) + f" where us >= {_FRESH}")
def incremental_features(spark, sf_dir):
    """ST-9, SURVEY 7.4: the last ten days scored from a week of context and a summary of what came
    before, as the live job does; the same answers as over all history."""
    from ..streaming.snapshots import WEEK_US, summarise
    t, base = native(spark, sf_dir), _FRESH - WEEK_US
    recent = t.filter(F.col("event_us") >= base).withColumn("fresh", F.col("event_us") >= _FRESH)
    rows = transfer_features(recent, confirmed_from_labels(t), prior=summarise(t.filter(F.col("event_us") < base)),
                             wanted=[*_LONG_REAL, *_LONG, "fresh"])
    return rows.filter("fresh").select(*_cols(*_LONG_REAL, whole=_LONG))


@query(f"""with {_DECIDED} select tid transaction_id, case when decision = 'REVIEW' then us + 86400000000
when cast('0x' || substr(md5(tid), 1, 8) as bigint) % 1000 < 500 then us + 604800000000 end known_us from d where label = 1""")
def label_availability(spark, sf_dir):
    """ML-27: when each fraud becomes known."""
    return lookups.known_labels(decided(spark, sf_dir, "label")).filter("label = 1").select("transaction_id", "known_us")


_TIES = ("vel_10m", "sender_payees_7d", "is_new_payee", "rcv_distinct_senders_1h", "payee_new_payers_24h", "payee_inflow_24h")


def _ties(spark, sf_dir):
    return transfer_features(adapters.from_orders(spark, sf_dir), wanted=list(_TIES))


@query(f"""with {Q.O}, {Q.MARKED}, {Q.SENDER}, {Q.PAYEE} select t.tid transaction_id, snd.c10 + 1 vel_10m,
snd.d7 + 1 sender_payees_7d, cast(n.is_new as int) is_new_payee, rcv.d1h + 1 rcv_distinct_senders_1h,
rcv.new24 + cast(n.new_payer as int) payee_new_payers_24h, rcv.in24 + t.tiyin inflow_tiyin
from t join n using (tid) join snd using (tid) join rcv using (tid)""")
def ties_orders(spark, sf_dir):
    """S1, S2: of transfers at one instant, only those before in the order count."""
    return _ties(spark, sf_dir).select(
        "transaction_id", *_TIES[:-1], F.round(F.expm1("payee_inflow_24h") * 100).cast("bigint").alias("inflow_tiyin"))


# --- Sources ------------------------------------------------------------------------------

@query(f"with {Q.E} select round(median(amount), 6) as median, round(138740 / median(amount), 6) scale from t")
def median_scale(spark, sf_dir):
    """AGG-1."""
    return adapters.scale_factors(events(spark, sf_dir), "amount", []).select(_r("median"), _r("scale"))


@query(f"with {Q.O} select currency, round(median(amount), 4) as median, round(138740 / median(amount), 6) scale from t group by currency")
def currency_scale(spark, sf_dir):
    """AGG-2: one scale per currency."""
    return adapters.scale_factors(adapters.from_orders(spark, sf_dir), "amount", ["currency"]).select(
        "currency", _r("median", 4), _r("scale"))


@query(f"""with {Q.E}, b as (select *, null::varchar currency from t) select count(*) as rows, sum(label)::bigint frauds,
round(avg(label), 6) fraud_share, count(*) filter (s = p) self_transfers, (max(us) - min(us)) // 86400000000 as days,
(select count(distinct x) from (select s x from t union all select p from t)) accounts,
count(distinct s) senders, count(distinct p) payees from b""")
def dataset_summary(spark, sf_dir):
    """SRC-7."""
    return adapters.describe(events(spark, sf_dir)).select(
        "rows", F.col("frauds").cast("bigint").alias("frauds"), _r("fraud_share"), "self_transfers", "days",
        "accounts", "senders", "payees")


@query("""with x as (select o_orderkey, o_custkey, o_totalprice, date_diff('hour', timestamp '1992-01-01', o_orderdate) step,
o_orderkey % 50 dest from orders where o_orderpriority in ('1-URGENT', '2-HIGH')), m as (select 138740 / median(o_totalprice) f from x)
select concat_ws('-', step, 'N' || o_custkey, 'N' || dest, o_totalprice) || coalesce('-' || nullif(row_number() over (
partition by step, o_custkey, dest, o_totalprice), 1), '') transaction_id, 'N' || o_custkey sender_key, 'N' || dest payee_key, step * 3600000000 event_us, round(o_totalprice * f, 4) amount from x, m""")
def paysim_rows(spark, sf_dir):
    """SRC-5: rename, step to time, TRANSFER rows only, median rescaling."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    hour = F.timestamp_diff("HOUR", F.lit("1992-01-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    raw = o.select(
        hour.alias("step"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "TRANSFER").otherwise("CASH_OUT").alias("type"),
        F.col("o_totalprice").alias("amount"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("nameOrig"),
        F.concat(F.lit("N"), (F.col("o_orderkey") % 50).cast("string")).alias("nameDest"), F.lit(0).alias("isFraud"))
    return adapters.paysim(raw).select("transaction_id", "sender_key", "payee_key", "event_us", _r("amount", 4))


@query("""with x as (select 'A' || o_custkey s, 'A' || (o_orderkey % 30) p, o_totalprice a, cast(c_nationkey as varchar) cur,
strftime(o_orderdate, '%Y/%m/%d %H:%M') as tm from orders join customer on o_custkey = c_custkey),
m as (select cur, 138740 / median(a) f from x group by cur)
select s sender_key, p payee_key, epoch_us(strptime(tm, '%Y/%m/%d %H:%M')) event_us, round(a * f, 4) amount, x.cur currency
from x join m on x.cur = m.cur""")
def bank_file_rows(spark, sf_dir):
    """SRC-6: repeated headers, minute times, one scale per currency, self-transfers kept."""
    o, c = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer"))
    raw = o.join(c, o.o_custkey == c.c_custkey).select(
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy/MM/dd HH:mm").alias("Timestamp"),
        F.lit("1").alias("From Bank"), F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("a1"),
        F.lit("2").alias("To Bank"), F.concat(F.lit("A"), (F.col("o_orderkey") % 30).cast("string")).alias("a2"),
        F.col("o_totalprice").alias("Amount Paid"), F.col("c_nationkey").cast("string").alias("Payment Currency"),
        F.lit("Wire").alias("Payment Format"), F.lit(0).alias("Is Laundering"))
    raw = raw.toDF(*[{"a1": "Account", "a2": "Account"}.get(c, c) for c in raw.columns])
    return adapters.bank_transfers(adapters.bank_rows(raw)).select(
        "sender_key", "payee_key", "event_us", _r("amount", 4), "currency")


# --- Learning loop on a plain score -------------------------------------------------------

def scored(spark, sf_dir) -> DataFrame:
    """Transfers with a score that knows something of the label and has many ties."""
    i = F.col("transaction_id").cast("bigint")
    return events(spark, sf_dir).withColumn("score", (i * 7919 % 500 + F.col("label") * 400) / 1000)


_S = f"{Q.E}, sc as (select *, (cast(tid as bigint) * 7919 % 500 + label * 400) / 1000 score from t)"
_SPLIT = f"""{_S}, q as (select *, row_number() over (order by us, tid) - 1 position, count(*) over () n from sc),
z as (select *, case when position < floor(floor(n * 0.8) * 0.8) then 'fit' when position < floor(n * 0.8) then 'tune' else 'test' end part from q)"""


@query(f"with {_SPLIT} select tid transaction_id, position, part from z")
def time_split(spark, sf_dir):
    """ML-2: 64/16/20 by place in time."""
    return metrics.time_split(scored(spark, sf_dir)).select("transaction_id", F.col("position").cast("bigint").alias("position"), "part")


@query(ORACLE["time_split"])
def time_split_sliced(spark, sf_dir):
    """ML-2, as with an order too long for a task."""
    with sliced(spark, events(spark, sf_dir), 8):
        return time_split(spark, sf_dir)


@query(f"with {_SPLIT} select part, count(*) n, sum(label)::bigint fraud, round(avg(label), 6) fraud_share from z group by part")
def dataset_makeup(spark, sf_dir):
    """AGG-14."""
    from .dashboards import dataset_makeup as panel
    return panel(metrics.time_split(scored(spark, sf_dir))).select("part", "n", "fraud", _r("fraud_share"))


@query(f"""with {Q.E}, x as (select 24 * 3600000000 h, * from t), b as (select *, row_number() over (order by us, tid) - 1 k,
count(*) over () n from x where us <= {Q.EPOCH + 6 * 3_600_000_000}) select tid transaction_id,
case when k < floor(n * 0.8) then 'fit' else 'tune' end part from b union all
select tid, 'test' from t where us > {Q.EPOCH + 6 * 3_600_000_000}""")
def split_at_moment(spark, sf_dir):
    """ML-2: a dated cut; the rows before it fit and tune."""
    return metrics.split_at(events(spark, sf_dir), Q.EPOCH + 6 * 3_600_000_000).select("transaction_id", "part")


@query(f"""with {_S} select sum(label)::bigint pos, count(*) filter (label = 0) neg,
round(case when avg(label) < 0.005 then 1 else count(*) filter (label = 0) / sum(label) end, 6) weight from sc""")
def class_weights(spark, sf_dir):
    """ML-3."""
    return metrics.class_weight(scored(spark, sf_dir)).select("pos", "neg", _r("weight"))


_CURVE = f"""{_S}, g as (select score, count(*) n, sum(label) pos from sc group by score),
c as (select *, sum(n) over (order by score desc) alerts, sum(pos) over (order by score desc) caught,
(select sum(label) from sc) p, (select count(*) from sc) total from g)"""


@query(f"""with {_CURVE}, h as (select score, 2 * (caught / alerts) * (caught / p) / greatest(caught / alerts + caught / p, 1e-12) f1 from c)
select score cutoff, round(f1, 6) f1 from h order by h.f1 desc, score limit 1""")
def f1_cutoff(spark, sf_dir):
    """ML-6."""
    return metrics.best_f1_cutoff(scored(spark, sf_dir)).select("cutoff", _r("f1"))


@query(f"""with {_CURVE} select round(sum(pos * ((total - p) - (alerts - caught) + (n - pos) / 2)) / (max(p) * (max(total) - max(p))), 6) roc_auc,
round(sum(pos * caught / alerts) / max(p), 6) average_precision from c""")
def rank_metrics(spark, sf_dir):
    """ML-8."""
    return metrics.ranking(scored(spark, sf_dir)).select(_r("roc_auc"), _r("average_precision"))


_READ = """count(*) filter ({a} and label = 1) tp, count(*) filter ({a} and label = 0) fp,
count(*) filter (not ({a}) and label = 1) fn, count(*) filter (not ({a}) and label = 0) tn,
round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1"""


def _reading(df):
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")],
                     _r("precision"), _r("recall"), _r("f1"))


@query(f"with {_S} select {_READ.format(a='score >= 0.45')} from sc")
def confusion(spark, sf_dir):
    """ML-7."""
    return _reading(metrics.reading(scored(spark, sf_dir), F.col("score") >= 0.45))


@query(f"with {ALL}, x as (select *, round(raw, 4) >= 0.4 hit from r) select {_READ.format(a='hit')} from x")
def rules_alone(spark, sf_dir):
    """ML-11: the rules' own reading."""
    return _reading(metrics.reading(ruled(spark, sf_dir, "label"), F.col("cep_score") >= S.RULE_CUTOFF))


@query(f"""with {_S} select round(avg(pow(score - label, 2)), 6) brier, count(*) filter (score >= 0.4) n_alerts,
round(avg(case when score >= 0.9995 then 1 else 0 end) filter (score >= 0.4), 6) saturated_share,
count(distinct round(score, 3)) filter (score >= 0.4) distinct_scores,
round(median(score) filter (score >= 0.4), 6) median_alert_score from sc""")
def calibration(spark, sf_dir):
    """ML-9."""
    return metrics.calibration(scored(spark, sf_dir), 0.4).select(
        _r("brier"), "n_alerts", _r("saturated_share"), "distinct_scores", _r("median_alert_score"))


@query(f"""with {_S} select kind label_type, count(*) n, count(*) filter (score >= 0.6) caught,
round(count(*) filter (score >= 0.6) / count(*), 6) recall from sc where label = 1 group by kind""")
def recall_by_type(spark, sf_dir):
    """ML-10."""
    return metrics.recall_by_type(scored(spark, sf_dir), 0.6).select("label_type", "n", "caught", _r("recall"))


@query(f"""with {_S}, k as (select *, row_number() over (order by score desc, tid) rk, count(*) over () n, sum(label) over () pos from sc)
select count(*) budget_alerts, sum(label)::bigint budget_caught, max(pos)::bigint fraud, round(sum(label) / max(pos), 6) budget_recall,
round(sum(label) / count(*), 6) budget_precision from k where rk <= greatest(1, round(n * 0.02))""")
def alert_budget(spark, sf_dir):
    """ML-12: the riskiest 2 %."""
    return metrics.alert_budget(scored(spark, sf_dir)).select(
        "budget_alerts", "budget_caught", "fraud", _r("budget_recall"), _r("budget_precision"))


_PSI_FEATURES = ["amount", "secs_login", "sender_number", "noisy"]


def _psi_rows(spark, sf_dir):
    i = F.col("transaction_id").cast("bigint")
    rows = events(spark, sf_dir).withColumns({
        "sender_number": F.substring("sender_key", 2, 9).cast("double"),
        "noisy": F.when(i % 7 == 0, F.lit(float("nan"))).otherwise(F.col("amount") / 1000 * F.when(i % 2 == 0, 1).otherwise(3))})
    return rows.filter(i % 2 == 0), rows.filter(i % 2 == 1)


@query(f"""with {Q.E}, l as (select cast(tid as bigint) % 2 side, unnest([{{'f': 'amount', 'v': amount}}, {{'f': 'secs_login', 'v': secs}},
{{'f': 'sender_number', 'v': cast(substr(s, 2) as double)}},
{{'f': 'noisy', 'v': case when cast(tid as bigint) % 7 = 0 then null else amount / 1000 * case when cast(tid as bigint) % 2 = 0 then 1 else 3 end end}}]) u from t),
x as (select side, u.f feature, u.v v from l),
ed as (select feature, list_distinct(quantile_cont(v, [.1, .2, .3, .4, .5, .6, .7, .8, .9])) es from x where side = 0 and v is not null group by feature),
bn as (select x.feature, side, case when v is null then -1 else len(list_filter(es, lambda z: v >= z)) end b, len(es) ne from x join ed using (feature)),
ct as (select feature, b, count(*) filter (side = 0) p, count(*) filter (side = 1) q from bn group by feature, b),
fr as (select feature, max(ne) + 2 nb, count(*) filter (side = 0) np, count(*) filter (side = 1) nq from bn group by feature),
gr as (select feature, nb, np, nq, unnest(range(-1, nb - 1)) b from fr),
sh as (select gr.feature, (coalesce(p, 0) + .5) / (np + .5 * nb) ps, (coalesce(q, 0) + .5) / (nq + .5 * nb) qs from gr left join ct on ct.feature = gr.feature and ct.b = gr.b)
select feature, round(sum((qs - ps) * ln(qs / ps)), 6) psi, sum((qs - ps) * ln(qs / ps)) > 0.25 moved from sh group by feature""")
def psi_drift(spark, sf_dir):
    """ML-13, ML-14: drift per feature over the reference's deciles."""
    ref, cur = _psi_rows(spark, sf_dir)
    return metrics.psi(ref, cur, _PSI_FEATURES).select("feature", _r("psi"), "moved")


_ALL_FEATURES = ", ".join(f"{{'f': '{n}', 'v': round(cast({n} as double), 6)}}" for n in FULL.feature_names)


@query(f"""with {ALL}, l as (select cast(tid as bigint) % 2 side, unnest([{_ALL_FEATURES}]) u from f),
x as (select side, u.f feature, u.v v from l),
ed as (select feature, list_distinct(quantile_cont(v, [.1, .2, .3, .4, .5, .6, .7, .8, .9])) es from x where side = 0 group by feature),
bn as (select x.feature, side, len(list_filter(es, lambda z: v >= z)) b, len(es) ne from x join ed using (feature)),
ct as (select feature, b, count(*) filter (side = 0) p, count(*) filter (side = 1) q from bn group by feature, b),
fr as (select feature, max(ne) + 2 nb, count(*) filter (side = 0) np, count(*) filter (side = 1) nq from bn group by feature),
gr as (select feature, nb, np, nq, unnest(range(-1, nb - 1)) b from fr),
sh as (select gr.feature, (coalesce(p, 0) + .5) / (np + .5 * nb) ps, (coalesce(q, 0) + .5) / (nq + .5 * nb) qs from gr left join ct on ct.feature = gr.feature and ct.b = gr.b)
select feature, round(sum((qs - ps) * ln(qs / ps)), 3) psi, sum((qs - ps) * ln(qs / ps)) > 0.25 moved from sh group by feature""")
def psi_features(spark, sf_dir):
    """ML-13: drift of all features between two halves of the transfers."""
    names = FULL.feature_names
    rows = stored(features(spark, sf_dir, wanted=names).select(
        "transaction_id", *[F.round(F.col(n).cast("double"), 6).alias(n) for n in names]))
    half = F.col("transaction_id").cast("bigint") % 2
    return metrics.psi(rows.filter(half == 0), rows.filter(half == 1), names).select("feature", _r("psi", 3), "moved")


def _two_scores(spark, sf_dir):
    i = F.col("transaction_id").cast("bigint")
    return scored(spark, sf_dir).withColumns({"old": F.col("score"), "new": i * 104729 % 997 / 1000 * 0.5 + F.col("label") * 0.3})


_TWO = f"{_S}, tw as (select *, score old_s, cast(tid as bigint) * 104729 % 997 / 1000 * 0.5 + label * 0.3 new_s from sc)"


@query(f"""with {_TWO}, k as (select count(*) filter (old_s >= 0.45) k from tw), r as (select new_s, row_number() over (order by new_s desc) rn from tw)
select k alerts, round(new_s, 6) cutoff from r, k where rn = k""")
def same_workload(spark, sf_dir):
    """ML-17: the new cut that raises as many alerts as the old one."""
    return metrics.same_workload_cut(_two_scores(spark, sf_dir), "old", "new", 0.45).select("alerts", _r("cutoff"))


@query(f"with {_TWO} select count(*) as rows, round(max(abs(old_s - new_s)), 6) max_difference from tw")
def score_parity(spark, sf_dir):
    """ML-26: how far two scores of the same rows are apart."""
    two = _two_scores(spark, sf_dir)
    return metrics.max_difference(two.withColumn("score", F.col("old")), two.withColumn("score", F.col("new"))).select(
        "rows", _r("max_difference"))


@query(f"""with {_TWO} select round(avg(case when score >= 0.45 then 1 else 0 end) filter (cast(tid as bigint) % 2 = 0), 6) rate_then,
round(avg(case when score >= 0.45 then 1 else 0 end) filter (cast(tid as bigint) % 2 = 1), 6) rate_now from tw""")
def alert_rates(spark, sf_dir):
    """ML-15."""
    rows, i = scored(spark, sf_dir), F.col("transaction_id").cast("bigint")
    return metrics.alert_rates(rows.filter(i % 2 == 0), rows.filter(i % 2 == 1), 0.45).select(_r("rate_then"), _r("rate_now"))


@query(f"""with {_S} select tid transaction_id, score from sc where score < 0.45 order by score desc, tid limit 100""")
def band_pick(spark, sf_dir):
    """ML-20: the second look's band."""
    return metrics.second_look_band(scored(spark, sf_dir), 0.45).select("transaction_id", "score")


@query(f"""with {_S}, c as (select sum(label) f, least(sum(label), 500) k, sum(1 - label) l from sc), d as (select *, ceil(l / (1000 - k)) n from c)
select cast(n as bigint) pieces, cast(k * n as bigint) fraud_rows, cast(l as bigint) ordinary_rows, cast(k + ceil(l / n) as bigint) largest from d""")
def training_pieces(spark, sf_dir):
    """ML-21: the frauds (a sample of half a piece at most) in each piece, the rest dealt evenly."""
    dealt = metrics.training_pieces(scored(spark, sf_dir), 1000)
    per = dealt.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("f"))
    return per.agg(F.count(F.lit(1)).alias("pieces"), F.sum("f").cast("bigint").alias("fraud_rows"),
                   F.sum(F.col("n") - F.col("f")).cast("bigint").alias("ordinary_rows"), F.max("n").alias("largest"))


# --- Lookups and episodes -----------------------------------------------------------------

@query(f"""with {Q.E}, {Q.confirmed(DELAY)}, q as (select *, row_number() over (order by us, tid) - 1 k, count(*) over () n from t)
select account from conf where since <= (select us from q where k = floor(n * 0.8))""")
def history_seed(spark, sf_dir):
    """AJ-7: accounts confirmed by the start of the held-out slice."""
    t = events(spark, sf_dir)
    start = metrics.time_split(t).filter("part = 'test'").agg(F.min("event_us").alias("m")).select("m").scalar()
    return known_by(confirmed_from_labels(t, DELAY), start)


_PICKS = f"""{_SPLIT}, pk as (select kind, arg_min(tid, (us, tid)) tid from z where part = 'test' and label = 1 group by kind),
pick as (select t.* from t join pk using (tid))"""


@query(f"""with {_PICKS}, nr as (select a.tid pick_id, a.s ps, a.p pp, a.kind k0, b.* from pick a join t b on b.label = 1 and b.kind = a.kind
and abs(b.us - a.us) <= 21600000000), hb as (select *, case when count(*) filter (p = pp) over (partition by pick_id) > 1 then pp else ps end hub from nr)
select pick_id, tid transaction_id, k0 label_type from hb where case when k0 = 'MULE' then s = hub or p = hub else s = ps end""")
def episode_window(spark, sf_dir):
    """AJ-8, AJ-9: frauds of one kind around a chosen one, or through a mule."""
    t = events(spark, sf_dir)
    return lookups.episodes(t, lookups.picks(t)).select("pick_id", "transaction_id", "label_type")


@query(f"""with {_PICKS}, h as (select a.tid pick_id, b.tid, row_number() over (partition by a.tid order by b.us desc, b.tid desc) back
from pick a join t b on b.s = a.s and (b.us, b.tid) < (a.us, a.tid)) select pick_id, tid transaction_id, back from h where back <= 8""")
def sender_history(spark, sf_dir):
    """AJ-10: the last eight transfers before a chosen one."""
    t = events(spark, sf_dir)
    return lookups.sender_history(t, lookups.picks(t)).select("pick_id", "transaction_id", F.col("back").cast("bigint").alias("back"))


@query(f"""with {_PICKS}, pr as (select tid, us, s, p, amount, tiyin, region, call, secs from t union all
select tid || '-probe', us - 60000000, s, p, 1000, 100000, region, call, secs from pick)
select a.tid transaction_id, 1 + count(b.tid) filter (b.us >= a.us - 600000000) vel_10m,
cast(count(b.tid) filter (b.p = a.p) = 0 as int) is_new_payee
from pr a left join pr b on b.s = a.s and (b.us, b.tid) < (a.us, a.tid) group by a.tid""")
def test_transfer_probe(spark, sf_dir):
    """ML-28: a small earlier transfer to the same payee, and the features it changes."""
    t = events(spark, sf_dir)
    return transfer_features(lookups.test_transfer_probe(t, lookups.picks(t))).select(
        "transaction_id", "vel_10m", "is_new_payee")
