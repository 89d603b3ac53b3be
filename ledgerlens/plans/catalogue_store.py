"""Named queries over wire records, decisions, cases and the audit log, all derived from `orders`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .. import settings as S
from ..functions import envelope, phrases, scalars
from ..operators import audit, cases as C, decision, lookups, queue
from ..sources import ingest
from ..sources.files import shared_folder, stored
from . import dashboards as D
from . import model, training
from .catalogue import _SPLIT, ALL, events, features, query, scored
from ..operators import metrics
from ..operators.features import FEATURES
from ..operators.rules import with_rules
from ..profile import FULL, Profile

NOW = 2_000_000_000      # epoch seconds, after everything derived here

# Decision records, in SQL both engines read. `k` is the order's number.
RECORD = {
    "transaction_id": "case when k % 41 = 0 then concat('replay-', cast(k as string)) else cast(k as string) end",
    "event_us": "days * 60000000 + 1600000000000000",
    "sender_card": "concat('860033', lpad(cast(o_custkey as string), 10, '0'))",
    "receiver_card": "concat(case when k % 3 = 0 then '986001' when k % 3 = 1 then '860003' else '999999' end, "
                     "lpad(cast(k % 40 as string), 10, '0'))",
    "amount_uzs": "cast(floor(o_totalprice * 20) as bigint)",
    "ml_score": "case when k % 11 <> 0 then (k * 7919 % 1000) / 1e3 end",
    "cep_score": "(k % 8) / 1e1",
    "final_score": "case when k % 11 <> 0 then (k * 7919 % 1000) / 1e3 else (k % 8) / 1e1 end",
    "hits": "case when k % 9 = 0 then 'STRUCTURING' when k % 7 = 0 then 'VELOCITY,MULE_FAN_IN' else '' end",
    "decision": "case when k % 9 = 0 or (k * 7919 % 1000) >= 900 then 'REVIEW' "
                "when (k * 7919 % 1000) >= 800 then 'SECOND_LOOK' else 'ALLOW' end",
    "predicted_type": "case when k % 9 = 0 then 'STRUCTURING' when k % 7 = 0 then 'ATO' end",
    "model_version": "case when k % 11 <> 0 then 'cep+ml-fusion-v2' else 'cep-only-fallback' end",
    "ingested_at": "case when k % 13 <> 0 then 1700000000 + days * 60 + (k % 100) / 1e1 end",
    "scored_at_job": "1700000000 + days * 60 + (k % 100) / 1e1 + ((k * 31) % 97) * 5 / 1e3",
}
_BASE = "select o_orderkey k, o_custkey, o_totalprice, {days} as days from orders"
ROWS = ("base as (" + _BASE.format(days="date_diff('day', date '1992-01-01', cast(o_orderdate as date))") + "), "
        "rec as (select k, " + ", ".join(f"{e} as {n}" for n, e in RECORD.items()) + " from base)")
# The second look's answers come later and replace the wait.
ANSWERS = """ans as (select * replace (case when k % 2 = 0 then 'REVIEW' else 'ALLOW' end as decision,
case when k % 10 = 4 then 'second-look:m1:unscored' else 'second-look:m1' end as model_version, scored_at_job + 1 as scored_at_job)
from rec where decision = 'SECOND_LOOK' and k % 4 <> 3),
rec_all as (select * from rec union all select * from ans),
fin as (select * from rec_all qualify row_number() over (partition by transaction_id order by decision = 'SECOND_LOOK', scored_at_job desc) = 1)"""
STORE = f"{ROWS}, {ANSWERS}"


def records(spark, sf_dir) -> DataFrame:
    """The job's records and the second look's answers."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = o.selectExpr("o_orderkey k", "o_custkey", "o_totalprice",
                        "cast(datediff(cast(o_orderdate as date), date '1992-01-01') as bigint) days")
    rec = base.selectExpr("k", *[f"{e} as {n}" for n, e in RECORD.items()])
    answers = rec.filter("decision = 'SECOND_LOOK' and k % 4 <> 3").withColumns({
        "decision": F.expr("if(k % 2 = 0, 'REVIEW', 'ALLOW')"),
        "model_version": F.expr("if(k % 10 = 4, 'second-look:m1:unscored', 'second-look:m1')"),
        "scored_at_job": F.col("scored_at_job") + 1})
    empty = F.array().cast("array<string>")
    return rec.unionByName(answers).withColumns({
        "rule_hits": F.when(F.col("hits") == "", empty).otherwise(F.split("hits", ",")),
        "event_time": F.timestamp_micros("event_us"), "scored_at": F.col("scored_at_job"),
        "decision_ms": scalars.span_ms(F.col("ingested_at") * 1e6, F.col("scored_at_job") * 1e6)})


def final(spark, sf_dir) -> DataFrame:
    return decision.final_decisions(records(spark, sf_dir))


def case_versions(spark, sf_dir, case_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(every case version: opened, reopened with reasons, judged, judged again; rejected verdicts). With `case_id` of that case only:
    the filter reaches the decisions before anything is grouped or stored."""
    rows = final(spark, sf_dir)
    held = stored(rows if case_id is None else rows.filter(F.col("transaction_id") == case_id))
    reasons = F.array(F.concat(F.lit("amount: "), F.col("amount_uzs").cast("string"), F.lit(" UZS (+0.50)")))
    opened = C.open_cases(held).unionByName(C.open_cases(held.filter("k % 2 = 0").withColumns(
        {"explanation": reasons, "explanation_status": F.lit("OK")})))
    k, tid = F.col("k"), F.col("transaction_id").alias("case_id")
    first = held.filter("k % 3 <> 0").select(
        tid, F.when(k % 3 == 1, "CONFIRMED_FRAUD").otherwise("FALSE_POSITIVE").alias("verdict"),
        F.when(k % 101 == 0, "").otherwise("ann").alias("by"), (F.col("scored_at_job") + 60 + k % 1000).alias("at"))
    again = held.filter("k % 15 = 1").select(tid, F.lit("FALSE_POSITIVE").alias("verdict"), F.lit("bob").alias("by"),
                                             (F.col("scored_at_job") + 5000).alias("at"))
    rows1, bad1 = C.resolve(opened, first)
    judged = stored(opened.unionByName(rows1))
    rows2, bad2 = C.resolve(judged, again)
    return judged.unionByName(rows2), bad1.unionByName(bad2)


CASES = f"""{STORE}, hold as (select * from fin where decision = 'REVIEW'),
ver as (select *, case when k % 15 = 1 then 'FALSE_POSITIVE' when k % 3 = 1 and k % 101 <> 0 then 'CONFIRMED_FRAUD'
when k % 3 = 2 and k % 101 <> 0 then 'FALSE_POSITIVE' else 'NEW' end disposition,
case when k % 15 = 1 then 'bob' when k % 3 <> 0 and k % 101 <> 0 then 'ann' else '' end resolved_by,
case when k % 15 = 1 then scored_at_job + 5000 when k % 3 <> 0 and k % 101 <> 0 then scored_at_job + 60 + k % 1000 else 0 end resolved_at,
case when k % 2 = 0 then 'OK' else '' end explanation_status from hold)"""


def cases(spark, sf_dir) -> DataFrame:
    return C.latest_cases(case_versions(spark, sf_dir)[0])


# --- Wire ---------------------------------------------------------------------------------

_WIRE = f"""{ROWS}, wire as (select k, transaction_id, cast(to_timestamp(event_us // 1000000) at time zone 'UTC' as varchar) event_time,
'p' || o_custkey pinfl, sender_card, receiver_card, amount_uzs from rec join base using (k))"""


def wire(spark, sf_dir) -> DataFrame:
    """Raw messages; some fields are damaged by the row's number."""
    o = records(spark, sf_dir).filter("model_version not like 'second-look%'")
    number = F.substring("sender_card", 7, 10).cast("bigint").cast("string")
    return o.select(
        "k", "transaction_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        F.concat(F.lit("p"), number).alias("sender_pinfl"), "sender_card", F.lit("HUMO").alias("sender_network"),
        "receiver_card", F.lit("HUMO").alias("receiver_network"),
        F.when(F.col("k") % 19 == 0, F.lit(None).cast("string")).when(F.col("k") % 23 == 0, "-5")
        .when(F.col("k") % 29 == 0, "NaN").when(F.col("k") % 31 == 0, "many")
        .otherwise(F.col("amount_uzs").cast("string")).alias("amount_uzs"),
        F.lit("d").alias("device_id"), F.when(F.col("k") % 2 == 0, "Navoi").alias("sender_region"),
        F.lit("0").alias("sender_balance_before"),
        F.when(F.col("k") % 5 == 0, "False").when(F.col("k") % 5 == 1, " N ").otherwise("yes").alias("active_call"),
        F.when(F.col("k") % 37 == 0, "-1").when(F.col("k") % 43 == 0, "inf").when(F.col("k") % 2 == 0, "12.5")
        .alias("secs_login_to_confirm"))


@query(f"""with {_WIRE}, x as (select *, case when k % 19 = 0 then '' when k % 23 = 0 then '-5' when k % 29 = 0 then 'NaN' when k % 31 = 0 then 'many'
else cast(amount_uzs as varchar) end amt from wire) select transaction_id, sha256(concat(transaction_id, chr(31), event_time, chr(31), pinfl, chr(31), sender_card, chr(31),
receiver_card, chr(31), amt, chr(31), case when k % 2 = 0 then 'Navoi' else '' end)) ingress_hash from x""")
def ingress_hash(spark, sf_dir):
    """ING-3."""
    return wire(spark, sf_dir).select("transaction_id", audit.ingress_hash().alias("ingress_hash"))


_REASON = """case when k % 53 = 0 then 'undecodable' when k % 19 = 0 then 'amount missing' when k % 23 = 0 then 'amount not finite or negative'
when k % 29 = 0 then 'amount not finite or negative' when k % 31 = 0 then 'amount is no number'
when k % 37 = 0 then 'seconds not finite or negative' when k % 43 = 0 then 'seconds not finite or negative' end"""


def _decoded(spark, sf_dir):
    messages = wire(spark, sf_dir)
    # Whole numbers travel as texts here; a damaged record is cut short.
    sent = ingest.to_wire(messages).withColumn(
        "value", F.when(F.get_json_object("value", "$.k").cast("bigint") % 53 == 0, F.expr("left(value, 40)"))
        .otherwise(F.col("value")))
    return ingest.decode(sent)


@query(f"with {_WIRE} select {_REASON} reject_reason, count(*) n from wire where {_REASON} is not null group by 1")
def quarantine(spark, sf_dir):
    """ING-1, ING-4, ING-7..9, AGG-12: decode, judge, count what cannot be scored."""
    return D.rejected_counts(ingest.split_usable(_decoded(spark, sf_dir))[1])


@query(f"""with {_WIRE} select transaction_id, event_us, sender_card sender_key, receiver_card payee_key, cast(amount_uzs as double) amount,
case when k % 5 < 2 then 0 else 1 end active_call, case when k % 2 = 0 then 12.5 else 0 end secs_login
from wire join rec using (k, transaction_id, sender_card, receiver_card, amount_uzs) where {_REASON} is null""")
def usable_transfers(spark, sf_dir):
    """ING-10..12, SC-1, SC-8: usable events as typed, keyed transfers."""
    from ..contract import to_transfers
    usable = ingest.deduplicated(ingest.split_usable(_decoded(spark, sf_dir))[0])
    return to_transfers(usable).select("transaction_id", "event_us", "sender_key", "payee_key", "amount", "active_call", "secs_login")


@query(f"""with {_WIRE} select sender_card routing, transaction_id, event_time, receiver_card, case when k % 19 = 0 then null when k % 23 = 0 then '-5'
when k % 29 = 0 then 'NaN' when k % 31 = 0 then 'many' else cast(amount_uzs as varchar) end amount_uzs, case when k % 2 = 0 then 'Navoi' end sender_region,
case when k % 5 = 0 then 'False' when k % 5 = 1 then ' N ' else 'yes' end active_call from wire""")
def envelope_roundtrip(spark, sf_dir):
    """ING-5, ING-6: sealed and opened again, every field as it was; a re-addressed record does not open."""
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    sealed = ingest.to_wire(wire(spark, sf_dir), key)
    moved = sealed.withColumn("value", F.regexp_replace("value", "^FDE1:8", "FDE1:9"))
    return ingest.decode(sealed.unionByName(moved), key).filter("decoded").select(
        "routing", "transaction_id", "event_time", "receiver_card", "amount_uzs", "sender_region", "active_call")


# --- Cards --------------------------------------------------------------------------------

def banks(spark, sf_dir) -> DataFrame:
    """A registry of one BIN for each region of the table."""
    r, k = spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("r_regionkey")
    return r.select(F.when(k == 0, "986001").when(k == 1, "860003").otherwise(F.concat(F.lit("40000"), k.cast("string"))).alias("bin"),
                    F.lpad(F.col("r_regionkey").cast("string"), 5, "0").alias("code"), F.col("r_name").alias("name"))


@query(f"""with {ROWS}, b as (select case r_regionkey when 0 then '986001' when 1 then '860003' else '40000' || r_regionkey end bin, lpad(cast(r_regionkey as varchar), 5, '0') code, r_name name
from region) select transaction_id, coalesce(b.code, '00000') bank_code, coalesce(b.name, 'UNKNOWN') bank_name,
case when receiver_card like '8600%' then 'UzCard' when receiver_card like '9860%' then 'HUMO' end network
from rec left join b on substr(receiver_card, 1, 6) = b.bin""")
def bin_lookup(spark, sf_dir):
    """SC-12, SC-13, SRC-8: issuing bank and network of a card."""
    rows = records(spark, sf_dir).filter("model_version not like 'second-look%'")
    return lookups.issuing_bank(rows, banks(spark, sf_dir), "receiver_card").select(
        "transaction_id", "bank_code", "bank_name", scalars.card_network(F.col("receiver_card")).alias("network"))


@query(f"""with {ROWS}, dg as (select transaction_id, sender_card, list_sum(list_transform(range(1, 17), lambda i:
case when i % 2 = 0 then cast(sender_card[i] as int) when cast(sender_card[i] as int) * 2 > 9 then cast(sender_card[i] as int) * 2 - 9 else cast(sender_card[i] as int) * 2 end)) sm from rec)
select transaction_id, substr(sender_card, 1, 4) || ' ' || substr(sender_card, 5, 2) || '** **** ' || right(sender_card, 4) masked, sm % 10 = 0 luhn from dg""")
def card_mask(spark, sf_dir):
    """SC-9, SC-14."""
    rows = records(spark, sf_dir).filter("model_version not like 'second-look%'")
    return rows.select("transaction_id", scalars.mask_card(F.col("sender_card")).alias("masked"),
                       F.expr("luhn_check(sender_card)").alias("luhn"))


_FLT = {"sender": "860033", "receiver": "07", "min": 1_000_000, "max": 9_000_000, "since": 1_700_000_000.0, "type": "NONE"}


@query(f"""with {STORE}, x as (select * from fin where sender_card like '860033%' and (receiver_card like '07%' or receiver_card like '%07')
and amount_uzs between 1000000 and 9000000 and scored_at_job >= 1700000000 and predicted_type is null)
select transaction_id, amount_uzs, count(*) over () passing from x order by scored_at_job desc, transaction_id limit 20""")
def card_filter(spark, sf_dir):
    """SC-10, SC-11, TOP-4: the newest decisions that pass a filter, and how many pass."""
    return queue.latest_decisions(final(spark, sf_dir), _FLT, 20).select("transaction_id", "amount_uzs", "passing")


# --- Decisions ----------------------------------------------------------------------------

@query(f"with {STORE} select transaction_id, decision, model_version, final_score from fin")
def final_decision(spark, sf_dir):
    """AJ-11: an answer replaces the wait for it."""
    return final(spark, sf_dir).select("transaction_id", "decision", "model_version", "final_score")


_HELD = "ml_score is not null and ml_score >= 0.9"
_RULE = "ml_score is null or hits = 'STRUCTURING'"


@query(f"""with {STORE} select transaction_id, case when model_version like 'second-look%' then 'SECOND_LOOK'
else concat_ws(',', case when {_HELD} then 'MODEL' end, case when {_RULE} then 'RULE' end) end held_by,
case when model_version like 'second-look%' then ml_score else final_score end score,
case when model_version like 'second-look%' and model_version not like '%:unscored' then final_score end second_score from fin where decision = 'REVIEW'""")
def held_by(spark, sf_dir):
    """SC-19, CA-5."""
    rows = final(spark, sf_dir).filter("decision = 'REVIEW'")
    return rows.select("transaction_id", F.array_join(decision.held_by(0.9), ",").alias("held_by"),
                       *[c.alias(n) for n, c in decision.both_scores().items()])


@query(f"with {STORE} select decision, count(*) records, count(distinct transaction_id) transfers from rec_all group by decision")
def decision_counts(spark, sf_dir):
    """AGG-5."""
    return D.decision_counts(records(spark, sf_dir))


_MS = "round((scored_at_job * 1e6 - ingested_at * 1e6) / 1e3, 3)"


@query(f"""with {STORE}, m as (select *, {_MS} ms from rec), o as (select ms, row_number() over (order by ms) - 1 r, count(*) over () c from m where ms is not null)
select (select count(*) from m) checked, (select count(*) from m where decision = 'REVIEW') held,
round((select avg(case when decision = 'REVIEW' then 1 else 0 end) from m), 6) share_held,
(select ms from o where r = floor(0.5 * c)) median_ms, (select ms from o where r = floor(0.99 * c)) p99_ms""")
def top_row(spark, sf_dir):
    """AGG-6, AGG-7: nearest-rank median and p99 of the decision time."""
    rows = records(spark, sf_dir).filter("model_version not like 'second-look%'").withColumn("decision_ms", F.round("decision_ms", 3))
    return D.top_row(rows).select("checked", F.col("held").cast("bigint").alias("held"),
                                  F.round("share_held", 6).alias("share_held"), "median_ms", "p99_ms")


@query(f"""with {STORE}, x as (select * from fin where event_us > (select max(event_us) from fin) - 3600000000)
select count(*) checked, count(*) filter (decision = 'REVIEW') held, round(count(*) filter (decision = 'REVIEW') / count(*), 6) share_held from x""")
def last_hour_row(spark, sf_dir):
    """AGG-7: the top row over the last hour."""
    return D.top_row(D.last_hour(final(spark, sf_dir))).select("checked", F.col("held").cast("bigint").alias("held"),
                                                              F.round("share_held", 6).alias("share_held"))


@query(f"""with {STORE}, h as (select * from fin where decision = 'REVIEW') select transaction_id, amount_uzs, (select count(*) from h) passing
from h order by scored_at_job desc, transaction_id limit 50""")
def latest_holds(spark, sf_dir):
    """AGG-10: the latest 50 holds."""
    return queue.latest_decisions(final(spark, sf_dir), {"decision": "REVIEW"}, 50).select("transaction_id", "amount_uzs", "passing")


@query(f"with {STORE}, m as (select {_MS} ms from rec) select " + ", ".join(
    f"round(avg(case when ms < {n} then 1 else 0 end) filter (ms is not null), 6) under_{n}_ms" for n in D.LATENCY_LIMITS_MS) + " from m")
def latency_share(spark, sf_dir):
    """AGG-8, SC-15."""
    rows = records(spark, sf_dir).filter("model_version not like 'second-look%'").withColumn("decision_ms", F.round("decision_ms", 3))
    return D.speed(rows).select(*[F.round(f"under_{n}_ms", 6).alias(f"under_{n}_ms") for n in D.LATENCY_LIMITS_MS])


@query(f"""with {ROWS} select round(avg((k % 17) / 10) filter (k % 13 <> 0), 6) kafka, round(avg((k % 7) / 100), 6) handoff,
round(avg(k % 5) filter (k % 4 = 0), 6) rules from rec""")
def stage_means(spark, sf_dir):
    """AGG-8, SC-16, SC-17: stages from stamps and from the job's map; an untimed one is null."""
    k, base = F.col("k"), F.lit(1_700_000_000.0)
    rows = records(spark, sf_dir).filter("model_version not like 'second-look%'").withColumn(
        "stage_ms", F.map_concat(
            D.before_operator(F.when(k % 13 != 0, base), base + (k % 17) / 10000, base + (k % 17) / 10000 + (k % 7) / 100000),
            F.when(k % 4 == 0, F.create_map(F.lit("rules"), (k % 5).cast("double"))).otherwise(F.create_map().cast("map<string,double>"))))
    return D.stage_means(rows.select("*", *[c.alias(n) for n, c in D.stage_columns().items()])).select(
        F.round("kafka", 6).alias("kafka"), F.round("handoff", 6).alias("handoff"), F.round("rules", 6).alias("rules"))


@query(f"""with {STORE}, h as (select event_us // 3600000000 hr, case when decision <> 'REVIEW' then 'none'
when model_version like '%:unscored' then 'no answer' when model_version like 'second-look%' then 'second look'
when {_RULE} then 'rules: ' || coalesce(predicted_type, 'other') else 'model' end holder from fin)
select hr as hour_number, holder, count(*) n from h group by hr, holder""")
def holds_over_time(spark, sf_dir):
    """AGG-9."""
    return D.holds_over_time(final(spark, sf_dir), 0.9, "1 hour").select(
        F.floor(F.unix_micros("minute") / 3_600_000_000).alias("hour_number"), "holder", "n")


@query(f"""with {STORE} select count(*) filter (decision = 'SECOND_LOOK') sent,
count(*) filter (decision = 'REVIEW' and model_version like 'second-look%' and model_version not like '%:unscored') held,
count(*) filter (decision = 'REVIEW' and model_version like 'second-look%:unscored') unanswered from rec_all""")
def second_look_panel(spark, sf_dir):
    """AGG-11."""
    return D.second_look_panel(records(spark, sf_dir)).select(*[F.col(c).cast("bigint").alias(c) for c in ("sent", "held", "unanswered")])


@query("""with r as (select o_orderkey, o_totalprice, o_orderdate from orders)
select cast(o_orderkey as bigint) logged, round(o_totalprice, 2) served_f1 from r order by o_orderdate desc, o_orderkey limit 10""")
def last_retrains(spark, sf_dir):
    """TOP-5: the ten newest runs, of a run for each order."""
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.struct(F.col("o_orderdate"), (-F.col("o_orderkey")).alias("n")).alias("run_at"),
        F.col("o_orderkey").alias("logged"), F.round("o_totalprice", 2).alias("served_f1"))
    return D.last_retrains(runs).select("logged", "served_f1")


# --- Cases --------------------------------------------------------------------------------

@query(f"""with {CASES} select transaction_id case_id, disposition, resolved_by, cast(round(resolved_at * 1000) as bigint) resolved_ms,
explanation_status, amount_uzs, hits from ver""")
def latest_case(spark, sf_dir):
    """WIN-5, CA-1, CA-2: the highest version per case."""
    judged = F.col("disposition") != "NEW"
    status = F.col("explanation_status")
    return cases(spark, sf_dir).select("case_id", "disposition", "resolved_by",
                                       F.round(F.unix_micros("resolved_at") / 1000).cast("bigint").alias("resolved_ms"),
                                       status, "amount_uzs", F.array_join("rule_hits", ",").alias("hits"))


@query(f"with {STORE} select transaction_id case_id, 'nobody named' reason from fin where k % 3 <> 0 and k % 101 = 0 union all "
       "select transaction_id, 'no such case' from fin where decision <> 'REVIEW' and k % 3 <> 0 and k % 101 <> 0 union all "
       "select transaction_id, 'no such case' from fin where decision <> 'REVIEW' and k % 15 = 1")
def refused_verdicts(spark, sf_dir):
    """CA-2: verdicts that cannot stand."""
    return case_versions(spark, sf_dir)[1].select("case_id", "reason")


@query(f"""with {CASES} select transaction_id case_id, amount_uzs, final_score from ver where disposition = 'NEW'
order by amount_uzs desc, final_score desc, scored_at_job, transaction_id limit 20""")
def open_queue(spark, sf_dir):
    """TOP-1."""
    return queue.open_queue(cases(spark, sf_dir)).select("case_id", "amount_uzs", "final_score")


@query(f"""with {CASES} select transaction_id case_id, disposition from ver where disposition <> 'NEW' and resolved_at >= 1700050000
order by round(resolved_at * 1e6) desc, transaction_id limit 20""")
def resolved_verdicts(spark, sf_dir):
    """TOP-2."""
    since = F.timestamp_seconds(F.lit(1_700_050_000))
    return queue.resolved_since(cases(spark, sf_dir), since).select("case_id", "disposition")


@query(f"with {CASES} select transaction_id case_id, amount_uzs, disposition from ver where transaction_id = '100'")
def case_lookup(spark, sf_dir):
    """TOP-3: one case; no other decision is grouped or stored for it."""
    return C.latest_cases(case_versions(spark, sf_dir, "100")[0]).select("case_id", "amount_uzs", "disposition")


@query(f"""with {CASES} select transaction_id case_id, case when model_version like 'second-look%' then 'held by the second look; ' else '' end ||
case when hits <> '' then replace(hits, ',', ', ') when explanation_status = 'OK' then 'model: amount: ' || amount_uzs || ' UZS (+0.50)'
else '(unexplained: none)' end reason from ver where disposition = 'NEW'""")
def queue_reasons(spark, sf_dir):
    """SC-22. A judged case keeps its reasons, so only open ones are listed."""
    rows = cases(spark, sf_dir).filter("disposition = 'NEW'")
    return rows.select("case_id", queue.reason_text().alias("reason"))


@query(f"""with {CASES} select count(*) filter (disposition = 'NEW') waiting, count(*) filter (disposition = 'CONFIRMED_FRAUD') blocked,
count(*) filter (disposition = 'FALSE_POSITIVE') released, count(*) filter (disposition <> 'NEW') resolved, 0 reported,
count(*) filter (explanation_status = 'OK') explained,
round(count(*) filter (disposition = 'CONFIRMED_FRAUD') / count(*) filter (disposition <> 'NEW'), 6) as precision from ver""")
def verdict_stats(spark, sf_dir):
    """AGG-3, AGG-10."""
    return queue.verdict_stats(cases(spark, sf_dir)).select(
        *[F.col(c).cast("bigint").alias(c) for c in ("waiting", "blocked", "released", "resolved", "reported", "explained")],
        F.round("precision", 6).alias("precision"))


@query(f"with {CASES} select case when explanation_status = '' then '(none)' else explanation_status end status, count(*) n from ver group by 1")
def explanation_coverage(spark, sf_dir):
    """AGG-3."""
    return queue.explanation_coverage(cases(spark, sf_dir))


@query(f"""with {CASES}, w as (select *, round((case when disposition = 'NEW' then {NOW} else resolved_at end) * 1e6) - round(scored_at_job * 1e6) wait from ver)
select d.disposition, count(w.k) n, coalesce(sum(amount_uzs), 0)::bigint amount, round(median(wait) / 1e6, 3) median_s, round(max(wait) / 1e6, 3) max_s
from (values ('NEW'), ('CONFIRMED_FRAUD'), ('FALSE_POSITIVE')) d(disposition) left join w using (disposition) group by d.disposition""")
def hold_summary(spark, sf_dir):
    """AGG-4: money and waits per disposition."""
    return queue.hold_summary(cases(spark, sf_dir), NOW * 1_000_000).select(
        "disposition", "n", "amount", F.round("median_s", 3).alias("median_s"), F.round("max_s", 3).alias("max_s"))


@query(f"""with {CASES} select transaction_id case_id, decision, 'CONFIRMED_FRAUD' disposition, 'client' resolved_by, amount_uzs
from fin where k % 17 = 0""")
def client_reports(spark, sf_dir):
    """CA-3: reported transfers; one that was let go keeps the system's decision."""
    versions = case_versions(spark, sf_dir)[0]
    rows = records(spark, sf_dir)
    reports = rows.filter("k % 17 = 0 and model_version not like 'second-look%'").select(
        "transaction_id", F.lit("client").alias("by"), F.lit(NOW * 1.0).alias("at"))
    return C.report(versions, rows, reports).select("case_id", "decision", "disposition", "resolved_by", "amount_uzs")


@query(f"""with {CASES} select receiver_card account from ver where disposition = 'CONFIRMED_FRAUD' union select receiver_card from rec where k < 3""")
def confirmed_accounts(spark, sf_dir):
    """CA-4, ST-11: accounts that a confirmed case or the history still names."""
    history = records(spark, sf_dir).filter("k < 3").select(F.col("receiver_card").alias("account"))
    return C.confirmed_now(case_versions(spark, sf_dir)[0], history)


_SPANS = f"""{CASES}, jd as (select transaction_id id, receiver_card account, k, round(scored_at_job * 1e6) + (60 + k % 1000) * 1000000 a1,
round(scored_at_job * 1e6) + 5000000000 a2 from hold where k % 3 <> 0 or k % 15 = 1),
sp as (select account, cast(a1 as bigint) a, case when k % 15 = 1 then cast(a2 as bigint) end b from jd where k % 3 = 1 and k % 101 <> 0),
pt as (select distinct account, a u from sp union select account, b from sp where b is not null)"""


@query(f"""with {_SPANS}, cov as (select account, u, exists (select 1 from sp where sp.account = pt.account and a <= u and (b is null or b > u)) held_after,
exists (select 1 from sp where sp.account = pt.account and a < u and (b is null or b >= u)) held_before from pt),
ed as (select * from cov where held_after <> held_before), nx as (select *, lead(u) over (partition by account order by u) to_us from ed)
select account, u from_us, to_us from nx where held_after""")
def confirmed_intervals(spark, sf_dir):
    """CA-4 over time: disjoint intervals for as-of use."""
    return C.confirmed_intervals(case_versions(spark, sf_dir)[0])


# --- Retraining ---------------------------------------------------------------------------

@query(f"""with {STORE}, q as (select k, row_number() over (order by event_us, transaction_id) - 1 p, count(*) over () n, transaction_id from rec),
ho as (select transaction_id from q where p >= floor(n * 0.8)) select transaction_id from fin where transaction_id not like 'replay-%'
and transaction_id not in (select transaction_id from ho)""")
def replay_antijoin(spark, sf_dir):
    """AJ-6: no marked replays, none of the held-out days."""
    rows = records(spark, sf_dir).filter("model_version not like 'second-look%'")
    held = lookups.held_out_ids(rows.select("transaction_id", "event_us"))
    return lookups.without_replays(final(spark, sf_dir), held).select("transaction_id")


@query(f"""with {CASES}, lt as (select * from rec_all qualify row_number() over (partition by transaction_id order by scored_at_job desc) = 1),
x as (select transaction_id, scored_at_job, coalesce((select 1 from ver where ver.transaction_id = lt.transaction_id and disposition = 'CONFIRMED_FRAUD'), 0) as label
from lt where k % 6 <> 0 and transaction_id not like 'replay-%')
select transaction_id, label from x where scored_at_job <= (select max(scored_at_job) from x) - 20000""")
def settled_labels(spark, sf_dir):
    """ML-16, ML-18, AJ-5, WIN-6: newest whole decisions per transfer, labelled, old enough."""
    rows = records(spark, sf_dir).withColumn(
        "features", F.when(F.col("k") % 6 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))))
    none = rows.filter("false").select("transaction_id")
    logged = training.logged_decisions(rows, cases(spark, sf_dir), none, 2)
    return metrics.settled(logged, "scored_at_job", 20_000).select("transaction_id", F.col("label"))


# --- Audit --------------------------------------------------------------------------------

def audit_log(spark, sf_dir) -> DataFrame:
    decided = final(spark, sf_dir)
    core = audit.audit_core(decided.select(
        "transaction_id", "event_time", "decision", "final_score", "model_version", "rule_hits",
        F.sha2(F.col("transaction_id"), 256).alias("ingress_hash")))
    return stored(audit.append_chain(core, ["event_time", "transaction_id"], audit.chains_for(decided.count())))


_CHAINED = f"""{STORE}, chained as (select *, cast('0x' || substr(md5(transaction_id), 1, 8) as bigint)
% (select greatest(8, (count(*) + 999999) // 1000000) from fin) chain_id from fin),
placed as (select *, row_number() over (partition by chain_id order by event_us, transaction_id) - 1 seq from chained)"""


@query(f"with {_CHAINED} select chain_id, seq, transaction_id, decision, sha256(transaction_id) ingress_hash from placed")
def audit_chain(spark, sf_dir):
    """AU-1..3: chains in time order. Their hashes are checked by `audit_intact`."""
    return audit_log(spark, sf_dir).select("chain_id", F.col("seq").cast("bigint").alias("seq"), "transaction_id",
                                           "decision", "ingress_hash")


@query(f"""with recursive {_CHAINED}, core as (select chain_id, seq, transaction_id, sha256(transaction_id) ingress from placed),
walk as (select chain_id, seq, repeat('0', 64) prev_hash, sha256(concat_ws(chr(31), repeat('0', 64), '0', ingress, transaction_id)) record_hash
from core where seq = 0 union all select c.chain_id, c.seq, w.record_hash,
sha256(concat_ws(chr(31), w.record_hash, cast(c.seq as varchar), c.ingress, c.transaction_id)) from walk w join core c
on c.chain_id = w.chain_id and c.seq = w.seq + 1) select * from walk""")
def audit_hashes(spark, sf_dir):
    """AU-1..3: every link's hashes, for records whose payload is their id."""
    core = final(spark, sf_dir).select("transaction_id", "event_time", F.sha2(F.col("transaction_id"), 256).alias("ingress_hash"),
                                       F.col("transaction_id").alias("payload"))
    log = audit.append_chain(core, ["event_time", "transaction_id"], audit.chains_for(core.count()))
    return log.select("chain_id", F.col("seq").cast("bigint").alias("seq"), "prev_hash", "record_hash")


@query(f"""with {_CHAINED}, n as (select chain_id, count(*) records, max(seq) last_seq, arg_max(transaction_id, seq) newest from placed group by chain_id)
select chain_id, records, last_seq, newest, case when last_seq >= 20 then 1 else 0 end findings from n""")
def audit_window(spark, sf_dir):
    """AU-5: each chain's head, and what a check of its last 20 records finds: a record that was altered 10 before the end, and
    none of those altered before that."""
    log = audit_log(spark, sf_dir)
    heads = stored(audit.chain_heads(log))
    back = heads.select("chain_id", F.col("last_seq").alias("_last"))
    damaged = log.join(back, "chain_id").withColumn("ingress_hash", F.when(
        F.col("_last") - F.col("seq") >= 20, "0").when((F.col("_last") - F.col("seq") == 10) & (F.col("_last") >= 20), "0")
        .otherwise(F.col("ingress_hash"))).drop("_last")
    found = audit.verify_chain(damaged, 20).groupBy("chain_id").agg(F.count(F.lit(1)).alias("findings"))
    newest = log.join(back, "chain_id").filter("seq = _last").select("chain_id", F.col("transaction_id").alias("newest"))
    return (heads.join(found, "chain_id", "left").join(newest, "chain_id")
            .select("chain_id", "records", F.col("last_seq").cast("bigint").alias("last_seq"), "newest",
                    F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings")))


@query(f"with {STORE} select 0 findings, count(*) records from fin")
def audit_intact(spark, sf_dir):
    """AU-4: a log as written has no finding."""
    log = audit_log(spark, sf_dir)
    records = audit.chain_heads(log).agg(F.sum("records").alias("n")).select("n").scalar()
    return audit.verify_chain(log).agg(F.count(F.lit(1)).alias("findings")).withColumn("records", records)


@query(f"""with {_CHAINED}, n as (select chain_id, max(seq) last, count(*) filter (seq % 50 = 7) alt, count(*) filter (seq % 50 = 11) del,
count(*) filter (seq % 50 = 23) dec, count(*) filter (seq % 50 = 31) ids, count(*) filter (seq % 50 = 43) bad, count(*) filter (seq % 50 = 37) rep
from placed group by chain_id), g as (select *, del - case when last % 50 = 11 then 1 else 0 end gap from n)
select sum(gap)::bigint gaps, sum(rep)::bigint repeated, sum(gap)::bigint broken_links, sum(alt + bad)::bigint altered,
sum(dec)::bigint decisions, sum(ids)::bigint ids, sum(bad)::bigint bad_json from g""")
def audit_verify(spark, sf_dir):
    """AU-4, AU-5: a damaged log and how often each kind of damage is found."""
    log, at = audit_log(spark, sf_dir), F.col("seq") % 50
    log = log.filter(at != 11).withColumns({
        "ingress_hash": F.when(at == 7, "0").otherwise(F.col("ingress_hash")),
        "decision": F.when(at == 23, "NONE").otherwise(F.col("decision")),
        "transaction_id": F.when(at == 31, "someone").otherwise(F.col("transaction_id")),
        "payload": F.when(at == 43, "{not json").otherwise(F.col("payload"))})
    log = log.unionByName(log.filter(at == 37))
    found = audit.verify_chain(log)
    kinds = {"gaps": "gap before", "repeated": "position repeated", "broken_links": "previous hash differs",
             "altered": "content altered", "decisions": "decision differs from payload",
             "ids": "id differs from payload", "bad_json": "payload is not JSON"}
    return found.agg(*[F.count_if(F.col("finding") == text).alias(n) for n, text in kinds.items()])


# --- Model --------------------------------------------------------------------------------

#: What the queries fit, `source_ablation` apart: all five seeds, each of few and shallow trees, so that a fit takes seconds.
FIT = {"trees": 5, "depth": 3, "step": 0.3}
_FITTED: dict = {}


def _committee(spark, sf_dir):
    """The committee of the early rows and all rows by part; fitted once a session and folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FITTED:
        parts = stored(metrics.time_split(training.training_matrix(events(spark, sf_dir))))
        _FITTED[key] = model.fit_committee(parts.filter("part = 'fit'"), FEATURES, **FIT), parts
    return _FITTED[key]


@query(f"""with {_SPLIT} select part, count(*) as rows, count(*) in_range, true ranks_well from z where part <> 'fit' group by part""")
def committee_score(spark, sf_dir):
    """ML-1, ML-4, ML-5: a committee fitted on the early rows scores the later ones, better than by chance (ROC-AUC over 0.7)."""
    fitted, parts = _committee(spark, sf_dir)
    fitted.check(FEATURES)
    scores = stored(model.score(fitted, parts.filter("part <> 'fit'")).withColumn("score", F.col("ml_score")))
    well = metrics.ranking(scores).select("roc_auc").scalar() > 0.7
    return (scores.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score").between(0, 1)).alias("in_range"))
            .withColumn("ranks_well", well))


def _scored_tests(spark, sf_dir):
    """The committee, and the later transfers with their features and scores."""
    fitted, parts = _committee(spark, sf_dir)
    return fitted, (model.score(fitted, parts.filter("part = 'test'"))
                    .select("transaction_id", F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("features"), "ml_score"))


def _explained(fitted, rows):
    """How many of the rows are explained, and how often the text does not parse back or weights do not fall."""
    told = model.explain_holds(fitted, rows.withColumns({"ml_score": F.bround("ml_score", 4), "decision": F.lit("REVIEW")}))
    lines = phrases.split_phrases(F.col("explanation"))
    weights = F.transform(lines, lambda p: p["weight"])
    return told.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("explanation_status") == "OK").alias("explained"),
        F.count_if(F.size(lines) != F.size("explanation")).alias("unparsed"),
        F.count_if(weights != F.sort_array(weights, False)).alias("unordered"))


@query(f"""with {_SPLIT}, n as (select count(*) c from z where part = 'test')
select c as rows, c explained, 0 unparsed, 0 unordered from n""")
def explain_every(spark, sf_dir):
    """ML-24, SC-18, SC-20, SC-21, TOP-6: the three largest pushes of every later transfer in words, so of each that is held."""
    return _explained(*_scored_tests(spark, sf_dir))


@query(f"""with {_SPLIT}, n as (select count(*) c from z where part = 'test')
select least(c, 100) as rows, least(c, 100) explained, 0 unparsed, 0 unordered from n""")
def explain_top3(spark, sf_dir):
    """ML-24, SC-18, SC-20, SC-21, TOP-6: the three largest pushes of the hundred riskiest transfers in words: each explanation's
    pushes add up to the score, each line parses back, and weights fall."""
    fitted, rows = _scored_tests(spark, sf_dir)
    return _explained(fitted, rows.orderBy(F.desc("ml_score"), "transaction_id").limit(100))


@query(f"""with {ALL}, q as (select *, row_number() over (order by us, tid) - 1 position, count(*) over () whole from r),
z as (select *, case when position < floor(floor(whole * 0.8) * 0.8) then 'fit' when position < floor(whole * 0.8) then 'tune' else 'test' end part from q),
b as (select round(raw, 4) / 2 score from z where part = 'tune' and round(raw, 4) / 2 < 0.4)
select least(count(*), 100) as rows, least(count(*), 100) in_range from b""")
def second_look_model(spark, sf_dir):
    """ML-20..22: a second model, fitted on pieces of the early rows, re-reads the band."""
    _, parts = _committee(spark, sf_dir)
    names = ["log_amount", "amount_z", "vel_1h", "payee_payers_24h", "daily_sum_ratio"]
    band = metrics.second_look_band(parts.filter("part = 'tune'").withColumn("score", F.col("cep_score") / 2), 0.4)
    looked = model.second_look_scores(parts.filter("part = 'fit'"), band, names)
    return looked.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("second_score").between(0, 1)).alias("in_range"))


@query(f"""with {_SPLIT}, s as (select *, us <= (select max(us) from t) - 3600000000 old_enough from z),
o as (select *, row_number() over (order by us, tid) - 1 place, count(*) over () whole from s where old_enough)
select count(*) logged, sum(label)::bigint known_fraud, count(*) filter (not old_enough) settling,
(select sum(label)::bigint from o where place >= floor(whole * 0.8)) deciding_fraud, true compared from s""")
def retrain_run(spark, sf_dir):
    """ML-13..19, SNK-8: one retrain run over logged decisions, as the row it leaves. Reports settle in an hour, as the adapter
    packs a month into half a day; five frauds decide."""
    from ..sources.sinks import run_row
    from datetime import datetime, timezone
    served, parts = _committee(spark, sf_dir)
    logged = parts.drop("part", "position").withColumn("decided_at", F.col("event_us") / 1e6)
    status = training.retrain(parts.drop("part", "position"), logged, served, 0.5, FEATURES, min_fraud=5, delay_s=3600, seeds=(42,), **FIT)
    row = run_row(spark, status, datetime(2024, 1, 2, tzinfo=timezone.utc))
    return row.select("logged", "known_fraud", "settling", "deciding_fraud", F.col("outcome").isin("better", "not_better").alias("compared"))


@query(f"""with {_SPLIT}, n as (select count(*) filter (part = 'test') c, sum(label) filter (part = 'test') f from z)
select p profile, cast(c as bigint) as rows, cast(f as bigint) fraud, true in_range from n, (values ('full'), ('no payee side')) v(p)""")
def source_ablation(spark, sf_dir):
    """ML-23: the same fit, of the whole committee, with and without what is known of the payee, read on the same slice."""
    profiles = {"full": FULL, "no payee side": Profile({"receiver_velocity": "off", "counterparty_history": "off", "confirmed_cases": "off"})}
    read = training.ablation(events(spark, sf_dir), profiles)
    return read.select("profile", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).cast("bigint").alias("rows"),
                       F.col("fraud").cast("bigint").alias("fraud"), F.col("average_precision").between(0, 1).alias("in_range"))


# --- Tables -------------------------------------------------------------------------------

@query(f"""with {STORE}, w as (select transaction_id, cast(amount_uzs as bigint) amount_uzs, decision, coalesce(predicted_type, '') predicted_type,
round(coalesce(ml_score, 0), 3) ml_score from rec) select * from w""")
def stored_decisions(spark, sf_dir):
    """SNK-1: decisions as the warehouse has them, written by month and read back."""
    from ..sources import sinks
    rows = records(spark, sf_dir).filter("model_version not like 'second-look%'")
    root = f"{shared_folder(spark)}/warehouse-{uuid.uuid4().hex}"
    sinks.write_batch(sinks.scored_rows(_whole_records(rows)), root, "decisions", 0, "event_time", ["event_time", "transaction_id"])
    return sinks.read_table(spark, root, "decisions").select(
        "transaction_id", "amount_uzs", "decision", "predicted_type", F.round(F.col("ml_score").cast("double"), 3).alias("ml_score"))


@query(f"""with {STORE} select 'audit' as name, count(*) as rows from fin where decision = 'REVIEW' union all
select 'cases', count(*) from fin where decision = 'REVIEW' union all select 'decisions', count(*) from fin
union all select 'second_look', count(*) from fin where decision = 'SECOND_LOOK'""")
def stored_batch(spark, sf_dir):
    """SNK-1..5: one batch in all its tables, where only holds are audited, stored twice as after a failure."""
    from ..sources import sinks
    rows = stored(_whole_records(final(spark, sf_dir)))
    root = f"{shared_folder(spark)}/warehouse-{uuid.uuid4().hex}"
    for _ in range(2):
        sinks.store_decisions(rows, root, 0, audit_all=False, chains=8)
    counts = [sinks.read_table(spark, root, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("rows"))
              for t in ("audit", "cases", "decisions", "second_look")]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


def _whole_records(rows: DataFrame) -> DataFrame:
    """Records with the columns that these tables do not carry, as nulls."""
    missing = {"sender_region": "string", "is_new_payee": "boolean", "active_call": "int", "secs_login_to_confirm": "double",
               "secs_login_z": "double", "scoring_ms": "double", "stage_ms": "map<string,double>", "features": "array<double>",
               "ingress_hash": "string"}
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()})
