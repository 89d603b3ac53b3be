"""The same answers in plain SQL over the same tables, by definition: correlated scans and self-joins,
fit for small data only. They check the Spark plans and share no code with them."""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the plans does not agree with itself.
_POINTS = """('Andijan', 40.7821, 72.3442), ('Bukhara', 39.7747, 64.4286), ('Fergana', 40.3864, 71.7864), ('Jizzakh', 40.1158, 67.8422),
('Karakalpakstan', 42.46, 59.61), ('Kashkadarya', 38.8606, 65.7891), ('Khorezm', 41.55, 60.6333), ('Namangan', 40.9983, 71.6726),
('Navoi', 40.0844, 65.3792), ('Samarkand', 39.6542, 66.9597), ('Surkhandarya', 37.2242, 67.2783), ('Syrdarya', 40.4897, 68.7842),
('Tashkent City', 41.2995, 69.2401), ('Tashkent Region', 41.0167, 69.35)"""
POINTS = f"points(r, lat, lon) as (values {_POINTS})"
REGION_LIST = ("['Andijan', 'Bukhara', 'Fergana', 'Jizzakh', 'Karakalpakstan', 'Kashkadarya', 'Khorezm', 'Namangan', 'Navoi', "
               "'Samarkand', 'Surkhandarya', 'Syrdarya', 'Tashkent City', 'Tashkent Region']")
SCHEME_LIST = "['APP', 'ATO', 'STRUCTURING', 'MULE']"
EPOCH = 1_704_067_200_000_000

# Transfers from `events`, as the adapter defines them.
E = f"""
e as (select event_id i, epoch_us(ts) us0, user_id u, cast(regexp_extract(props, '[0-9]+') as bigint) k,
             event_type, value from events),
t as (select cast(i as varchar) tid, {EPOCH} + (us0 - {EPOCH}) // 60 us, 'A' || u s, 'A' || k p,
             value * 60000 amount, cast(round(value * 6000000) as bigint) tiyin,
             {REGION_LIST}[cast(case when k % 10 = 0 then (u + k // 10 + 1) % 14 else u % 14 end as int) + 1] region,
             case when event_type = 'signup' then 1 else 0 end call,
             cast((20 + (i * 37) % 60) * case when event_type = 'signup' and k % 3 = 0 then 5 else 1 end as double) secs,
             case when k % 25 = 0 and event_type = 'error' then 1 else 0 end label,
             case when k % 25 = 0 and event_type = 'error' then {SCHEME_LIST}[cast(k // 25 % 4 as int) + 1] else 'NONE' end kind
      from e)"""

# Transfers from `orders`: many share an instant.
O = """
t as (select cast(o_orderkey as varchar) tid,
             date_diff('day', date '1995-01-01', cast(o_orderdate as date)) * 60000000 us,
             'C' || o_custkey s, 'P' || (o_orderkey % 40) p, o_totalprice * 20 amount,
             cast(round(o_totalprice * 2000) as bigint) tiyin, '' region, 0 call, 0.0 secs,
             cast(c_nationkey as varchar) currency
      from orders left join customer on o_custkey = c_custkey)"""

BEFORE = "(b.us, b.tid) < (a.us, a.tid)"


def win(seconds: int) -> str:
    return f"b.us >= a.us - {seconds * 1_000_000}"


MARKED = f"""
n as (select *, row_number() over (partition by s, p order by us, tid) = 1 is_new,
             coalesce(us - lag(us) over (partition by p, s order by us, tid) > 2592000000000, true) new_payer
      from t)"""

SENDER = f"""
snd as (select a.tid, count(b.tid) n, avg(b.amount) mean,
               case when min(b.amount) = max(b.amount) then 0 else stddev_pop(b.amount) end std,
               avg(ln(1 + b.secs)) lmean, stddev_pop(ln(1 + b.secs)) lstd, max(b.us) last_us,
               count(*) filter ({win(600)}) c10, count(*) filter ({win(3600)}) c1h,
               count(*) filter ({win(3600)} and b.amount >= 8000000 and b.amount < 10000000) band,
               coalesce(sum(b.tiyin) filter ({win(86400)}), 0) sum24,
               count(distinct b.p) filter ({win(600)} and b.p <> a.p) d10,
               count(distinct b.p) filter ({win(86400)} and b.p <> a.p) d24,
               count(distinct b.p) filter ({win(604800)} and b.p <> a.p) d7,
               count(*) filter ({win(86400)} and b.is_new) new24,
               coalesce(sum(b.tiyin) filter ({win(86400)} and b.is_new), 0) newsum
        from n a left join n b on b.s = a.s and {BEFORE} group by a.tid)"""

PAYEE = f"""
rcv as (select a.tid, count(distinct b.s) filter ({win(3600)} and b.s <> a.s) d1h,
               count(distinct b.s) filter ({win(86400)} and b.s <> a.s) d24,
               count(distinct b.s) filter ({win(604800)} and b.s <> a.s) d7,
               coalesce(sum(b.tiyin) filter ({win(3600)}), 0) in1h,
               coalesce(sum(b.tiyin) filter ({win(86400)}), 0) in24,
               count(*) filter ({win(86400)} and b.new_payer) new24
        from n a left join n b on b.p = a.p and {BEFORE} group by a.tid)"""

HOME = f"""
seen as (select a.tid, b.region, count(*) c, min((b.us, b.tid)) f
         from t a join t b on b.s = a.s and {BEFORE} group by a.tid, b.region),
home as (select tid, region from (select *, row_number() over (partition by tid order by c desc, f) k from seen)
         where k = 1)"""

TRAVEL = f"""
{POINTS},
moved as (select tid, region, us, lag(region) over w r0, us - lag(us) over w gap from t
          window w as (partition by s order by us, tid)),
trip as (select m.tid, case when r0 <> m.region then
                2 * 6371.0088 * asin(sqrt(pow(sin((radians(q.lat) - radians(o.lat)) / 2), 2)
                  + cos(radians(o.lat)) * cos(radians(q.lat)) * pow(sin((radians(q.lon) - radians(o.lon)) / 2), 2)))
                else 0 end km, gap
         from moved m left join points o on o.r = r0 left join points q on q.r = m.region)"""

PAID = """
paid as (select a.tid, max(b.us) us from t a join t b on b.p = a.s and (b.us, b.tid) < (a.us, a.tid) group by a.tid)"""


def confirmed(delay_s: int) -> str:
    return f"conf as (select p account, min(us) + {delay_s * 1_000_000} since from t where label = 1 group by p)"


CONTACTS = f"""
edges as (select distinct account, other, us, tid from
          (select p account, s other, us, tid from t union all select s, p, us, tid from t)),
near as (select a.tid, count(distinct b.other) c from t a
         join edges b on b.account = a.p and {BEFORE} and {win(604800)}
         join conf on conf.account = b.other and conf.since <= a.us group by a.tid)"""

FEATURES = f"""
f as (select t.tid, t.us, t.s, t.p, t.amount, t.label, t.kind, t.call active_call, snd.n,
             ln(1 + t.amount) log_amount,
             case when snd.mean > 0 then t.amount / snd.mean else 4.0 end amount_to_mean,
             case when snd.std > 0 then (t.amount - snd.mean) / snd.std else 0 end amount_z,
             cast(n.is_new as int) is_new_payee, snd.c10 + 1 vel_10m, snd.c1h + 1 vel_1h,
             snd.d10 + 1 distinct_payees_10m,
             snd.band + case when t.amount >= 8000000 and t.amount < 10000000 then 1 else 0 end sub_threshold_1h,
             coalesce((t.us - snd.last_us) / 1e6, 86400) secs_since_last,
             (snd.sum24 + t.tiyin) / 100 / 1e8 daily_sum_ratio,
             cast(t.us // 3600000000 % 24 as double) as hour,
             rcv.d1h + 1 rcv_distinct_senders_1h, ln(1 + (rcv.in1h + t.tiyin) / 100) rcv_inflow_1h,
             case when snd.n >= 3 and home.region <> t.region then 1 else 0 end geo_is_anomaly,
             case when snd.n >= 5 and snd.lstd > 1e-6 then (ln(1 + t.secs) - snd.lmean) / snd.lstd else 0 end secs_login_z,
             rcv.d24 + 1 payee_payers_24h, rcv.d7 + 1 payee_payers_7d,
             snd.d24 + 1 sender_payees_24h, snd.d7 + 1 sender_payees_7d,
             coalesce(least((t.us - paid.us) / 1e6, 604800), 604800) secs_since_sender_inbound,
             ln(1 + (rcv.in24 + t.tiyin) / 100) payee_inflow_24h,
             rcv.new24 + cast(n.new_payer as int) payee_new_payers_24h,
             snd.new24 + cast(n.is_new as int) sender_new_payees_24h,
             ln(1 + (snd.newsum + case when n.is_new then t.tiyin else 0 end) / 100) sender_new_payee_sum_24h,
             case when cp.since <= t.us then 1 else 0 end payee_flagged,
             case when cs.since <= t.us then 1 else 0 end sender_flagged,
             coalesce(near.c, 0) payee_flagged_contacts,
             coalesce(trip.km, 0) travel_distance_km,
             case when trip.km > 0 then trip.km / (greatest(trip.gap / 1e6, 1) / 3600) else 0 end travel_kmh,
             snd.mean
      from t join n using (tid) join snd using (tid) join rcv using (tid) left join home using (tid)
      join trip using (tid) left join paid using (tid) left join near using (tid)
      left join conf cp on cp.account = t.p left join conf cs on cs.account = t.s)"""

RULES = f"""
r as (select *, least(1, a1*.35 + a2*.3 + a3*.4 + a4*.25 + a5*.2 + a6*.45 + a7*.25 + a8*.35 + a9*.3 + a10*.35) raw,
             concat_ws(',', case when a1=1 then 'NEW_PAYEE_HIGH_AMOUNT' end, case when a2=1 then 'VELOCITY' end,
                case when a3=1 then 'STRUCTURING' end, case when a4=1 then 'DISTINCT_PAYEE_BURST' end,
                case when a5=1 then 'GEO_ANOMALY' end, case when a6=1 then 'IMPOSSIBLE_TRAVEL' end,
                case when a7=1 then 'AMOUNT_DEVIATION' end, case when a8=1 then 'COACHED_SESSION' end,
                case when a9=1 then 'DAILY_LIMIT_BREACH' end, case when a10=1 then 'MULE_FAN_IN' end) hits
      from (select *, cast(is_new_payee = 1 and amount >= 2000000 and (n < 5 or amount > 3 * mean) as int) a1,
                   cast(vel_10m > 5 as int) a2, cast(sub_threshold_1h >= 3 as int) a3,
                   cast(distinct_payees_10m > 5 as int) a4, geo_is_anomaly a5,
                   cast(travel_distance_km >= 100 and travel_kmh > 900 as int) a6,
                   cast(n >= 5 and amount_z > 4 as int) a7, cast(active_call = 1 and secs_login_z > 2 as int) a8,
                   cast(daily_sum_ratio > 1 as int) a9, cast(rcv_distinct_senders_1h >= 6 as int) a10 from f))"""


def all_of(delay_s: int) -> str:
    return ", ".join([E, MARKED, SENDER, PAYEE, HOME, TRAVEL, PAID, confirmed(delay_s), CONTACTS, FEATURES, RULES])
