"""Named queries that compare models over time and decisions with and without an inserted transfer."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..operators import decision, metrics
from ..operators.features import transfer_features
from ..operators.rules import reads, with_rules
from ..sources.files import stored
from . import catalogue, oracle as Q, rolling
from .catalogue import _DECIDED, _SPLIT, query

# The adapter compresses time by 60.
REPORT = S.REPORT_DELAY // 60

_RULES = ", ".join(f"({i}, '{name}')" for i, name in enumerate((
    "NEW_PAYEE_HIGH_AMOUNT", "VELOCITY", "STRUCTURING", "DISTINCT_PAYEE_BURST", "GEO_ANOMALY", "IMPOSSIBLE_TRAVEL", "AMOUNT_DEVIATION",
    "COACHED_SESSION", "DAILY_LIMIT_BREACH", "MULE_FAN_IN")))


@query(f"""with {_DECIDED}, rules(i, rule) as (values {_RULES}),
k as (select *, case when decision = 'REVIEW' then us + {catalogue.DELAY * 1_000_000}
      when cast('0x' || substr(md5(tid), 1, 8) as bigint) % 1000 < 500 then us + {REPORT * 1_000_000} end known_us,
      row_number() over (order by us, tid) - 1 position, count(*) over () whole from d),
p as (select *, (position >= whole * 1 // 5)::int + (position >= whole * 2 // 5)::int + (position >= whole * 3 // 5)::int
      + (position >= whole * 4 // 5)::int step from k),
begins as (select step as ahead, min(us) began from p group by step),
fits as (select 'static' model, ahead, p.*, label told from p join begins on step < 2 and ahead >= 2
         union all select 'retrained', ahead, p.*, case when label = 1 and (step < 2 or known_us <= began) then 1 else 0 end
         from p join begins on step < ahead and ahead >= 2
         union all select 'all labels', ahead, p.*, label from p join begins on step < ahead and ahead >= 2),
sums as (select model, ahead, i, rule, count(*) filter (told = 1) f, count(*) filter (told = 0) g,
         count(*) filter (told = 1 and list_contains(string_split(hits, ','), rule)) fr,
         count(*) filter (told = 0 and list_contains(string_split(hits, ','), rule)) gr from fits, rules group by all),
weights as (select model, ahead, rule, ln(((fr + 1) / (f + 2)) / ((gr + 1) / (g + 2))) w from sums),
scores as (select model, step, tid, us, label, decision, round(coalesce(sum(w) filter (list_contains(string_split(hits, ','), rule)), 0), 9) score
           from p join weights on ahead = step group by all),
ranked as (select *, row_number() over (partition by model, step order by score desc, us, tid) place,
           count(*) filter (decision = 'REVIEW') over (partition by model, step) alerts from scores)
select step, model, alerts, count(*) as rows, sum(label)::bigint fraud, (count(*) filter (label = 1 and place <= alerts))::bigint caught
from ranked group by step, model, alerts""")
def rolling_models(spark, sf_dir):
    """ML-27: frauds caught by a static model, one retrained on the labels known by then, and one that knows all labels."""
    return rolling.rolling(catalogue.decided(spark, sf_dir, "label"), held_delay_s=catalogue.DELAY, report_delay_s=REPORT)


def _over(base: str, name: str) -> str:
    """Decisions over the transfers that `base` selects."""
    rules = ", ".join([Q.MARKED, Q.SENDER, Q.PAYEE, Q.HOME, Q.TRAVEL, Q.PAID, Q.confirmed(catalogue.DELAY), Q.CONTACTS, Q.FEATURES, Q.RULES])
    return f"""{name} as (with t as ({base}), {rules} select tid, round(raw, 4) score,
    case when raw >= 0.4 - 1e-9 or a3 = 1 or a9 = 1 then 'REVIEW' else 'ALLOW' end decision from r)"""


@query(f"""with {_SPLIT}, chosen as (select tid from z where part = 'test' and label = 1), first as (select t.* from t),
{_over("select * from first", "was")}, {_over('''select * from first union all select tid || '-probe', us - 60000000, s, p, 1000, 100000, region, call, secs, 0, 'NONE'
from first where tid in (select tid from chosen)''', "would")}
select tid transaction_id, was.score score_before, was.decision decision_before, would.score score_after, would.decision decision_after,
was.decision = 'REVIEW' and would.decision <> 'REVIEW' hidden from chosen join was using (tid) join would using (tid)""")
def probe_rescoring(spark, sf_dir):
    """ML-28: every later fraud decided again with a small payment to the same payee a minute before."""
    t = stored(catalogue.events(spark, sf_dir))  # read by the split, the choice and both decisions

    def decide(rows):
        told = with_rules(transfer_features(rows, wanted=reads())).withColumn("ml_score", F.lit(None).cast("double"))
        return decision.decide(told).withColumn("final_score", F.round("final_score", 4))

    return rolling.with_test_payment(t, metrics.time_split(t.select("transaction_id", "event_us", "label")).filter("part = 'test' and label = 1"), decide)
