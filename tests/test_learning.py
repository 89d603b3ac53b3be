"""Models by invariants: contributions add up, explanations refuse, retraining takes each way out."""
import math
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import metrics
from ledgerlens.plans import model, training
from ledgerlens.sources.files import stored

NAMES = ["a", "b"]
FIT = dict(seeds=(1, 2), trees=4, depth=2, step=0.3)


@pytest.fixture(scope="module")
def rows(spark):
    noise = lambda k: (F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000)
    return stored(spark.range(3000).select(
        F.format_string("t%05d", "id").alias("transaction_id"), F.col("id").alias("event_us"),
        (F.col("id") * 600).cast("double").alias("decided_at"), noise(1).alias("a"), noise(2).alias("b"),
        ((noise(1) > .7) & (noise(3) > .2)).cast("int").alias("label"), noise(1).alias("cep_score"), F.lit("APP").alias("label_type")))


@pytest.fixture(scope="module")
def committee(rows):
    return model.fit_committee(rows, NAMES, **FIT)


def test_contributions_add_up_to_the_score(rows, committee):
    scored = model.score(committee, rows.limit(200)).withColumn("features", F.array(*NAMES))
    for r in model.contributions(committee, scored).collect():
        assert math.isclose(r["recomputed"], r["ml_score"], abs_tol=1e-9)
    auc = metrics.ranking(model.score(committee, rows, "score")).first()["roc_auc"]
    assert auc > .85


def test_explanations_refuse_rather_than_guess(rows, committee):
    r = model.score(committee, rows.orderBy(F.desc("a")).limit(4)).withColumn("features", F.array(*NAMES))
    one = lambda df: {(x["explanation_status"], len(x["explanation"])) for x in model.explain_holds(committee, df).collect()}
    assert {s for s, _ in one(r)} == {"OK"} and all(n >= 1 for _, n in one(r))
    assert one(r.withColumn("ml_score", F.col("ml_score") - .01)) == {("MODEL_MISMATCH", 0)}
    assert one(r.withColumn("ml_score", F.lit(None).cast("double"))) == {("RULES_ONLY", 0)}
    assert one(r.withColumn("features", F.lit(None).cast("array<double>"))) == {("NO_FEATURES", 0)}
    assert one(r.withColumn("features", F.array(F.lit(1.0)))) == {("FAILED", 0)}
    none = model.explain_holds(None, r).collect()
    assert {x["explanation_status"] for x in none} == {"NO_MODEL"}
    with pytest.raises(ValueError):
        committee.check(["a"])


def test_retraining_takes_each_way_out(rows, committee):
    run = lambda **k: training.retrain(rows, rows, committee, .5, NAMES, **{**dict(min_rows=100, min_fraud=30, delay_s=60_000), **k}, **FIT)
    assert run(min_rows=5000)["outcome"] == "too_few_rows"
    few = run(min_fraud=5000)
    assert few["outcome"] == "too_few_fraud" and few["settling"] == 100
    status = run()
    assert status["outcome"] in ("better", "not_better") and status["deciding_fraud"] >= 30
    assert status["logged"] == 3000 and status["moved"] == [] and 0 < status["alert_rate"]["now"] < 1
    assert status["served"]["fraud"] == status["retrained"]["fraud"] == status["deciding_fraud"]


def test_the_band_has_its_own_cutoff(rows, committee):
    scored = model.score(committee, metrics.time_split(rows), "score")
    fit = scored.filter("part = 'fit'").drop("score").limit(600)
    spec = training.choose_band(scored.filter("part = 'tune'"), fit, .5, NAMES, 40)
    assert spec["from"] < spec["review"] == .5 and 0 < spec["cut"] < 1


def test_every_query_with_a_twin_agrees_on_the_small_tables(spark, sf):
    """The quick ones here; check.py runs them all."""
    import duckdb
    import __spark_entry__ as entry
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    queries, twins = entry.queries(), entry.oracle_sql()
    from ledgerlens.plans.catalogue import QUERIES
    # The text operators, which may be absent, are held against brute force by tests of their own.
    assert set(twins) <= set(queries) and set(QUERIES) <= set(twins)
    for name in ("time_split", "ingress_hash", "final_decision", "decision_counts", "bin_lookup", "class_weights",
                 "labelled_file", "bank_registry", "wire_messages", "event_time_fallback", "duplicate_delivery", "audit_payload", "reason_phrases",
                 "case_lookup"):
        df = queries[name](spark, sf)
        cur = con.execute(twins[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        norm = lambda v: round(v, 6) if isinstance(v, float) else v
        want = sorted([tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()], key=repr)
        got = sorted([tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()], key=repr)
        assert got == want, name


def test_the_flagship_runs(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 1000
