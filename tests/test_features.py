import math

import brute
import pytest
from pyspark.sql import functions as F
from ledgerlens.operators import decision
from ledgerlens.operators.features import FEATURES, HELPERS, transfer_features
from ledgerlens.operators.rules import reads, with_rules
from ledgerlens.plans import catalogue, catalogue_models
from ledgerlens.sources import adapters

DAY = 86_400_000_000


def confirmations(rows, seed):
    import random
    rng = random.Random(seed)
    start, end = rows[0]["us"], rows[-1]["us"]
    out = []
    for a in ("A1", "A3", "A5"):
        cuts = sorted(rng.randrange(start, end) for _ in range(4))
        out += [(a, cuts[0], cuts[1]), (a, cuts[2], None if a == "A3" else cuts[3])]
    # One that begins and one that ends at a transfer's own instant.
    out.append(("A6", rows[20]["us"], rows[90]["us"]))
    return out


def compare(spark, rows, marks):
    want = brute.features(rows, marks)
    c = spark.createDataFrame(marks, "account string, from_us bigint, to_us bigint")
    got = {r["transaction_id"]: r.asDict() for r in transfer_features(brute.as_transfers(spark, rows), c).collect()}
    assert got.keys() == want.keys()
    for tid, w in want.items():
        for name in FEATURES + HELPERS:
            assert math.isclose(got[tid][name], w[name], rel_tol=1e-9, abs_tol=1e-7), (tid, name, got[tid][name], w[name])


@pytest.mark.parametrize("seed", [1, 2])
def test_features_equal_their_definitions(spark, seed):
    rows = brute.stream(seed)
    compare(spark, rows, confirmations(rows, seed))


@pytest.mark.parametrize("seed", [1, 3])
def test_features_are_the_same_when_timelines_are_cut(spark, small_slices, seed):
    rows = brute.stream(seed)
    compare(spark, rows, confirmations(rows, seed))


def test_a_constant_history_has_no_spread(spark, small_slices):
    rows = brute.stream(5, n=60)
    for r in rows:
        r["amount"], r["sender"], r["secs"] = 123_456.7, "A1", 33.0
    compare(spark, rows, [("A3", rows[3]["us"], None)])


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_chosen_features_leave_out_the_rest(spark, sf):
    from ledgerlens.operators.confirmed import confirmed_from_labels
    from ledgerlens.sources.adapters import from_events
    t = from_events(spark, sf)
    plan = plan_of(transfer_features(t, confirmed_from_labels(t), wanted=["vel_10m", "vel_1h"]))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "NestedLoop" not in plan


def test_slices_need_no_nested_loop(spark, sf, small_slices):
    from ledgerlens.operators.metrics import time_split
    from ledgerlens.sources.adapters import from_events
    spark.conf.set("ledgerlens.rowsPerSlice", "100")
    plan = plan_of(time_split(from_events(spark, sf)))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "BroadcastHashJoin" in plan


def test_no_hot_key_means_two_wide_shuffles(spark, sf):
    from ledgerlens.sources.adapters import from_events
    plan = transfer_features(from_events(spark, sf))._jdf.queryExecution().executedPlan().toString()
    # payee side, sender side, and the narrow list of credits joining the sender's side
    assert plan.count("Exchange hashpartitioning") == 3
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_decisions_are_planned_from_the_rules_features_alone(spark, sf):
    """Fewer features, the same hits and decisions; the transfer's own columns come along when they are named."""
    few = catalogue.decided(spark, sf, "label", "label_type")
    everything = decision.decide(with_rules(catalogue.features(spark, sf)).withColumn("ml_score", F.lit(None).cast("double")))
    assert not {"payee_flagged_contacts", "sender_payees_7d", "secs_since_sender_inbound"} & set(few.columns)
    same = ["transaction_id", "event_us", "label", "label_type", "amount", "rule_hits", "cep_score", "final_score", "decision", "predicted_type"]
    rows = lambda df: sorted(map(tuple, df.select(*same).collect()))
    assert rows(few) == rows(everything) and len(rows(few)) == 1000
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert shuffles(few) < shuffles(everything) / 2
    assert set(reads()) <= set(FEATURES + HELPERS) | {"amount", "active_call"}


def test_tied_orders_are_planned_from_what_is_returned(spark, sf):
    asked = catalogue._ties(spark, sf)
    assert asked.columns == ["transaction_id", "event_us", *catalogue._TIES]
    whole = transfer_features(adapters.from_orders(spark, sf)).select(asked.columns)
    assert sorted(map(tuple, asked.collect())) == sorted(map(tuple, whole.collect()))


def test_test_payments_choose_once_and_plan_what_rules_read(spark, sf):
    """Neither the choice's order over all transfers nor accounts' contacts are worked out again in either decision."""
    plan = catalogue_models.probe_rescoring(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 10


def test_what_came_before_is_no_join_of_the_transfers(spark, sf):
    """Prior pairs, payers and regions stand in the timelines; only a sender's own summary is joined, by the account it is dealt by."""
    plan = catalogue.incremental_features(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2
