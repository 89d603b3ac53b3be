"""Features from keyed state against those by definition."""
import math
import time

import brute
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.features import FEATURES
from ledgerlens.streaming import keyed

@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "ckpt")


def feed(spark, folder, rows, flags=()):
    """One more batch of transfers and of flags that go up or down."""
    transfers = brute.as_transfers(spark, rows) if rows else brute.as_transfers(spark, brute.stream(1, n=1)).limit(0)
    marks = spark.createDataFrame([(a, us, step) for a, us, step in flags], "account string, us bigint, step int")
    both = transfers.withColumn("flag", F.lit(None).cast("struct<account: string, us: bigint, step: int>")).unionByName(
        marks.select(F.struct("*").alias("flag")), allowMissingColumns=True)
    both.coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, ckpt, silent_days=None):
    """All that has come since the checkpoint; {id: features}."""
    got = {}
    schema = spark.read.parquet(folder).schema
    source = spark.readStream.schema(schema).parquet(folder)
    entries = keyed.halves(source.filter("flag is null").drop("flag"), source.filter("flag is not null").select("flag.*"))
    take = lambda batch, n: got.update({r["transaction_id"]: r for r in keyed.features(batch).collect()})
    keyed.start(keyed.measured(entries, silent_days), take, ckpt).awaitTermination()
    return got


@pytest.mark.parametrize("seed", [1, 7])
def test_state_gives_what_history_gives(spark, folder, seed):
    rows = brute.stream(seed, n=120)
    rows.sort(key=lambda r: (r["us"], r["transaction_id"]))
    day = 86_400_000_000
    start = rows[0]["us"]
    confirmed = [("A1", start + 2 * day, start + 9 * day), ("A2", start + 5 * day, None), ("A3", rows[60]["us"], None)]
    want = brute.features(rows, confirmed)
    steps = [(a, f, 1) for a, f, _ in confirmed] + [(a, t, -1) for a, _, t in confirmed if t]
    got = {}
    for low, high in ((0, 50), (50, 51), (51, 120)):
        part = rows[low:high]
        upto = rows[high]["us"] if high < len(rows) else rows[-1]["us"] + 1
        since = rows[low]["us"] if low else 0
        feed(spark, folder[0], part, [s for s in steps if since <= s[1] < upto])
        got |= run(spark, *folder)
    assert got.keys() == want.keys()
    for tid, w in want.items():
        for name in FEATURES:
            assert math.isclose(got[tid][name], w[name], rel_tol=1e-9, abs_tol=1e-7), (tid, name, got[tid][name], w[name])


def test_a_late_transfer_has_windows_of_its_own_time(spark, folder):
    first = brute.stream(1, n=1)[0]
    at = lambda i, secs: dict(first, transaction_id=f"t{i}", us=first["us"] + secs * 1_000_000, sender="A", payee=f"P{i}", payer="pA")
    feed(spark, folder[0], [at(1, 0), at(2, 3_000), at(3, 3_100)])
    run(spark, *folder)
    feed(spark, folder[0], [at(4, 10), at(5, 3_200)])
    got = run(spark, *folder)
    assert (got["t4"]["vel_10m"], got["t4"]["vel_1h"], got["t4"]["distinct_payees_10m"]) == (2, 2, 2)
    assert (got["t5"]["vel_10m"], got["t5"]["vel_1h"]) == (3, 5)


def test_a_silent_sender_is_forgotten_and_an_active_one_is_not(spark, folder):
    """The clock is the machine's, so a day here is some seconds: what counts is that it moves on between the batches."""
    first = brute.stream(1, n=1)[0]
    at = lambda i, who: dict(first, transaction_id=f"{who}{i}", us=first["us"] + i * 1_000_000, sender=who, payee=f"P{who}", payer=who)
    silent = 4 / 86_400
    feed(spark, folder[0], [at(0, "Q"), at(0, "B")])
    run(spark, *folder, silent_days=silent)
    for i in range(1, 5):
        time.sleep(2.5)
        feed(spark, folder[0], [at(i, "B")])
        got = run(spark, *folder, silent_days=silent)
        assert got[f"B{i}"]["is_new_payee"] == 0
    feed(spark, folder[0], [at(9, "Q"), at(9, "B")])
    got = run(spark, *folder, silent_days=silent)
    assert got["Q9"]["is_new_payee"] == 1 and got["Q9"]["secs_since_last"] == 86_400 and got["B9"]["is_new_payee"] == 0
    # What it was paid, and what its payee remembers of it, does not go with it.
    assert got["Q9"]["payee_new_payers_24h"] == 1 and got["B9"]["vel_10m"] == 6


def test_the_keyed_job_over_wire_records(spark, tmp_path):
    """Records delivered again, unusable ones, a restart, a verdict, timings, and an audit chain that goes on from its tails."""
    from test_streaming import message, write_files

    from ledgerlens.operators.audit import verify_chain
    from ledgerlens.sources.files import file_stream
    from ledgerlens.sources.sinks import read_table
    from ledgerlens.streaming.jobs import KeyedJob, case_state, give_verdicts

    rows = brute.stream(11, n=45)
    for r in rows:
        r["us"] = r["us"] // 1000 * 1000
    rows.sort(key=lambda r: (r["us"], r["transaction_id"]))
    hold = dict(rows[-1], transaction_id="big", us=rows[-1]["us"] + 1000, sender="S1", payee="HUB", payer="pS1", amount=2e8)
    after = dict(hold, transaction_id="next", us=hold["us"] + 10_000_000, sender="S2", payer="pS2", amount=1000.0)
    rows += [hold, after]
    text = [message(r) for r in rows]
    parts = [text[:25], text[20:22] + text[25:46] + ['{"amount_uzs": -1}', "not json"], text[46:]]
    folder, root, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    job = KeyedJob(root, chains=2, known_accounts=lambda s: s.createDataFrame([("A2",)], "account string"))
    write_files(folder, rows, parts[:2])
    job.start(file_stream(spark, folder), ckpt, every=None).awaitTermination()
    job.start_quarantine(file_stream(spark, folder), ckpt + "q", every=None).awaitTermination()
    at = hold["us"] / 1e6 + 1
    verdicts = spark.createDataFrame([("big", "CONFIRMED_FRAUD", "ann", at), ("nowhere", "CONFIRMED_FRAUD", "ann", at)],
                                     "case_id string, verdict string, by string, at double")
    for _ in range(2):
        refused = give_verdicts(spark, root, verdicts, 1)
        assert [(r["case_id"], r["reason"]) for r in refused.collect()] == [("nowhere", "no such case")]
    write_files(folder, rows, parts)
    job.start(file_stream(spark, folder), ckpt, every=None).awaitTermination()
    confirmed = [("A2", 0, None), ("HUB", hold["us"] + 1_000_000, None)]
    want = brute.features(rows, confirmed)
    got = {r["transaction_id"]: r for r in read_table(spark, root, "records").collect()}
    assert got.keys() == want.keys() and want["next"]["payee_flagged"] == 1
    for tid, w in want.items():
        for name, v in zip(FEATURES, got[tid]["features"]):
            assert math.isclose(v, w[name], rel_tol=1e-6, abs_tol=2e-6), (tid, name, v, w[name])
    assert read_table(spark, root, "quarantine").count() == 2
    log = read_table(spark, root, "audit")
    assert log.count() == len(rows) and verify_chain(log.drop("batch")).count() == 0
    assert read_table(spark, root, "audit_tails").select("batch").distinct().count() <= 2
    held = {t for t, r in got.items() if r["decision"] == "REVIEW"}
    cases = {r["case_id"]: r["disposition"] for r in case_state(root).read(spark).collect()}
    assert cases.keys() == held and cases["big"] == "CONFIRMED_FRAUD" and set(cases.values()) == {"NEW", "CONFIRMED_FRAUD"}
    for t in read_table(spark, root, "timings").collect():
        assert t["state_ms"] + t["decide_ms"] + t["store_ms"] == pytest.approx(t["batch_ms"], abs=1)
    stages = got["next"]["stage_ms"]
    assert got["next"]["scoring_ms"] == pytest.approx(stages["state"] + stages["rules"]) and {"kafka", "handoff"} <= stages.keys()


def test_buckets_touch_their_own_files_only(spark, tmp_path):
    import os

    from ledgerlens.sources.state import Buckets
    state = Buckets(str(tmp_path), "s", ["k"], [F.desc("v")], count=8)
    frame = lambda pairs: spark.createDataFrame(pairs, "k string, v int")
    assert state.read(spark) is None and state.of(frame([("a", 1)])) is None
    state.merge(frame([(f"k{i}", 1) for i in range(100)]))
    files = lambda: {f"{d}/{n}" for d, _, names in os.walk(tmp_path / "s") for n in names if n.endswith(".parquet")}
    before = files()
    state.merge(frame([("k7", 3), ("k7", 2), ("k8", 0)]))
    after = files()
    assert len(before & after) >= 6 and len(after) == len(before)
    assert {(r["k"], r["v"]) for r in state.of(frame([("k7", 0), ("k8", 0), ("none", 0)])).collect()} == {("k7", 3), ("k8", 1)}
    assert state.read(spark).count() == 100
