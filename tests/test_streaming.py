import json
import math
import os

import brute
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.audit import verify_chain
from ledgerlens.operators.decision import Cutoffs
from ledgerlens.operators.features import FEATURES, transfer_features
from ledgerlens.sources.files import file_stream
from ledgerlens.sources.sinks import read_table
from ledgerlens.streaming import snapshots
from ledgerlens.streaming.jobs import Job, minutes, second_look


def message(r):
    from datetime import datetime, timezone
    at = datetime.fromtimestamp(r["us"] / 1e6, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    return json.dumps({"transaction_id": r["transaction_id"], "event_time": at, "sender_pinfl": r["payer"],
                       "sender_card": r["sender"], "receiver_card": r["payee"], "amount_uzs": r["amount"],
                       "sender_region": r["region"], "active_call": bool(r["call"]),
                       "secs_login_to_confirm": r["secs"], "ingested_at": r["us"] / 1e6})


def write_files(folder, rows, parts):
    os.makedirs(folder, exist_ok=True)
    for i, part in enumerate(parts):
        with open(f"{folder}/part{i}.txt", "w") as fh:
            fh.write("\n".join(part) + "\n")
        os.utime(f"{folder}/part{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))


def test_stream_equals_replay_and_survives_a_restart(spark, tmp_path):
    rows = brute.stream(11, n=60)
    for r in rows:
        r["us"] = r["us"] // 1000 * 1000
    rows.sort(key=lambda r: (r["us"], r["transaction_id"]))
    text = [message(r) for r in rows]
    # The second file delivers two records again, and carries what cannot be scored.
    parts = [text[:25], text[20:22] + text[25:45] + ['{"amount_uzs": -1}', "not json"], text[45:]]
    folder, root, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    write_files(folder, rows, parts[:2])
    job = Job(root, chains=2)
    job.start(file_stream(spark, folder), ckpt, every=None).awaitTermination()
    write_files(folder, rows, parts)
    job.start(file_stream(spark, folder), ckpt, every=None).awaitTermination()
    got = {r["transaction_id"]: r for r in read_table(spark, root, "records").collect()}
    want = brute.features(rows)
    assert got.keys() == want.keys()
    for tid, w in want.items():
        for name, v in zip(FEATURES, got[tid]["features"]):
            assert math.isclose(v, w[name], rel_tol=1e-6, abs_tol=2e-6), (tid, name, v, w[name])
    assert read_table(spark, root, "quarantine").count() == 2
    log = read_table(spark, root, "audit")
    assert log.count() == len(rows)
    assert verify_chain(log.drop("batch")).count() == 0
    held = {t for t, r in got.items() if r["decision"] == "REVIEW"}
    assert {r["case_id"] for r in read_table(spark, root, "cases").collect()} == held


def test_a_snapshot_gives_what_all_history_gives(spark, tmp_path):
    rows = brute.stream(4, n=140, days=60)
    rows.sort(key=lambda r: (r["us"], r["transaction_id"]))
    old, new = rows[:120], rows[120:]
    root = str(tmp_path)
    history, fresh = brute.as_transfers(spark, old), brute.as_transfers(spark, new)
    history.withColumn("batch", F.lit(0)).write.partitionBy("batch").parquet(f"{root}/transfers")
    cut = new[0]["us"] - snapshots.WEEK_US
    assert sum(r["us"] < cut for r in old) > 20
    middle = old[15]["us"] + 1
    snapshots.roll(spark, root, middle)
    snapshots.roll(spark, root, cut)
    assert snapshots.newest(spark, root, cut) == cut and snapshots.newest(spark, root, cut - 1) == middle
    context, prior = snapshots.context_of(fresh, history, root)
    assert prior is not None and context.filter(F.col("event_us") < cut).count() == 0
    both = fresh.withColumn("fresh", F.lit(True)).unionByName(context.withColumn("fresh", F.lit(False)))
    got = {r["transaction_id"]: r for r in transfer_features(both, prior=prior).filter("fresh").collect()}
    want = brute.features(rows)
    assert len(got) == len(new)
    for tid in got:
        for name in FEATURES:
            assert math.isclose(got[tid][name], want[tid][name], rel_tol=1e-9, abs_tol=1e-7), (tid, name)


def test_a_verdict_counts_from_the_next_batch(spark, tmp_path):
    from ledgerlens.operators import cases
    root = str(tmp_path)
    rows = [dict(brute.stream(1, n=1)[0], transaction_id=f"t{i}", sender=f"S{i}", payee="HUB", amount=9_000_000.0 * 12,
                 us=1_704_067_200_000_000 + i * 1_000_000) for i in range(3)]
    job = Job(root)
    wire = lambda r: spark.createDataFrame([(message(r),)], "value string").withColumn("arrived", F.current_timestamp())
    job(wire(rows[0]), 0)
    versions = read_table(spark, root, "cases").drop("batch")
    verdict = spark.createDataFrame([("t0", "CONFIRMED_FRAUD", "ann", rows[1]["us"] / 1e6 - 0.5)],
                                    "case_id string, verdict string, by string, at double")
    cases.resolve(versions, verdict)[0].write.parquet(f"{root}/cases/batch=900001")
    job(wire(rows[1]), 1)
    flags = {r["transaction_id"]: r["features"][FEATURES.index("payee_flagged")]
             for r in read_table(spark, root, "records").collect()}
    assert flags == {"t0": 0.0, "t1": 1.0}


def test_a_batch_run_again_leaves_one_copy(spark, tmp_path):
    rows = brute.stream(2, n=10)
    batch = spark.createDataFrame([(message(r),) for r in rows], "value string").withColumn("arrived", F.current_timestamp())
    job = Job(str(tmp_path))
    job(batch, 0)
    job(batch, 0)
    for table in ("transfers", "records", "audit"):
        assert read_table(spark, str(tmp_path), table).count() == 10
    assert verify_chain(read_table(spark, str(tmp_path), "audit").drop("batch")).count() == 0


def test_the_band_waits_for_the_second_look(spark, tmp_path):
    rows = brute.stream(3, n=12)
    for i, r in enumerate(rows):
        r["amount"], r["sender"] = 1000.0, f"Z{i}"
    batch = spark.createDataFrame([(message(r),) for r in rows], "value string").withColumn("arrived", F.current_timestamp())
    root = str(tmp_path)
    job = Job(root, cutoffs=Cutoffs(0.9, 0.5, 0.9), score=lambda df: df.withColumn("ml_score", F.lit(0.6)))
    job(batch, 0)
    waiting = read_table(spark, root, "second_look").drop("batch")
    assert waiting.count() == 12
    handle = second_look(root, lambda df: df.withColumn("second_score", F.lit(0.95)), 0.9, "m1")
    handle(waiting.withColumn("scored_at_job", F.unix_micros(F.current_timestamp()) / 1e6), 0)
    done = read_table(spark, root, "decisions").filter("batch like '_second_look_%'")
    assert {(r["decision"], r["model_version"]) for r in done.collect()} == {("REVIEW", "second-look:m1")}
    job.second_look_answers = lambda: False
    job(batch.withColumn("value", F.regexp_replace("value", '"transaction_id": "', '"transaction_id": "x')), 1)
    held = read_table(spark, root, "records").filter("batch = 1").collect()
    assert {(r["decision"], r["model_version"]) for r in held} == {("REVIEW", "second-look:unscored")}


def test_minutes_stream(spark, tmp_path):
    src = str(tmp_path / "dec")
    spark.sql("select timestamp'2024-01-01 00:00:30' + make_interval(0,0,0,0,0,id) event_time, "
              "if(id % 3 = 0, 'REVIEW', 'ALLOW') decision from range(60)").write.parquet(src)
    s = spark.readStream.schema("event_time timestamp, decision string").parquet(src)
    q = minutes(s).writeStream.format("memory").queryName("per_minute").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("per_minute").orderBy("minute").collect()
    assert sum(r["checked"] for r in rows) == 60 and sum(r["held"] for r in rows) == 20 and len(rows) >= 2


def test_stream_deduplicates_by_id(spark, tmp_path):
    from ledgerlens.sources.ingest import deduplicated
    src = str(tmp_path / "ev")
    spark.sql("select cast(id % 5 as string) transaction_id, current_timestamp() arrived from range(20)").write.parquet(src)
    s = spark.readStream.schema("transaction_id string, arrived timestamp").parquet(src)
    q = deduplicated(s).writeStream.format("memory").queryName("dedup").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == 5
