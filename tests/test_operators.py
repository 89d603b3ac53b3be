"""Expectations on single operators; long orders are cut into slices of a few rows."""
import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ledgerlens import settings as S
from ledgerlens.functions import envelope, phrases, scalars
from ledgerlens.operators import audit, cases, decision, metrics, queue
from ledgerlens.operators.quantiles import exact_quantiles, with_position
from ledgerlens.operators.rules import with_rules
from ledgerlens.plans import dashboards
from ledgerlens.profile import FULL, Profile, foreign
from ledgerlens.sources import adapters, ingest


def one(df):
    return df.first()[0]


# --- Wire and scalars ---------------------------------------------------------------------

def test_flags_as_text(spark):
    rows = spark.createDataFrame([("False",), (" n ",), ("NaN",), ("",), (None,), ("True",), ("yes",), ("1.0",)], "f string")
    assert [r[0] for r in rows.select(scalars.truthy(F.col("f"))).collect()] == [0, 0, 0, 0, 0, 1, 1, 1]


def test_masks_and_matches(spark):
    card = spark.createDataFrame([("8600031234562655",), ("123",), (None,)], "c string")
    assert [r[0] for r in card.select(scalars.mask_card(F.col("c"))).collect()] == ["8600 03** **** 2655", "123", ""]
    hit = lambda d: [r[0] for r in card.select(scalars.card_matches(F.col("c"), d)).collect()][0]
    assert hit("860003") and hit("2655") and hit("8600031234562655") and not hit("8600031") and not hit("62655")


def test_unusable_events(spark):
    def reason(text):
        decoded = ingest.decode(spark.createDataFrame([(text,)], "value string"))
        rows = ingest.split_usable(decoded)[1].collect()
        return rows[0]["reject_reason"] if rows else None
    assert reason('{"amount_uzs": 5, "event_time": "2024-01-01T00:00:00"}') is None
    assert reason('{"amount_uzs": "5"}') is None
    assert reason('{"amount_uzs": 5, "secs_login_to_confirm": null}') is None
    assert reason('{"event_time": "2024"}') == "amount missing"
    assert reason('{"amount_uzs": "NaN"}') == "amount not finite or negative"
    assert reason('{"amount_uzs": -1}') == "amount not finite or negative"
    assert reason('{"amount_uzs": 5, "secs_login_to_confirm": -2}') == "seconds not finite or negative"
    assert reason('{"amount_uzs": 5, "event_time": 17}') == "event time is no text"
    assert reason("{oops") == "undecodable" and reason("") == "undecodable"


def test_envelopes(spark):
    key = F.lit("k" * 32).cast("binary")
    body = '{"amount_uzs": 5, "sender_card": "8600"}'
    df = spark.createDataFrame([(body, "8600"), (body, "86:00")], "b string, r string")
    sealed = [r[0] for r in df.select(envelope.encrypt(F.col("b"), F.col("r"), key)).collect()]
    assert sealed[0].startswith("FDE1:8600:") and sealed[1] is None
    wire = [sealed[0], sealed[0].replace(":8600:", ":8601:"), sealed[0][:40], "FDE1:8600", "FDE1:8600:!!", body, "junk"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(wire)], "i int, v string").select(
        envelope.decrypt(F.col("v"), key), envelope.routing_key(F.col("v")),
        envelope.clear_text(F.col("v"), key, True)).collect()
    assert [r[0] for r in rows] == [body] + [None] * 6
    assert [r[1] for r in rows] == ["8600", "8601", "8600", envelope.POISON, "8600", "8600", envelope.POISON]
    assert rows[5][2] is None and rows[0][2] == body


def test_hashes_bind_every_field(spark):
    row = lambda **k: spark.createDataFrame([tuple(k.get(f) for f in audit.INGRESS_FIELDS)],
                                            ", ".join(f"{f} string" for f in audit.INGRESS_FIELDS))
    import hashlib
    want = hashlib.sha256("\x1f".join(["t", "", "", "c", "", "9", ""]).encode()).hexdigest()
    assert one(row(transaction_id="t", sender_card="c", amount_uzs="9").select(audit.ingress_hash())) == want
    link = lambda prev: one(spark.range(1).select(audit.record_hash(F.lit(prev), F.lit(5), F.lit("ing"), F.lit("payload"))))
    assert link("prev") == hashlib.sha256(b"prev\x1f5\x1fing\x1fpayload").hexdigest()
    assert link("") == hashlib.sha256((audit.GENESIS + "\x1f5\x1fing\x1fpayload").encode()).hexdigest()


def test_phrases_read_back(spark):
    df = spark.createDataFrame([("log_amount", math.log1p(1234567), .42), ("hour", 7.0, -1.0), ("made_up", 2.5, .1),
                                ("daily_sum_ratio", .256, 1.0), ("amount_z", 3.14, .5)], "f string, v double, c double")
    text = [r[0] for r in df.select(F.expr(phrases.phrase_sql("f", "v", "c"))).collect()]
    assert text[0] == "amount: 1 234 567 UZS (+0.42)" and text[1] == "hour of day (UTC): 07:00 (-1.00)"
    assert text[2] == "made_up: 2.5 (+0.10)" and text[3].endswith("used: 26% (+1.00)") and "+3.1 sigma" in text[4]
    back = one(spark.createDataFrame([(text + ["no finding"],)], "p array<string>").select(phrases.split_phrases(F.col("p"))))
    assert [b["feature"] for b in back] == ["log_amount", "hour", "made_up", "daily_sum_ratio", "amount_z"]
    assert back[0]["shown"] == "1 234 567 UZS" and back[1]["weight"] == -1.0


# --- Profiles, rules, decisions -----------------------------------------------------------

def test_profiles():
    assert len(FULL.feature_names) == 28 and FULL.feature_names[0] == "log_amount"
    assert len(foreign("geo_telemetry", "session_telemetry").feature_names) == 22
    reduced = Profile({"geo_telemetry": "off", "session_telemetry": "off"})
    assert reduced.rule_cutoff() == 0.1714 and FULL.rule_cutoff() == 0.4 and reduced.rule_cutoff(scaled=False) == 0.4
    with pytest.raises(KeyError):
        Profile({"geo": "off"})
    with pytest.raises(ValueError):
        Profile({"core_history": "off"})


def decided(spark, cep, ml, hits, **kw):
    df = spark.createDataFrame([(cep, ml, hits)], "cep_score double, ml_score double, rule_hits array<string>")
    r = decision.decide(df, **kw).first()
    return r["decision"], r["predicted_type"], r["model_version"]


def test_decisions(spark):
    band = decision.Cutoffs(0.18, 0.05, 0.18)
    stale = decision.Cutoffs(0.18, 0.05, 0.2)
    d = lambda *a, **k: decided(spark, *a, **k)
    assert d(0.4, None, ["GEO_ANOMALY"]) == ("REVIEW", "ATO", S.RULES_ONLY_VERSION)
    assert d(0.39, None, []) == ("ALLOW", None, S.RULES_ONLY_VERSION)
    assert d(0.0, 0.01, ["DAILY_LIMIT_BREACH"], cutoffs=band) == ("REVIEW", None, S.MODEL_VERSION)
    assert d(1.0, 0.1, ["MULE_FAN_IN", "AMOUNT_DEVIATION"], cutoffs=band) == ("SECOND_LOOK", "MULE", S.MODEL_VERSION)
    assert d(1.0, 0.1, [], cutoffs=stale)[0] == "ALLOW"
    assert d(1.0, 0.1, [], cutoffs=band, second_look_answers=False) == ("REVIEW", None, "second-look:unscored")
    assert d(0.1, None, [], cutoffs=band)[0] == "ALLOW"
    assert d(0.0, 0.18, ["STRUCTURING", "VELOCITY"], cutoffs=band)[:2] == ("REVIEW", "STRUCTURING")


def test_second_look(spark):
    df = spark.createDataFrame([("a", .95, 99.0), ("b", .2, 99.0), ("c", None, 99.0), ("d", .2, 95.0)],
                               "transaction_id string, second_score double, scored_at_job double").withColumns(
        {"final_score": F.lit(.1), "ml_score": F.lit(.1), "decision": F.lit("SECOND_LOOK"), "model_version": F.lit("m"),
         "stage_ms": F.lit(1)})
    got = {r["transaction_id"]: r for r in decision.second_look_verdict(df, .9, "ck", F.lit(100.0)).collect()}
    assert [got[k]["decision"] for k in "abcd"] == ["REVIEW", "ALLOW", "REVIEW", "REVIEW"]
    assert [got[k]["model_version"] for k in "abcd"] == ["second-look:ck"] * 2 + ["second-look:ck:unscored"] * 2
    assert got["a"]["final_score"] == .95 and got["d"]["final_score"] == .1 and got["a"]["ml_score"] == .1
    assert "stage_ms" not in got["a"].asDict()


# --- Orders cut into slices ---------------------------------------------------------------

@pytest.fixture
def numbers(spark):
    rng = random.Random(9)
    rows = [(f"t{i}", rng.choice("abc"), float(rng.choice([1, 2, 2, 5, rng.randrange(100)])) / 100, int(rng.random() < .3))
            for i in range(300)]
    return rows, spark.createDataFrame(rows, "transaction_id string, g string, score double, label int")


def test_quantiles_and_positions(spark, small_slices, numbers):
    import numpy as np
    rows, df = numbers
    got = exact_quantiles(df, [], "score", {"m": .5, "q": .9, "z": 0.0}).first()
    v = sorted(r[2] for r in rows)
    assert np.allclose([got["m"], got["q"], got["z"]], np.quantile(v, [.5, .9, 0]))
    near = exact_quantiles(df, [], "score", {"p": .99}, nearest=True).first()["p"]
    assert near == v[int(.99 * len(v))]
    by = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "score", {"m": .5}).collect()}
    for g in "abc":
        assert math.isclose(by[g], np.median([r[2] for r in rows if r[1] == g]))
    placed = with_position(df, [F.col("score"), F.col("transaction_id")]).collect()
    assert {r["transaction_id"]: r["position"] for r in placed} == {
        r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}


def test_score_readings(spark, small_slices, numbers):
    rows, df = numbers
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    auc = sum((p > n) + .5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    scores = sorted({r[2] for r in rows}, reverse=True)
    curve = [(s, sum(r[2] >= s for r in rows), sum(r[3] for r in rows if r[2] >= s)) for s in scores]
    ap = last = 0
    for s, alerts, caught in curve:
        ap += (caught - last) / len(pos) * caught / alerts
        last = caught
    r = metrics.ranking(df).first()
    assert math.isclose(r["roc_auc"], auc) and math.isclose(r["average_precision"], ap)
    f1 = {s: 2 * c / (a + len(pos)) for s, a, c in curve}
    best = max(f1.values())
    assert metrics.best_f1_cutoff(df).first()["cutoff"] == min(s for s in scores if math.isclose(f1[s], best))
    top = sorted(rows, key=lambda r: (-r[2], r[0]))[:round(.1 * len(rows))]
    b = metrics.alert_budget(df, .1).first()
    assert (b["budget_alerts"], b["budget_caught"]) == (len(top), sum(r[3] for r in top))
    two = df.withColumn("new", F.col("score") * 2 + F.length("transaction_id") / 1000)
    k = sum(r[2] >= .05 for r in rows)
    new = sorted((r[2] * 2 + len(r[0]) / 1000 for r in rows), reverse=True)
    cut = metrics.same_workload_cut(two, "score", "new", .05).first()
    assert cut["alerts"] == k and math.isclose(cut["cutoff"], new[k - 1])
    none = metrics.same_workload_cut(two, "score", "new", 5.0).first()
    assert none["alerts"] == 0 and math.isclose(none["cutoff"], max(new) + 1e-9, rel_tol=0, abs_tol=1e-12)


def test_split_weights_pieces(spark, small_slices):
    df = spark.range(1000).select(F.col("id").alias("event_us"), F.col("id").cast("string").alias("transaction_id"),
                                  (F.col("id") % 100 == 0).cast("int").alias("label"))
    parts = {r["part"]: r["n"] for r in metrics.time_split(df).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"fit": 640, "tune": 160, "test": 200}
    assert metrics.class_weight(df).first()["weight"] == 99.0
    assert metrics.class_weight(df, "off").first()["weight"] == 1.0
    assert metrics.class_weight(df.filter("label = 0")).first()["weight"] == 1.0
    dealt = metrics.training_pieces(df, 110).groupBy("piece").agg(F.count("*").alias("n"), F.sum("label").alias("f")).collect()
    assert len(dealt) == 10 and all(r["f"] == 10 and r["n"] == 109 for r in dealt)
    # More frauds than fit into a piece: a sample of half a piece.
    dealt = metrics.training_pieces(df.withColumn("label", F.col("label").bitwiseXOR(F.lit(1))), 20, wanted=3)
    assert {(r["piece"], r["f"]) for r in dealt.groupBy("piece").agg(F.sum("label").alias("f")).collect()} == {(0, 10)}


def test_psi(spark, small_slices):
    import numpy as np
    rng = np.random.default_rng(1)
    frame = lambda v: spark.createDataFrame([(float(x), 1.0) for x in v], "a double, b double")
    ref, same, moved = rng.normal(size=400), rng.normal(size=400), rng.normal(1.0, size=400)
    score = lambda r, c: {x["feature"]: x for x in metrics.psi(frame(r), frame(c), ["a", "b"]).collect()}
    near, far = score(ref, same), score(ref, moved)
    assert not near["a"]["moved"] and far["a"]["moved"] and abs(far["b"]["psi"]) < 1e-9
    gone = metrics.psi(frame(range(400)), frame([float("nan")] * 400), ["a"]).first()
    assert gone["psi"] > 1

    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)[1:-1]))
    share = lambda x: (np.append(np.bincount(np.searchsorted(edges, x, side="right"), minlength=10), 0) + .5) / (len(x) + 5.5)
    p, q = share(ref), share(moved)
    assert math.isclose(far["a"]["psi"], float(np.sum((q - p) * np.log(q / p))), rel_tol=1e-9)


# --- Audit chain --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def log(spark):
    core = spark.range(40).select(
        F.format_string("t%02d", "id").alias("transaction_id"), F.timestamp_seconds("id").alias("event_time"),
        F.lit("ALLOW").alias("decision"), F.lit(.5).alias("final_score"), F.lit("m").alias("model_version"),
        F.array(F.lit("R")).alias("rule_hits"), F.lit("h").alias("ingress_hash"))
    built = audit.append_chain(audit.audit_core(core), ["event_time", "transaction_id"])
    return spark.createDataFrame(built.collect(), built.schema)


def findings(log, **kw):
    return sorted((r["seq"], r["finding"]) for r in audit.verify_chain(log, **kw).collect())


def test_chain(spark, log):
    assert findings(log) == [] and [r["seq"] for r in log.orderBy("seq").collect()] == list(range(40))
    change = lambda col, at, v: log.withColumn(col, F.when(F.col("seq") == at, v).otherwise(F.col(col)))
    assert findings(change("ingress_hash", 7, "x")) == [(7, "content altered")]
    assert findings(change("decision", 7, "REVIEW")) == [(7, "decision differs from payload")]
    assert findings(change("transaction_id", 7, "x")) == [(7, "id differs from payload")]
    assert findings(change("payload", 7, "{")) == [(7, "content altered"), (7, "payload is not JSON")]
    assert findings(log.filter("seq <> 7")) == [(8, "gap before"), (8, "previous hash differs")]
    assert findings(log.filter("seq > 0")) == [(1, "previous hash differs")]
    assert findings(log.filter("seq > 20"), window=10) == []
    assert findings(log.unionByName(log.filter("seq = 7"))) == [(7, "position repeated")]
    swapped = log.withColumn("seq", F.when(F.col("seq") == 7, 8).when(F.col("seq") == 8, 7).otherwise(F.col("seq")))
    assert {f for _, f in findings(swapped)} == {"content altered", "previous hash differs"}
    more = audit.append_chain(log.select(*audit.audit_core(log.withColumn("final_score", F.col("final_score").cast("double"))).columns),
                              ["event_time", "transaction_id"], 1, log.select("chain_id", "seq", "record_hash"))
    assert findings(log.unionByName(more.select(log.columns))) == []
    assert audit.chain_heads(log).first()["last_seq"] == 39


def test_copies_of_a_damaged_record_have_findings_of_their_own(spark, log):
    damaged = log.withColumn("payload", F.when(F.col("seq") == 5, "{").otherwise(F.col("payload")))
    twice = damaged.unionByName(damaged.filter("seq in (5, 6)"))
    assert findings(twice) == sorted([(5, "content altered"), (5, "payload is not JSON")] * 2 + [(5, "position repeated"), (6, "position repeated")])
    other = log.withColumn("prev_hash", F.when(F.col("seq") == 9, "0" * 64).otherwise(F.col("prev_hash")))
    assert findings(other) == [(9, "content altered"), (9, "previous hash differs")]
    assert findings(log.filter("seq <> 35"), window=10) == [(36, "gap before"), (36, "previous hash differs")]
    assert findings(log.limit(0)) == []
    two = log.unionByName(log.withColumn("chain_id", F.lit(1).cast(log.schema["chain_id"].dataType)).filter("seq <> 3"))
    assert [(r["chain_id"], r["seq"]) for r in audit.verify_chain(two).collect()] == [(1, 4), (1, 4)]


def test_checking_a_chain_is_one_shuffle_by_position(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    plan = audit.verify_chain(spark.read.parquet(str(tmp_path / "log")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Join ") == 1


def test_chain_over_slices(spark, small_slices, log):
    rows = log.drop("chain_id", "seq", "prev_hash", "record_hash")
    again = audit.append_chain(rows, ["event_time", "transaction_id"])
    assert {(r["seq"], r["record_hash"]) for r in again.collect()} == {(r["seq"], r["record_hash"]) for r in log.collect()}


# --- Cases --------------------------------------------------------------------------------

def record(spark, *rows):
    return spark.createDataFrame(rows, "transaction_id string, decision string, scored_at_job double").withColumns({
        "event_time": F.timestamp_seconds(F.lit(0)), "sender_card": F.lit("s"), "receiver_card": F.concat(F.lit("r"), "transaction_id"),
        "amount_uzs": F.lit(10), "final_score": F.lit(.5), "predicted_type": F.lit(None).cast("string"),
        "rule_hits": F.array().cast("array<string>"), "model_version": F.lit("m"), "ml_score": F.lit(.5),
        "scored_at": F.col("scored_at_job")})


def test_case_versions(spark):
    held = record(spark, ("a", "REVIEW", 10.0), ("b", "REVIEW", 20.0), ("c", "ALLOW", 30.0))
    opened = cases.open_cases(held)
    told = cases.open_cases(held.withColumns({"explanation": F.array(F.lit("x")), "explanation_status": F.lit("OK")}))
    both = cases.latest_cases(told.unionByName(opened))
    assert {r["case_id"]: r["explanation_status"] for r in both.collect()} == {"a": "OK", "b": "OK"}
    verdicts = spark.createDataFrame([("a", "CONFIRMED_FRAUD", "ann", 50.0), ("b", "NEW", "ann", 50.0),
                                      ("b", "FALSE_POSITIVE", "", 50.0), ("zz", "CONFIRMED_FRAUD", "ann", 50.0)],
                                     "case_id string, verdict string, by string, at double")
    rows, bad = cases.resolve(opened, verdicts)
    assert {(r["case_id"], r["reason"]) for r in bad.collect()} == {
        ("b", "not a terminal disposition"), ("b", "nobody named"), ("zz", "no such case")}
    # A redelivered hold never reverts a verdict.
    versions = opened.unionByName(rows).unionByName(opened).unionByName(told)
    now = {r["case_id"]: r for r in cases.latest_cases(versions).collect()}
    assert now["a"]["disposition"] == "CONFIRMED_FRAUD" and now["a"]["version"] == 50_000 and now["b"]["disposition"] == "NEW"
    accounts = lambda v, h=None: {r[0] for r in cases.confirmed_now(v, h).collect()}
    assert accounts(versions) == {"ra"}
    undone = versions.unionByName(cases.resolve(versions, spark.createDataFrame(
        [("a", "FALSE_POSITIVE", "bob", 90.0)], verdicts.schema))[0])
    history = spark.createDataFrame([("ra",)], "account string")
    assert accounts(undone) == set() and accounts(undone, history) == {"ra"}
    spans = [(r["account"], r["from_us"], r["to_us"]) for r in cases.confirmed_intervals(undone).collect()]
    assert spans == [("ra", 50_000_000, 90_000_000)]
    reports = spark.createDataFrame([("c", "client", 70.0), ("b", "client", 70.0), ("nope", "client", 70.0)],
                                    "transaction_id string, by string, at double")
    new = {r["case_id"]: r for r in cases.report(versions, held, reports).collect()}
    assert set(new) == {"b", "c"} and new["c"]["decision"] == "ALLOW" and new["b"]["decision"] == "REVIEW"
    every = cases.latest_cases(versions.unionByName(cases.report(versions, held, reports)))
    stats = queue.verdict_stats(every).first()
    assert (stats["waiting"], stats["blocked"], stats["reported"], stats["precision"]) == (0, 2, 1, 1.0)
    empty = queue.verdict_stats(opened).first()
    assert empty["precision"] is None and empty["waiting"] == 2
    holds = {r["disposition"]: r for r in queue.hold_summary(every, 100_000_000).collect()}
    assert holds["FALSE_POSITIVE"]["n"] == 0 and holds["FALSE_POSITIVE"]["median_s"] is None
    assert holds["CONFIRMED_FRAUD"]["median_s"] == 45.0 and holds["CONFIRMED_FRAUD"]["max_s"] == 50.0


def test_stage_columns(spark):
    df = spark.createDataFrame([({"rules": 1.5},), (None,)], "stage_ms map<string,double>").select(
        *[c.alias(n) for n, c in dashboards.stage_columns().items()])
    assert [(r["stage_rules_ms"], r["stage_kafka_ms"]) for r in df.collect()] == [(1.5, None), (None, None)]


# --- Adapters -----------------------------------------------------------------------------

def test_scales(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "amount double")
    assert adapters.scale_factors(df, "amount", []).first()["scale"] == S.FOREIGN_TARGET_MEDIAN / 2
    zero = spark.createDataFrame([(0.0,)], "amount double")
    assert adapters.scale_factors(zero, "amount", []).first()["scale"] == 1.0


def test_bank_file_needs_its_columns(spark):
    with pytest.raises(ValueError):
        adapters.bank_rows(spark.createDataFrame([("x",)], "Timestamp string"))


def test_materialised_matrix(spark, tmp_path):
    from ledgerlens.sources.files import materialised
    source, built = spark.range(5), []
    build = lambda: built.append(1) or source.toDF("x")
    for _ in range(2):
        assert materialised(build, source, ["x"], str(tmp_path / "m")).count() == 5
    assert len(built) == 1
    with pytest.raises(ValueError):
        materialised(build, spark.range(6), ["x"], str(tmp_path / "m"), refuse_other=True)


def test_retrain_rows(spark):
    from ledgerlens.sources.sinks import RUN_COLUMNS, run_row
    row = run_row(spark, {"outcome": "too_few_rows", "logged": 7}, datetime(2024, 1, 1, tzinfo=timezone.utc)).first()
    assert list(row.asDict()) == list(RUN_COLUMNS) and row["new_f1"] == 0.0 and row["moved"] == [] and row["logged"] == 7


def test_run_rows(spark):
    from ledgerlens.sources.sinks import run_rows
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = run_rows(spark, [({"outcome": "better", "logged": 3, "served": {"alerts": 1, "f1": 1}, "moved": ["a"]}, at), ({"error": "none"}, at)]).collect()
    assert [(r["outcome"], r["logged"], r["served_alerts"], r["served_f1"], r["new_f1"], r["moved"], r["error"]) for r in rows] == [
        ("better", 3, 1, 1.0, 0.0, ["a"], ""), ("", 0, 0, 0.0, 0.0, [], "none")]


def test_labelled_files_and_registries(spark, tmp_path):
    from ledgerlens.contract import LABELLED
    from ledgerlens.sources import files
    rows = spark.createDataFrame([(f"t{i}", f"2024-01-0{3 - i}", "0086") for i in range(3)], "transaction_id string, event_time string, sender_card string")
    whole = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LABELLED.fields])
    whole.write.csv(str(tmp_path / "csv"), header=True)
    whole.write.parquet(str(tmp_path / "parquet"))
    for fmt in ("csv", "parquet"):
        read = files.read_labelled(spark, str(tmp_path / fmt), fmt, limit=2).collect()
        assert [(r["transaction_id"], r["sender_card"]) for r in read] == [("t2", "0086"), ("t1", "0086")]
    spark.createDataFrame([(" ", "1", "none", 1.0)], "bin string, code string, name string, cards_mln double").write.csv(str(tmp_path / "banks"), header=True)
    with pytest.raises(ValueError):
        files.read_banks(spark, str(tmp_path / "banks"))


def test_a_bank_file_is_described_without_numbering_its_rows(spark):
    """Ids and scales are not read, so equal rows are not brought together; the figures are those of the transfers."""
    names = ["Timestamp", "Account", "Account", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering"]
    lines = [("2022/09/01 00:20", "a", "b", 5.0, "EUR", "Wire", 0)] * 3 + [("2022/09/01 00:20", "b", "b", 7.0, None, "Cash", 1),
             ("2022/09/03 01:20", "c", "a", None, "USD", "Wire", None), ("2022/09/02 00:00", "b", "d", 1.0, "USD", None, 1)]
    rows = adapters.bank_rows(spark.createDataFrame([(t, s, p, a, c, f, l) for t, s, p, a, c, f, l in lines],
                                                    ", ".join(f"c{i} {k}" for i, k in enumerate(("string",) * 3 + ("double", "string", "string", "int")))).toDF(*names))
    told = adapters.describe(adapters.bank_parties(rows))
    assert told.first().asDict() == {
        "rows": 6, "frauds": 2, "fraud_share": 2 / 6, "self_transfers": 1, "days": 2, "accounts": 4, "senders": 3, "payees": 3,
        "currencies": 2, "formats": 2} == adapters.describe(adapters.bank_transfers(rows)).first().asDict()
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Join" not in plan
