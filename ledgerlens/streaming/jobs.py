"""The live job: wire records in, decisions out, by the same plans as the batch.

Each micro-batch is scored together with the earlier transfers of the accounts it touches, so a
decision on the stream equals the one a replay gives. What a batch writes lies in folders of its own
number: after a failure the batch runs again and replaces them.

`KeyedJob` keeps what it needs of history in keyed state and is the one to run; `Job` reads history from tables through the batch
plans, which deal a hot account into slices, and is for backfills and for accounts whose week does not fit a task.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import settings as S
from ..contract import to_transfers
from ..operators.cases import CASE_ROWS, CASE_VERSIONS, confirmed_intervals, latest_cases, open_cases, resolve
from ..operators.decision import Cutoffs, decide, decision_record, second_look_verdict
from ..operators.features import transfer_features
from ..operators.rules import with_rules
from ..plans.dashboards import before_operator
from ..profile import FULL, Profile
from ..sources import ingest
from ..sources.files import stored
from ..sources.sinks import read_batch, read_table, store_decisions, write_batch
from ..sources.state import Buckets
from . import keyed, snapshots


@dataclass
class Job:
    """What a live job needs: where its tables are, what its data has, and how it decides."""
    root: str
    profile: Profile = FULL
    cutoffs: Cutoffs = field(default_factory=Cutoffs)
    score: Callable[[DataFrame], DataFrame] | None = None     # adds ml_score; None: rules only
    key: Column | None = None
    require_encrypted: bool = False
    second_look_answers: Callable[[], bool] = lambda: True
    audit_all: bool = True
    chains: int = 1
    known_accounts: Callable[[SparkSession], DataFrame | None] = lambda spark: None   # `account`: confirmed before the job began

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of wire records (value, arrived)."""
        spark = batch.sparkSession
        records = batch.persist()
        try:
            usable, refused = ingest.split_usable(ingest.decode(records, self.key, self.require_encrypted))
            write_batch(refused.select("raw", "routing", "reject_reason"), self.root, "quarantine", batch_id)
            arrived = usable.groupBy("transaction_id").agg(F.min("arrived").alias("arrived"))
            fresh = to_transfers(ingest.deduplicated(usable).drop("arrived"), self.profile).join(arrived, "transaction_id")
            history = read_table(spark, self.root, "transfers")
            if history is not None:
                history = history.filter(F.col("batch") < batch_id).drop("batch")
                # A record delivered again rewrites itself: its first decision stands.
                fresh = fresh.join(history.select("transaction_id"), "transaction_id", "left_anti")
            write_batch(fresh, self.root, "transfers", batch_id)
            fresh = spark.read.schema(fresh.schema).parquet(f"{self.root}/transfers/batch={batch_id}")
            scored = self.decide(fresh, history)
            write_batch(scored, self.root, "records", batch_id)
            store_decisions(spark.read.schema(scored.schema).parquet(f"{self.root}/records/batch={batch_id}"),
                            self.root, batch_id, self.audit_all, self.chains)
        finally:
            records.unpersist()

    def decide(self, fresh: DataFrame, history: DataFrame | None) -> DataFrame:
        """Decision records of the fresh transfers."""
        rows = self.decided(self.features(fresh, history))
        now = F.unix_micros(F.current_timestamp()) / 1e6
        appended = F.unix_micros("arrived") / 1e6
        return decision_record(rows.withColumns({
            "scored_at_job": now, "scoring_ms": F.bround((now - appended) * 1000, 3),
            "stage_ms": before_operator(F.col("ingested_at"), appended, now)}), self.profile)

    def decided(self, rows: DataFrame) -> DataFrame:
        """Transfers with features as scored and decided ones."""
        rows = with_rules(rows, self.profile)
        rows = self.score(rows) if self.score else rows.withColumn("ml_score", F.lit(None).cast("double"))
        return decide(rows, self.cutoffs, self.profile, self.second_look_answers())

    def features(self, fresh: DataFrame, history: DataFrame | None) -> DataFrame:
        cases = read_table(fresh.sparkSession, self.root, "cases")
        # Read anew for each batch: a verdict counts from the next batch on.
        known = self.known_accounts(fresh.sparkSession)
        confirmed = None if cases is None and known is None else confirmed_intervals(
            fresh.sparkSession.createDataFrame([], CASE_VERSIONS) if cases is None else cases.drop("batch"), known)
        if history is None:
            return transfer_features(fresh, confirmed, self.profile)
        context, prior = snapshots.context_of(fresh, history, self.root)
        both = fresh.withColumn("fresh", F.lit(True)).unionByName(context.withColumn("fresh", F.lit(False)))
        return transfer_features(both, confirmed, self.profile, prior=prior).filter("fresh").drop("fresh")

    def start(self, records: DataFrame, checkpoint: str, every: str | None = "2 seconds"):
        """Run on a stream of records: every so often, or with None over what there is and stop. A new
        checkpoint starts from nothing; an old one goes on."""
        writer = records.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


@dataclass
class KeyedJob(Job):
    """The live job with its history in keyed state: a batch costs what its own rows cost. Ids are remembered as long as `replayed_within`
    says, so a record that is delivered again is dropped before it touches the state; verdicts come in by the `flags` table."""
    replayed_within: str = "1 hour"
    silent_days: float | None = S.FORGET_SENDER_DAYS

    def start(self, records: DataFrame, checkpoint: str, every: str | None = "2 seconds"):
        usable, _ = ingest.split_usable(ingest.decode(records, self.key, self.require_encrypted))
        transfers = to_transfers(ingest.deduplicated(usable, self.replayed_within), self.profile)
        return keyed.start(keyed.measured(keyed.halves(transfers, self._flags(records.sparkSession)), self.silent_days),
                           self, checkpoint, every)

    def start_quarantine(self, records: DataFrame, checkpoint: str, every: str | None = "2 seconds"):
        """What cannot be scored, as a query of its own on the same records: it needs no state."""
        _, refused = ingest.split_usable(ingest.decode(records, self.key, self.require_encrypted))
        refused = refused.select("raw", "routing", "reject_reason")
        return keyed.start(refused, lambda rows, n: write_batch(rows, self.root, "quarantine", n), checkpoint, every)

    def _flags(self, spark: SparkSession) -> DataFrame:
        """The stream of accounts whose flag goes up or down, from those confirmed before the job began."""
        if read_table(spark, self.root, "flags", FLAG) is None:
            known = self.known_accounts(spark)
            known = spark.createDataFrame([], FLAG) if known is None else known.select(
                "account", F.lit(0).cast("bigint").alias("us"), F.lit(1).alias("step"))
            write_batch(known, self.root, "flags", "_known_")
        return spark.readStream.schema(FLAG).parquet(f"{self.root}/flags")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of measured halves."""
        spark, marks = batch.sparkSession, [time.time()]
        rows = batch.persist()
        rows.count()
        marks.append(time.time())
        decided = self.decided(keyed.features(rows)).persist()
        try:
            scored = decided.count()
            marks.append(time.time())
            write_batch(self.record(decided, marks), self.root, "records", batch_id)
            stored_rows = read_batch(spark, self.root, "records", batch_id)
            store_decisions(stored_rows, self.root, batch_id, self.audit_all, self.chains)
            opened = open_cases(stored_rows)
            if not opened.isEmpty():
                case_state(self.root).merge(opened)
            marks.append(time.time())
            spent = [round((b - a) * 1000, 3) for a, b in zip(marks, marks[1:])]
            timing = spark.createDataFrame([(scored, *spent, round((marks[-1] - marks[0]) * 1000, 3))], TIMING)
            write_batch(timing, self.root, "timings", batch_id)
        finally:
            decided.unpersist()
            rows.unpersist()

    def record(self, decided: DataFrame, marks: list[float]) -> DataFrame:
        """Decision records that say what was measured: the state's share of the batch, and that of the rules, the model and the
        decision; all transfers of a batch wait for each other."""
        came, measured, done = marks
        appended = F.unix_micros("arrived") / 1e6
        own = {"state": round((measured - came) * 1000, 3), "rules": round((done - measured) * 1000, 3)}
        stages = F.map_concat(before_operator(F.col("ingested_at"), appended, F.lit(came)),
                              F.create_map(*[F.lit(x) for pair in own.items() for x in pair]))
        return decision_record(decided.withColumns({
            "scored_at_job": F.lit(done), "scoring_ms": F.lit(sum(own.values())), "stage_ms": stages}), self.profile)


#: An account whose flag goes up (1) or down (-1) at a moment.
FLAG = "account string, us bigint, step int"
#: What a batch took: its parts add up to the whole.
TIMING = "rows bigint, state_ms double, decide_ms double, store_ms double, batch_ms double"


def case_state(root: str) -> Buckets:
    """The version of each case that counts."""
    return Buckets(root, "case_state", ["case_id"], [F.desc(c) for c in ("version", "resolved_at", "explanation_status")])


def give_verdicts(spark: SparkSession, root: str, verdicts: DataFrame, batch_id: int) -> DataFrame:
    """Verdicts (case_id, verdict, by, at) on stored cases: new versions in `cases` and `case_state`, and in `flags` the accounts
    whose flag goes up or down, which the keyed job reads. Only the buckets of these cases are read and written. Returns the
    verdicts that cannot stand. A batch may run again: its flags stand from the first time that they were written whole."""
    state = case_state(root)
    known = state.of(verdicts.select("case_id"))
    known = stored(spark.createDataFrame([], CASE_ROWS) if known is None else known)
    fresh, refused = resolve(known, verdicts)
    fresh = stored(fresh)
    if read_batch(spark, root, "flags", batch_id) is None:
        fraud = lambda side: F.coalesce(F.col(f"{side}.disposition") == "CONFIRMED_FRAUD", F.lit(False)).cast("int")
        change = fraud("a") - fraud("k")
        after = latest_cases(known.unionByName(fresh)).alias("a").join(known.alias("k"), "case_id")
        write_batch(after.filter((change != 0) & (F.col("a.receiver_card") != "")).select(
            F.col("a.receiver_card").alias("account"), F.unix_micros("a.resolved_at").alias("us"), change.alias("step")),
            root, "flags", batch_id)
    write_batch(fresh, root, "cases", f"_verdicts_{batch_id}")
    if not fresh.isEmpty():
        state.merge(fresh)
    return refused


def second_look(root: str, scorer: Callable[[DataFrame], DataFrame], cut: float, checkpoint_name: str,
                chains: int = 1) -> Callable[[DataFrame, int], None]:
    """The second look on a stream of waiting decisions: `scorer` adds second_score. Its records
    replace the waits; what waited past the deadline is held unscored."""
    def handle(waiting: DataFrame, batch_id: int) -> None:
        now = F.unix_micros(F.current_timestamp()) / 1e6
        done = second_look_verdict(scorer(waiting), cut, checkpoint_name, now)
        done = done.withColumn("stage_ms", F.lit(None).cast("map<string,double>"))
        store_decisions(done, root, batch_id, chains=chains, source="_second_look_")
    return handle


def minutes(decisions: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Decisions and holds per minute on a stream, late ones counted as long as `late` says."""
    held = F.col("decision") == "REVIEW"
    return (decisions.withWatermark("event_time", late).groupBy(F.window("event_time", every))
            .agg(F.count(F.lit(1)).alias("checked"), F.sum(held.cast("bigint")).alias("held"))
            .select(F.col("window.start").alias("minute"), "checked", "held"))
