"""A chain is walked by a task of its own, over rows that were sorted once."""
from pyspark.sql import functions as F

from ledgerlens.operators import audit


def test_each_chain_has_a_task_and_no_window(spark):
    core = spark.range(400).select(F.col("id").cast("string").alias("transaction_id"), (F.col("id") % 50).alias("event_time"),
                                   F.lit("i").alias("ingress_hash"), F.lit("p").alias("payload"))
    built = audit.append_chain(core, ["event_time", "transaction_id"], 16)
    assert "Window" not in built._jdf.queryExecution().optimizedPlan().toString()
    rows = built.withColumn("task", F.spark_partition_id()).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault(r["chain_id"], set()).add(r["task"])
    assert len(tasks) == 16 and all(len(t) == 1 for t in tasks.values()) and len(set.union(*tasks.values())) == 16
    for chain in tasks:
        placed = sorted((r["seq"], r["event_time"], r["transaction_id"]) for r in rows if r["chain_id"] == chain)
        assert [p[0] for p in placed] == list(range(len(placed))) and [p[1:] for p in placed] == sorted(p[1:] for p in placed)
    assert audit.verify_chain(built.withColumn("decision", F.lit("")).withColumn("payload", F.lit("p"))).filter(
        "finding = 'previous hash differs'").count() == 0
