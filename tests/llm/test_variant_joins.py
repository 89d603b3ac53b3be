"""Spelling variants: no join goes through the driver, whatever size Spark takes its tables for."""
from ledgerlens.llm import variants


def test_no_table_is_broadcast(spark):
    counts = spark.createDataFrame([("kitten", 9), ("kiten", 3), ("mitten", 20), ("sitting", 4)], "word string, n long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pairs, found = variants.near_pairs(counts), variants.grouped(counts)
    assert "SortMergeJoin" in plan(pairs) and "Broadcast" not in plan(pairs)
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    assert sorted((r["word"], r["form"], r["root"], r["n_near"]) for r in found.collect()) == [
        ("kiten", "kitten", "mitten", 1), ("kitten", "mitten", "mitten", 2), ("mitten", None, "mitten", 1), ("sitting", None, "sitting", 0)]
