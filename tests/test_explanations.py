"""Explanations of all transfers that may be held."""


def test_every_later_transfer_is_explained(spark, sf):
    import duckdb
    import __spark_entry__ as entry
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    cur = con.execute(entry.oracle_sql()["explain_every"])
    want = dict(zip([c[0] for c in cur.description], cur.fetchone(), strict=True))
    [got] = entry.queries()["explain_every"](spark, sf).collect()
    assert got.asDict() == want and got["rows"] > 100
