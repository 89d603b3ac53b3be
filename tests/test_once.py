"""Plans that go over rows several times compute them once."""
import pytest

from ledgerlens.operators import metrics
from ledgerlens.plans.rolling import rolling


@pytest.fixture
def counted(spark):
    """Rows as they are, and how many of them were computed."""
    seen = spark.sparkContext.accumulator(0)

    def through(rows):
        def count(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf
        return rows.mapInPandas(count, rows.schema)
    return through, seen


@pytest.fixture(params=[None, 30])
def few_a_slice(spark, request):
    if request.param:
        spark.conf.set("ledgerlens.rowsPerSlice", request.param)
    yield
    spark.conf.unset("ledgerlens.rowsPerSlice")


def test_time_split_computes_its_rows_once(spark, counted, few_a_slice):
    through, seen = counted
    rows = through(spark.range(200).selectExpr("id event_us", "cast(id as string) transaction_id"))
    parts = metrics.time_split(rows).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"fit": 128, "tune": 32, "test": 40}
    assert seen.value == 200


def test_drift_computes_its_rows_once(spark, counted, few_a_slice):
    through, seen = counted
    rows = through(spark.range(200).selectExpr("cast(id % 50 as double) a", "cast(null as double) b", "id"))
    got = {r["feature"]: r for r in metrics.psi(rows.filter("id < 100"), rows.filter("id >= 100"), ["a", "b"]).collect()}
    assert got["a"]["psi"] == pytest.approx(0) and got["b"]["psi"] == pytest.approx(0)
    assert seen.value == 400    # once for each side


def test_models_over_time_compute_their_rows_once(spark, counted, few_a_slice):
    through, seen = counted
    rows = through(spark.range(200).selectExpr(
        "id event_us", "cast(id as string) transaction_id", "cast(id % 7 = 0 as int) label", "if(id % 3 = 0, 'REVIEW', 'ALLOW') decision",
        "if(id % 3 = 0, array('VELOCITY'), array()) rule_hits"))
    assert rolling(rows).count() == 9
    assert seen.value == 200
