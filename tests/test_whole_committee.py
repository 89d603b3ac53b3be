"""The ablation fits the committee as it is deployed; members that are fitted beside each other are those fitted alone."""
import inspect

from pyspark.sql import functions as F

from ledgerlens import settings as S
from ledgerlens.plans import catalogue_store, model, training


def test_the_ablation_fits_every_seed_and_tree(spark, sf, monkeypatch):
    asked, real = [], model.fit_committee

    def fit(*args, **named):
        call = inspect.signature(real).bind(*args, **named)
        call.apply_defaults()
        asked.append(tuple(call.arguments[k] for k in ("seeds", "trees", "depth", "step")))
        return real(*args, **named | dict(seeds=(1,), trees=1, depth=1))

    monkeypatch.setattr(training, "fit_committee", fit)
    rows = catalogue_store.source_ablation(spark, sf).collect()
    assert asked == [(S.COMMITTEE_SEEDS, 400, 5, .05)] * 2
    assert {r["profile"] for r in rows} == {"full", "no payee side"} and all(r["in_range"] for r in rows)


def test_members_are_those_of_their_seeds(spark):
    rows = spark.range(0, 600, 1, 1).select(
        F.rand(3).alias("a"), F.rand(4).alias("b"), F.when(F.rand(5) < .3, 1).otherwise(0).alias("label"))
    told = lambda *seeds: [m.toDebugString.split("\n", 1)[1]
                           for m in model.fit_committee(rows, ["a", "b"], seeds=seeds, trees=3, depth=2).members]
    both = told(1, 2)
    assert both == told(1) + told(2) and both[0] != both[1]
