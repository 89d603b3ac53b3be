"""A committee of boosted-tree models: fitting, scoring, and each feature's share of a score."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.util import inheritable_thread_target

from .. import settings as S
from ..functions.phrases import phrase_sql
from ..operators.metrics import class_weight, training_pieces
from ..sources.files import shared_folder, stored


@dataclass
class Committee:
    """Models that score together: the mean of their log-odds."""
    members: list
    features: list[str]

    def check(self, features: list[str]) -> None:
        """A model serves only the columns it was fitted on."""
        if list(features) != self.features:
            raise ValueError(f"the model takes {len(self.features)} features {self.features[:3]}..., "
                             f"the profile supplies {len(features)}")


def _vector(rows: DataFrame, features: list[str]) -> DataFrame:
    typed = rows.withColumns({f"_x_{f}": F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features})
    assembler = VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="_x", handleInvalid="keep")
    return assembler.transform(typed).drop(*[f"_x_{f}" for f in features])


def fit_committee(rows: DataFrame, features: list[str], seeds=S.COMMITTEE_SEEDS, trees: int = 400,
                  depth: int = 5, step: float = 0.05, weighting: str = "auto") -> Committee:
    """One boosted-tree fit per seed on rows with a 0/1 `label`. A tree is a few short jobs that each wait for the one before, so the
    members are fitted beside each other. Boosting cuts its lineage by checkpoints, in the shared folder if the session names none."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    weight = class_weight(rows, weighting).first()["weight"]
    data = _vector(rows, features).select(
        "_x", F.col("label").cast("double").alias("label"),
        F.when(F.col("label") == 1, weight).otherwise(1.0).alias("_w")).persist()

    def fit(seed: int):
        return GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=trees,
                             maxDepth=depth, stepSize=step, subsamplingRate=0.8,
                             featureSubsetStrategy="0.8", minInstancesPerNode=30, seed=seed).fit(data)

    try:
        with ThreadPoolExecutor(len(seeds)) as pool:
            members = list(pool.map(inheritable_thread_target(rows.sparkSession)(fit), seeds))
    finally:
        data.unpersist()
    return Committee(members, list(features))


def score(model: Committee, rows: DataFrame, name: str = "ml_score") -> DataFrame:
    """`rows` with the committee's probability: the logistic of the members' mean log-odds."""
    scored = _vector(rows, model.features)
    raws = []
    for i, member in enumerate(model.members):
        member = member.copy().setRawPredictionCol(f"_raw{i}").setProbabilityCol("").setPredictionCol("")
        scored = member.transform(scored)
        # Spark keeps half the log-odds.
        raws.append(2 * F.get(vector_to_array(F.col(f"_raw{i}")), F.lit(1)))
    margin = sum(raws[1:], raws[0]) / len(raws)
    return scored.withColumn(name, 1 / (1 + F.exp(-margin))).drop("_x", *[f"_raw{i}" for i in range(len(raws))])


def _trees(model: Committee) -> list[tuple]:
    """Every tree as arrays: weight, feature, threshold, left, right, value; -1 marks a leaf."""
    out = []
    for member in model.members:
        for weight, tree in zip(member.treeWeights, member.trees):
            feature, threshold, left, right, value = [], [], [], [], []

            def add(node):
                at = len(feature)
                value.append(node.prediction())
                for column, blank in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1)):
                    column.append(blank)
                if node.subtreeDepth() > 0:
                    feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
                    left[at] = add(node.leftChild())
                    right[at] = add(node.rightChild())
                return at

            add(tree._java_obj.rootNode())
            out.append((2.0 * weight / len(model.members), np.array(feature), np.array(threshold),
                        np.array(left), np.array(right), np.array(value)))
    return out


def _path_shares(x: np.ndarray, trees: list[tuple]) -> tuple[np.ndarray, float]:
    """What each feature added to each row's log-odds along its paths, and the common bias."""
    shares, bias = np.zeros_like(x), 0.0
    rows = np.arange(len(x))
    for weight, feature, threshold, left, right, value in trees:
        bias += weight * value[0]
        node = np.zeros(len(x), dtype=int)
        while True:
            split = feature[node] >= 0
            if not split.any():
                break
            r, n = rows[split], node[split]
            with np.errstate(invalid="ignore"):
                down = np.where(x[r, feature[n]] <= threshold[n], left[n], right[n])
            np.add.at(shares, (r, feature[n]), weight * (value[down] - value[n]))
            node[split] = down
    return shares, bias


def contributions(model: Committee, rows: DataFrame, vector: str = "features") -> DataFrame:
    """`rows` plus `contributions` per feature and `recomputed`, the probability they add up to."""
    shared = rows.sparkSession.sparkContext.broadcast(_trees(model))
    width = len(model.features)

    def explain(batches):
        for pdf in batches:
            x = np.array([[np.nan if v is None else v for v in f] if f is not None and len(f) == width
                          else [np.nan] * width for f in pdf[vector]], dtype=float).reshape(len(pdf), width)
            shares, bias = _path_shares(x, shared.value)
            yield pdf.assign(contributions=list(shares), bias=bias,
                             recomputed=1 / (1 + np.exp(-(shares.sum(axis=1) + bias))))

    schema = T.StructType(rows.schema.fields + [
        T.StructField("contributions", T.ArrayType(T.DoubleType())),
        T.StructField("bias", T.DoubleType()), T.StructField("recomputed", T.DoubleType())])
    return rows.mapInPandas(explain, schema)


def explain_holds(model: Committee | None, records: DataFrame, top: int = 3) -> DataFrame:
    """Records (id, features, ml_score) with `explanation_status` and `explanation`, the largest
    pushes upwards in words. No explanation when the model does not reproduce the recorded score."""
    absent = F.col("features").isNull() | (F.size("features") == 0)
    early = F.when(absent, "NO_FEATURES").when(F.col("ml_score").isNull(), "RULES_ONLY")
    empty = F.array().cast("array<string>")
    if model is None:
        return records.withColumns({"explanation_status": early.otherwise("NO_MODEL"), "explanation": empty})
    done = contributions(model, records)
    off = F.abs(F.col("recomputed") - F.col("ml_score")) > S.EXPLAIN_TOLERANCE
    status = (early.when(F.size("features") != len(model.features), "FAILED")
              .when(off, "MODEL_MISMATCH").otherwise("OK"))
    names = F.array(*[F.lit(f) for f in model.features])
    parts = F.arrays_zip(names.alias("feature"), F.col("features").alias("value"),
                         F.col("contributions").alias("share"))
    done = done.withColumns({"explanation_status": status, "_parts": F.transform(
        parts, lambda p: F.struct(p["share"].alias("share"), p["feature"].alias("feature"), p["value"].alias("value")))})
    lines = F.expr(f"transform(slice(array_sort(filter(_parts, p -> p.share > 0), (a, b) -> "
                   f"case when a.share > b.share then -1 when a.share < b.share then 1 else 0 end), 1, {top}), "
                   f"p -> {phrase_sql('p.feature', 'p.value', 'p.share')})")
    return (done.withColumn("explanation", F.when(F.col("explanation_status") == "OK", lines).otherwise(empty))
            .drop("_parts", "contributions", "bias", "recomputed"))


# --- The second look's model --------------------------------------------------------------

def second_look_scores(context: DataFrame, band: DataFrame, features: list[str], pieces: int = 2,
                       piece_rows: int = S.PIECE_ROWS) -> DataFrame:
    """A second model's view of the band: the mean of `pieces` classifiers, each fitted on a piece of the training rows after median
    imputation and scaling. The first so many pieces, of `piece_rows` each, bound the rows that are fitted on; the whole band is
    scored."""
    dealt = stored(training_pieces(context, piece_rows, wanted=pieces))
    scored, names = band, []
    for k in range(pieces):
        part = dealt.filter(F.col("piece") == k)
        if part.isEmpty():
            break
        cols = [f"_f_{f}" for f in features]
        typed = lambda df: df.withColumns({f"_f_{f}": F.col(f).cast("double") for f in features})
        imputer = Imputer(strategy="median", inputCols=cols, outputCols=[f"{c}_i" for c in cols]).fit(typed(part))
        assembler = VectorAssembler(inputCols=[f"{c}_i" for c in cols], outputCol="_v", handleInvalid="keep")
        ready = lambda df: assembler.transform(imputer.transform(typed(df))).drop(*cols, *[f"{c}_i" for c in cols])
        train = ready(part)
        scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(train)
        model = LogisticRegression(featuresCol="_s", labelCol="label", regParam=0.01, maxIter=50,
                                   probabilityCol=f"_p{k}", rawPredictionCol="", predictionCol="").fit(scaler.transform(train))
        scored = model.transform(scaler.transform(ready(scored))).withColumn(
            f"_p{k}", F.get(vector_to_array(F.col(f"_p{k}")), F.lit(1))).drop("_v", "_s")
        names.append(f"_p{k}")
    mean = sum([F.col(n) for n in names[1:]], F.col(names[0])) / len(names)
    return scored.withColumn("second_score", mean).drop(*names)
