"""Cross-fitted classifiers, calibration and combination with Spark ML.

Folds are folds of entities: a pair is always scored by a model that saw no pair of its entity, and
early stopping is watched on entities that the trees were not grown on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.folds import entity_uniform, key_of


def shared_features(frames: list[DataFrame], wanted: list[str]) -> list[str]:
    """The wanted features that every frame has, in order."""
    return [c for c in wanted if all(c in f.columns for f in frames)]


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def learner(kind: str, seed: int = 7, **options):
    """A model family by name."""
    if kind == "gbt":
        return GBTClassifier(seed=seed, maxIter=20, validationIndicatorCol="held", validationTol=0.001, **options)
    if kind == "forest":
        return RandomForestClassifier(seed=seed, numTrees=30, **options)
    return LogisticRegression(maxIter=50, **options)


def cross_fit(df: DataFrame, features: list[str], folds: list[int], entity: str = "s1", kind: str = "gbt", stop_share: float = 0.1, train_share: float = 1.0, salt: int = 5, **options) -> list:
    """One model per fold, fitted on the other folds. ``df`` has features, label and fold."""
    rows, key, out = assembled(df, features), key_of(df, entity), []
    for f in folds:
        own = rows.where(F.col("fold").isin([x for x in folds if x != f]) & (entity_uniform(key, salt) < train_share))
        fit = own.withColumns({"held": entity_uniform(key, salt + 1) < stop_share, "label": F.col("label").cast("double")})
        out.append((f, learner(kind, **options).fit(fit)))
    return out


def _p(model, df: DataFrame, name: str) -> DataFrame:
    own = model.transform(df)
    return own.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def cross_predict(models: list, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    """``p``: of the model that did not see the row's fold; the mean of all for other folds."""
    out = assembled(df, features)
    for f, m in models:
        out = _p(m, out, f"_p{f}")
    mean = reduce(lambda a, b: a + b, [F.col(f"_p{f}") for f, _ in models]) / len(models)
    value: Column = mean
    if "fold" in df.columns:
        for f, _ in models:
            value = F.when(F.col("fold") == f, F.col(f"_p{f}")).otherwise(value)
    return out.withColumn(name, value).drop("features", *[f"_p{f}" for f, _ in models])


def choose_ensemble(scores: dict[str, float], first: str, least_gain: float = 0.0005) -> str:
    """The first family unless another option is better by ``least_gain``; then the best, by name on ties."""
    better = {k: v for k, v in scores.items() if k != first and v >= scores[first] + least_gain}
    return max(sorted(better), key=better.get) if better else first


def importances(model, features: list[str], n: int = 20) -> list[tuple[str, float]]:
    """The features with the largest shares of the gain."""
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def calibrated(fit: DataFrame, df: DataFrame, p: str = "p", name: str = "q") -> DataFrame:
    """``q``: isotonic calibration of ``p`` fitted on ``fit`` (p, label), clipped to its range."""
    model = IsotonicRegression(featuresCol="_x", labelCol="_y").fit(fit.select(F.col(p).cast("double").alias("_x"), F.col("label").cast("double").alias("_y")))
    return model.transform(df.withColumn("_x", F.col(p).cast("double"))).withColumnRenamed("prediction", name).drop("_x")


def combiner_features(p: Column, s: Column) -> list[Column]:
    """Logit of p, logit of a second score, and their product, clipped."""

    def logit(x: Column, low: float) -> Column:
        c = F.least(F.greatest(x, F.lit(low)), F.lit(1 - low))
        return F.log(c / (1 - c))

    a, b = logit(p, 1e-4), logit(s, 0.02)
    return [a, b, a * b]


def combined(fit: DataFrame, df: DataFrame, p: str = "p", s: str = "s", least: int = 200) -> DataFrame:
    """``p_new``: a logistic combination of two scores where the second is there, else ``p``."""
    names = ["_c0", "_c1", "_c2"]

    def with_features(x: DataFrame) -> DataFrame:
        return assembled(x.withColumns(dict(zip(names, combiner_features(F.col(p), F.col(s)), strict=True))), names)

    own = fit.where(F.col(s).isNotNull())
    if own.count() < least:
        raise ValueError(f"fewer than {least} pairs have a second score")
    model = LogisticRegression(maxIter=200, regParam=0.0).fit(with_features(own).withColumn("label", F.col("label").cast("double")))
    scored = _p(model, with_features(df.where(F.col(s).isNotNull())), "p_new").drop("features", *names)
    return scored.unionByName(df.where(F.col(s).isNull()).withColumn("p_new", F.col(p)))
