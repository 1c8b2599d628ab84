"""Failure classifiers, remaining-life regressors, clusterings and projections on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwarden.operators.evaluation import areas, best_threshold, classification_report, confusion, curve_points, threshold_sweep
from millwarden.operators.boosting import BoostedModel, Boosting, fit_boosted
from millwarden.operators.kmeans import KMeansFit, fit_kmeans
from millwarden.operators.preparing import Preparation, fit_preparation
from millwarden.session import cut_lineage
from millwarden.operators.splitting import group_split, stratified_folds, stratified_split

SEED = 42


def classifiers(trees: int = 300, rounds: int = 200, boosted_rounds: int = 300) -> dict[str, Callable[[], Estimator | Boosting]]:
    """The one configuration of each model, shared by training, cross-validation and out-of-fold scoring."""
    at = {"featuresCol": "features", "labelCol": "label"}
    return {
        "logistic_regression": lambda: LogisticRegression(**at, weightCol="weight", maxIter=100, tol=1e-4),
        "decision_tree": lambda: DecisionTreeClassifier(**at, weightCol="weight", maxDepth=8, seed=SEED),
        "random_forest": lambda: RandomForestClassifier(**at, weightCol="weight", numTrees=trees, maxDepth=12, seed=SEED),
        "naive_bayes": lambda: NaiveBayes(**at, modelType="gaussian"),
        "gradient_boosting": lambda: Boosting(rounds, 3, newton=False, ridge=0.0, least_curvature=0.0, seed=SEED),
        "boosted_trees_weighted": lambda: Boosting(boosted_rounds, 5, row_share=0.8, column_share=0.8, balanced=True, seed=SEED),
    }


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weight, and the negative/positive ratio on positive rows, as row constants."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    total, classes = sum(counts.values()), max(1, len(counts))
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(total / (classes * n))).otherwise(weight)
    ratio = counts.get(0, 0) / counts[1] if counts.get(1) else 1.0
    return df.withColumn("weight", weight).withColumn("positive_weight", F.when(F.col(label) == 1, F.lit(ratio)).otherwise(1.0))


def model_input(df: DataFrame, preparation: Preparation, label: str, keep: Sequence[str]) -> DataFrame:
    ready = VectorAssembler(inputCols=preparation.feature_names, outputCol="features").transform(preparation.transform(df))
    return ready.select(*keep, F.col(label).cast("double").alias("label"), "features")


def probability() -> Column:
    return vector_to_array("probability")[1]


def score(model: Model | BoostedModel, df: DataFrame, keep: Sequence[str], name: str) -> DataFrame:
    if isinstance(model, BoostedModel):
        return model.score(df, [*keep, "label"]).select(*keep, "label", F.lit(name).alias("model"), "p")
    return model.transform(df).select(*keep, "label", F.lit(name).alias("model"), probability().alias("p"))


def fit_all(tables: Sequence[DataFrame], models: dict[str, Callable[[], Estimator | Boosting]], key: str) -> list[dict[str, Model | BoostedModel]]:
    """Every model on every table; the boosted ones of all tables grow in the same passes."""
    made = {name: make() for name, make in models.items()}
    specs = {name: m for name, m in made.items() if isinstance(m, Boosting)}
    boosted = fit_boosted(tables, list(specs.values()), key=key) if specs else [[]] * len(tables)
    return [{name: dict(zip(specs, own))[name] if name in specs else m.fit(table) for name, m in made.items()} for table, own in zip(tables, boosted)]


def train_and_score(df: DataFrame, key: str, label: str, models: dict[str, Callable[[], Estimator | Boosting]]) -> DataFrame:
    """Split, prepare on the train part, fit every model, score the held-out part."""
    split = cut_lineage(stratified_split(df, label, key))
    train, test = split.filter("part = 'train'"), split.filter("part = 'test'")
    preparation = fit_preparation(train)
    ready = cut_lineage(with_weights(model_input(train, preparation, label, [key])))
    held = model_input(test, preparation, label, [key])
    (fitted,) = fit_all([ready], models, key)
    return reduce(DataFrame.unionByName, [score(model, held, [key], name) for name, model in fitted.items()])


def fold_tables(df: DataFrame, key: str, label: str, folds: int, prefit: bool = False) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per fold, the prepared rows of the other folds and its own.

    Preparation is refitted on each fold's own train rows; ``prefit`` learns it
    once on all rows instead.
    """
    # Written once: every fold of every model reads it.
    folded = cut_lineage(stratified_folds(df, label, key, folds))
    shared = fit_preparation(df) if prefit else None
    tables, held = [], []
    for fold in range(folds):
        train = folded.filter(F.col("fold") != fold)
        preparation = shared or fit_preparation(train)
        tables.append(cut_lineage(with_weights(model_input(train, preparation, label, [key]))))
        held.append(model_input(folded.filter(F.col("fold") == fold), preparation, label, [key, "fold"]))
    return tables, held


def out_of_fold(df: DataFrame, key: str, label: str, models: dict[str, Callable[[], Estimator | Boosting]], folds: int = 5, prefit: bool = False) -> DataFrame:
    """Every row scored once per model, by the fit that did not see its fold."""
    tables, held = fold_tables(df, key, label, folds, prefit)
    fitted = fit_all(tables, models, key)
    return reduce(DataFrame.unionByName, [score(model, rows, [key, "fold"], name) for rows, of_fold in zip(held, fitted) for name, model in of_fold.items()])


def locked_evaluation(df: DataFrame, key: str, label: str, models: dict[str, Callable[[], Estimator | Boosting]], folds: int = 5) -> DataFrame:
    """Per model the threshold of highest F1 out of fold on the train part, and its rates on the test part, which chose nothing.

    The fits on the whole train part and those of its folds share the boosted models' passes.
    """
    split = cut_lineage(stratified_split(df, label, key))
    train, test = split.filter("part = 'train'").drop("part"), split.filter("part = 'test'").drop("part")
    tables, held = fold_tables(train, key, label, folds)
    preparation = fit_preparation(train)
    tables.append(cut_lineage(with_weights(model_input(train, preparation, label, [key]))))
    *of_folds, last = fit_all(tables, models, key)
    scored = [score(model, rows, [key, "fold"], name) for rows, of_fold in zip(held, of_folds) for name, model in of_fold.items()]
    chosen = best_threshold(threshold_sweep(cut_lineage(reduce(DataFrame.unionByName, scored)), ["model"], "p", "label"), ["model"])
    tested = cut_lineage(reduce(DataFrame.unionByName, [score(model, model_input(test, preparation, label, [key]), [key], name) for name, model in last.items()]))
    # One threshold per model.
    marked = tested.join(F.broadcast(chosen.select("model", "best_threshold")), "model")
    rates = classification_report(confusion(marked, ["model", "best_threshold"], F.col("p") >= F.col("best_threshold"), "label"))
    return rates.join(areas(curve_points(tested, ["model"], "p", "label"), ["model"]).drop("pr_auc"), "model").orderBy(F.desc("f1"), "model")


def fourier_features(column: str, width: int, outputs: int = 128, gamma: float | None = None, seed: int = SEED) -> Column:
    """Random Fourier features (Rahimi, Recht 2007) of an array column: a linear stand-in for the RBF kernel."""
    rng = np.random.default_rng(seed)
    spread = np.sqrt(2.0 * (gamma if gamma is not None else 1.0 / width))
    weights, phase = rng.normal(0.0, spread, (width, outputs)), rng.uniform(0.0, 2.0 * np.pi, outputs)

    @F.pandas_udf("array<double>")
    def project(rows: pd.Series) -> pd.Series:
        data = np.stack(rows.to_numpy()).astype("float64")
        return pd.Series(list(np.sqrt(2.0 / outputs) * np.cos(data @ weights + phase)))

    return project(column)


def margin_classifier(train: DataFrame, held: DataFrame, key: str, width: int, outputs: int = 128, calibration: int = 5,
                      iterations: int = 50) -> DataFrame:
    """Balanced large-margin classifier on Fourier features, its margins calibrated out of fold to probabilities."""
    def lifted(df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(fourier_features("_x", width, outputs)))

    def expanded(df: DataFrame) -> DataFrame:
        return lifted(df.withColumn("_x", vector_to_array("features")).drop("features"))

    svm = LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", maxIter=iterations, tol=1e-3)
    # The features as they came are kept; the lifted ones, many times as wide, are made where they are read.
    folded = stratified_folds(train, "label", key, calibration).persist()
    margins = None
    for fold in range(calibration):
        model = svm.fit(expanded(folded.filter(F.col("fold") != fold)))
        part = model.transform(expanded(folded.filter(F.col("fold") == fold))).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
        margins = part if margins is None else margins.unionByName(part)
    to_vector = VectorAssembler(inputCols=["margin"], outputCol="features")
    curve = LogisticRegression(labelCol="label").fit(to_vector.transform(margins))
    final = svm.fit(expanded(folded))
    folded.unpersist()
    raw = final.transform(expanded(held)).select(key, "label", vector_to_array("rawPrediction")[1].alias("margin"))
    return score(curve, to_vector.transform(raw), [key], "margin_classifier")


def rul_models(trees: int = 100, rounds: int = 50) -> dict[str, Callable[[], Estimator | Boosting]]:
    at = {"featuresCol": "features", "labelCol": "rul"}
    return {"boosted_trees": lambda: Boosting(rounds, 5, rate=0.1, loss="squared", newton=False, ridge=0.0, least_curvature=0.0, seed=SEED),
            "random_forest": lambda: RandomForestRegressor(**at, numTrees=trees, maxDepth=8, seed=SEED),
            "linear": lambda: LinearRegression(**at)}


def rul_regression(windows: DataFrame, features: Sequence[str], models: dict[str, Callable[[], Estimator]], unit: str = "unit_id", cycle: str = "end_cycle") -> DataFrame:
    """Fit on window features of the train units, predict the held-out units."""
    ready = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(group_split(windows, unit))
    ready = cut_lineage(ready.select(unit, cycle, "rul", "part", "features"))
    train, held = ready.filter("part = 'train'"), ready.filter("part = 'validation'")
    out = None
    for name, make in models.items():
        made = make()
        if isinstance(made, Boosting):
            done = fit_boosted([train], [made], label="rul")[0][0].score(held, [unit, cycle, "rul"], name="predicted")
        else:
            done = made.fit(train).transform(held).select(unit, cycle, "rul", F.col("prediction").alias("predicted"))
        part = done.select(unit, cycle, "rul", F.lit(name).alias("model"), "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def centred_vectors(df: DataFrame, columns: Sequence[str], means: dict[str, float], name: str = "_centred") -> DataFrame:
    shifted = [(F.col(c) - F.lit(means[c])).alias(f"_c_{c}") for c in columns]
    wide = df.select("*", *shifted)
    return VectorAssembler(inputCols=[f"_c_{c}" for c in columns], outputCol=name).transform(wide).drop(*[f"_c_{c}" for c in columns])


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()


def pca_projection(train: DataFrame, df: DataFrame, columns: Sequence[str], components: int = 2) -> DataFrame:
    """Principal components learned on train rows; each axis points where its largest loading is positive."""
    means = column_means(train, columns)
    model = PCA(k=components, inputCol="_centred", outputCol="_pc").fit(centred_vectors(train, columns, means))
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.abs(loadings[:, j]).argmax(), j]) or 1.0) for j in range(components)]
    projected = model.transform(centred_vectors(df, columns, means)).withColumn("_pc", vector_to_array("_pc"))
    return projected.select(*df.columns, *[(F.col("_pc")[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(components)])


def reconstruction_error(healthy: DataFrame, df: DataFrame, columns: Sequence[str], components: int = 32) -> DataFrame:
    """Mean squared residual after projection on the components of healthy rows only."""
    k = min(components, len(columns))
    means = column_means(healthy, columns)
    axes = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(centred_vectors(healthy, columns, means)).pc.toArray()

    @F.pandas_udf("double")
    def residual(rows: pd.Series) -> pd.Series:
        data = np.stack(rows.to_numpy()).astype("float64")
        return pd.Series(((data - (data @ axes) @ axes.T) ** 2).mean(1))

    return centred_vectors(df, columns, means).withColumn("reconstruction_error", residual(vector_to_array("_centred"))).drop("_centred")


def kmeans_select(vectors: DataFrame, ks: Sequence[int] = range(2, 7), restarts: int = 10, features: str = "features") -> tuple[list[tuple[int, float, float]], KMeansFit]:
    """Best of ``restarts`` fits by cost for each k; the (k, silhouette, cost) list, and the fit of highest silhouette."""
    judge = ClusteringEvaluator(featuresCol=features, predictionCol="prediction")
    table, best = [], None
    for k, fits in zip(ks, fit_kmeans(vectors, ks, restarts, features, SEED)):
        fit = min(fits, key=lambda m: m.cost)
        width = judge.evaluate(fit.transform(vectors, features))
        table.append((k, float(width), fit.cost))
        if best is None or width > best[0]:
            best = (width, fit)
    return table, best[1]
