"""Classifier, detector, clustering and forecast metrics, grouped by any keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwarden.functions.scoring import ratio
from millwarden.operators.quantiles import exact_quantiles
from millwarden.operators.ranking import running_totals
from millwarden.session import cut_lineage

SWEEP_LOW, SWEEP_HIGH = 5, 95  # hundredths
HIGH_RECALL = 0.90


def precision() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f1() -> Column:
    return ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def accuracy() -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def confusion(df: DataFrame, by: Sequence[str], predicted: Column, label: str) -> DataFrame:
    actual = F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(~predicted & ~actual).alias("tn"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"), F.count_if(predicted & actual).alias("tp"))


def classification_report(counts: DataFrame) -> DataFrame:
    """Rates from confusion counts; a zero divisor gives zero."""
    return counts.withColumns({
        "accuracy": F.round(accuracy(), 6), "precision": F.round(precision(), 6),
        "recall": F.round(recall(), 6), "f1": F.round(f1(), 6)})


def curve_points(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Per distinct score, highest first: counts at the score (pos, neg) and at or above it (tp, fp), with group totals."""
    by = list(by)
    # Written once: the ranges, the running totals and the group totals all come from these counts.
    counts = cut_lineage(df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))
    points = running_totals(counts, score, {"pos": "tp", "neg": "fp"}, by=by, descending=True)
    totals = counts.groupBy(*by).agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"))
    return points.join(totals, by) if by else points.withColumns(
        {c: F.lit(v) for c, v in totals.first().asDict().items()})


def areas(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC area with ties counted half, step-sum average precision, and trapezoid area under precision-recall."""
    before_tp, before_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    here = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    before = F.coalesce(F.try_divide(before_tp.cast("double"), (before_tp + before_fp).cast("double")), F.lit(1.0))
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    step = F.sum(F.col("pos") * here)
    slope = F.sum(F.col("pos") * (here + before) / 2)
    positives, negatives = F.first("positives").cast("double"), F.first("negatives").cast("double")
    return points.groupBy(*by).agg(
        F.round(F.try_divide(won, positives * negatives), 6).alias("roc_auc"),
        F.round(F.try_divide(step, positives), 6).alias("average_precision"),
        F.round(F.try_divide(slope, positives), 6).alias("pr_auc"))


def roc_curve(points: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    return points.select(*by, F.col(score).alias("threshold"),
                         F.round(ratio(F.col("fp"), F.col("negatives")), 6).alias("fpr"),
                         F.round(ratio(F.col("tp"), F.col("positives")), 6).alias("tpr"))


def pr_curve(points: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    return points.select(*by, F.col(score).alias("threshold"),
                         F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
                         F.round(ratio(F.col("tp"), F.col("positives")), 6).alias("recall"))


def threshold_sweep(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Confusion counts and rates at 0.05, 0.06 … 0.95, from one count per score cell."""
    s = F.col(score).cast("double")
    guess = F.floor(s * 100)
    cell = guess + F.when(s >= (guess + 1) / 100, 1).otherwise(0) - F.when(s < guess / 100, 1).otherwise(0)
    bounded = F.greatest(F.least(cell, F.lit(SWEEP_HIGH)), F.lit(SWEEP_LOW - 1))
    cells = df.groupBy(*by, bounded.cast("int").alias("cell")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    steps = cells.select(*by, "cell", "pos", "neg", F.explode(F.sequence(F.lit(SWEEP_LOW), F.lit(SWEEP_HIGH))).alias("step"))
    over = F.col("cell") >= F.col("step")

    def total(column: str, wanted: Column) -> Column:
        return F.sum(F.when(wanted, F.col(column)).otherwise(0))

    counts = steps.groupBy(*by, "step").agg(
        total("neg", ~over).alias("tn"), total("neg", over).alias("fp"), total("pos", ~over).alias("fn"), total("pos", over).alias("tp"))
    return counts.select(*by, (F.col("step") / 100).alias("threshold"), "tn", "fp", "fn", "tp",
                         precision().alias("precision"), recall().alias("recall"), f1().alias("f1"))


def best_threshold(sweep: DataFrame, by: Sequence[str]) -> DataFrame:
    """First maximum of F1, and the highest threshold that keeps recall at 0.90 or more (null when none does)."""
    top = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold")))
    found = sweep.groupBy(*by).agg(
        top.alias("b"), F.max(F.when(F.col("recall") >= HIGH_RECALL, F.col("threshold"))).alias("high_recall_threshold"))
    return found.select(*by, F.col("b.threshold").alias("best_threshold"), F.round("b.precision", 6).alias("precision"),
                        F.round("b.recall", 6).alias("recall"), F.round("b.f1", 6).alias("f1"), "high_recall_threshold")


def fold_metrics(df: DataFrame, model: str, fold: str, score: str, label: str, cut: float = 0.5) -> DataFrame:
    by = [model, fold]
    counts = confusion(df, by, F.col(score) >= cut, label)
    rates = counts.select(*by, precision().alias("precision"), recall().alias("recall"), f1().alias("f1"))
    return rates.join(areas(curve_points(df, by, score, label), by).select(*by, "roc_auc", "average_precision"), by)


def cv_summary(folds: DataFrame, model: str) -> DataFrame:
    """Mean and population deviation of each fold metric, best recall first."""
    names = [c for c in ("precision", "recall", "f1", "roc_auc", "average_precision") if c in folds.columns]
    return folds.groupBy(model).agg(
        *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in names], *[F.round(F.stddev_pop(c), 6).alias(f"{c}_std") for c in names]
    ).orderBy(F.desc("recall_mean"), model)


def detector_report(df: DataFrame, flagged: Column, label: str, by: Sequence[str] = ()) -> DataFrame:
    counts = confusion(df, by, flagged, label)
    found = F.col("tp") + F.col("fp")
    return counts.select(
        *by, found.alias("anomalies"), F.round(ratio(found, F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")), 6).alias("detection_rate"),
        F.round(precision(), 6).alias("precision"), F.round(recall(), 6).alias("recall"), F.round(f1(), 6).alias("f1"))


def adjusted_rand(df: DataFrame, left: str, right: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency table."""
    def pairs(n: Column) -> Column:
        return n.cast("double") * (n.cast("double") - 1) / 2

    cells = df.groupBy(left, right).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    rows = cells.groupBy(left).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("a"))
    columns = cells.groupBy(right).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("b"))
    one = both.unionByName(rows, allowMissingColumns=True).unionByName(columns, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("both", "total", "a", "b")])
    expected = F.col("a") * F.col("b") / F.greatest(pairs(F.col("total")), F.lit(1.0))
    most = (F.col("a") + F.col("b")) / 2
    return one.select(F.round(F.when(most == expected, F.lit(1.0)).otherwise(
        F.try_divide(F.col("both") - expected, most - expected)), 6).alias("ari"))


def silhouette(df: DataFrame, features: Sequence[str], cluster: str, noise: int = -1) -> float | None:
    """Mean silhouette over squared Euclidean distance, which one pass of cluster sums suffices for.

    Noise rows are left out; fewer than two clusters have none.
    """
    kept = df.filter(F.col(cluster) != noise)
    if kept.select(cluster).distinct().limit(2).count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(kept)
    return ClusteringEvaluator(featuresCol="_v", predictionCol=cluster).evaluate(vectors)


def forecast_errors(df: DataFrame, by: Sequence[str], predicted: str, actual: str) -> DataFrame:
    error = F.col(predicted) - F.col(actual)
    return df.groupBy(*by).agg(F.round(F.avg(F.abs(error)), 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse")
                               ).orderBy("mae", *by)


def per_unit_errors(df: DataFrame, unit: str, model: str, models: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """Windows and mean absolute error per unit, one error column per model."""
    wanted = [F.round(F.avg(F.when(F.col(model) == m, F.abs(F.col(predicted) - F.col(actual)))), 6).alias(f"mae_{m}") for m in models]
    return df.groupBy(unit).agg(F.count_if(F.col(model) == models[0]).alias("windows"), *wanted)


def error_statistics(df: DataFrame, model: str, predicted: str, actual: str) -> DataFrame:
    """Mean, median absolute, population deviation and largest absolute error per model."""
    errors = df.select(model, (F.col(predicted) - F.col(actual)).cast("double").alias("e")).withColumn("a", F.abs("e"))
    medians = exact_quantiles(errors, ["a"], (0.5,), by=[model])
    middle = F.lit(None).cast("double")
    for (name, _), found in medians.items():
        middle = F.when(F.col(model) == name, F.lit(found[0.5])).otherwise(middle)
    return errors.groupBy(model).agg(
        F.round(F.avg("e"), 6).alias("mean_error"), F.round(F.stddev_pop("e"), 6).alias("std_error"), F.round(F.max("a"), 6).alias("max_abs_error")
    ).withColumn("median_abs_error", F.round(middle, 6))


def reconstruction_sweep(df: DataFrame, error: str, label: str, healthy: Column) -> DataFrame:
    """Metrics at 20 candidate cuts, the 90th to 99.5th percentile of healthy errors; anomalous is above the cut."""
    probs = [(90 + i / 2) / 100 for i in range(20)]
    found = exact_quantiles(df.filter(healthy), [error], probs)[(error,)]
    cuts = [found[p] for p in probs]
    cell = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        cell = F.when(F.col(error) <= F.lit(cuts[i]), i).otherwise(cell)
    cells = df.groupBy(cell.alias("cell")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    frame = F.explode(F.arrays_zip(F.array(*map(F.lit, probs)).alias("p"), F.array(*map(F.lit, cuts)).alias("t"), F.sequence(F.lit(0), F.lit(len(cuts) - 1)).alias("i")))
    steps = cells.select("cell", "pos", "neg", frame.alias("s")).select("cell", "pos", "neg", "s.*")
    over = F.col("cell") > F.col("i")
    counts = steps.groupBy("p", "t").agg(
        F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(over, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(over, 0).otherwise(F.col("neg"))).alias("tn"))
    return counts.select(F.round(F.col("p") * 100, 1).alias("percentile"), F.col("t").alias("threshold"), "tn", "fp", "fn", "tp",
                         precision().alias("precision"), recall().alias("recall"), f1().alias("f1"))


def reconstruction_choice(sweep: DataFrame) -> DataFrame:
    """The first candidate of highest F1."""
    return sweep.orderBy(F.desc("f1"), "percentile").limit(1)


def leaderboard(df: DataFrame, order: Sequence[Column], n: int | None = None) -> DataFrame:
    ranked = df.orderBy(*order)
    return ranked if n is None else ranked.limit(n)
