"""Leakage-safe preparation: statistics are learned on train rows, then applied anywhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwarden.functions.scoring import ENGINEERED, FEATURES, clip, mechanical_power, ratio, temperature_differential
from millwarden.operators.quantiles import exact_quantiles

LEAKAGE = ("uid", "machine_failure", "twf", "hdf", "pwf", "osf", "rnf")


def engineer_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"temperature_differential": temperature_differential(), "mechanical_power": mechanical_power()})


def drop_leakage(df: DataFrame, expected: Sequence[str], key: str | None = None) -> DataFrame:
    """Drop identifiers, target and failure modes, and align to the expected features; raise when one is missing."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"model features are missing: {missing}")
    kept = df.drop(*[c for c in LEAKAGE if c != key])
    return kept.select(*([key] if key else []), *expected)


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float, float, float]]:
    """(q1, q3, low, high) per column."""
    quartiles = exact_quantiles(df, columns, (0.25, 0.75))
    bounds = {}
    for column in columns:
        q1, q3 = quartiles[(column,)][0.25], quartiles[(column,)][0.75]
        bounds[column] = (q1, q3, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return bounds


def clip_outliers(df: DataFrame, bounds: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    return df.withColumns({c: clip(c, b[2], b[3]) for c, b in bounds.items()})


def scaler_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column keeps deviation 1."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}


def standardize(df: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in moments.items()})


def categories_of(df: DataFrame, column: str, limit: int = 1000) -> list[str]:
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """One 0/1 column per known category; an unknown or null value is zero in all of them."""
    return df.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in categories})


def impute_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, object]:
    """Median per numeric column; most frequent value (smallest on ties) per categorical one."""
    medians = exact_quantiles(df, numeric, (0.5,)) if numeric else {}
    fills: dict[str, object] = {c: medians[(c,)][0.5] for c in numeric if (c,) in medians}
    for column in categorical:
        top = (df.filter(F.col(column).isNotNull()).groupBy(column).count()
               .orderBy(F.desc("count"), column).first())
        if top is not None:
            fills[column] = top[0]
    return fills


def impute(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, balanced weight n/(k·n_c), and the negative/positive ratio."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # One row per class by now, so the unkeyed window is small.
    whole = Window.partitionBy()
    total, classes = F.sum("n").over(whole), F.count("*").over(whole)
    negatives = F.sum(F.when(F.col(label) == 0, F.col("n"))).over(whole)
    positives = F.sum(F.when(F.col(label) == 1, F.col("n"))).over(whole)
    return counts.select(
        label, "n", F.round(total / (classes * F.col("n")), 6).alias("balanced_weight"),
        F.round(ratio(negatives, positives), 6).alias("positive_weight"))


@dataclass
class Preparation:
    """Fitted preprocessing: clip bounds, scaler, categories.  Batch and stream share it."""

    bounds: dict[str, tuple[float, float, float, float]]
    moments: dict[str, tuple[float, float]]
    category: str = "type"
    categories: list[str] = field(default_factory=list)

    @property
    def feature_names(self) -> list[str]:
        return [*self.moments, *[f"{self.category}_{c}" for c in self.categories]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Raw sensors to model features; other columns pass through."""
        ready = engineer_features(df) if any(f in ENGINEERED for f in self.moments) else df
        ready = standardize(clip_outliers(ready, self.bounds), self.moments)
        return one_hot(ready, self.category, self.categories)

    def check_features(self, expected: Sequence[str]) -> None:
        """Refuse a model trained on other features, or on another order of them."""
        if list(expected) != self.feature_names:
            raise ValueError(f"model expects {list(expected)}, preparation yields {self.feature_names}")

    def save(self, spark: SparkSession, path: str) -> None:
        values = asdict(self)
        rows = [(i, c, *values["bounds"][c], *m) for i, (c, m) in enumerate(self.moments.items())]
        spark.createDataFrame(rows, "position int, feature string, q1 double, q3 double, low double, high double, mean double, std double"
                              ).write.mode("overwrite").parquet(f"{path}/numeric")
        spark.createDataFrame([(i, self.category, c) for i, c in enumerate(self.categories)],
                              "position int, category string, value string").write.mode("overwrite").parquet(f"{path}/categories")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preparation:
        rows = {r["feature"]: r for r in spark.read.parquet(f"{path}/numeric").orderBy("position").collect()}
        cats = spark.read.parquet(f"{path}/categories").orderBy("position").collect()
        names = list(rows)
        return cls({f: (rows[f]["q1"], rows[f]["q3"], rows[f]["low"], rows[f]["high"]) for f in names},
                   {f: (rows[f]["mean"], rows[f]["std"]) for f in names},
                   cats[0]["category"] if cats else "type", [r["value"] for r in cats])


def fit_preparation(train: DataFrame, features: Sequence[str] = FEATURES, category: str = "type") -> Preparation:
    """Learn bounds, then moments of the clipped columns, then categories, from train rows only."""
    ready = engineer_features(train) if any(f in ENGINEERED for f in features) else train
    bounds = iqr_bounds(ready, features)
    moments = scaler_moments(clip_outliers(ready, bounds), features)
    return Preparation(bounds, moments, category, categories_of(train, category))

