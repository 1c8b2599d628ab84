"""Risk table: normalised signals, fusion, bands, ranks, events, and the questions a console asks of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwarden.functions.scoring import (
    BANDS,
    FAILURE_MODES,
    SENSOR_UNITS,
    SENSORS,
    event_type,
    fuse_risk,
    mechanical_power,
    risk_band,
    temperature_differential,
)
from millwarden.operators.quantiles import exact_quantiles
from millwarden.operators.ranking import BROADCAST_VALUES, competition_ranks


def scaled(column: str, low: float | None, high: float | None, clipped: bool = False) -> Column:
    """Position between two ends; a degenerate range gives zero, a null stays null."""
    value = F.col(column)
    if low is None or high is None or high <= low:
        return F.when(value.isNotNull(), F.lit(0.0))
    share = (value - F.lit(low)) / F.lit(high - low)
    return F.when(value.isNotNull(), F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))) if clipped else share


def minmax_normalize(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scale over the whole scored set: minimum to 0, maximum to 1."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return df.withColumn(name, scaled(column, low, high))


def reference_range(train: DataFrame, column: str) -> tuple[float, float]:
    """5th and 95th percentile of train scores; learned once, stored with the model."""
    found = exact_quantiles(train, [column], (0.05, 0.95))[(column,)]
    return found[0.05], found[0.95]


def reference_normalize(df: DataFrame, column: str, name: str, ends: tuple[float, float]) -> DataFrame:
    """Scale by a frozen reference range, clipped to [0, 1]: the live form."""
    return df.withColumn(name, scaled(column, ends[0], ends[1], clipped=True))


def risk_table(signals: DataFrame, probability: str = "failure_probability", anomaly: str = "anomaly_score") -> DataFrame:
    """Fused score, band, and competition ranks of probability and risk."""
    fused = signals.withColumn("unified_risk_score", fuse_risk(probability, anomaly))
    fused = fused.withColumn("risk_band", risk_band("unified_risk_score"))
    return competition_ranks(fused, {probability: "failure_probability_rank", "unified_risk_score": "risk_rank"})


def structured_events(risk: DataFrame, observations: DataFrame, key: str = "uid") -> DataFrame:
    """One JSON event per scored row; fields the source lacks are left out."""
    have = observations.columns
    joined = risk.select(key, "unified_risk_score", "failure_probability", "anomaly_score").join(observations, key, "left")
    fields = [
        F.coalesce(F.col(key).cast("string"), F.lit("UNKNOWN")).alias("machine_id"),
        event_type(have).alias("event_type"),
        F.round("unified_risk_score", 6).alias("risk_score"),
        risk_band("unified_risk_score").alias("risk_band"),
        F.round("failure_probability", 6).alias("failure_probability"),
        F.round("anomaly_score", 6).alias("anomaly_score"),
        *[F.col(s).cast("double").alias(s) for s in SENSORS if s in have],
    ]
    if {"air_temperature", "process_temperature"} <= set(have):
        fields.append(F.round(temperature_differential(), 6).alias("temperature_differential"))
    if {"torque", "rotational_speed"} <= set(have):
        fields.append(F.round(mechanical_power(), 6).alias("mechanical_power"))
    if "type" in have:
        fields.append(F.col("type").alias("product_type"))
    fields += [F.col(m).try_cast("int").alias(m.upper()) for m, _ in FAILURE_MODES if m in have]
    if "machine_failure" in have:
        fields.append(F.col("machine_failure").try_cast("int").alias("actual_failure"))
    return joined.select(F.col(key), F.to_json(F.struct(*fields)).alias("event"))


def high_risk(df: DataFrame, key: str = "uid", least: float = 0.5) -> DataFrame:
    return df.filter(F.col("unified_risk_score") >= least).orderBy(F.desc("unified_risk_score"), key)


def top_risk(df: DataFrame, n: int, key: str = "uid") -> DataFrame:
    return df.orderBy(F.desc_nulls_last("unified_risk_score"), key).limit(n)


def search_machines(df: DataFrame, text: str, columns: Sequence[str] = ("machine_id", "type", "risk_band"), literal: bool = False) -> DataFrame:
    """Case-insensitive match in any column; a blank search keeps all rows."""
    text = text.strip()
    if not text:
        return df
    found = F.lit(False)
    for column in columns:
        if column in df.columns:
            value = F.col(column).cast("string")
            hit = F.contains(F.lower(value), F.lit(text.lower())) if literal else value.rlike("(?i)" + text)
            found = found | F.coalesce(hit, F.lit(False))
    return df.filter(found)


def machine_id_text(column: str) -> Column:
    """Identifier as text, without the '.0' or the exponent a float column leaves."""
    number = F.col(column).try_cast("double")
    whole = F.typeof(F.col(column)).isin("double", "float") & (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.col(column).cast("string"), r"\.0$", ""))


def coerce_numeric(df: DataFrame, numbers: Sequence[str], label: str | None = None) -> DataFrame:
    """Unreadable numbers become null; an unreadable label becomes 0."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    if label is None:
        return out
    return out.withColumn(label, F.coalesce(F.col(label).try_cast("double").try_cast("int"), F.lit(0)))


def band_distribution(df: DataFrame, band: str = "risk_band") -> DataFrame:
    """Count and percent per band, absent bands included."""
    counts = df.groupBy(band).agg(F.count("*").alias("n"))
    frame = df.sparkSession.createDataFrame([(i, b) for i, b in enumerate(BANDS)], f"position int, {band} string")
    filled = frame.join(F.broadcast(counts), band, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())
    return filled.select("position", band, "n", F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), total), F.lit(0.0)), 6).alias("percent"))


def risk_summary(df: DataFrame, score: str = "unified_risk_score") -> DataFrame:
    median = exact_quantiles(df, [score], (0.5,))[(score,)][0.5]
    return df.agg(F.count(score).alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.lit(median), 6).alias("median"),
                  F.round(F.min(score), 6).alias("min"), F.round(F.max(score), 6).alias("max"))


def kpi_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("monitored"), F.count_if(F.col("anomaly_score") >= 0.5).alias("anomalies"),
        F.count_if(F.col("failure_probability") >= 0.5).alias("predicted_failures"),
        F.count_if(F.col("unified_risk_score") >= 0.75).alias("critical"))


def sensor_long(df: DataFrame, key: str = "uid") -> DataFrame:
    parts = [F.struct(F.lit(s).alias("sensor"), F.col(s).cast("double").alias("value"), F.lit(u).alias("unit"))
             for s, u in SENSOR_UNITS.items() if s in df.columns]
    return df.select(key, F.inline(F.array(*parts))).filter(F.col("value").isNotNull())


def signals_long(df: DataFrame, key: str, columns: Sequence[str], name: str = "signal") -> DataFrame:
    """Wide numeric columns as (name, value) rows."""
    parts = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(key, F.inline(F.array(*parts)))


def mode_flags(df: DataFrame, key: str = "uid") -> DataFrame:
    parts = [F.struct(F.lit(m.upper()).alias("code"), F.lit(n).alias("failure_mode"),
                      F.when(F.col(m).try_cast("int") == 1, "FLAGGED").otherwise("NOT FLAGGED").alias("state"))
             for m, n in FAILURE_MODES if m in df.columns]
    return df.select(key, F.inline(F.array(*parts)))


def fleet_table(df: DataFrame) -> DataFrame:
    """Display form of scored readings: rounded numbers, percent of the three scores."""
    return df.select(
        F.col("machine_id").alias("machine"), "type", F.round("air_temperature", 2).alias("air_temp"),
        F.round("process_temperature", 2).alias("process_temp"), F.round("rotational_speed", 1).alias("rpm"),
        F.round("torque", 2).alias("torque"), F.round("tool_wear", 2).alias("tool_wear"),
        F.round(F.col("failure_probability") * 100, 2).alias("failure_percent"),
        F.round(F.col("anomaly_score") * 100, 1).alias("anomaly_percent"),
        F.round(F.col("unified_risk_score") * 100, 1).alias("risk_percent"), "risk_band")


def attach_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on the key; columns both sides have are taken from the right.  ``matched`` tells which rows found one."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    return left.drop(*shared).join(right.withColumn("matched", F.lit(True)), key, "left").withColumn(
        "matched", F.coalesce("matched", F.lit(False)))


def attach_thresholds(df: DataFrame, thresholds: DataFrame, model: str = "model") -> DataFrame:
    """Join the locked threshold of each model; a model without one is an error."""
    names = df.select(model).distinct()
    lost = [r[0] for r in names.join(thresholds, model, "left_anti").limit(20).collect()]
    if lost:
        raise ValueError(f"no locked threshold for {lost}")
    few = thresholds.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
    return df.join(F.broadcast(thresholds) if few else thresholds, model)
