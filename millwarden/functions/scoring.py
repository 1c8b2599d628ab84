"""Column expressions for machine features, risk and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published definitions.
FAILURE_WEIGHT = 0.60
ANOMALY_WEIGHT = 0.40
BAND_LIMITS = ((0.25, "Low"), (0.50, "Medium"), (0.75, "High"))
TOP_BAND = "Critical"
BANDS = ("Low", "Medium", "High", "Critical")
FAILURE_MODES = (
    ("twf", "tool_wear_failure"),
    ("hdf", "heat_dissipation_failure"),
    ("pwf", "power_failure"),
    ("osf", "overstrain_failure"),
    ("rnf", "random_failure"),
)
SENSORS = ("air_temperature", "process_temperature", "rotational_speed", "torque", "tool_wear")
ENGINEERED = ("temperature_differential", "mechanical_power")
FEATURES = SENSORS + ENGINEERED
SENSOR_UNITS = {
    "air_temperature": "K", "process_temperature": "K", "rotational_speed": "rpm", "torque": "Nm", "tool_wear": "min"}


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def temperature_differential() -> Column:
    return F.col("process_temperature") - F.col("air_temperature")


def mechanical_power() -> Column:
    return F.col("torque") * F.col("rotational_speed") * (F.lit(2) * F.pi() / F.lit(60))


def fuse_risk(probability: str | Column, anomaly: str | Column) -> Column:
    return F.lit(FAILURE_WEIGHT) * _col(probability) + F.lit(ANOMALY_WEIGHT) * _col(anomaly)


def risk_band(score: str | Column) -> Column:
    """Band of a score; a missing score has no band."""
    value = _col(score)
    band = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("string"))
    for limit, name in BAND_LIMITS:
        band = band.when(value < limit, name)
    return band.otherwise(TOP_BAND)


def ratio(top: Column, bottom: Column) -> Column:
    """Division in which a zero divisor gives zero."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def event_type(columns: list[str]) -> Column:
    """Name of the first failure mode set to 1; modes that are absent or unreadable are passed over."""
    hits = [F.when(F.col(mode).try_cast("int") == 1, name) for mode, name in FAILURE_MODES if mode in columns]
    return F.coalesce(*hits, F.lit("risk_detected"))


def clip(column: str, low: float, high: float) -> Column:
    value = F.col(column)
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def evidence_tier(probability: str, anomaly: str) -> Column:
    """Which of the two signals is elevated."""
    likely, odd = F.col(probability) >= 0.5, F.col(anomaly) >= 0.5
    return (F.when(likely & odd, "both signals elevated").when(likely, "failure probability elevated")
            .when(odd, "anomaly score elevated").otherwise("no signal elevated"))
