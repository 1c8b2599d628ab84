"""Stateful stream operators over live readings, and the table they keep.

State lives in the state store: the newest reading of each machine, and its open windows with a timer each.  Batches of changed
rows are merged into a table of one row per key: each batch writes the next version of it and removes the one before the last,
so what is read back is as large as the number of keys, and a batch that runs again writes the same version again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from millwarden.session import folders_in, remove_folder

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BANDS = ("Low", "Medium", "High", "Critical")
FLEET_SCHEMA = ("machine_id string, window_start timestamp, readings long, risk_sum double, low long, medium long, high long, critical long")


def _plain(value):
    return None if value is None or value is pd.NaT or (isinstance(value, float) and value != value) else value.item() if hasattr(value, "item") else value


class LatestReading(StatefulProcessor):
    """Keeps the newest reading of a key, by time and then event id; gives it out when it changes."""

    def __init__(self, schema: StructType, key: str, time: str, event: str):
        self.schema, self.key, self.time, self.event = schema, key, time, event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        place = names.index(self.time), names.index(self.event)
        held = self.latest.get() if self.latest.exists() else None
        best = held
        for batch in rows:
            batch = batch[batch[self.time].notna()]
            if len(batch):
                top = batch.sort_values([self.time, self.event]).iloc[-1]
                row = tuple(top[n].to_pydatetime() if n == self.time else _plain(top[n]) for n in names)
                if best is None or tuple(row[p] for p in place) > tuple(best[p] for p in place):
                    best = row
        if best is not None and best is not held:
            self.latest.update(best)
            yield pd.DataFrame([best], columns=names)

    def close(self) -> None:
        pass


class FleetWindows(StatefulProcessor):
    """Running sums of a machine per window of ``seconds``.  A timer releases a window once the watermark has passed its end; later readings are dropped."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start long", "readings long, risk_sum double, low long, medium long, high long, critical long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, changed = timerValues.getCurrentWatermarkInMs(), {}
        for batch in rows:
            batch = batch[batch["ts"].notna()]
            start = batch["ts"].astype("datetime64[us]").astype("int64") // 1_000_000 // self.seconds * self.seconds
            for at, part in batch.groupby(start):
                at = int(at)
                if (at + self.seconds) * 1000 <= mark:
                    continue
                if at not in changed:
                    if self.windows.containsKey((at,)):
                        changed[at] = list(self.windows.getValue((at,)))
                    else:
                        changed[at] = [0, 0.0, 0, 0, 0, 0]
                        self.handle.registerTimer((at + self.seconds) * 1000)
                sums = changed[at]
                sums[0] += len(part)
                sums[1] += float(part["unified_risk_score"].sum())
                for k, band in enumerate(BANDS):
                    sums[2 + k] += int((part["risk_band"] == band).sum())
        for at, sums in changed.items():
            self.windows.updateValue((at,), tuple(sums))
        if changed:
            yield pd.DataFrame([(key[0], pd.Timestamp(at, unit="s"), *sums) for at, sums in changed.items()],
                               columns=["machine_id", "window_start", "readings", "risk_sum", "low", "medium", "high", "critical"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self.seconds
        if self.windows.containsKey((at,)):
            self.windows.removeKey((at,))
        return iter(())

    def close(self) -> None:
        pass


def latest_readings(telemetry: DataFrame, key: str = "machine_id", time: str = "ts", event: str = "event_id") -> DataFrame:
    """Stream of each key's newest reading whenever it changes."""
    telemetry.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = telemetry.schema
    return telemetry.groupBy(key).transformWithStateInPandas(LatestReading(schema, key, time, event), schema, "Update", "None")


def fleet_windows(scored: DataFrame, seconds: int = 86_400, late: str = "1 day") -> DataFrame:
    """Stream of each machine's sums per window whenever they change."""
    scored.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    slim = scored.select("machine_id", "ts", "unified_risk_score", "risk_band").withWatermark("ts", late)
    return slim.groupBy("machine_id").transformWithStateInPandas(FleetWindows(seconds), FLEET_SCHEMA, "Update", "EventTime")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of a kept table, oldest first."""
    return sorted(int(name.split("=")[1]) for name in folders_in(spark, path, "_SUCCESS") if name.startswith("version="))


def keep_table(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str] = (), every: str | None = None) -> StreamingQuery:
    """Merge each batch of changed rows into a table of one row per ``keys``; of several in a batch the last by ``order`` counts.

    Runs to the end of the available data, or keeps running where ``every`` (such as '5 seconds') is given; returns the query.
    """
    schema, keys = stream.schema, list(keys)

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if order:
            rest = [c for c in schema.names if c not in keys]
            batch = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, "_v.*").select(*schema.names)
        before = [v for v in versions(spark, path) if v < number]
        if before:
            # One version of the table and one batch: both hold a row per key.
            batch = batch.persist()
            old = spark.read.schema(schema).parquet(f"{path}/version={before[-1]}")
            batch = batch.unionByName(old.join(batch.select(*keys), keys, "left_anti"))
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")
        for version in before[:-1]:
            remove_folder(spark, f"{path}/version={version}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge)
    query = writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
    if not every:
        query.awaitTermination()
    return query


def kept_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest version."""
    found = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={found[-1]}") if found else spark.createDataFrame([], schema)


def fleet_summary(windows: DataFrame) -> DataFrame:
    """Machines online, band counts and mean risk per window."""
    return windows.groupBy("window_start").agg(
        F.count("*").alias("machines"), F.sum("readings").alias("readings"), *[F.sum(b.lower()).alias(b.lower()) for b in BANDS],
        F.round(F.sum("risk_sum") / F.sum("readings"), 6).alias("mean_risk"))
