"""Queries: risk table, events, console questions, preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwarden.functions.scoring import FEATURES, event_type, evidence_tier, fuse_risk, risk_band
from millwarden.operators import preparing as prep
from millwarden.operators import risk as R
from millwarden.operators import splitting
from millwarden.plans.catalog import query
from millwarden.plans.views import view, with_views
from millwarden.session import cut_lineage

BAND_SQL = """CASE WHEN {s} IS NULL THEN NULL WHEN {s} < 0.25 THEN 'Low' WHEN {s} < 0.5 THEN 'Medium'
 WHEN {s} < 0.75 THEN 'High' ELSE 'Critical' END"""
EVENT_SQL = """CASE WHEN twf = 1 THEN 'tool_wear_failure' WHEN hdf = 1 THEN 'heat_dissipation_failure'
 WHEN pwf = 1 THEN 'power_failure' WHEN osf = 1 THEN 'overstrain_failure' WHEN rnf = 1 THEN 'random_failure'
 ELSE 'risk_detected' END"""
RISK = with_views("risk") + f", r AS (SELECT *, {BAND_SQL.format(s='unified_risk_score')} AS risk_band FROM risk)\n"
RISK_COLUMNS = """uid, type, actual_failure, failure_probability, round(anomaly_score, 6) AS anomaly_score,
 round(unified_risk_score, 6) AS unified_risk_score, risk_band"""


def banded(spark, sf):
    return view(spark, sf, "risk").withColumn("risk_band", risk_band("unified_risk_score"))


def shown(df, *more):
    return df.select("uid", "type", "actual_failure", "failure_probability", F.round("anomaly_score", 6).alias("anomaly_score"),
                     F.round("unified_risk_score", 6).alias("unified_risk_score"), "risk_band", *more)


@query("top_risk", with_views("split") + f""",
e AS (SELECT *, round(process_temperature - air_temperature, 2) AS td, torque*rotational_speed*(2*pi()/60) AS mp FROM split),
q AS (SELECT quantile_cont(tool_wear, 0.25) AS w1, quantile_cont(tool_wear, 0.75) AS w3,
             quantile_cont(torque, 0.25) AS t1, quantile_cont(torque, 0.75) AS t3,
             quantile_cont(td, 0.25) AS d1, quantile_cont(td, 0.75) AS d3 FROM e WHERE part = 'train'),
c AS (SELECT uid, type, part, machine_failure,
             greatest(least(tool_wear, w3 + 1.5*(w3-w1)), w1 - 1.5*(w3-w1)) AS w,
             greatest(least(torque, t3 + 1.5*(t3-t1)), t1 - 1.5*(t3-t1)) AS t,
             greatest(least(td, d3 + 1.5*(d3-d1)), d1 - 1.5*(d3-d1)) AS d FROM e, q),
m AS (SELECT avg(w) AS wm, stddev_pop(w) AS ws, avg(t) AS tm, stddev_pop(t) AS ts, avg(d) AS dm, stddev_pop(d) AS ds
      FROM c WHERE part = 'train'),
z AS (SELECT uid, type, machine_failure AS actual_failure, (w-wm)/ws AS wz, (t-tm)/ts AS tz, (d-dm)/ds AS dz FROM c, m WHERE part = 'test'),
s AS (SELECT uid, type, actual_failure, 1/(1+exp(-(wz + tz - 2))) AS p, abs(wz) + abs(tz) + abs(dz) AS a FROM z),
n AS (SELECT *, (a - (SELECT min(a) FROM s)) / (SELECT max(a) - min(a) FROM s) AS an FROM s),
u AS (SELECT *, 0.6*p + 0.4*an AS risk FROM n)
SELECT uid, type, actual_failure, round(p, 6) AS failure_probability, round(an, 6) AS anomaly_score,
       round(risk, 6) AS unified_risk_score, {BAND_SQL.format(s='risk')} AS risk_band
FROM u ORDER BY risk DESC, uid LIMIT 250""")
def top_risk(spark, sf):
    """Held-out rows through fitted preparation, two closed-form signals, fusion and bands; the top 250."""
    split = view(spark, sf, "split").withColumn(
        "temperature_differential", F.round(F.col("process_temperature") - F.col("air_temperature"), 2))
    used = ("tool_wear", "torque", "temperature_differential")
    train, test = split.filter("part = 'train'"), split.filter("part = 'test'")
    bounds = prep.iqr_bounds(train, used)
    moments = prep.scaler_moments(prep.clip_outliers(train, bounds), used)
    ready = prep.standardize(prep.clip_outliers(test, bounds), moments)
    signals = ready.select(
        "uid", "type", F.col("machine_failure").alias("actual_failure"),
        (1 / (1 + F.exp(-(F.col("tool_wear") + F.col("torque") - 2)))).alias("failure_probability"),
        (F.abs("tool_wear") + F.abs("torque") + F.abs("temperature_differential")).alias("anomaly_raw"))
    scored = R.minmax_normalize(signals, "anomaly_raw", "anomaly_score")
    fused = scored.withColumn("unified_risk_score", fuse_risk("failure_probability", "anomaly_score"))
    top = R.top_risk(fused.withColumn("risk_band", risk_band("unified_risk_score")), 250)
    return shown(top.withColumn("failure_probability", F.round("failure_probability", 6)))


@query("model_columns", with_views("telemetry") + "SELECT uid, round(mechanical_power, 6) AS mechanical_power, torque, tool_wear FROM telemetry")
def model_columns(spark, sf):
    return view(spark, sf, "telemetry").select("uid", F.round("mechanical_power", 6).alias("mechanical_power"), "torque", "tool_wear")


@query("drop_leakage", with_views("telemetry") + """SELECT uid, air_temperature, process_temperature, rotational_speed, torque,
 tool_wear, temperature_differential, round(mechanical_power, 6) AS mechanical_power FROM telemetry""")
def drop_leakage(spark, sf):
    return prep.drop_leakage(view(spark, sf, "telemetry"), FEATURES, key="uid").withColumn(
        "mechanical_power", F.round("mechanical_power", 6))


@query("engineer_features", with_views("telemetry") + """SELECT uid, round(process_temperature - air_temperature, 6) AS temperature_differential,
 round(torque*rotational_speed*(2*pi()/60), 6) AS mechanical_power FROM telemetry""")
def engineer_features(spark, sf):
    df = prep.engineer_features(view(spark, sf, "telemetry").drop("temperature_differential", "mechanical_power"))
    return df.select("uid", F.round("temperature_differential", 6).alias("temperature_differential"),
                     F.round("mechanical_power", 6).alias("mechanical_power"))


@query("machine_lookup", with_views("live") + "SELECT machine_id, event_id, type, torque, tool_wear FROM live WHERE machine_id = 'M-0008'")
def machine_lookup(spark, sf):
    return view(spark, sf, "live").filter(F.col("machine_id") == "M-0008").select("machine_id", "event_id", "type", "torque", "tool_wear")


@query("high_risk", RISK + f"SELECT {RISK_COLUMNS} FROM r WHERE unified_risk_score >= 0.5")
def high_risk(spark, sf):
    return shown(R.high_risk(banded(spark, sf)))


@query("search_machines", RISK + f"""SELECT {RISK_COLUMNS} FROM r
WHERE regexp_matches(uid, '(?i)^5.*7$|crit') OR regexp_matches(type, '(?i)^5.*7$|crit') OR regexp_matches(risk_band, '(?i)^5.*7$|crit')""")
def search_machines(spark, sf):
    return shown(R.search_machines(banded(spark, sf), " ^5.*7$|CRIT ", ("uid", "type", "risk_band")))


@query("coerce_numeric", """SELECT event_id, TRY_CAST(v AS DOUBLE) AS reading, coalesce(CAST(TRY_CAST(f AS DOUBLE) AS INT), 0) AS flag
FROM (SELECT event_id, CASE WHEN value > 30 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS v,
             CASE event_type WHEN 'error' THEN '1' WHEN 'click' THEN 'yes' WHEN 'view' THEN NULL ELSE '0.0' END AS f FROM events)""")
def coerce_numeric(spark, sf):
    raw = view(spark, sf, "events").select(
        "event_id", F.when(F.col("value") > 30, "n/a").otherwise(F.col("event_id").cast("string")).alias("reading"),
        F.expr("CASE event_type WHEN 'error' THEN '1' WHEN 'click' THEN 'yes' WHEN 'view' THEN NULL ELSE '0.0' END AS flag"))
    return R.coerce_numeric(raw, ["reading"], "flag")


def _bounds_sql(columns, where="part = 'train'"):
    return ", ".join(f"""b_{c} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
 quantile_cont({c}, 0.25) - 1.5*(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS low,
 quantile_cont({c}, 0.75) + 1.5*(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS high FROM split WHERE {where})""" for c in columns)


def _clipped_sql(columns):
    return ("k AS (SELECT uid, type, part, machine_failure, " + ", ".join(f"greatest(least(s.{c}, b_{c}.high), b_{c}.low) AS {c}" for c in columns)
            + " FROM split s, " + ", ".join(f"b_{c}" for c in columns) + ")")


def _scaled_sql(columns):
    return ("m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns) + " FROM k WHERE part = 'train'), "
            "z AS (SELECT uid, type, part, machine_failure, " + ", ".join(
                f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in columns) + " FROM k, m)")


PREPARED = (with_views("split") + ", " + _bounds_sql(FEATURES) + ", " + _clipped_sql(FEATURES) + ", " + _scaled_sql(FEATURES)
            + ", h AS (SELECT *, CAST(type = 'H' AS INT) AS type_H, CAST(type = 'L' AS INT) AS type_L, CAST(type = 'M' AS INT) AS type_M FROM z)\n")


@query("iqr_bounds", with_views("split") + ", " + _bounds_sql(FEATURES) + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high FROM b_{c}""" for c in FEATURES))
def iqr_bounds(spark, sf):
    bounds = prep.iqr_bounds(view(spark, sf, "split").filter("part = 'train'"), FEATURES)
    rows = spark.createDataFrame([(c, *b) for c, b in bounds.items()], "feature string, q1 double, q3 double, low double, high double")
    return rows.select("feature", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "low", "high")])


@query("iqr_clip", with_views("split") + ", " + _bounds_sql(FEATURES) + ", " + _clipped_sql(FEATURES) + " SELECT uid, part, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM k")
def iqr_clip(spark, sf):
    split = view(spark, sf, "split")
    bounds = prep.iqr_bounds(split.filter("part = 'train'"), FEATURES)
    return prep.clip_outliers(split, bounds).select("uid", "part", *[F.round(c, 6).alias(c) for c in FEATURES])


@query("class_weights", with_views("telemetry") + """SELECT machine_failure, count(*) AS n,
 round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS balanced_weight,
 round(max(CASE WHEN machine_failure = 0 THEN count(*) END) OVER () / max(CASE WHEN machine_failure = 1 THEN count(*) END) OVER (), 6) AS positive_weight
FROM telemetry GROUP BY machine_failure""")
def class_weights(spark, sf):
    return prep.class_weights(view(spark, sf, "telemetry"), "machine_failure")


@query("standardize", PREPARED + "SELECT uid, part, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM z")
def standardize(spark, sf):
    split = view(spark, sf, "split")
    train = split.filter("part = 'train'")
    bounds = prep.iqr_bounds(train, FEATURES)
    moments = prep.scaler_moments(prep.clip_outliers(train, bounds), FEATURES)
    ready = prep.standardize(prep.clip_outliers(split, bounds), moments)
    return ready.select("uid", "part", *[F.round(c, 6).alias(c) for c in FEATURES])


@query("one_hot", with_views("telemetry") + """SELECT uid, CAST(type = 'H' AS INT) AS type_H, CAST(type = 'L' AS INT) AS type_L,
 CAST(type = 'M' AS INT) AS type_M FROM telemetry""")
def one_hot(spark, sf):
    df = view(spark, sf, "telemetry")
    return prep.one_hot(df, "type", prep.categories_of(df, "type")).select("uid", "type_H", "type_L", "type_M")


@query("prepare_features", PREPARED + "SELECT uid, machine_failure, part, type_H, type_L, type_M, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM h")
def prepare_features(spark, sf):
    split = view(spark, sf, "split")
    fitted = prep.fit_preparation(split.filter("part = 'train'"))
    ready = fitted.transform(split)
    return ready.select("uid", "machine_failure", "part", *[F.round(c, 6).alias(c) if c in FEATURES else c for c in fitted.feature_names])


@query("impute", with_views("split") + """,
g AS (SELECT uid, part, nullif(tool_wear, 0) AS tool_wear, nullif(type, 'M') AS type FROM split),
f AS (SELECT median(tool_wear) AS w FROM g WHERE part = 'train'),
t AS (SELECT type AS ty FROM g WHERE part = 'train' AND type IS NOT NULL GROUP BY type ORDER BY count(*) DESC, type LIMIT 1)
SELECT uid, coalesce(tool_wear, w) AS tool_wear, coalesce(type, ty) AS type FROM g, f, t""")
def impute(spark, sf):
    gaps = view(spark, sf, "split").select("uid", "part", F.expr("nullif(tool_wear, 0)").alias("tool_wear"), F.expr("nullif(type, 'M')").alias("type"))
    fills = prep.impute_values(gaps.filter("part = 'train'"), ["tool_wear"], ["type"])
    return prep.impute(gaps, fills).drop("part")


@query("risk_band", RISK + "SELECT uid, risk_band FROM r")
def risk_bands(spark, sf):
    return banded(spark, sf).select("uid", "risk_band")


@query("risk_fusion", RISK + "SELECT uid, round(unified_risk_score, 6) AS unified_risk_score FROM r")
def risk_fusion(spark, sf):
    return view(spark, sf, "risk").select("uid", F.round("unified_risk_score", 6).alias("unified_risk_score"))


@query("event_type", with_views("telemetry") + f"SELECT uid, {EVENT_SQL} AS event_type FROM telemetry")
def event_types(spark, sf):
    df = view(spark, sf, "telemetry")
    return df.select("uid", event_type(df.columns).alias("event_type"))


EVENT_SCHEMA = """machine_id string, event_type string, risk_score double, risk_band string, failure_probability double,
 anomaly_score double, air_temperature double, process_temperature double, rotational_speed double, torque double,
 tool_wear double, temperature_differential double, mechanical_power double, product_type string,
 TWF int, HDF int, PWF int, OSF int, RNF int, actual_failure int"""
EVENTS_SQL = RISK + f""", ev AS (SELECT r.uid AS machine_id, {EVENT_SQL} AS event_type, round(unified_risk_score, 6) AS risk_score, risk_band,
 round(failure_probability, 6) AS failure_probability, round(anomaly_score, 6) AS anomaly_score, air_temperature, process_temperature,
 rotational_speed, torque, tool_wear, round(process_temperature - air_temperature, 6) AS temperature_differential,
 round(torque*rotational_speed*(2*pi()/60), 6) AS mechanical_power, r.type AS product_type, twf AS "TWF", hdf AS "HDF", pwf AS "PWF",
 osf AS "OSF", rnf AS "RNF", machine_failure AS actual_failure FROM r JOIN telemetry t ON r.uid = t.uid)
"""


def events_of(spark, sf):
    observations = view(spark, sf, "telemetry").drop("temperature_differential", "mechanical_power")
    return R.structured_events(view(spark, sf, "risk"), observations)


@query("structured_event", EVENTS_SQL + "SELECT * FROM ev")
def structured_event(spark, sf):
    return events_of(spark, sf).select(F.from_json("event", EVENT_SCHEMA).alias("e")).select("e.*")


@query("highest_risk_event", EVENTS_SQL + "SELECT ev.* FROM ev JOIN r ON r.uid = ev.machine_id ORDER BY unified_risk_score DESC, uid LIMIT 1")
def highest_risk_event(spark, sf):
    top = R.top_risk(view(spark, sf, "risk"), 1)
    observations = view(spark, sf, "telemetry").drop("temperature_differential", "mechanical_power")
    # The left side is one row, so its key prunes the other.
    return R.structured_events(F.broadcast(top), observations.join(F.broadcast(top.select("uid")), "uid", "left_semi")).select(
        F.from_json("event", EVENT_SCHEMA).alias("e")).select("e.*")


@query("evidence_tier", RISK + """SELECT uid, CASE WHEN failure_probability >= 0.5 AND anomaly_score >= 0.5 THEN 'both signals elevated'
 WHEN failure_probability >= 0.5 THEN 'failure probability elevated' WHEN anomaly_score >= 0.5 THEN 'anomaly score elevated'
 ELSE 'no signal elevated' END AS tier FROM r""")
def evidence_tiers(spark, sf):
    return view(spark, sf, "risk").select("uid", evidence_tier("failure_probability", "anomaly_score").alias("tier"))


@query("sensor_long", with_views("telemetry") + " UNION ALL ".join(
    f"SELECT uid, '{s}' AS sensor, {v} AS value, '{u}' AS unit FROM telemetry WHERE {v} IS NOT NULL"
    for s, v, u in (("air_temperature", "air_temperature", "K"), ("process_temperature", "process_temperature", "K"),
                    ("rotational_speed", "rotational_speed", "rpm"), ("torque", "torque", "Nm"), ("tool_wear", "nullif(tool_wear, 0)", "min"))))
def sensor_long(spark, sf):
    return R.sensor_long(view(spark, sf, "telemetry").withColumn("tool_wear", F.expr("nullif(tool_wear, 0)")))


@query("risk_components_long", RISK + " UNION ALL ".join(
    f"SELECT uid, '{c}' AS signal, round({c}, 6) AS value FROM r" for c in ("failure_probability", "anomaly_score", "unified_risk_score")))
def risk_components_long(spark, sf):
    return R.signals_long(view(spark, sf, "risk"), "uid", ("failure_probability", "anomaly_score", "unified_risk_score")).withColumn(
        "value", F.round("value", 6))


@query("machine_id_text", "SELECT o_orderkey AS k, regexp_replace(CAST(CAST(o_custkey AS DOUBLE) AS VARCHAR), '\\.0$', '') AS machine_id FROM orders")
def machine_ids(spark, sf):
    return view(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("double").alias("c")).select(
        "k", R.machine_id_text("c").alias("machine_id"))


@query("sample_rows", with_views("telemetry") + "SELECT uid, torque FROM telemetry ORDER BY md5(concat('42', uid)), uid LIMIT 1000")
def sample_rows(spark, sf):
    return splitting.sample_rows(view(spark, sf, "telemetry").select("uid", "torque"), "uid", 1000)


@query("fleet_table", RISK + """SELECT r.uid AS machine, r.type, round(air_temperature, 2) AS air_temp, round(process_temperature, 2) AS process_temp,
 round(rotational_speed, 1) AS rpm, round(torque, 2) AS torque, round(tool_wear, 2) AS tool_wear, round(failure_probability*100, 2) AS failure_percent,
 round(anomaly_score*100, 1) AS anomaly_percent, round(unified_risk_score*100, 1) AS risk_percent, risk_band
 FROM r JOIN telemetry t ON r.uid = t.uid""")
def fleet_table(spark, sf):
    sensors = view(spark, sf, "telemetry").select("uid", "air_temperature", "process_temperature", "rotational_speed", "torque", "tool_wear")
    return R.fleet_table(banded(spark, sf).join(sensors, "uid").withColumnRenamed("uid", "machine_id"))


@query("mode_flags", with_views("telemetry") + " UNION ALL ".join(
    f"SELECT uid, '{m.upper()}' AS code, '{n}' AS failure_mode, CASE WHEN {m} = 1 THEN 'FLAGGED' ELSE 'NOT FLAGGED' END AS state FROM telemetry"
    for m, n in (("twf", "tool_wear_failure"), ("hdf", "heat_dissipation_failure"), ("pwf", "power_failure"), ("osf", "overstrain_failure"), ("rnf", "random_failure"))))
def mode_flags(spark, sf):
    return R.mode_flags(view(spark, sf, "telemetry"))


@query("attach_metadata", RISK + """SELECT r.uid, failure_probability, risk_band, torque, tool_wear, t.type, t.uid IS NOT NULL AS matched
FROM r LEFT JOIN (SELECT * FROM telemetry WHERE tool_wear < 240) t ON r.uid = t.uid""")
def attach_metadata(spark, sf):
    known = view(spark, sf, "telemetry").filter("tool_wear < 240").select("uid", "type", "torque", "tool_wear")
    return R.attach_by_key(banded(spark, sf).select("uid", "type", "failure_probability", "risk_band"), known, "uid")


@query("attach_labels", with_views("scored") + "SELECT s.uid, failure_probability, machine_failure FROM scored s JOIN telemetry t ON s.uid = t.uid")
def attach_labels(spark, sf):
    labels = view(spark, sf, "telemetry").select("uid", "machine_failure")
    return view(spark, sf, "scored").select("uid", "failure_probability").join(labels, "uid")


@query("test_metadata", with_views("split") + "SELECT uid, type, torque, tool_wear FROM telemetry WHERE uid IN (SELECT uid FROM split WHERE part = 'test')")
def test_metadata(spark, sf):
    held = view(spark, sf, "split").filter("part = 'test'").select("uid")
    return view(spark, sf, "telemetry").select("uid", "type", "torque", "tool_wear").join(held, "uid", "left_semi")


@query("minmax_scores", RISK + "SELECT uid, round(anomaly_score, 6) AS anomaly_score FROM r")
def minmax_scores(spark, sf):
    return view(spark, sf, "risk").select("uid", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("reference_scores", with_views("scored", "split") + """,
q AS (SELECT quantile_cont(anomaly_raw, 0.05) AS lo, quantile_cont(anomaly_raw, 0.95) AS hi FROM scored JOIN split USING (uid) WHERE part = 'train')
SELECT uid, round(greatest(least((anomaly_raw - lo) / (hi - lo), 1.0), 0.0), 6) AS anomaly_score FROM scored, q""")
def reference_scores(spark, sf):
    train = splitting.stratified_split(view(spark, sf, "scored"), "actual_failure", "uid").filter("part = 'train'")
    ends = R.reference_range(train, "anomaly_raw")
    scaled = R.reference_normalize(view(spark, sf, "scored"), "anomaly_raw", "anomaly_score", ends)
    return scaled.select("uid", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("band_distribution", RISK + """SELECT CAST(p AS INT) AS position, b.risk_band, coalesce(n, 0) AS n,
 round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM r), 6) AS percent
FROM (VALUES (0, 'Low'), (1, 'Medium'), (2, 'High'), (3, 'Critical')) b(p, risk_band)
LEFT JOIN (SELECT risk_band, count(*) AS n FROM r GROUP BY risk_band) c ON b.risk_band = c.risk_band""")
def band_distribution(spark, sf):
    return R.band_distribution(banded(spark, sf))


@query("risk_summary", RISK + """SELECT count(*) AS n, round(avg(unified_risk_score), 6) AS mean, round(median(unified_risk_score), 6) AS median,
 round(min(unified_risk_score), 6) AS min, round(max(unified_risk_score), 6) AS max FROM r""")
def risk_summary(spark, sf):
    return R.risk_summary(view(spark, sf, "risk"))


@query("kpi_counts", RISK + """SELECT count(*) AS monitored, CAST(count_if(anomaly_score >= 0.5) AS BIGINT) AS anomalies,
 CAST(count_if(failure_probability >= 0.5) AS BIGINT) AS predicted_failures, CAST(count_if(unified_risk_score >= 0.75) AS BIGINT) AS critical FROM r""")
def kpi_counts(spark, sf):
    return R.kpi_counts(view(spark, sf, "risk"))


RANKED = RISK + """, k AS (SELECT *, rank() OVER (ORDER BY failure_probability DESC) AS failure_probability_rank,
 rank() OVER (ORDER BY round(unified_risk_score, 6) DESC) AS risk_rank FROM r) """


@query("risk_ranks", with_views("scored") + """SELECT uid, rank() OVER (ORDER BY failure_probability DESC) AS failure_probability_rank,
 rank() OVER (ORDER BY anomaly_raw DESC) AS anomaly_rank FROM scored""")
def risk_ranks(spark, sf):
    scored = view(spark, sf, "scored").select("uid", "failure_probability", "anomaly_raw")
    ranked = R.competition_ranks(scored, {"failure_probability": "failure_probability_rank", "anomaly_raw": "anomaly_rank"})
    return ranked.select("uid", "failure_probability_rank", "anomaly_rank")


@query("risk_table", RANKED + f"SELECT {RISK_COLUMNS}, failure_probability_rank, risk_rank FROM k")
def risk_table(spark, sf):
    """Ranks are over scores rounded to 6 places, as shown."""
    rounded = cut_lineage(banded(spark, sf).withColumn("unified_risk_score", F.round("unified_risk_score", 6)))
    ranked = R.competition_ranks(rounded, {"failure_probability": "failure_probability_rank", "unified_risk_score": "risk_rank"})
    return shown(ranked, "failure_probability_rank", "risk_rank")


@query("search_then_top", RISK + f"""SELECT {RISK_COLUMNS} FROM (SELECT * FROM r WHERE regexp_matches(uid, '(?i)h') OR regexp_matches(type, '(?i)h')
 OR regexp_matches(risk_band, '(?i)h') ORDER BY unified_risk_score DESC, uid LIMIT 250)""")
def search_then_top(spark, sf):
    return shown(R.top_risk(R.search_machines(banded(spark, sf), "h", ("uid", "type", "risk_band")), 250))


@query("preview_rows", with_views("telemetry") + "SELECT uid, type, torque FROM telemetry ORDER BY uid LIMIT 5")
def preview_rows(spark, sf):
    return view(spark, sf, "telemetry").select("uid", "type", "torque").orderBy("uid").limit(5)


@query("stratified_split", with_views("split") + "SELECT uid, machine_failure, part FROM split")
def stratified_split(spark, sf):
    return view(spark, sf, "split").select("uid", "machine_failure", "part")


FOLDS = with_views("telemetry") + """, o AS (SELECT uid, machine_failure,
 row_number() OVER (PARTITION BY machine_failure ORDER BY md5(concat('42', uid)), uid) AS rn, count(*) OVER (PARTITION BY machine_failure) AS n FROM telemetry)
"""
FOLD_ROWS = "SELECT uid, machine_failure, CAST(CASE WHEN rn <= n // 5 THEN 0 WHEN rn <= (2*n) // 5 THEN 1 WHEN rn <= (3*n) // 5 THEN 2 WHEN rn <= (4*n) // 5 THEN 3 ELSE 4 END AS INT) AS fold FROM o"


@query("stratified_folds", FOLDS + FOLD_ROWS)
def stratified_folds(spark, sf):
    return splitting.stratified_folds(view(spark, sf, "telemetry"), "machine_failure", "uid").select("uid", "machine_failure", "fold")


GROUP_SPLIT = with_views("trajectories") + """, u AS (SELECT unit_id, row_number() OVER (ORDER BY md5(concat('42', unit_id)), CAST(unit_id AS VARCHAR)) AS rn,
 count(*) OVER () AS n FROM (SELECT DISTINCT unit_id FROM trajectories)),
g AS (SELECT t.*, CASE WHEN rn <= floor(0.2 * n) THEN 'validation' ELSE 'train' END AS part FROM trajectories t JOIN u USING (unit_id))
"""


@query("group_split", GROUP_SPLIT + "SELECT unit_id, cycle, part FROM g")
def group_split(spark, sf):
    return splitting.group_split(view(spark, sf, "trajectories"), "unit_id").select("unit_id", "cycle", "part")


def _sides(spark, sf):
    parts = splitting.group_split(view(spark, sf, "events").select(F.col("user_id").alias("unit_id")), "unit_id")
    return (parts.filter(f"part = '{p}'").select("unit_id") for p in ("train", "validation"))


@query("group_overlap", GROUP_SPLIT + """SELECT count(*) AS shared FROM (SELECT unit_id FROM g WHERE part = 'train' INTERSECT SELECT unit_id FROM g WHERE part = 'validation')""")
def group_overlap(spark, sf):
    train, held = _sides(spark, sf)
    return train.join(held.distinct(), "unit_id", "left_semi").agg(F.countDistinct("unit_id").alias("shared"))


@query("split_overlap", GROUP_SPLIT + """SELECT unit_id FROM g WHERE part = 'train' AND cycle > 60 INTERSECT SELECT unit_id FROM g WHERE part = 'train' AND cycle <= 60""")
def split_overlap(spark, sf):
    train = splitting.group_split(view(spark, sf, "trajectories"), "unit_id").filter("part = 'train'")
    return train.filter("cycle > 60").select("unit_id").intersect(train.filter("cycle <= 60").select("unit_id"))
