"""Test inputs as views over the driver tables.

Each view is plain SQL with ``{table}`` placeholders, so that Spark queries and
their oracles start from equal rows.  ``trajectories`` and ``split`` rank rows:
their Spark form uses the distributed operators, the SQL here is the oracle's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwarden.operators.ranking import grouped_positions
from millwarden.operators.splitting import stratified_split
from millwarden.session import cut_lineage

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "telemetry": (("lineitem",), """
WITH b AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice*100) AS BIGINT)) AS uid,
         CASE l_returnflag WHEN 'A' THEN 'H' WHEN 'N' THEN 'L' ELSE 'M' END AS type,
         round(296.0 + 80*l_discount, 2) AS air_temperature,
         round(304.0 + 80*l_discount + 60*l_tax, 2) AS process_temperature,
         round(1200 + l_extendedprice/65.625, 2) AS rotational_speed,
         25 + l_quantity AS torque,
         CAST((l_partkey*7 + l_suppkey*13 + l_linenumber*31) % 251 AS DOUBLE) AS tool_wear,
         l_orderkey, l_linenumber
  FROM {lineitem}),
m AS (
  SELECT *, round(process_temperature - air_temperature, 2) AS temperature_differential,
         torque*rotational_speed*(2*pi()/60) AS mechanical_power FROM b),
f AS (
  SELECT *, CAST(tool_wear >= 248 AS INT) AS twf,
         CAST(temperature_differential < 8.5 AND rotational_speed < 1260 AS INT) AS hdf,
         CAST(mechanical_power < 3400 OR mechanical_power > 19000 AS INT) AS pwf,
         CAST(torque*tool_wear > 17500 AS INT) AS osf,
         CAST((l_orderkey*31 + l_linenumber) % 1000 = 0 AS INT) AS rnf FROM m)
SELECT uid, type, air_temperature, process_temperature, rotational_speed, torque, tool_wear,
       temperature_differential, mechanical_power, twf, hdf, pwf, osf, rnf,
       greatest(twf, hdf, pwf, osf) AS machine_failure FROM f"""),
    "split": (("telemetry",), """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY machine_failure ORDER BY md5(concat('42', uid)), uid)
                    <= 0.8 * count(*) OVER (PARTITION BY machine_failure) THEN 'train' ELSE 'test' END AS part
FROM {telemetry}"""),
    "scored": (("telemetry",), """
SELECT uid, type, machine_failure AS actual_failure,
       round(0.5*tool_wear/250 + 0.5*(torque-25)/50, 4) AS failure_probability,
       round(abs(torque-50)/25 + abs(temperature_differential-10)/2.5, 4) AS anomaly_raw,
       round(tool_wear/250, 2) AS wear_probability
FROM {telemetry}"""),
    "risk": (("scored",), """
SELECT uid, type, actual_failure, failure_probability,
       (anomaly_raw - (SELECT min(anomaly_raw) FROM {scored}))
         / (SELECT max(anomaly_raw) - min(anomaly_raw) FROM {scored}) AS anomaly_score,
       0.6*failure_probability + 0.4*((anomaly_raw - (SELECT min(anomaly_raw) FROM {scored}))
         / (SELECT max(anomaly_raw) - min(anomaly_raw) FROM {scored})) AS unified_risk_score
FROM {scored}"""),
    "trajectories": (("events",), """
SELECT user_id AS unit_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS cycle,
       value AS sensor_1,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS sensor_2,
       event_type AS op_setting
FROM {events}"""),
    "final_rul": (("events",), """
SELECT DISTINCT user_id AS unit_id, CAST((user_id*7) % 60 AS INT) AS rul FROM {events}"""),
    "live": (("events",), """
SELECT concat('M-', lpad(CAST(user_id AS STRING), 4, '0')) AS machine_id, ts, event_id,
       CASE user_id % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'M' END AS type,
       300.0 + user_id % 5 AS air_temperature, 310.0 + user_id % 7 AS process_temperature,
       1200 + value*4 AS rotational_speed, 25 + value/8 AS torque,
       CAST(event_id % 251 AS DOUBLE) AS tool_wear
FROM {events}"""),
    "corpus": (("documents",), """
SELECT doc_id, text, concat('docs/', source, '/', CAST(doc_id AS STRING), '.md') AS source_path,
       CASE WHEN doc_id % 20 = 0 THEN 'safety_procedure' ELSE 'synthetic_incident' END AS document_type,
       CASE WHEN doc_id % 20 = 0 THEN 'procedure' ELSE 'incident' END AS evidence_type,
       CASE WHEN doc_id % 20 <> 0 THEN concat('INC-', lpad(CAST(doc_id AS STRING), 4, '0')) END AS incident_id,
       CASE WHEN doc_id % 20 = 0 THEN concat('FSP-SOP-', lpad(CAST(CAST(floor(doc_id/20) AS INT) AS STRING), 3, '0')) END AS procedure_id,
       lang AS event_type,
       CASE doc_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS severity,
       doc_id % 50 <> 7 AS is_synthetic
FROM {documents}"""),
    "vectors": (("embeddings",), """
SELECT vec_id, embedding, concat('event_', CAST(label AS STRING)) AS event_type,
       CASE WHEN vec_id % 5 = 0 THEN 'safety_procedure' ELSE 'synthetic_incident' END AS document_type,
       CASE vec_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS severity,
       CASE WHEN vec_id % 5 <> 0 THEN concat('INC-', lpad(CAST(CAST(floor(vec_id/3) AS INT) AS STRING), 4, '0')) END AS incident_id,
       CASE WHEN vec_id % 5 = 0 THEN concat('FSP-SOP-', lpad(CAST(CAST(floor(vec_id/15) AS INT) AS STRING), 3, '0')) END AS procedure_id,
       concat('docs/event_', CAST(label AS STRING), '/', CAST(CAST(floor(vec_id/15) AS INT) AS STRING), '.md') AS source,
       vec_id % 50 <> 7 AS is_synthetic
FROM {embeddings}"""),
    "answers": (("documents",), """
SELECT doc_id, doc_id % 3 <> 0 AS expected_supported,
       concat('INC-', lpad(CAST(doc_id AS STRING), 4, '0')) AS retrieved_incident, 'FSP-SOP-001' AS retrieved_procedure,
       concat('FACTS per INC-', lpad(CAST(doc_id AS STRING), 4, '0'), '. POSSIBLE HYPOTHESES none. RECOMMENDED ACTIONS see FSP-SOP-001. EVIDENCE SOURCES listed.',
              CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' LIMITATIONS synthetic records.' END,
              CASE WHEN doc_id % 7 = 0 THEN ' Also INC-9999.' ELSE '' END,
              CASE WHEN doc_id % 3 = 0 THEN ' The retrieved evidence is insufficient to answer this safely.' ELSE '' END) AS answer
FROM {documents}"""),
    "records": (("documents",), """
SELECT doc_id, concat('docs/', CASE WHEN doc_id % 20 = 0 THEN 'safety_procedures' ELSE 'synthetic_incidents' END, '/', CAST(doc_id AS STRING), '.md') AS source_path,
  CASE WHEN doc_id % 20 = 0 THEN concat('# Procedure ', CAST(doc_id AS STRING), chr(10), chr(10), '**Document ID:** FSP-SOP-',
      lpad(CAST(CAST(floor(doc_id/20) AS INT) AS STRING), 3, '0'), '  ', chr(10), CASE WHEN doc_id % 40 = 0 THEN concat('  **is_synthetic:** True', chr(13), chr(10))
      WHEN doc_id % 60 = 0 THEN concat('**is_synthetic:** no', chr(10)) ELSE '' END, chr(10), '## Purpose', chr(10), chr(10), text)
  ELSE concat('# ', lang, ' incident ', CAST(doc_id AS STRING), chr(10), chr(10), '**Incident ID:** INC-', lpad(CAST(doc_id AS STRING), 4, '0'), chr(10), chr(10),
      '**Machine ID:** MACHINE-', CAST(n_chars AS STRING), chr(10), chr(10), '**Event Type:** ', lang, chr(10), chr(10), '**Severity:** High ', chr(9), chr(10), chr(10),
      '## Incident Summary', chr(10), chr(10), text, chr(10), chr(10), '## Sensor Context', chr(10), chr(10), '| Sensor | Value |', chr(10), '|---|---:|', chr(10),
      '| Air temperature | ', CAST(300 + doc_id % 7 AS STRING), '.5 |', chr(10), '| Torque | ', CASE WHEN doc_id % 9 = 0 THEN 'n/a' ELSE CAST(n_chars AS STRING) END, ' |', chr(10), chr(10),
      '## Possible Contributing Factors', chr(10), chr(10), '- Source ', source, chr(10), '- Length ', CAST(n_chars AS STRING), ' ', chr(10), chr(10),
      '## Corrective Actions', chr(10), chr(10), '- Inspect ', lang, chr(10), chr(10), '## Data Provenance', chr(10), chr(10), 'Synthetic.',
      CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), ' **Severity:** Low', chr(10)) ELSE '' END) END AS text
FROM {documents}"""),
    "evidence_corpus": (("vectors", "documents"), """
SELECT v.*, CASE WHEN document_type = 'safety_procedure' THEN 'procedure' ELSE 'incident' END AS evidence_type, d.text
FROM {vectors} v LEFT JOIN {documents} d ON v.vec_id = d.doc_id"""),
    "reports": (("answers", "documents"), """
SELECT a.doc_id, a.expected_supported, a.retrieved_incident, a.retrieved_procedure,
  concat(CASE WHEN a.doc_id % 2 = 0 THEN '## ' ELSE '' END, CASE WHEN a.doc_id % 4 = 1 THEN 'Facts' ELSE 'FACTS' END, chr(10), d.text, ' ', answer, chr(10),
    CASE WHEN a.doc_id % 6 = 5 THEN '' ELSE concat('## RECOMMENDED ACTIONS', chr(10), '**Inspect** ', d.lang, ', then FSP-SOP-001 and INC-', lpad(CAST(a.doc_id AS STRING), 4, '0'), ' ', chr(10)) END,
    'LIMITATIONS', chr(10), 'Synthetic.') AS report
FROM {answers} a JOIN {documents} d ON a.doc_id = d.doc_id"""),
    "points": (("customer",), """
SELECT c_custkey AS id, c_acctbal/1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM {customer}"""),
}


SPREAD = ("lineitem", "events", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table.  A fact table in fewer pieces than there are cores is dealt out; larger inputs are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in SPREAD and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, df.columns[0])
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark form of a view or driver table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    if name == "split":
        # Every fit reads the split several times, so it is written once.
        return cut_lineage(stratified_split(view(spark, sf_dir, "telemetry"), "machine_failure", "uid"))
    if name == "trajectories":
        events = table(spark, sf_dir, "events").withColumn("second", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
        ranked = grouped_positions(events, "user_id", "second", ["ts", "event_id"], "cycle")
        return ranked.select(
            F.col("user_id").alias("unit_id"), F.col("cycle").cast("int"), F.col("value").alias("sensor_1"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("sensor_2"),
            F.col("event_type").alias("op_setting"))
    if name == "risk":
        from millwarden.operators.risk import minmax_normalize
        from millwarden.functions.scoring import fuse_risk

        base = minmax_normalize(view(spark, sf_dir, "scored"), "anomaly_raw", "anomaly_score")
        return base.select("uid", "type", "actual_failure", "failure_probability", "anomaly_score",
                           fuse_risk("failure_probability", "anomaly_score").alias("unified_risk_score"))
    needs, sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in needs})


def with_views(*names: str) -> str:
    """``WITH`` clause defining the named views (and what they need) for an oracle."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in VIEWS or name in ordered:
            return
        for need in VIEWS[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    body = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1].format(**{m: m for m in VIEWS[n][0]})})" for n in ordered)
    return f"WITH {body}\n"
