"""Queries: data profile and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwarden.functions.scoring import FEATURES
from millwarden.operators import profiling as P
from millwarden.plans.catalog import query
from millwarden.plans.views import view, with_views

FLAGS = ("twf", "hdf", "pwf", "osf", "rnf")
NUMERIC = (*FEATURES, *FLAGS, "machine_failure")
TELEMETRY_COLUMNS = ("uid", "type", *FEATURES, *FLAGS, "machine_failure")


def _stack(columns, template, tables="telemetry"):
    return " UNION ALL ".join(template.format(c=c, t=tables) for c in columns)


@query("profile_shape", with_views("telemetry") + "SELECT count(*) AS n_rows, CAST(15 AS INT) AS n_columns FROM telemetry")
def profile_shape(spark, sf):
    return P.shape(view(spark, sf, "telemetry"))


def with_gaps(df):
    return df.withColumn("tool_wear", F.expr("nullif(tool_wear, 0)"))


GAPS = "gaps AS (SELECT * REPLACE (nullif(tool_wear, 0) AS tool_wear) FROM telemetry)"


@query("profile_nulls", with_views("telemetry") + ", " + GAPS + _stack(
    TELEMETRY_COLUMNS, " SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM gaps ")
    + " UNION ALL SELECT 'total', count(*) - count(tool_wear) FROM gaps")
def profile_nulls(spark, sf):
    return P.null_counts(with_gaps(view(spark, sf, "telemetry")))


@query("profile_duplicates", "SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates")
def profile_duplicates(spark, sf):
    return P.duplicate_rows(view(spark, sf, "lineitem"))


@query("profile_duplicate_keys", """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
    SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_discount)""")
def profile_duplicate_keys(spark, sf):
    """Rows equal to an earlier one in some columns."""
    return P.duplicate_rows(view(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount"))


@query("profile_distinct", with_views("telemetry") + ", " + GAPS + _stack(
    TELEMETRY_COLUMNS, " SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM gaps "))
def profile_distinct(spark, sf):
    return P.distinct_counts(with_gaps(view(spark, sf, "telemetry")))


@query("class_distribution", with_views("telemetry") + """
SELECT machine_failure, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent
FROM telemetry GROUP BY machine_failure""")
def class_distribution(spark, sf):
    return P.class_distribution(view(spark, sf, "telemetry"), "machine_failure")


@query("describe", with_views("telemetry") + _stack(FEATURES, """
SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25,
       round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM {t} """))
def describe(spark, sf):
    return P.describe(view(spark, sf, "telemetry"), FEATURES)


@query("failure_mode_counts", with_views("telemetry") + _stack(
    FLAGS, " SELECT '{c}' AS failure_mode, CAST(sum({c}) AS BIGINT) AS n FROM {t} "))
def failure_mode_counts(spark, sf):
    return P.flag_counts(view(spark, sf, "telemetry"), FLAGS)


@query("failure_rate_by_type", with_views("telemetry") + """
SELECT type, count(*) AS n, CAST(sum(machine_failure) AS BIGINT) AS failures, round(avg(machine_failure), 6) AS rate,
       round(100.0 * avg(machine_failure), 6) AS percent FROM telemetry GROUP BY type""")
def failure_rate_by_type(spark, sf):
    return P.rate_by(view(spark, sf, "telemetry"), "type", "machine_failure")


BINNED = ("torque", "rotational_speed", "tool_wear", "temperature_differential", "mechanical_power")


@query("failure_rate_by_bins", with_views("telemetry") + ", " + ", ".join(f"""
e_{c} AS (SELECT list_sort(list_distinct([quantile_cont({c}, 0.0), quantile_cont({c}, 0.1), quantile_cont({c}, 0.2),
  quantile_cont({c}, 0.3), quantile_cont({c}, 0.4), quantile_cont({c}, 0.5), quantile_cont({c}, 0.6), quantile_cont({c}, 0.7),
  quantile_cont({c}, 0.8), quantile_cont({c}, 0.9), quantile_cont({c}, 1.0)])) AS e FROM telemetry)""" for c in BINNED) + _stack(BINNED, """
SELECT '{c}' AS feature, CAST(bin AS INT) AS bin, round(low, 6) AS low, round(high, 6) AS high, count(*) AS n,
       CAST(sum(machine_failure) AS BIGINT) AS failures, round(avg(machine_failure), 6) AS rate
FROM (SELECT machine_failure, greatest(1, len(list_filter(e, lambda x: x < {c}))) AS bin,
             e[greatest(1, len(list_filter(e, lambda x: x < {c})))] AS low,
             e[greatest(1, len(list_filter(e, lambda x: x < {c}))) + 1] AS high FROM {t}, e_{c})
GROUP BY bin, low, high """))
def failure_rate_by_bins(spark, sf):
    return P.quantile_bins(view(spark, sf, "telemetry"), BINNED, "machine_failure")


@query("correlation_matrix", with_views("telemetry") + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN NOT isnan(corr({a}, {b})) THEN round(corr({a}, {b}), 6) END AS r FROM telemetry"
    for a in NUMERIC for b in NUMERIC))
def correlation_matrix(spark, sf):
    return P.correlation_matrix(view(spark, sf, "telemetry"), NUMERIC)


@query("target_association", with_views("telemetry") + _stack(FEATURES, """
SELECT '{c}' AS feature, round(corr({c}, machine_failure), 6) AS r, abs(round(corr({c}, machine_failure), 6)) AS strength FROM {t} """))
def target_association(spark, sf):
    return P.target_association(view(spark, sf, "telemetry"), FEATURES, "machine_failure")


@query("histogram", with_views("telemetry") + """, s AS (SELECT min(torque) AS lo, (max(torque) - min(torque)) / 45 AS w FROM telemetry),
c AS (SELECT least(CAST(floor((torque - lo) / w) AS INT), 44) AS bin, count(*) AS n FROM telemetry, s GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(lo + i * w, 6) AS low, round(lo + (i + 1) * w, 6) AS high, coalesce(n, 0) AS n
FROM range(45) r(i) LEFT JOIN c ON c.bin = i, s""")
def histogram(spark, sf):
    return P.histogram(view(spark, sf, "telemetry"), "torque", 45)


@query("box_stats", with_views("telemetry") + _stack(FEATURES, """
SELECT machine_failure, '{c}' AS feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN ok THEN v END), 6) AS whisker_low, round(max(CASE WHEN ok THEN v END), 6) AS whisker_high,
       CAST(count_if(NOT ok) AS BIGINT) AS outliers
FROM (SELECT *, v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) AS ok
      FROM (SELECT machine_failure, {c} AS v FROM {t}) JOIN (
        SELECT machine_failure, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
               quantile_cont({c}, 0.75) AS q3 FROM {t} GROUP BY machine_failure) USING (machine_failure))
GROUP BY machine_failure, q1, median, q3 """))
def box_stats(spark, sf):
    return P.box_stats(view(spark, sf, "telemetry"), FEATURES, "machine_failure")


@query("density_curve", with_views("telemetry") + """,
s AS (SELECT min(mechanical_power) AS lo, max(mechanical_power) AS hi,
             stddev_samp(mechanical_power) * pow(count(*), -0.2) AS h, count(*) AS n FROM telemetry)
SELECT CAST(p AS INT) AS point, round(lo + p * ((hi - lo) / 99), 6) AS x,
       round(sum(exp(-0.5 * pow((lo + p * ((hi - lo) / 99) - mechanical_power) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM telemetry, s, range(100) g(p) GROUP BY p, lo, hi, h, n""")
def density_curve(spark, sf):
    return P.density_curve(view(spark, sf, "telemetry"), "mechanical_power")


@query("trajectory_profile", with_views("trajectories", "final_rul") + """,
l AS (SELECT unit_id, max(cycle) AS last, count(*) AS n FROM trajectories GROUP BY unit_id)
SELECT count(*) AS units, CAST(sum(n) AS BIGINT) AS n_rows, min(last) AS min_last_cycle, max(last) AS max_last_cycle,
       (SELECT count(rul) FROM final_rul) AS labels, (SELECT min(rul) FROM final_rul) AS min_rul,
       (SELECT max(rul) FROM final_rul) AS max_rul, (SELECT round(avg(rul), 6) FROM final_rul) AS mean_rul FROM l""")
def trajectory_profile(spark, sf):
    return P.trajectory_profile(view(spark, sf, "trajectories"), view(spark, sf, "final_rul"))
