"""Queries: classifier, detector, clustering and forecast metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwarden.operators import evaluation as E
from millwarden.operators import risk as R
from millwarden.operators import series as S
from millwarden.operators.splitting import stratified_folds
from millwarden.plans.catalog import query
from millwarden.plans.views import view, with_views
from millwarden.session import cut_lineage

MODELS = ("fused", "wear")
LONG = with_views("scored") + """, long AS (SELECT uid, actual_failure AS y, 'fused' AS model, failure_probability AS p FROM scored
 UNION ALL SELECT uid, actual_failure, 'wear', wear_probability FROM scored)
"""


def scored_long(spark, sf):
    return both_models(view(spark, sf, "scored"))


def both_models(scored, *keep):
    models = F.array(F.struct(F.lit("fused").alias("model"), F.col("failure_probability").alias("p")),
                     F.struct(F.lit("wear").alias("model"), F.col("wear_probability").alias("p")))
    return scored.select("uid", *keep, F.col("actual_failure").alias("y"), F.inline(models))


def div(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


PRECISION, RECALL = div("tp", "tp + fp"), div("tp", "tp + fn")
F1, ACCURACY = div("2 * tp", "2 * tp + fp + fn"), div("tp + tn", "tp + tn + fp + fn")
COUNTS = """CAST(count_if(NOT ({pred}) AND y = 0) AS BIGINT) AS tn, CAST(count_if(({pred}) AND y = 0) AS BIGINT) AS fp,
 CAST(count_if(NOT ({pred}) AND y = 1) AS BIGINT) AS fn, CAST(count_if(({pred}) AND y = 1) AS BIGINT) AS tp"""
LOCKED = LONG + ", t(model, threshold) AS (VALUES ('fused', 0.35::DOUBLE), ('wear', 0.74::DOUBLE))\n"


def locked(spark, sf):
    thresholds = spark.createDataFrame([("fused", 0.35), ("wear", 0.74)], "model string, threshold double")
    return R.attach_thresholds(scored_long(spark, sf), thresholds)


@query("locked_thresholds", LOCKED + "SELECT uid, model, p, y, threshold, p >= threshold AS predicted FROM long JOIN t USING (model)")
def locked_thresholds(spark, sf):
    return locked(spark, sf).select("uid", "model", "p", "y", "threshold", (F.col("p") >= F.col("threshold")).alias("predicted"))


CONFUSION = LOCKED + f", c AS (SELECT model, {COUNTS.format(pred='p >= threshold')} FROM long JOIN t USING (model) GROUP BY model)\n"


@query("confusion_matrix", CONFUSION + "SELECT * FROM c")
def confusion_matrix(spark, sf):
    return E.confusion(locked(spark, sf), ["model"], F.col("p") >= F.col("threshold"), "y")


@query("classification_report", CONFUSION + f"""SELECT *, round({ACCURACY}, 6) AS accuracy, round({PRECISION}, 6) AS precision,
 round({RECALL}, 6) AS recall, round({F1}, 6) AS f1 FROM c""")
def classification_report(spark, sf):
    return E.classification_report(confusion_matrix(spark, sf))


@query("model_leaderboard", CONFUSION + f"SELECT model, fn, round({RECALL}, 6) AS recall, round({F1}, 6) AS f1 FROM c")
def model_leaderboard(spark, sf):
    report = classification_report(spark, sf).select("model", "fn", "recall", "f1")
    return E.leaderboard(report, [F.desc("recall"), F.desc("f1"), F.col("model")])


POINTS = LONG + """, g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM long GROUP BY model, p),
pts AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS pp, sum(neg) OVER (PARTITION BY model) AS nn
 FROM g WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
"""


def points(spark, sf):
    return E.curve_points(scored_long(spark, sf), ["model"], "p", "y")


@query("roc_auc", POINTS + "SELECT model, round(sum(neg * (tp - pos / 2)) / (max(pp) * max(nn)), 6) AS roc_auc FROM pts GROUP BY model")
def roc_auc(spark, sf):
    return E.areas(points(spark, sf), ["model"]).select("model", "roc_auc")


@query("average_precision", POINTS + "SELECT model, round(sum(pos * tp / (tp + fp)) / max(pp), 6) AS average_precision FROM pts GROUP BY model")
def average_precision(spark, sf):
    return E.areas(points(spark, sf), ["model"]).select("model", "average_precision")


@query("roc_curve", POINTS + "SELECT model, p AS threshold, round(fp / nn, 6) AS fpr, round(tp / pp, 6) AS tpr FROM pts")
def roc_curve(spark, sf):
    return E.roc_curve(points(spark, sf), ["model"], "p")


@query("pr_curve", POINTS + "SELECT model, p AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pp, 6) AS recall FROM pts")
def pr_curve(spark, sf):
    return E.pr_curve(points(spark, sf), ["model"], "p")


@query("pr_auc_trapezoid", POINTS + """, s AS (SELECT *, tp / (tp + fp) AS pr, tp / pp AS rc FROM pts),
l AS (SELECT *, lag(pr, 1, 1.0) OVER w AS pr0, lag(rc, 1, 0.0) OVER w AS rc0 FROM s WINDOW w AS (PARTITION BY model ORDER BY p DESC))
SELECT model, round(sum((rc - rc0) * (pr + pr0) / 2), 6) AS pr_auc FROM l GROUP BY model""")
def pr_auc_trapezoid(spark, sf):
    return E.areas(points(spark, sf), ["model"]).select("model", "pr_auc")


SWEEP = LONG + f""", g AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(5, 96) r(i)),
c AS (SELECT model, threshold, {COUNTS.format(pred='p >= threshold')} FROM
  (SELECT model, p, y, threshold FROM long, g) GROUP BY model, threshold),
sweep AS (SELECT *, {PRECISION} AS precision, {RECALL} AS recall, {F1} AS f1 FROM c)
"""


@query("threshold_sweep", SWEEP + """SELECT model, threshold, tn, fp, fn, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
 round(f1, 6) AS f1 FROM sweep""")
def threshold_sweep(spark, sf):
    sweep = E.threshold_sweep(scored_long(spark, sf), ["model"], "p", "y")
    return sweep.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("best_threshold", SWEEP + """, o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS k FROM sweep)
SELECT model, threshold AS best_threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
 (SELECT max(threshold) FROM sweep s WHERE s.model = o.model AND recall >= 0.9) AS high_recall_threshold FROM o WHERE k = 1""")
def best_threshold(spark, sf):
    return E.best_threshold(E.threshold_sweep(scored_long(spark, sf), ["model"], "p", "y"), ["model"])


FOLDED = LONG + """, o AS (SELECT uid, row_number() OVER (PARTITION BY actual_failure ORDER BY md5(concat('42', uid)), uid) AS rn,
 count(*) OVER (PARTITION BY actual_failure) AS n FROM scored),
f AS (SELECT long.*, CAST(CASE WHEN rn <= n // 5 THEN 0 WHEN rn <= (2*n) // 5 THEN 1 WHEN rn <= (3*n) // 5 THEN 2 WHEN rn <= (4*n) // 5 THEN 3 ELSE 4 END AS INT) AS fold
 FROM long JOIN o USING (uid)),
g AS (SELECT model, fold, p, sum(y) AS pos, sum(1 - y) AS neg FROM f GROUP BY ALL),
pts AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model, fold) AS pp, sum(neg) OVER (PARTITION BY model, fold) AS nn
 FROM g WINDOW w AS (PARTITION BY model, fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT model, fold, round(sum(neg * (tp - pos / 2)) / (max(pp) * max(nn)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(pp), 6) AS average_precision
 FROM pts GROUP BY model, fold),
""" + f"""c AS (SELECT model, fold, {COUNTS.format(pred='p >= 0.5')} FROM f GROUP BY model, fold),
m AS (SELECT model, fold, {PRECISION} AS precision, {RECALL} AS recall, {F1} AS f1, roc_auc, average_precision FROM c JOIN a USING (model, fold))
"""


@query("cv_summary", FOLDED + "SELECT model, " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std" for c in ("precision", "recall", "f1", "roc_auc", "average_precision"))
    + " FROM m GROUP BY model")
def cv_summary(spark, sf):
    folds = both_models(cut_lineage(stratified_folds(view(spark, sf, "scored"), "actual_failure", "uid")), "fold")
    return E.cv_summary(E.fold_metrics(folds, "model", "fold", "p", "y"), "model")


@query("detector_report", with_views("scored") + f""", c AS (SELECT {COUNTS.format(pred='anomaly_raw >= 1.5')} FROM (SELECT *, actual_failure AS y FROM scored))
SELECT tp + fp AS anomalies, round({div('tp + fp', 'tn + fp + fn + tp')}, 6) AS detection_rate, round({PRECISION}, 6) AS precision,
 round({RECALL}, 6) AS recall, round({F1}, 6) AS f1 FROM c""")
def detector_report(spark, sf):
    return E.detector_report(view(spark, sf, "scored"), F.col("anomaly_raw") >= 1.5, "actual_failure")


@query("adjusted_rand", with_views("scored") + """, d AS (SELECT type AS a, CAST(floor(failure_probability * 4) AS INT) AS b FROM scored),
c AS (SELECT a, b, count(*)::DOUBLE AS n FROM d GROUP BY a, b),
s AS (SELECT (SELECT sum(n*(n-1)/2) FROM c) AS pairs_both, (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS sa,
 (SELECT sum(n*(n-1)/2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS sb, (SELECT sum(n)*(sum(n)-1)/2 FROM c) AS t)
SELECT round((pairs_both - sa*sb/t) / ((sa+sb)/2 - sa*sb/t), 6) AS ari FROM s""")
def adjusted_rand(spark, sf):
    labels = view(spark, sf, "scored").select("type", F.floor(F.col("failure_probability") * 4).alias("quarter"))
    return E.adjusted_rand(labels, "type", "quarter")


@query("silhouette", """WITH p AS (SELECT c_custkey AS id, c_acctbal/1000 AS x, CAST(c_nationkey AS DOUBLE) AS y, CAST(floor(c_nationkey / 5) AS INT) AS k FROM customer),
s AS (SELECT k, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x + y*y) AS q FROM p GROUP BY k),
d AS (SELECT id, p.k AS own, s.k AS other, n, x*x + y*y + q/n - 2*(x*sx + y*sy)/n AS m FROM p, s),
ab AS (SELECT id, max(CASE WHEN own = other THEN m * n / (n - 1) END) AS a, min(CASE WHEN own <> other THEN m END) AS b FROM d GROUP BY id)
SELECT (SELECT CAST(count(DISTINCT k) AS INT) FROM p) AS clusters, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab""")
def silhouette(spark, sf):
    clustered = view(spark, sf, "points").withColumn("cluster", F.floor(F.col("y") / 5).cast("int"))
    value = E.silhouette(clustered, ["x", "y"], "cluster")
    return clustered.filter("cluster <> -1").agg(F.countDistinct("cluster").cast("int").alias("clusters")).withColumn(
        "silhouette", F.round(F.lit(value), 6))


PREDICTED = with_views("trajectories", "final_rul") + """,
l AS (SELECT unit_id, max(cycle) AS last FROM trajectories GROUP BY unit_id),
a AS (SELECT t.unit_id, t.cycle AS end_cycle, least(l.last - t.cycle + f.rul, 125) AS rul
      FROM trajectories t JOIN l USING (unit_id) JOIN final_rul f USING (unit_id) WHERE t.cycle >= 30),
p AS (SELECT unit_id, end_cycle, rul, 'a' AS model, rul + (end_cycle*13 + unit_id) % 11 - 5 AS predicted FROM a
      UNION ALL SELECT unit_id, end_cycle, rul, 'b', rul + (end_cycle*7 + unit_id) % 17 - 8 FROM a)
"""


def actual_windows(spark, sf):
    labelled = S.test_rul(view(spark, sf, "trajectories"), view(spark, sf, "final_rul"))
    return labelled.filter(F.col("cycle") >= S.WINDOW).select("unit_id", F.col("cycle").alias("end_cycle"), "rul")


def predictions(actual):
    a = F.col("rul") + (F.col("end_cycle") * 13 + F.col("unit_id")) % 11 - 5
    b = F.col("rul") + (F.col("end_cycle") * 7 + F.col("unit_id")) % 17 - 8
    models = F.array(F.struct(F.lit("a").alias("model"), a.alias("predicted")), F.struct(F.lit("b").alias("model"), b.alias("predicted")))
    return actual.select("unit_id", "end_cycle", F.inline(models))


def predicted_windows(spark, sf):
    actual = actual_windows(spark, sf)
    return S.align_predictions(actual, predictions(actual))


@query("windows_to_errors", PREDICTED + "SELECT unit_id, end_cycle, model, predicted - rul AS error FROM p")
def windows_to_errors(spark, sf):
    return predicted_windows(spark, sf).select("unit_id", "end_cycle", "model", (F.col("predicted") - F.col("rul")).alias("error"))


@query("forecast_errors", PREDICTED + """SELECT model, round(avg(abs(predicted - rul)), 6) AS mae, round(sqrt(avg((predicted - rul) * (predicted - rul))), 6) AS rmse
FROM p GROUP BY model""")
def forecast_errors(spark, sf):
    return E.forecast_errors(predicted_windows(spark, sf), ["model"], "predicted", "rul")


@query("per_unit_errors", PREDICTED + """SELECT unit_id, CAST(count_if(model = 'a') AS BIGINT) AS windows,
 round(avg(CASE WHEN model = 'a' THEN abs(predicted - rul) END), 6) AS mae_a, round(avg(CASE WHEN model = 'b' THEN abs(predicted - rul) END), 6) AS mae_b
FROM p GROUP BY unit_id""")
def per_unit_errors(spark, sf):
    return E.per_unit_errors(predicted_windows(spark, sf), "unit_id", "model", ("a", "b"), "predicted", "rul")


@query("error_statistics", PREDICTED + """SELECT model, round(avg(predicted - rul), 6) AS mean_error, round(stddev_pop(predicted - rul), 6) AS std_error,
 CAST(max(abs(predicted - rul)) AS DOUBLE) AS max_abs_error, CAST(median(abs(predicted - rul)) AS DOUBLE) AS median_abs_error FROM p GROUP BY model""")
def error_statistics(spark, sf):
    return E.error_statistics(predicted_windows(spark, sf), "model", "predicted", "rul")


RECON = with_views("scored") + """, d AS (SELECT anomaly_raw AS e, actual_failure AS y FROM scored),
g AS (SELECT i, round(90 + i / 2, 1) AS percentile FROM range(20) r(i)),
q AS (SELECT quantile_cont(e, [0.9, 0.905, 0.91, 0.915, 0.92, 0.925, 0.93, 0.935, 0.94, 0.945, 0.95, 0.955, 0.96, 0.965, 0.97, 0.975, 0.98, 0.985, 0.99, 0.995]) AS ts
 FROM d WHERE y = 0),
cand AS (SELECT percentile, ts[i + 1] AS threshold FROM g, q),
""" + f"""c AS (SELECT percentile, threshold, {COUNTS.format(pred='e > threshold')} FROM d, cand GROUP BY percentile, threshold),
sweep AS (SELECT *, {PRECISION} AS precision, {RECALL} AS recall, {F1} AS f1 FROM c)
"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("threshold", "precision", "recall", "f1")})


RECON_COLUMNS = """percentile, round(threshold, 6) AS threshold, tn, fp, fn, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"""


def recon_sweep(spark, sf):
    return E.reconstruction_sweep(view(spark, sf, "scored"), "anomaly_raw", "actual_failure", F.col("actual_failure") == 0)


@query("reconstruction_sweep", RECON + f"SELECT {RECON_COLUMNS} FROM sweep")
def reconstruction_sweep(spark, sf):
    return _rounded(recon_sweep(spark, sf))


@query("reconstruction_threshold", RECON + f"SELECT {RECON_COLUMNS} FROM sweep ORDER BY sweep.f1 DESC, percentile LIMIT 1")
def reconstruction_threshold(spark, sf):
    return _rounded(E.reconstruction_choice(recon_sweep(spark, sf)))


TRAIN_RUL = with_views("trajectories") + """,
r AS (SELECT *, least(max(cycle) OVER (PARTITION BY unit_id) - cycle, 125) AS rul FROM trajectories)
"""


def labelled(spark, sf):
    return S.train_rul(view(spark, sf, "trajectories"))


@query("train_rul", TRAIN_RUL + "SELECT unit_id, cycle, rul FROM r")
def train_rul(spark, sf):
    return labelled(spark, sf).select("unit_id", "cycle", "rul")


@query("test_rul", with_views("trajectories", "final_rul") + """
SELECT unit_id, cycle, least(max(cycle) OVER (PARTITION BY unit_id) - cycle + rul, 125) AS rul FROM trajectories JOIN final_rul USING (unit_id)""")
def test_rul(spark, sf):
    return S.test_rul(view(spark, sf, "trajectories"), view(spark, sf, "final_rul")).select("unit_id", "cycle", "rul")


@query("sliding_windows", TRAIN_RUL + """, w AS (SELECT unit_id, cycle AS end_cycle, rul, list(sensor_1) OVER f AS a, list(sensor_2) OVER f AS b FROM r
 WINDOW f AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT unit_id, end_cycle, CAST(rul AS FLOAT) AS rul, list_aggregate([CAST(CAST(x AS FLOAT) AS VARCHAR) for x in a], 'string_agg', ' ') AS first_sensor,
 list_aggregate([CAST(CAST(x AS FLOAT) AS VARCHAR) for x in b], 'string_agg', ' ') AS second_sensor FROM w WHERE len(a) = 30""")
def sliding_windows(spark, sf):
    windows = S.sliding_windows(labelled(spark, sf), ["sensor_1", "sensor_2"], position="cycle")
    def text(i):
        return F.array_join(F.transform("seq", lambda row: row[i].cast("string")), " ")
    return windows.select("unit_id", "end_cycle", "rul", text(0).alias("first_sensor"), text(1).alias("second_sensor"))


WINDOW_STATS = ("mean", "std", "min", "max", "last", "slope")


def _window_stats(c):
    return (f"avg({c}) OVER f AS {c}_mean, stddev_pop({c}) OVER f AS {c}_std, min({c}) OVER f AS {c}_min, max({c}) OVER f AS {c}_max, {c} AS {c}_last, "
            f"regr_slope({c}, cycle) OVER f AS {c}_slope")


@query("window_features", TRAIN_RUL + ", w AS (SELECT unit_id, cycle AS end_cycle, rul, count(*) OVER f AS n, " + ", ".join(map(_window_stats, ("sensor_1", "sensor_2")))
       + " FROM r WINDOW f AS (PARTITION BY unit_id ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) SELECT unit_id, end_cycle, rul, "
       + ", ".join(f"round({c}_{k}, 6) AS {c}_{k}" for c in ("sensor_1", "sensor_2") for k in WINDOW_STATS) + " FROM w WHERE n = 30")
def window_features(spark, sf):
    w = S.window_features(labelled(spark, sf), ["sensor_1", "sensor_2"], position="cycle")
    return w.select("unit_id", "end_cycle", "rul", *[F.round(c, 6).alias(c) for c in w.columns if c.startswith("sensor_")])


@query("healthy_windows", TRAIN_RUL + """, w AS (SELECT unit_id, cycle AS end_cycle, rul FROM r WHERE cycle >= 30)
SELECT * FROM w WHERE rul >= (SELECT quantile_cont(rul, 0.7) FROM w)""")
def healthy_windows(spark, sf):
    windows = labelled(spark, sf).filter(F.col("cycle") >= S.WINDOW).select("unit_id", F.col("cycle").alias("end_cycle"), "rul")
    return S.healthy_windows(windows)


@query("near_failure_label", TRAIN_RUL + "SELECT unit_id, cycle, CAST(rul <= 30 AS INT) AS near_failure FROM r")
def near_failure_label(spark, sf):
    return labelled(spark, sf).select("unit_id", "cycle", S.near_failure().alias("near_failure"))


ATTRIBUTED = with_views("telemetry") + """, m AS (SELECT avg(torque) AS tm, avg(tool_wear) AS wm, avg(rotational_speed) AS rm FROM telemetry),
a AS (SELECT uid, 'fused' AS model, 'torque' AS feature, 0.01*(torque-tm) AS value FROM telemetry, m
 UNION ALL SELECT uid, 'fused', 'tool_wear', 0.002*(tool_wear-wm) FROM telemetry, m
 UNION ALL SELECT uid, 'fused', 'rotational_speed', -0.0003*(rotational_speed-rm) FROM telemetry, m
 UNION ALL SELECT uid, 'wear', 'tool_wear', 0.004*(tool_wear-wm) FROM telemetry, m
 UNION ALL SELECT uid, 'wear', 'torque', 0.001*(torque-tm) FROM telemetry, m
 UNION ALL SELECT uid, 'wear', 'rotational_speed', 0.0*(rotational_speed-rm) FROM telemetry, m),
g AS (SELECT model, feature, avg(abs(value)) AS importance FROM a GROUP BY model, feature)
"""
WEIGHTS = {"fused": {"torque": 0.01, "tool_wear": 0.002, "rotational_speed": -0.0003},
           "wear": {"torque": 0.001, "tool_wear": 0.004, "rotational_speed": 0.0}}


def attributions(spark, sf):
    from millwarden.operators import attribution as A

    df = view(spark, sf, "telemetry")
    means = df.agg(*[F.avg(f).alias(f) for f in WEIGHTS["fused"]]).first().asDict()
    tables = {m: A.linear_attribution(df, "uid", w, means) for m, w in WEIGHTS.items()}
    return A.union_models(tables)


@query("linear_attribution", ATTRIBUTED + "SELECT uid, model, feature, round(value, 9) AS value FROM a")
def linear_attribution(spark, sf):
    return attributions(spark, sf).withColumn("value", F.round("value", 9))


@query("union_models", ATTRIBUTED + "SELECT model, count(*) AS n FROM a GROUP BY model")
def union_models(spark, sf):
    return attributions(spark, sf).groupBy("model").agg(F.count("*").alias("n"))


@query("global_importance", ATTRIBUTED + "SELECT model, feature, round(importance, 6) AS importance FROM g")
def global_importance(spark, sf):
    from millwarden.operators import attribution as A

    return A.global_importance(attributions(spark, sf)).withColumn("importance", F.round("importance", 6))


@query("importance_comparison", ATTRIBUTED + """SELECT feature, round(avg(importance), 6) AS mean_importance, round(stddev_samp(importance), 6) AS std_importance
FROM g GROUP BY feature""")
def importance_comparison(spark, sf):
    from millwarden.operators import attribution as A

    return A.importance_comparison(A.global_importance(attributions(spark, sf)))


@query("top_features", ATTRIBUTED + "SELECT feature, round(avg(importance), 6) AS mean_importance FROM g GROUP BY feature ORDER BY avg(importance) DESC, feature LIMIT 2")
def top_features(spark, sf):
    from millwarden.operators import attribution as A

    return A.top_features(A.importance_comparison(A.global_importance(attributions(spark, sf))), 2).select("feature", "mean_importance")


@query("dependence_points", ATTRIBUTED + """, t AS (SELECT feature FROM g WHERE model = 'fused' ORDER BY importance DESC, feature LIMIT 2),
v AS (SELECT uid, 'torque' AS feature, torque AS x FROM telemetry UNION ALL SELECT uid, 'tool_wear', tool_wear FROM telemetry
 UNION ALL SELECT uid, 'rotational_speed', rotational_speed FROM telemetry)
SELECT a.uid, a.feature, x, round(value, 9) AS value FROM a JOIN v ON a.uid = v.uid AND a.feature = v.feature WHERE model = 'fused' AND a.feature IN (SELECT feature FROM t)""")
def dependence_points(spark, sf):
    from millwarden.operators import attribution as A

    fused = attributions(spark, sf).filter("model = 'fused'").drop("model")
    return A.dependence_points(view(spark, sf, "telemetry"), fused, "uid", list(WEIGHTS["fused"]), 2).withColumn("value", F.round("value", 9))
