"""Queries: models, detectors, clusterings, neighbours.  Library fits cannot be repeated in SQL and have no oracle."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from millwarden.functions.scoring import FEATURES
from millwarden.operators import attribution as A
from millwarden.operators import boosting as B
from millwarden.operators import clustering as C
from millwarden.operators import evaluation as E
from millwarden.operators import hierarchy as H
from millwarden.operators import isolation as I
from millwarden.operators import learning as L
from millwarden.operators import neighbours as N
from millwarden.operators import preparing as prep
from millwarden.operators import sequences as Q
from millwarden.operators import series as S
from millwarden.operators.risk import minmax_normalize, risk_table
from millwarden.operators.splitting import group_split, stratified_split
from millwarden.plans.catalog import query
from millwarden.plans.risk_queries import FOLD_ROWS, FOLDS, GROUP_SPLIT, PREPARED
from millwarden.plans.views import view, with_views
from millwarden.session import cut_lineage, scratch_path

def machines(spark, sf):
    return view(spark, sf, "telemetry").drop("temperature_differential", "mechanical_power")


def prepared_parts(spark, sf):
    split = cut_lineage(stratified_split(machines(spark, sf), "machine_failure", "uid"))
    train, test = split.filter("part = 'train'"), split.filter("part = 'test'")
    return prep.fit_preparation(train), train, test


def metrics_table(scored):
    counts = E.classification_report(E.confusion(scored, ["model"], F.col("p") >= 0.5, "label"))
    return counts.join(E.areas(E.curve_points(scored, ["model"], "p", "label"), ["model"]), "model")


@query("failure_classifiers")
def failure_classifiers(spark, sf):
    models = {k: v for k, v in L.classifiers().items() if k != "boosted_trees_weighted"}
    return metrics_table(L.train_and_score(machines(spark, sf), "uid", "machine_failure", models))


@query("boosted_trees_weighted")
def boosted_trees_weighted(spark, sf):
    models = {"boosted_trees_weighted": L.classifiers()["boosted_trees_weighted"]}
    return metrics_table(L.train_and_score(machines(spark, sf), "uid", "machine_failure", models))


def margin_scores(spark, sf):
    fitted, train, test = prepared_parts(spark, sf)
    ready = L.with_weights(L.model_input(train, fitted, "machine_failure", ["uid"]))
    held = L.model_input(test, fitted, "machine_failure", ["uid"])
    return L.margin_classifier(ready, held, "uid", len(fitted.feature_names))


@query("margin_classifier")
def margin_classifier(spark, sf):
    return metrics_table(margin_scores(spark, sf))


@query("model_comparison")
def model_comparison(spark, sf):
    """All eight models on the same held-out part, best recall first."""
    fitted, train, test = prepared_parts(spark, sf)
    votes = N.knn_classify(fitted.transform(test), fitted.transform(train), "uid", fitted.feature_names, "machine_failure")
    votes = votes.join(test.select(F.col("uid").alias("query_key"), F.col("machine_failure").cast("double").alias("label")), "query_key")
    votes = votes.select(F.col("query_key").alias("uid"), "label", F.lit("neighbours").alias("model"), F.col("vote_share").alias("p"))
    scored = L.train_and_score(machines(spark, sf), "uid", "machine_failure", L.classifiers()).unionByName(margin_scores(spark, sf)).unionByName(votes)
    return metrics_table(cut_lineage(scored)).orderBy(F.desc("recall"), "model")


def oof(spark, sf):
    return cut_lineage(L.out_of_fold(machines(spark, sf), "uid", "machine_failure", L.classifiers()))


@query("cross_validate")
def cross_validate(spark, sf):
    return E.cv_summary(E.fold_metrics(oof(spark, sf), "model", "fold", "p", "label"), "model")


MODEL_NAMES = ", ".join(f"('{name}')" for name in L.classifiers())


@query("oof_predict", FOLDS + f", f AS ({FOLD_ROWS}) SELECT uid, model, fold, TRUE AS scored FROM f, (VALUES {MODEL_NAMES}) AS m(model)")
def oof_predict(spark, sf):
    """Every row once per model, scored by the fit that did not see its fold."""
    return oof(spark, sf).select("uid", "model", "fold", F.col("p").between(0.0, 1.0).alias("scored"))


@query("locked_evaluation")
def locked_evaluation(spark, sf):
    """Thresholds chosen out of fold on the train part, then applied once to the test part."""
    return L.locked_evaluation(machines(spark, sf), "uid", "machine_failure", L.classifiers())


NEAREST = PREPARED + """, q AS (SELECT uid, [{x}] AS x FROM h WHERE part = 'test'), t AS (SELECT uid AS other, machine_failure AS y, [{x}] AS x FROM h WHERE part = 'train')
SELECT uid, round(list_avg(arg_min(y, {{'d': round(list_distance(q.x, t.x), 9), 'k': other}}, 7)), 6) AS vote_share FROM q, t GROUP BY uid""".format(
    x=", ".join(f"CAST({c} AS DOUBLE)" for c in (*FEATURES, "type_H", "type_L", "type_M")))


@query("knn_classify", NEAREST)
def knn_classify(spark, sf):
    fitted, train, test = prepared_parts(spark, sf)
    voted = N.knn_classify(fitted.transform(test), fitted.transform(train), "uid", fitted.feature_names, "machine_failure")
    return voted.select(F.col("query_key").alias("uid"), F.round("vote_share", 6).alias("vote_share"))


@query("isolation_forest")
def isolation_forest(spark, sf):
    fitted, train, test = prepared_parts(spark, sf)
    nodes = I.fit_isolation_forest(fitted.transform(train), "uid", fitted.feature_names)
    scored = I.score_isolation_forest(fitted.transform(test), nodes, fitted.feature_names)
    return scored.select("uid", F.round("isolation_score", 6).alias("isolation_score"), (F.col("isolation_score") > 0.5).alias("anomalous"))


@query("novelty_boundary", with_views("split") + """,
m AS (SELECT avg(torque) AS a, avg(tool_wear) AS b, var_pop(torque) AS va, var_pop(tool_wear) AS vb, covar_pop(torque, tool_wear) AS c FROM split WHERE part = 'train'),
d AS (SELECT uid, part, sqrt((vb*(torque-a)*(torque-a) - 2*c*(torque-a)*(tool_wear-b) + va*(tool_wear-b)*(tool_wear-b)) / (va*vb - c*c)) AS novelty FROM split, m)
SELECT uid, round(novelty, 6) AS novelty, novelty > (SELECT quantile_cont(novelty, 0.95) FROM d WHERE part = 'train') AS is_novel FROM d WHERE part = 'test'""")
def novelty_boundary(spark, sf):
    split = view(spark, sf, "split")
    scored = I.novelty_boundary(split.filter("part = 'train'"), split.filter("part = 'test'"), ["torque", "tool_wear"])
    return scored.select("uid", F.round("novelty", 6).alias("novelty"), "is_novel")


@query("one_class_boundary", with_views("split") + """SELECT part, count(*) AS n_rows, CASE WHEN part = 'train' THEN TRUE END AS share_kept FROM split GROUP BY part""")
def one_class_boundary(spark, sf):
    """Rows outside a one-class margin over all features: a twentieth of the train rows, by its exact offset."""
    fitted, train, test = prepared_parts(spark, sf)
    model = I.fit_one_class(fitted.transform(train), fitted.feature_names)
    marked = model.score(fitted.transform(train.unionByName(test)), fitted.feature_names).groupBy("part").agg(F.count("*").alias("n_rows"), F.count_if(F.col("margin") < 0).alias("outside"))
    return marked.select("part", "n_rows", F.when(F.col("part") == "train", F.abs(F.col("outside") / F.col("n_rows") - 0.05) < 0.002).alias("share_kept"))


SENSORS = [f"sensor_{k}" for k in range(1, 22)]
#: Cycles of a unit whose windows share a row: a reader holds some thousand rows at once, and 29 cycles of the block before are repeated.
PACKED = 250


def engines(spark, sf):
    """Labelled trajectories with the full set of 21 sensors: the two of the table, and mixtures of these and of the cycle."""
    # Labelling reads the trajectories three times, and ranks them anew each time unless they are written.
    rows = S.train_rul(cut_lineage(view(spark, sf, "trajectories")))
    mixed = [((F.col("sensor_1") * k + F.col("sensor_2") * (22 - k)) / 22 + F.pmod(F.col("cycle") * k, F.lit(11))).alias(f"sensor_{k}") for k in range(3, 22)]
    return rows.select("*", *mixed)


def engine_windows(spark, sf):
    """Windows of all sensors, those of a block in one row, with the part of their unit: a fifth of the units validate."""
    windows = S.sliding_windows(engines(spark, sf), SENSORS, position="cycle", block=PACKED, packed=True)
    return group_split(cut_lineage(windows), "unit_id")


@query("rul_regression")
def rul_regression(spark, sf):
    """Errors on the held-out units: trees and a line on window features, a reservoir on the windows themselves."""
    features = S.window_features(engines(spark, sf), SENSORS, position="cycle")
    predicted = L.rul_regression(features, [c for c in features.columns if c.startswith("sensor_")], L.rul_models())
    return E.forecast_errors(predicted.unionByName(reservoir_predictions(spark, sf)), ["model"], "predicted", "rul")


def reservoir_predictions(spark, sf):
    windows = engine_windows(spark, sf)
    model = Q.fit_sequence_model(windows.filter("part = 'train'"), len(SENSORS), size=S.WINDOW)
    held = model.predict(windows.filter("part = 'validation'"), ["unit_id", "end_cycle", "rul"], size=S.WINDOW)
    return held.withColumn("model", F.lit("reservoir")).select("unit_id", "end_cycle", F.col("rul").cast("int").alias("rul"), "model", "predicted")


@query("sequence_regression", GROUP_SPLIT + """, r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY cycle) AS place, least(max(cycle) OVER (PARTITION BY unit_id) - cycle, 125) AS rul FROM g)
SELECT unit_id, cycle AS end_cycle, CAST(rul AS INT) AS rul, TRUE AS known FROM r WHERE part = 'validation' AND place >= 30""")
def sequence_regression(spark, sf):
    """Every window of the held-out units has a prediction of the reservoir model."""
    return reservoir_predictions(spark, sf).select("unit_id", "end_cycle", "rul", (~F.isnan("predicted") & F.col("predicted").isNotNull()).alias("known"))


@query("reconstruction_error")
def reconstruction_error(spark, sf):
    """Residuals of the held-out units' windows against the components of the train units' healthy ones."""
    width = S.WINDOW * len(SENSORS)
    flat = S.unpacked(engine_windows(spark, sf)).select("unit_id", "end_cycle", "rul", "part", F.flatten("seq").alias("s"))
    wide = flat.select("unit_id", "end_cycle", "rul", "part", *[F.col("s")[i].cast("double").alias(f"v{i}") for i in range(width)])
    healthy = S.healthy_windows(wide.filter("part = 'train'"))
    scored = L.reconstruction_error(healthy, wide.filter("part = 'validation'"), [f"v{i}" for i in range(width)])
    return scored.select("unit_id", "end_cycle", "rul", F.round("reconstruction_error", 6).alias("reconstruction_error"))


def feature_vectors(spark, sf):
    """Train and test rows as vectors of the prepared features."""
    fitted, train, test = prepared_parts(spark, sf)
    keep = ["uid", "machine_failure", *fitted.feature_names]
    vectors = VectorAssembler(inputCols=fitted.feature_names, outputCol="features")
    return fitted.feature_names, *(cut_lineage(vectors.transform(fitted.transform(rows).select(*keep))) for rows in (train, test))


@query("kmeans_select")
def kmeans_select(spark, sf):
    _, train, _ = feature_vectors(spark, sf)
    table, _ = L.kmeans_select(train, restarts=10)
    return spark.createDataFrame(table, "k int, silhouette double, cost double")


@query("best_k")
def best_k(spark, sf):
    """The number of clusters of highest silhouette on the train rows, and the test rows in each."""
    _, train, test = feature_vectors(spark, sf)
    table, model = L.kmeans_select(train, restarts=10)
    chosen = max(table, key=lambda row: (row[1], -row[0]))[0]
    return model.transform(test).groupBy("prediction").agg(F.count("*").alias("n")).withColumn("k", F.lit(chosen))


@query("hierarchical_clusters")
def hierarchical_clusters(spark, sf):
    """Ward clusters of the train rows: their sizes, silhouette and agreement with the label."""
    names, train, _ = feature_vectors(spark, sf)
    found = cut_lineage(H.ward_clusters(train.select("uid", "machine_failure", *names), names, 3))
    agreement = E.adjusted_rand(found, "cluster", "machine_failure").first()[0]
    return found.groupBy("cluster").agg(F.count("*").alias("n")).withColumns({
        "silhouette": F.round(F.lit(E.silhouette(found, names, "cluster")), 6), "ari": F.lit(agreement)})


NEIGHBOURS = with_views("points") + ", nb AS (SELECT a.id, count(*) AS neighbours FROM points a JOIN points b ON b.x BETWEEN a.x - 0.8 AND a.x + 0.8 AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 0.8 GROUP BY a.id)\n"


@query("epsilon_pairs", NEIGHBOURS + "SELECT id, neighbours FROM nb")
def epsilon_pairs(spark, sf):
    """Neighbours within eps of every point, itself included, counted without listing pairs inside a cell."""
    points = view(spark, sf, "points")
    counts = C.epsilon_counts(points, ["x", "y"], 0.8).select("x", "neighbours").withColumnRenamed("x", "spot")
    return points.withColumn("spot", F.array("x", "y")).join(counts, "spot").select("id", "neighbours")


@query("dbscan", NEIGHBOURS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
core AS MATERIALIZED (SELECT p.* FROM points p JOIN nb USING (id) WHERE neighbours >= 10),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM core a JOIN core b ON b.x BETWEEN a.x - 0.8 AND a.x + 0.8 AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 0.8),
walk(id, label) AS (SELECT id, id FROM core UNION SELECT near.b, walk.label FROM walk JOIN near ON near.a = walk.id AND near.b > walk.label),
comp AS (SELECT id, min(label) AS label FROM walk GROUP BY id),
adj AS (SELECT p.id, min(comp.label) AS label FROM points p JOIN core c ON c.x BETWEEN p.x - 0.8 AND p.x + 0.8 AND sqrt((p.x-c.x)*(p.x-c.x) + (p.y-c.y)*(p.y-c.y)) <= 0.8 JOIN comp ON comp.id = c.id
  WHERE p.id NOT IN (SELECT id FROM core) GROUP BY p.id)
SELECT p.id, coalesce(comp.label, -1) AS cluster, CASE WHEN comp.id IS NOT NULL THEN 'core' WHEN adj.id IS NOT NULL THEN 'border' ELSE 'noise' END AS role
FROM points p LEFT JOIN comp ON comp.id = p.id LEFT JOIN adj ON adj.id = p.id""")
def dbscan(spark, sf):
    """Clusters named by their least core id; border points carry only their role, as several clusters may claim one."""
    found = C.dbscan(view(spark, sf, "points"), "id", ["x", "y"])
    least = found.filter("is_core").groupBy("cluster").agg(F.min("id").alias("least"))
    role = F.when(F.col("is_core"), "core").when(F.col("cluster") != str(C.NOISE), "border").otherwise("noise")
    return found.join(least, "cluster", "left").select(
        "id", F.when(F.col("is_core"), F.col("least")).otherwise(F.lit(C.NOISE)).cast("bigint").alias("cluster"), role.alias("role"))


@query("pca_projection")
def pca_projection(spark, sf):
    fitted, train, test = prepared_parts(spark, sf)
    projected = L.pca_projection(fitted.transform(train), fitted.transform(test), fitted.feature_names)
    return projected.select("uid", F.round("pc1", 4).alias("pc1"), F.round("pc2", 4).alias("pc2"))


def boosted(spark, sf):
    fitted, train, test = prepared_parts(spark, sf)
    ready = cut_lineage(L.model_input(train, fitted, "machine_failure", ["uid"]))
    (models,) = L.fit_all([ready], {"gradient_boosting": L.classifiers()["gradient_boosting"]}, "uid")
    return fitted, models["gradient_boosting"], L.model_input(test, fitted, "machine_failure", ["uid"])


@query("tree_attribution", with_views("split") + "SELECT uid, TRUE AS adds_up, CAST(10 AS BIGINT) AS features FROM split WHERE part = 'test'")
def tree_attribution(spark, sf):
    """Base and attributions of every test row add up to its margin."""
    fitted, model, held = boosted(spark, sf)
    values = A.tree_attribution(held, model, "uid", fitted.feature_names, scratch_path(spark, "model"))
    margin = model.score(held, ["uid"]).select("uid", F.log(F.col("p") / (1 - F.col("p"))).alias("margin"))
    total = values.groupBy("uid").agg((F.first("base") + F.sum("value")).alias("total"), F.count("*").alias("features"))
    return total.join(margin, "uid").select("uid", (F.abs(F.col("total") - F.col("margin")) < 1e-6).alias("adds_up"), "features")


@query("tree_importance")
def tree_importance(spark, sf):
    """Mean size of the attributions per feature, for the boosted model and for a single tree."""
    fitted, model, held = boosted(spark, sf)
    _, train, _ = prepared_parts(spark, sf)
    tree = L.classifiers()["decision_tree"]().fit(L.with_weights(L.model_input(train, fitted, "machine_failure", ["uid"])))
    found = A.union_models({name: A.tree_attribution(held, m, "uid", fitted.feature_names, scratch_path(spark, "model")) for name, m in (("gradient_boosting", model), ("decision_tree", tree))})
    return A.global_importance(cut_lineage(found))


@query("model_round_trip", with_views("split") + "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS different FROM split WHERE part = 'test'")
def model_round_trip(spark, sf):
    """Scores of a saved and reloaded model and preparation beside the originals: none may differ."""
    fitted, model, held = boosted(spark, sf)
    path = scratch_path(spark, "saved")
    model.save(spark, f"{path}/model")
    fitted.save(spark, f"{path}/preparation")
    again = prep.Preparation.load(spark, f"{path}/preparation")
    again.check_features(fitted.feature_names)
    _, _, test = prepared_parts(spark, sf)
    first = L.score(model, held, ["uid"], "saved").select("uid", F.col("p").alias("before"))
    second = L.score(B.BoostedModel.load(spark, f"{path}/model"), L.model_input(test, again, "machine_failure", ["uid"]), ["uid"], "loaded").select("uid", F.col("p").alias("after"))
    return first.join(second, "uid").agg(F.count("*").alias("rows"), F.count_if(F.col("before") != F.col("after")).alias("different"))


@query("risk_table_models")
def risk_table_models(spark, sf):
    """The risk table with fitted signals: forest anomaly score and boosted failure probability."""
    fitted, model, held = boosted(spark, sf)
    _, train, test = prepared_parts(spark, sf)
    chance = L.score(model, held, ["uid"], "gradient_boosting").select("uid", F.col("p").alias("failure_probability"))
    nodes = I.fit_isolation_forest(fitted.transform(train), "uid", fitted.feature_names)
    odd = I.score_isolation_forest(fitted.transform(test).select("uid", *fitted.feature_names), nodes, fitted.feature_names).select("uid", "isolation_score")
    path = scratch_path(spark, "signals")
    minmax_normalize(odd, "isolation_score", "anomaly_score").join(chance, "uid").write.parquet(path)
    return risk_table(spark.read.parquet(path)).drop("isolation_score")


@query("feature_gate", "SELECT '" + "|".join([*FEATURES, "type_H", "type_L", "type_M"]) + "' AS features FROM (SELECT count(*) FROM lineitem)")
def feature_gate(spark, sf):
    """Feature order a model must have been trained with."""
    fitted, _, test = prepared_parts(spark, sf)
    fitted.check_features([*FEATURES, "type_H", "type_L", "type_M"])
    return test.agg(F.lit("|".join(fitted.feature_names)).alias("features"))
