"""Edge rows, published arithmetic, and brute-force checks of the distributed operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwarden.functions import scoring as S
from millwarden.functions import text as T
from millwarden.operators import attribution as A
from millwarden.operators import clustering as C
from millwarden.operators import documents as D
from millwarden.operators import evaluation as E
from millwarden.operators import evidence as V
from millwarden.operators import isolation as I
from millwarden.operators import learning as L
from millwarden.operators import neighbours as N
from millwarden.operators import preparing as P
from millwarden.operators import profiling
from millwarden.operators import ranking as K
from millwarden.operators import risk as R
from millwarden.operators import series
from millwarden.operators import splitting
from millwarden.operators.quantiles import exact_quantiles
from millwarden.sources import readers
from millwarden.streaming import live, state


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first()


# Published arithmetic

def test_fusion_and_band_of_the_published_event(spark):
    row = one(frame(spark, [(0.999465, 0.901129)], "p double, a double").select(
        F.round(S.fuse_risk("p", "a"), 6).alias("r"), S.risk_band(S.fuse_risk("p", "a")).alias("b")))
    assert (row.r, row.b) == (0.960131, "Critical")


def test_structured_event_of_the_published_machine(spark):
    seen = frame(spark, [("4343", "M", 301.7, 309.8, 1284.0, 68.2, 111.0, 0, 1, 1, 0, 0, 1)],
                 "uid string, type string, air_temperature double, process_temperature double, rotational_speed double, torque double, tool_wear double, "
                 "twf int, hdf int, pwf int, osf int, rnf int, machine_failure int")
    scored = frame(spark, [("4343", 0.960131, 0.999465, 0.901129)], "uid string, unified_risk_score double, failure_probability double, anomaly_score double")
    event = json.loads(one(R.structured_events(scored, seen)).event)
    assert event["event_type"] == "heat_dissipation_failure"
    assert event["mechanical_power"] == 9170.183292
    assert event["temperature_differential"] == 8.1
    assert (event["HDF"], event["PWF"], event["actual_failure"]) == (1, 1, 1)


def test_event_without_sensor_leaves_the_field_out(spark):
    seen = frame(spark, [("1", None, "1", "x")], "uid string, torque double, hdf string, twf string")
    scored = frame(spark, [("1", 0.5, 0.5, 0.5)], "uid string, unified_risk_score double, failure_probability double, anomaly_score double")
    event = json.loads(one(R.structured_events(scored, seen)).event)
    assert "torque" not in event and event["event_type"] == "heat_dissipation_failure" and event["HDF"] == 1 and "TWF" not in event


@pytest.mark.parametrize("tn,fp,fn,tp,precision,recall,f1", [
    (1926, 6, 13, 55, 0.901639, 0.808824, 0.852713), (1928, 4, 17, 51, 0.927273, 0.75, 0.829268), (1925, 7, 14, 54, 0.885246, 0.794118, 0.837209),
    (1897, 35, 21, 47, 0.573171, 0.691176, 0.626667), (5, 0, 0, 0, 0.0, 0.0, 0.0)])
def test_confusion_rates(spark, tn, fp, fn, tp, precision, recall, f1):
    row = one(E.classification_report(frame(spark, [(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")))
    assert (row.precision, row.recall, row.f1) == (precision, recall, f1)


# Quantiles, ranks, splits

def test_quantiles_match_numpy_with_narrowing(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25), rng.exponential(size=1000) * 1e6])
    df = frame(spark, [(float(v), int(i % 2)) for i, v in enumerate(values)], "v double, g int")
    probs = [0.0, 0.05, 0.25, 0.5, 0.705, 0.95, 1.0]
    whole = exact_quantiles(df, ["v"], probs)[("v",)]
    narrowed = exact_quantiles(df, ["v"], probs, accuracy=50, listed=40)[("v",)]
    for p in probs:
        assert whole[p] == pytest.approx(np.quantile(values, p), rel=1e-12)
        assert narrowed[p] == pytest.approx(np.quantile(values, p), rel=1e-12)
    groups = exact_quantiles(df, ["v"], [0.5], by=["g"])
    for g in (0, 1):
        assert groups[(g, "v")][0.5] == pytest.approx(np.quantile(values[np.arange(len(values)) % 2 == g], 0.5))


def test_quantiles_of_a_heavy_value_end(spark):
    """Half of the rows are one value in the middle: passes stay few and the values exact."""
    values = np.concatenate([np.full(20_000, 0.5), np.linspace(0, 1, 20_000)])
    df = spark.createDataFrame(np.random.default_rng(3).permutation(values).reshape(-1, 1).tolist(), "v double")
    for options in ({"listed": 200}, {"accuracy": 50, "listed": 2}):
        got = exact_quantiles(df, ["v"], (0.25, 0.5, 0.75, 0.2501, 0.7499), **options)[("v",)]
        for p, found in got.items():
            assert found == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantile_passes_stay_few(spark, monkeypatch):
    """A continuous column, one of few values and one of both signs are settled by two passes of bins and one that lists what is left."""
    from millwarden.operators import quantiles

    rng = np.random.default_rng(6)
    data = np.stack([rng.normal(1600, 200, 30_000), rng.integers(0, 9, 30_000), rng.normal(size=30_000) ** 3], axis=1)
    passes, counts = [], quantiles._counts
    monkeypatch.setattr(quantiles, "_counts", lambda *a: passes.append(a[2]) or counts(*a))
    got = exact_quantiles(spark.createDataFrame(data.tolist(), "a double, b double, c double"), ["a", "b", "c"], (0.25, 0.75), accuracy=3000, listed=2000)
    assert len(passes) <= 3
    for k, name in enumerate("abc"):
        for p, found in got[(name,)].items():
            assert found == pytest.approx(np.quantile(data[:, k], p), rel=1e-12)


def test_machine_ids_from_ten_million_up(spark):
    df = frame(spark, [(10_000_000.0,), (12_345_678.0,), (7.0,), (7.5,), (None,)], "c double")
    assert [r[0] for r in df.select(R.machine_id_text("c")).collect()] == ["10000000", "12345678", "7", "7.5", None]
    assert frame(spark, [("007.0",)], "c string").select(R.machine_id_text("c")).first()[0] == "007"


def test_unreadable_labels(spark):
    df = frame(spark, [("NaN",), ("1e300",), ("1.0",), ("x",)], "label string")
    assert [r[0] for r in R.coerce_numeric(df, [], "label").collect()] == [0, 0, 1, 0]


def test_windows_across_missing_cycles(spark):
    cycles = [c for c in range(1, 1101) if c not in (980, 985)]
    df = frame(spark, [(1, c, float(c), c) for c in cycles], "unit_id int, cycle int, s double, rul int")
    ends = [r.end_cycle for r in series.sliding_windows(df, ["s"]).orderBy("end_cycle").collect()]
    assert ends == cycles[29:]


def test_preparation_is_loaded_as_it_was_saved(spark, tmp_path):
    df = frame(spark, [(float(i), float(i % 7), "HL"[i % 2]) for i in range(40)], "vibration double, torque double, type string")
    fitted = P.fit_preparation(df, ["vibration", "torque"])
    fitted.save(spark, str(tmp_path))
    again = P.Preparation.load(spark, str(tmp_path))
    assert again.feature_names == fitted.feature_names == ["vibration", "torque", "type_H", "type_L"]
    assert again.transform(df).exceptAll(fitted.transform(df)).isEmpty()


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from millwarden.session import shared_folder

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_quantiles_skip_nulls_and_take_single_rows(spark):
    df = frame(spark, [(None,), (3.0,)], "v double")
    assert exact_quantiles(df, ["v"], [0.3])[("v",)][0.3] == 3.0


def test_ranks_with_ties_nulls_and_hot_values(spark):
    scores = [0.5] * 500 + [0.9, 0.9, 0.1, None] + [i / 1000 for i in range(200)]
    df = frame(spark, [(i, s) for i, s in enumerate(scores)], "id int, s double")
    for limit in (200_000, 0):
        got = {r.id: r.k for r in K.competition_ranks(df, {"s": "k"}, broadcast_values=limit).collect()}
        for i, s in enumerate(scores):
            assert got[i] == (None if s is None else 1 + sum(1 for x in scores if x is not None and x > s))


def test_grouped_positions_of_a_hot_group(spark):
    df = frame(spark, [(0 if i % 3 else i % 5, float(i * 7 % 1000), i) for i in range(900)], "g int, t double, i int")
    rows = K.grouped_positions(df, "g", "t", ["t", "i"], "pos", ranges=8).collect()
    for g in {r.g for r in rows}:
        ordered = sorted((r for r in rows if r.g == g), key=lambda r: (r.t, r.i))
        assert [r.pos for r in ordered] == list(range(1, len(ordered) + 1))


def test_split_and_folds_partition_evenly(spark):
    df = frame(spark, [(f"k{i}", int(i % 23 == 0)) for i in range(1000)], "k string, y int")
    parts = {(r.y, r.part): r["count"] for r in splitting.stratified_split(df, "y", "k").groupBy("y", "part").count().collect()}
    assert parts[(1, "train")] == int(0.8 * 44) and parts[(0, "train")] == int(0.8 * 956)
    counts = splitting.stratified_folds(df, "y", "k").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r.y == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_hash_cut_descends_when_few_rows_may_be_listed(spark):
    df = frame(spark, [(f"k{i}", 0) for i in range(3000)], "k string, y int")
    shallow = splitting.hash_cuts(df, "y", "k", [splitting.Decimal("0.3")])
    deep = splitting.hash_cuts(df, "y", "k", [splitting.Decimal("0.3")], listed=1)
    assert shallow == deep


# Profile and preparation

def test_quantile_bins_drop_repeated_edges(spark):
    df = frame(spark, [(1.0, 0)] * 90 + [(float(i), 1) for i in range(2, 12)], "v double, y int")
    rows = profiling.quantile_bins(df, ["v"], "y").collect()
    assert sum(r.n for r in rows) == 100 and len(rows) == 2


def test_constant_and_degenerate_scales(spark):
    df = frame(spark, [(2.0,), (2.0,)], "v double")
    assert {r.z for r in R.minmax_normalize(df, "v", "z").collect()} == {0.0}
    assert {r.z for r in R.reference_normalize(df, "v", "z", (1.0, 1.0)).collect()} == {0.0}
    moments = P.scaler_moments(df, ["v"])
    assert {r.v for r in P.standardize(df, moments).collect()} == {0.0}


def test_unknown_category_is_all_zero(spark):
    row = one(P.one_hot(frame(spark, [("X",)], "type string"), "type", ["H", "L"]))
    assert (row.type_H, row.type_L) == (0, 0)


def test_null_score_has_no_band(spark):
    rows = frame(spark, [(None,), (0.25,), (0.75,), (0.4999,)], "s double").select(S.risk_band("s").alias("b")).collect()
    assert [r.b for r in rows] == [None, "Medium", "Critical", "Medium"]


def test_feature_gate_refuses_other_order(spark):
    fitted = P.Preparation({"a": (0, 1, 0, 1), "b": (0, 1, 0, 1)}, {"a": (0, 1), "b": (0, 1)}, "type", ["H"])
    with pytest.raises(ValueError):
        fitted.check_features(["b", "a", "type_H"])


def test_missing_threshold_and_columns_raise(spark):
    with pytest.raises(ValueError):
        R.attach_thresholds(frame(spark, [("m",)], "model string"), frame(spark, [("n", 0.5)], "model string, threshold double"))
    with pytest.raises(ValueError):
        readers.contract_report(frame(spark, [(1,)], "a int"), {"b": "int"})
    with pytest.raises(ValueError):
        readers.contract_check(frame(spark, [("x",)], "a string"), {"a": "int"})


# Metrics

def test_auc_of_constant_score_and_of_one_class(spark):
    df = frame(spark, [("m", 0.5, i % 2) for i in range(10)] + [("n", 0.1 * i, 1) for i in range(5)], "model string, p double, y int")
    got = {r.model: r for r in E.areas(E.curve_points(df, ["model"], "p", "y"), ["model"]).collect()}
    assert got["m"].roc_auc == 0.5 and got["n"].roc_auc is None and got["n"].average_precision == 1.0


def test_rand_index_of_equal_labels(spark):
    df = frame(spark, [(i % 3, i % 3) for i in range(30)], "a int, b int")
    assert one(E.adjusted_rand(df, "a", "b")).ari == 1.0


def test_no_threshold_keeps_recall_then_null(spark):
    df = frame(spark, [("m", 0.01, 1), ("m", 0.99, 0)], "model string, p double, y int")
    assert one(E.best_threshold(E.threshold_sweep(df, ["model"], "p", "y"), ["model"])).high_recall_threshold is None


def test_silhouette_needs_two_clusters(spark):
    assert E.silhouette(frame(spark, [(1.0, 0), (2.0, 0), (9.0, -1)], "x double, c int"), ["x"], "c") is None


# Series

def test_windows_across_blocks_equal_whole_windows(spark):
    df = frame(spark, [(1, c, float(c), 10) for c in range(1, 101)] + [(2, c, 0.0, 10) for c in range(1, 30)], "unit_id int, cycle int, v double, rul int")
    rows = series.sliding_windows(df, ["v"], block=31).collect()
    assert len(rows) == 71 and {r.unit_id for r in rows} == {1}
    for r in rows:
        assert [x[0] for x in r.seq] == [float(c) for c in range(r.end_cycle - 29, r.end_cycle + 1)]
    slopes = series.window_features(df, ["v"], block=40).collect()
    assert len(slopes) == 71 and all(abs(r.v_slope - 1.0) < 1e-9 for r in slopes)


def test_label_mismatch_raises(spark):
    units = frame(spark, [(1, 1), (2, 1)], "unit_id int, cycle int")
    with pytest.raises(ValueError):
        series.test_rul(units, frame(spark, [(1, 5)], "unit_id int, rul int"))


# Documents and evidence

def python_chunks(text, size=1200, overlap=200):
    """Independent statement of the rule: windows every size - overlap characters up to the first that reaches the end."""
    if len(text) <= size:
        return [text]
    last = math.ceil((len(text) - size) / (size - overlap))
    return [c for c in (text[i * (size - overlap):i * (size - overlap) + size].strip() for i in range(last + 1)) if c]


@pytest.mark.parametrize("text", ["", "a", "é" * 1200, "b" * 1201, "c" * 2200, "d" * 2201, "\n\t x" + " " * 1300 + "y　\n", "w " * 3000, " " * 1200 + "tail" * 400])
def test_chunks(spark, text):
    got = one(frame(spark, [(text,)], "t string").select(T.chunks("t").alias("c"))).c
    assert got == python_chunks(text)


def test_report_sections_bare_marked_and_absent(spark):
    report = "FACTS\nfirst\nline\n## RECOMMENDED ACTIONS\n\nact\nLimitations\nnone"
    row = one(frame(spark, [(report,)], "r string").select(
        T.report_section("r", "FACTS").alias("f"), T.report_section("r", "RECOMMENDED ACTIONS").alias("a"),
        T.report_section("r", "LIMITATIONS").alias("l"), T.report_section("r", "EVIDENCE SOURCES").alias("e")))
    assert (row.f, row.a, row.l, row.e) == ("first\nline", "act", "none", "")


def test_grounding_of_an_unsupported_question(spark):
    rows = [("Records hold no such evidence.", False), ("It does not include that.", False), ("Sure.", False), ("The retrieved evidence is insufficient to answer this safely.", True)]
    df = frame(spark, rows, "answer string, expected boolean").withColumn("ids", F.array().cast("array<string>"))
    got = [r.insufficient_behavior_correct for r in D.grounding_checks(df, "answer", "ids", "expected").collect()]
    assert got == [True, True, False, False]


CORPUS = "vec_id int, embedding array<float>, event_type string, severity string, document_type string, evidence_type string, incident_id string, procedure_id string, source string, text string, is_synthetic boolean"


def corpus(spark, incidents, procedures):
    def unit(i):
        v = np.array([math.cos(i), math.sin(i)])
        return [float(x) for x in v]
    rows = [(i, unit(0.01 * i), "e", "High", "synthetic_incident", "incident", f"INC-{i // 2:04d}", None, f"s{i // 2}", "text", True) for i in range(incidents)]
    rows += [(100 + i, unit(0.02 * i), None, None, "safety_procedure", "procedure", None, f"FSP-SOP-{i:03d}", f"p{i}", "pressure relief", True) for i in range(procedures)]
    return frame(spark, rows, CORPUS)


def ask(spark):
    return frame(spark, [("q", [1.0, 0.0], "unknown_event", None)], "query_id string, vector array<double>, event_type string, severity string")


def test_unknown_event_takes_the_fallback(spark):
    rows = V.incident_evidence(corpus(spark, 12, 5), ask(spark), 6).orderBy("final_rank").collect()
    assert [r.retrieval_role for r in rows].count("incident") == 3 and len(rows) == 6
    assert len({r.incident_id for r in rows if r.incident_id}) == 3
    assert [r.distance for r in rows] == sorted(r.distance for r in rows)


def test_one_class_only_and_no_hits(spark):
    only = V.incident_evidence(corpus(spark, 0, 9), ask(spark), 6).collect()
    assert len(only) == 6 and {r.retrieval_role for r in only} == {"procedure"}
    none = V.incident_evidence(corpus(spark, 0, 0), ask(spark), 6)
    assert one(V.format_evidence(none, ask(spark), "final_rank")).evidence_text == T.NO_EVIDENCE


def test_k_larger_than_corpus_and_below_one(spark):
    assert V.similarity_topk(corpus(spark, 3, 0), ask(spark), 50).count() == 3
    with pytest.raises(ValueError):
        V.similarity_topk(corpus(spark, 3, 0), ask(spark), 0)


# Models

def blobs(n, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    x = rng.normal(size=(n, 3)) + y[:, None] * 1.5
    x[: n // 3] = x[0]
    return x, y.astype(int)


def test_neighbour_join_equals_brute_force(spark):
    x, y = blobs(500)
    df = frame(spark, [(f"k{i:04d}", *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "k string, a double, b double, c double, y int")
    got = {}
    for r in N.knn_join(df, df, "k", ["a", "b", "c"], 7, "y", cell_rows=30, block=60).collect():
        got.setdefault(r.query_key, {})[r["rank"]] = r.train_key
    for i in range(len(x)):
        near = np.lexsort((np.arange(len(x)), np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)))[:7]
        assert [got[f"k{i:04d}"][j + 1] for j in range(7)] == [f"k{j:04d}" for j in near]


@pytest.mark.parametrize("width", [2, 3, 10])
def test_dbscan_equals_brute_force(spark, width):
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.normal(0, 0.5, (150, width)), rng.normal(3, 0.7, (120, width)), rng.uniform(-3, 7, (80, width)), np.ones((100, width)) * 5])
    names = [f"x{k}" for k in range(width)]
    df = frame(spark, [(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names))
    eps = 0.5 if width < 10 else 2.0
    got = {r.id: r for r in C.dbscan(df, "id", names, eps, 8, cell_rows=25).collect()}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= 8
    label, n = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], n
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[j] = n
                    stack.append(j)
            n += 1
    assert [got[i].is_core for i in range(len(x))] == list(core)
    names_of = {(label[i], got[i].cluster) for i in np.flatnonzero(core)}
    assert len(names_of) == n == len({a for a, _ in names_of}) == len({b for _, b in names_of})
    noise = ~core & ~(near & core[None]).any(1)
    assert [got[i].cluster == "-1" for i in range(len(x))] == list(noise)


def test_isolation_forest_finds_a_planted_outlier(spark):
    rng = np.random.default_rng(0)
    rows = [(f"k{i}", *map(float, rng.normal(size=2))) for i in range(400)] + [("far", 9.0, -9.0)]
    df = frame(spark, rows, "k string, a double, b double")
    nodes = I.fit_isolation_forest(df, "k", ["a", "b"], trees=40, sample=64)
    top = I.score_isolation_forest(df, nodes, ["a", "b"], sample=64).orderBy(F.desc("isolation_score")).first()
    assert top.k == "far" and 0.5 < top.isolation_score < 1.0


@pytest.mark.parametrize("name", ["gradient_boosting", "random_forest", "decision_tree"])
def test_tree_attribution_adds_up(spark, tmp_path, name):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x, y = blobs(400)
    df = frame(spark, [(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y))], "k int, a double, b double, c double, label double")
    ready = L.with_weights(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df))
    model = L.fit_all([ready], {name: L.classifiers(trees=5, rounds=4)[name]}, "k")[0][name]
    values = A.tree_attribution(ready, model, "k", ["a", "b", "c"], str(tmp_path / "m"))
    total = values.groupBy("k").agg((F.first("base") + F.sum("value")).alias("t"))
    if name == "gradient_boosting":
        margin = F.log(F.col("p") / (1 - F.col("p")))
        scored = model.score(ready, ["k"]).select("k", margin.alias("m"))
    else:
        scored = model.transform(ready).select("k", vector_to_array("probability")[1].alias("m"))
    gap = scored.join(total, "k").agg(F.max(F.abs(F.col("m") - F.col("t")))).first()[0]
    assert gap < 1e-6


def test_reconstruction_error_is_small_on_healthy_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 5))
    rows = [(i, 0, *map(float, r)) for i, r in enumerate(base)] + [(1000 + i, 1, *map(float, rng.normal(size=5) * 3)) for i in range(50)]
    df = frame(spark, rows, "k int, bad int, " + ", ".join(f"v{i} double" for i in range(5)))
    got = {r.bad: r.e for r in L.reconstruction_error(df.filter("bad = 0"), df, [f"v{i}" for i in range(5)], 2).groupBy("bad").agg(F.avg("reconstruction_error").alias("e")).collect()}
    assert got[0] < 1e-9 < got[1]


# Sources and streams

def test_numbered_lines_follow_file_order(spark, tmp_path):
    for name, part in (("a.txt", range(0, 5)), ("b.txt", range(5, 9))):
        (tmp_path / name).write_text("\n".join(str(v) for v in part) + "\n")
    rows = readers.read_numbered_lines(spark, str(tmp_path)).collect()
    assert sorted((r.position, r.value) for r in rows) == [(i + 1, str(i)) for i in range(9)]


def test_strict_event_read_raises(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"machine_id": "1"}\n')
    schema = "machine_id string, event_type string, risk_score double, risk_band string"
    with pytest.raises(ValueError):
        readers.read_events(spark, str(tmp_path), schema)
    assert readers.read_events(spark, str(tmp_path), schema, strict=False).count() == 1


def test_stream_of_two_files_keeps_the_latest(spark, tmp_path):
    stamp = F.to_timestamp
    first = frame(spark, [("M", "2024-01-01 00:00:00", 1), ("N", "2024-01-01 00:00:00", 2)], "machine_id string, t string, event_id long")
    second = frame(spark, [("M", "2024-01-02 00:00:00", 4), ("M", "2024-01-02 00:00:00", 3)], "machine_id string, t string, event_id long")
    source = str(tmp_path / "in")
    for part in (first, second):
        part.select("machine_id", stamp("t").alias("ts"), "event_id").coalesce(1).write.mode("append").parquet(source)
    stream = state.latest_readings(live.read_stream(spark, source, "machine_id string, ts timestamp, event_id long", files_per_batch=1))
    state.keep_table(stream, str(tmp_path / "out"), str(tmp_path / "progress"), ["machine_id"], ["ts", "event_id"])
    got = {r.machine_id: r.event_id for r in state.kept_table(spark, str(tmp_path / "out"), stream.schema).collect()}
    assert got == {"M": 4, "N": 2}
