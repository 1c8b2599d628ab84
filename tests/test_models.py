"""Ward on summaries, the one-class margin and the reservoir against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwarden.operators import hierarchy as H
from millwarden.operators import isolation as I
from millwarden.operators import learning as L
from millwarden.operators import profiling as P
from millwarden.operators import sequences as Q
from millwarden.operators import series as S


def frame(spark, x, names="abcdefghij"):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k int, " + ", ".join(f"{n} double" for n in names[: x.shape[1]]))


def plain_ward(x, k):
    """Join the two clusters whose joining raises the squared error least, until k are left."""
    clusters = [[i] for i in range(len(x))]

    def cost(a, b):
        return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()

    while len(clusters) > k:
        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters[:i]))
        clusters[j] += clusters.pop(i)
    return {frozenset(c) for c in clusters}


def groups(labels):
    found = {}
    for k, c in labels:
        found.setdefault(c, set()).add(k)
    return {frozenset(v) for v in found.values()}


@pytest.mark.parametrize("k", [2, 3, 5])
def test_ward_of_single_rows_is_exact(spark, k):
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(c, 1.0, (20, 4)) for c in (0, 2.5, 5)])
    got = H.ward_clusters(frame(spark, x), ["a", "b", "c", "d"], k).collect()
    assert groups((r.k, r.cluster) for r in got) == plain_ward(x, k)


def test_ward_of_summaries_finds_separate_groups(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (500, 3)) for c in (0, 4, 8)])
    got = H.ward_clusters(frame(spark, x), ["a", "b", "c"], 3, summaries=40).collect()
    assert groups((r.k, r.cluster) for r in got) == {frozenset(range(s, s + 500)) for s in (0, 500, 1000)}
    assert H.ward_clusters(frame(spark, x).limit(0), ["a", "b", "c"], 3).count() == 0
    same = H.ward_clusters(frame(spark, np.ones((10, 2))), ["a", "b"], 3).collect()
    assert {r.cluster for r in same} == {0} and len(same) == 10


def test_one_class_margin_follows_a_ring(spark):
    rng = np.random.default_rng(2)
    angle = rng.uniform(0, 2 * np.pi, 1500)
    ring = np.stack([np.cos(angle), np.sin(angle)], axis=1) * rng.normal(3, 0.15, (1500, 1))
    train = frame(spark, ring).repartition(5)
    model = I.fit_one_class(train, ["a", "b"], gamma=1.0)
    inside = model.score(train, ["a", "b"]).agg(F.avg((F.col("margin") < 0).cast("int"))).first()[0]
    assert abs(inside - 0.05) < 0.002
    spots = frame(spark, np.array([[0.0, 0.0], [3.0, 0.0], [0.0, -3.0], [6.0, 6.0]]))
    novel = [r.margin < 0 for r in model.score(spots, ["a", "b"]).orderBy("k").collect()]
    assert novel == [True, False, False, True]
    # The ellipse around the ring holds its centre.
    ellipse = I.novelty_boundary(train, spots, ["a", "b"]).orderBy("k").collect()
    assert not ellipse[0].is_novel


def test_one_class_direction_is_near_the_shortest(spark):
    """Against many plain steps towards the best mean on all rows."""
    x = np.random.default_rng(3).normal(size=(400, 3))
    model = I.fit_one_class(frame(spark, x), ["a", "b", "c"], nu=0.2, outputs=32)
    lifted, n = model.lifted(x), 80
    direction = lifted.mean(0)
    for _ in range(3000):
        target = lifted[np.argsort(lifted @ direction)[:n]].mean(0)
        step = direction - target
        direction = direction - np.clip(direction @ step / max(1e-15, step @ step), 0, 1) * step
    assert abs((model.direction**2).sum() - (direction**2).sum()) < 0.05 * (direction**2).sum()


def windows(spark, n=120, cycles=6, width=3):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, cycles, width)).cumsum(1)
    y = x[:, -1, 0] * 2 - x[:, 2, 1] + 10
    rows = [(k, [[float(v) for v in r] for r in w], float(t)) for k, (w, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "k int, seq array<array<float>>, rul double").repartition(4)


def test_reservoir_equals_a_plain_loop(spark):
    x, y, table = windows(spark)
    model = Q.fit_sequence_model(table, 3, states=20)
    r = model.reservoir
    x = x.astype("float32").astype("float64")
    inputs = []
    for w in x:
        state = np.zeros(20)
        for row in w:
            z = (row - r.mean) / r.scale
            state = (1 - r.leak) * state + r.leak * np.tanh(z @ r.inward + state @ r.inner)
        inputs.append(np.concatenate([[1.0], z, state]))
    inputs = np.array(inputs)
    assert np.allclose(r.states(x), inputs)
    penalty = 1e-3 * len(x) * np.eye(24)
    penalty[0, 0] = 0
    weights = np.linalg.solve(inputs.T @ inputs + penalty, inputs.T @ y)
    assert np.allclose(model.weights, weights, atol=1e-6)
    got = {row.k: row.predicted for row in model.predict(table, ["k"]).collect()}
    assert np.allclose([got[k] for k in range(len(x))], inputs @ weights, atol=1e-5)
    assert ((inputs @ weights - y) ** 2).mean() < 0.3 * y.var()


def series_rows(spark, lengths=(4, 5, 6, 40, 67), gap=(3, 21)):
    """Units of these lengths, one with a missing cycle, some with null readings or labels."""
    rng = np.random.default_rng(11)
    rows = [(u, c, float(rng.normal()), None if (u, c) == (4, 9) else float(c + u), None if (u, c) == (3, 12) else float(n - c))
            for u, n in enumerate(lengths) for c in range(1, n + 1) if (u, c) != gap]
    return spark.createDataFrame(rows, "unit_id int, cycle int, a double, b double, rul double").repartition(5)


@pytest.mark.parametrize("position", [None, "cycle"])
@pytest.mark.parametrize("block", [6, 20, 1000])
def test_packed_windows_are_the_windows(spark, position, block):
    """Blocks of many windows give the same windows as a row each, and hold a reading once and those of the lead twice."""
    rows = series_rows(spark)
    plain = S.sliding_windows(rows, ["a", "b"], 5, block=block, position=position)
    packed = S.sliding_windows(rows, ["a", "b"], 5, block=block, position=position, packed=True)
    same = S.unpacked(packed, 5).select(plain.columns)
    assert same.schema.simpleString() == plain.schema.simpleString()
    found = sorted(map(repr, same.collect()))
    assert found and found == sorted(map(repr, plain.collect()))
    held = sum(len(r.seq) for r in packed.collect())
    assert held <= rows.count() * (1 + 4 / block)


def test_sequence_model_of_packed_windows_is_that_of_single_ones(spark):
    rows = series_rows(spark).na.fill(0.0)
    plain = S.sliding_windows(rows, ["a", "b"], 5, block=20)
    packed = S.sliding_windows(rows, ["a", "b"], 5, block=20, packed=True)
    one, many = Q.fit_sequence_model(plain, 2, states=16), Q.fit_sequence_model(packed, 2, states=16, size=5)
    assert np.allclose(one.weights, many.weights, atol=1e-8)
    keep = ["unit_id", "end_cycle", "rul"]
    wanted = {(r.unit_id, r.end_cycle): (r.rul, r.predicted) for r in one.predict(plain, keep).collect()}
    got = many.predict(packed, keep, size=5).collect()
    assert len(got) == len(wanted) == plain.count()
    assert all(wanted[r.unit_id, r.end_cycle][0] == r.rul and abs(wanted[r.unit_id, r.end_cycle][1] - r.predicted) < 1e-6 for r in got)


def test_reservoir_in_parts_equals_a_plain_loop(monkeypatch):
    """Windows that share rows, some at a time, with readings far out, missing and equal."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(60, 3)) * 30
    rows[7] = 1e6
    rows[50, 1] = np.nan
    rows[20:30] = 0.0
    r = Q.Reservoir.drawn(np.array([0.1, 0.0, -0.2]), np.array([1.0, 2.0, 0.5]), 24)
    starts = np.array([0, 1, 2, 9, 10, 21, 40, 41, 52])
    monkeypatch.setattr(Q, "SOME", 4)
    got = np.concatenate(list(r.inputs(rows, starts, 8)))
    for at, line in zip(starts, got):
        state = np.zeros(24)
        for z in (rows[at : at + 8] - r.mean) / r.scale:
            state = (1 - r.leak) * state + r.leak * np.tanh(z @ r.inward + state @ r.inner)
        assert np.allclose(line, np.concatenate([[1.0], z, state]), atol=1e-9, equal_nan=True)
    assert r.states(np.zeros((0, 8, 3))).shape == (0, 28)


def test_engine_windows_hold_a_reading_once(spark, tmp_path):
    """What is written for the windows grows with the rows, not with thirty times the rows."""
    from millwarden.plans import model_queries as M

    rows = [(1000 * u + k, 60 * k, u, f"kind{k % 3}", float((k * 7 + u) % 31), '{"k": %d}' % (k % 90)) for u in range(10) for k in range(30 + u)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    events.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    held = sum(len(r.seq) for r in M.engine_windows(spark, str(tmp_path)).collect())
    assert held == len(rows)
    got = M.sequence_regression(spark, str(tmp_path)).collect()
    units = {r.unit_id for r in got}
    assert len(units) == 2 and all(r.known for r in got)
    assert sorted((r.unit_id, r.end_cycle, r.rul) for r in got) == sorted((u, c, 30 + u - c) for u in units for c in range(30, 31 + u))


@pytest.mark.parametrize("n", [40, 3000])
def test_density_equals_the_kernel_sum(spark, n):
    x = np.random.default_rng(n).gamma(2.0, 3.0, n)
    table = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    h = x.std(ddof=1) * n ** (-0.2)
    for r in P.density_curve(table, "v").collect():
        at = x.min() + r.point * (x.max() - x.min()) / 99
        want = np.exp(-0.5 * ((at - x) / h) ** 2).sum() / (n * h * np.sqrt(2 * np.pi))
        assert abs(r.density - want) < 1e-6


def test_one_class_cosines_equal_the_library(spark):
    """Whole blocks of cosines at once give the features that the library's cosine gives."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=5000) * 20
    assert np.abs(I.cosine(x / (2 * np.pi)) - np.cos(x)).max() < 2e-14
    assert I.cosine(np.array([0.0, 0.25, 0.5, -1.0])).tolist() == [1.0, 0.0, -1.0, 1.0]
    model = I.OneClass(rng.normal(size=(3, 16)), rng.uniform(0, 6, 16), np.zeros(16))
    data = rng.normal(size=(I.LIFTED * 2 + 3, 3))
    assert np.allclose(model.lifted(data), np.sqrt(2 / 16) * np.cos(data @ model.weights + model.phase), rtol=0, atol=1e-14)
    assert model.lifted(data[:0]).shape == (0, 16)


def test_margin_classifier_keeps_only_the_features_as_they_came(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    rows = spark.createDataFrame([(str(k), float(v[0] > 0), 1.0, [float(a) for a in v]) for k, v in enumerate(x)], "uid string, label double, weight double, x array<double>")
    rows = rows.withColumn("features", array_to_vector("x")).drop("x")
    kept = []
    real = type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda self, *at: kept.append(len(self.first()["features"])) or real(self, *at))
    scored = L.margin_classifier(rows, rows, "uid", 3, outputs=16, calibration=2, iterations=5).collect()
    assert kept == [3] and len(scored) == 60
