"""Density clustering (DBSCAN) in many dimensions, exact.

Points lie in cells of recursive median cuts; a cell's box is told apart on every axis.  A point looks only into the cells whose
boxes come within eps of it, and a box wholly within eps counts at once, without its points.  Core points of a cell no wider
than eps are neighbours of one another; such cells are joined by their boxes first, so that dense regions are settled
without comparing points, and only pairs between what is still apart are compared.  Tasks send on links between components
there, never pairs.  Copies of a point are one weighted point.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwarden.operators.ranking import join_per_value
from millwarden.operators.space import AT_ONCE, Space, as_points, cut_space, few_at_once, measured, meet, with_cells
from millwarden.session import cut_lineage

NOISE = -1
#: Rows wanted in a cell: fewer than for a neighbour search, as boxes are to be small beside eps.
CELL_ROWS = 500
#: What rounding may hide at a distance of eps.
LESS, MORE = 1 - 1e-12, 1 + 1e-12


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of b lie within eps of each row of a."""
    near = np.empty((len(a), len(b)), dtype=bool)
    step = max(1, AT_ONCE // max(1, len(b)))
    for at in range(0, len(a), step):
        square = np.zeros((len(a[at : at + step]), len(b)))
        for k in range(a.shape[1]):
            gap = a[at : at + step, k, None] - b[None, :, k]
            square += gap * gap
        near[at : at + step] = np.sqrt(square) <= eps
    return near


def _weighted_points(df: DataFrame, features: Sequence[str], cell_rows: int) -> tuple[DataFrame, Space]:
    """Distinct points (spot, x, w, cell), written, and the space they lie in."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    spot = F.md5(F.concat_ws(",", *[F.col(f).cast("double").cast("string") for f in features]))
    points = cut_lineage(df.dropna(subset=list(features)).select(spot.alias("spot"), x.alias("x")).groupBy("spot").agg(F.first("x").alias("x"), F.count("*").alias("w")))
    space = cut_space(points, len(features), cell_rows=cell_rows)
    placed = cut_lineage(with_cells(points, space))
    return placed, measured(space, placed)


def _cell_weights(points: DataFrame, space: Space) -> np.ndarray:
    weights = np.zeros(len(space.sizes), dtype=np.int64)
    for r in points.groupBy("cell").agg(F.sum("w").alias("w")).collect():
        weights[r["cell"]] = r["w"]
    return weights


def _visits(points: DataFrame, space: Space, eps: float, settled: np.ndarray) -> DataFrame:
    """A row (spot, x, cell) for each cell that a point must look into, and one of no cell with the ``sure`` weight of the boxes wholly within eps.

    ``settled`` is the weight of each cell, or nothing where boxes settle nothing.
    """
    width = space.low.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_once(batches, len(space.sizes)):
            x = as_points(batch.column(1), width)
            near, whole = space.gaps(x) <= eps * MORE, space.spans(x) <= eps * LESS
            whole &= settled > 0
            at, cell = np.nonzero(near & ~whole)
            sure = (whole * settled).sum(1)
            every = np.arange(len(x))
            take = pa.array(np.concatenate([at, every]))
            cells = pa.array(np.concatenate([cell, np.full(len(x), -1)]).astype("int32"))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), cells, pa.array(np.concatenate([np.zeros(len(at), "int64"), sure]))],
                                             ["spot", "x", "cell", "sure"])

    return points.select("spot", "x").mapInArrow(run, "spot string, x array<double>, cell int, sure long")


def _neighbour_counts(points: DataFrame, space: Space, eps: float) -> DataFrame:
    """spot, neighbours: the weight within eps of each point, itself included."""
    visits = cut_lineage(_visits(points, space, eps, _cell_weights(points, space)))

    def count(_, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"spot": [], "n": []}).astype({"spot": str, "n": "int64"})
        near = _within(np.stack(asked["x"].to_numpy()), np.stack(held["x"].to_numpy()), eps)
        return pd.DataFrame({"spot": asked["spot"], "n": near @ held["w"].to_numpy()})

    open_ones = meet(visits.filter("cell >= 0").select("spot", "x", "cell"), points.select("spot", "x", "w", "cell"), "spot", "spot", count, "spot string, n long")
    sure = visits.filter("cell < 0").select("spot", F.col("sure").alias("n"))
    return open_ones.unionByName(sure).groupBy("spot").agg(F.sum("n").alias("neighbours"))


def epsilon_counts(df: DataFrame, features: Sequence[str], eps: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows within ``eps`` of each distinct point, itself included: (x, w, neighbours)."""
    points, space = _weighted_points(df, features, cell_rows)
    return points.select("spot", "x", "w").join(_neighbour_counts(points, space, eps), "spot").drop("spot")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each component.  ``edges`` (a, b) hold both directions.

    Each round takes the least label around a node and then that label's own
    label, so the rounds grow with the logarithm of a component's width; every
    round is written out, so a lost executor repeats one round only.
    """
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")))
    edges = cut_lineage(edges.select("a", "b").distinct())
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(around, labels["node"] == around["a"], "left").select(
            "node", F.col("component").alias("before"), F.least("component", F.coalesce("near", "component")).alias("component"))
        roots = stepped.select(F.col("node").alias("r"), F.col("component").alias("further"))
        jumped = stepped.join(roots, stepped["component"] == roots["r"], "left").select(
            "node", "before", F.least("component", F.coalesce("further", "component")).alias("component"))
        written = cut_lineage(jumped)
        labels = written.select("node", "component")
        if written.filter(F.col("before") != F.col("component")).limit(1).count() == 0:
            return labels


def _box_groups(space: Space, eps: float) -> np.ndarray:
    """A group number for each cell whose box is no wider than eps, the same for cells whose boxes lie within eps of one another whole; else -1."""
    tight = np.flatnonzero((space.sizes > 0) & (np.sqrt((np.maximum(space.high - space.low, 0.0) ** 2).sum(1)) <= eps * LESS))
    group = np.full(len(space.sizes), -1)
    if not len(tight):
        return group
    low, high = space.low[tight], space.high[tight]
    name = np.full(len(tight), -1)
    for start in range(len(tight)):
        if name[start] >= 0:
            continue
        name[start], waiting = start, [start]
        while waiting:
            at = waiting.pop()
            rest = np.flatnonzero(name < 0)
            reach = np.sqrt((np.maximum(high[rest] - low[at], high[at] - low[rest]) ** 2).sum(1)) <= eps * LESS
            name[rest[reach]] = start
            waiting.extend(rest[reach].tolist())
    group[tight] = name
    return group


def _spanning(edges: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[str, str]]:
    """As many of the marked pairs of names as join two components."""
    up: dict[str, str] = {}

    def root(a: str) -> str:
        while up.get(a, a) != a:
            up[a] = up.get(up[a], up[a])
            a = up[a]
        return a

    out = []
    for i, a in enumerate(left):
        for b in set(right[edges[i]]):
            one, other = root(a), root(b)
            if one != other:
                up[max(one, other)] = min(one, other)
                out.append((a, b))
    return out


def _looks(rows: DataFrame, space: Space, group: np.ndarray, eps: float) -> DataFrame:
    """For points (spot, x, name; null names for border points): rows (spot, x, name, cell) to look into, or of no cell with the ``sure`` name reached by box.

    A cell of the point's own group is left out.
    """
    width = space.low.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_once(batches, len(space.sizes)):
            x, name = as_points(batch.column(1), width), np.array([v or "" for v in batch.column(2).to_pylist()], dtype=object)
            near = space.gaps(x) <= eps * MORE
            own = np.array([int(v[1:]) if v.startswith("c") else -2 for v in name])
            near &= group[None, :] != own[:, None]
            whole = near & (space.spans(x) <= eps * LESS) & (group >= 0)
            at, cell = np.nonzero(near & ~whole)
            sure_at, sure_cell = np.nonzero(whole)
            pairs = sorted(set(zip(sure_at.tolist(), group[sure_cell].tolist())))
            take = pa.array(np.concatenate([at, np.array([p for p, _ in pairs], dtype=at.dtype)]))
            cells = pa.array(np.concatenate([cell, np.full(len(pairs), -1)]).astype("int32"))
            sure = pa.array([None] * len(at) + [f"c{g}" for _, g in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), cells, sure], ["spot", "x", "name", "cell", "sure"])

    return cut_lineage(rows.select("spot", "x", "name").mapInArrow(run, "spot string, x array<double>, name string, cell int, sure string"))


def dbscan(df: DataFrame, key: str, features: Sequence[str], eps: float = 0.8, least: int = 10, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add ``cluster`` and ``is_core`` to (key, features): noise is -1, as are rows with a missing feature.

    Clusters are named by their least component; a border point reachable from
    several takes the least name.
    """
    points, space = _weighted_points(df, features, cell_rows)
    counted = cut_lineage(points.join(_neighbour_counts(points, space, eps), "spot"))
    core = counted.filter(F.col("neighbours") >= least)
    inner = measured(space, core)
    group = _box_groups(inner, eps)
    # A core point goes by its cell's group, or by itself.
    groups = F.broadcast(df.sparkSession.createDataFrame([(c, f"c{g}" if g >= 0 else None) for c, g in enumerate(group.tolist())], "cell int, in_group string"))
    named = cut_lineage(core.join(groups, "cell").select("spot", "x", "w", "cell", F.coalesce("in_group", F.concat(F.lit("p"), "spot")).alias("name")))

    def link(_, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        pairs = []
        if not asked.empty and not held.empty:
            near = _within(np.stack(asked["x"].to_numpy()), np.stack(held["x"].to_numpy()), eps)
            pairs = _spanning(near, asked["name"].to_numpy(), held["name"].to_numpy())
        return pd.DataFrame(pairs, columns=["a", "b"]).astype(str)

    looks = _looks(named, inner, group, eps)
    members = named.select("spot", "x", "name", "cell")
    found = meet(looks.filter("cell >= 0").drop("sure"), members, "spot", "spot", link, "a string, b string")
    links = cut_lineage(found.unionByName(looks.filter("cell < 0").select(F.col("name").alias("a"), F.col("sure").alias("b"))).distinct())
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    components = connected_components(named.select(F.col("name").alias("node")).distinct(), edges)
    clusters = components.select(F.col("node").alias("name"), F.col("component").alias("cluster"))

    def reach(_, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        pairs = []
        if not asked.empty and not held.empty:
            near = _within(np.stack(asked["x"].to_numpy()), np.stack(held["x"].to_numpy()), eps)
            names = held["name"].to_numpy()
            pairs = [(spot, name) for spot, row in zip(asked["spot"], near) for name in set(names[row])]
        return pd.DataFrame(pairs, columns=["spot", "name"]).astype(str)

    border = counted.filter(F.col("neighbours") < least).select("spot", "x", F.lit(None).cast("string").alias("name"))
    tried = _looks(border, inner, group, eps)
    adopted = meet(tried.filter("cell >= 0").select("spot", "x", "cell"), members, "spot", "spot", reach, "spot string, name string")
    adopted = adopted.unionByName(tried.filter("cell < 0").select("spot", F.col("sure").alias("name"))).join(clusters, "name").groupBy("spot").agg(F.min("cluster").alias("cluster"))
    labels = named.join(clusters, "name").select("spot", "w", "cluster", F.lit(True).alias("is_core")).unionByName(
        adopted.join(points.select("spot", "w"), "spot").withColumn("is_core", F.lit(False)).select("spot", "w", "cluster", "is_core"))
    rows = df.select(key, *features, F.md5(F.concat_ws(",", *[F.col(f).cast("double").cast("string") for f in features])).alias("_spot"))
    total = points.agg(F.sum("w")).first()[0] or 0
    return join_per_value(rows, labels.withColumnRenamed("spot", "_spot"), "_spot", "w", total).select(
        key, *features, F.coalesce("cluster", F.lit(str(NOISE))).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
