"""Ward clustering of many rows: mergeable summaries of cells, then exact Ward on those.

Rows fall into at most ``summaries`` cells, cut where rows are furthest apart (on a bounded sample); a cell is its rows' number
and sums, which Spark adds up.
Ward joins the cells, by nearest-neighbour chains, as it would join clusters of rows; where every cell holds one distinct
point, the result is that of Ward on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwarden.operators.space import drawn_points, even_cuts, with_cells

#: Summaries that Ward joins on the driver: their distances take 8 bytes a pair.
SUMMARIES = 2000


def ward_labels(sizes: np.ndarray, means: np.ndarray, k: int) -> np.ndarray:
    """Cluster (from 0, by first member) of each of the summaries, cut at ``k``.

    The cost of a join is n·m / (n + m) times the squared distance of the means; ties go to the first pair.
    """
    m = len(sizes)
    n = sizes.astype("float64").copy()
    square = (means * means).sum(1)
    gap = np.maximum(square[:, None] + square[None, :] - 2.0 * means @ means.T, 0.0)
    cost = n[:, None] * n[None, :] / (n[:, None] + n[None, :]) * gap
    np.fill_diagonal(cost, np.inf)
    live = np.ones(m, dtype=bool)
    joins: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while live.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        while True:
            a = chain[-1]
            row = cost[a]
            b = int(row.argmin())
            # A reciprocal neighbour wins a tie, or the chain would not end.
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        joins.append((float(cost[a, b]), a, b))
        # Lance and Williams.
        other = live.copy()
        other[[a, b]] = False
        total = n[a] + n[b] + n[other]
        new = ((n[a] + n[other]) * cost[a, other] + (n[b] + n[other]) * cost[b, other] - n[other] * cost[a, b]) / total
        cost[a, other] = cost[other, a] = new
        live[b] = False
        cost[b, :] = cost[:, b] = np.inf
        n[a] += n[b]
    up = np.arange(m)

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for _, a, b in sorted(joins, key=lambda j: j[0])[: max(0, m - k)]:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    roots = [root(x) for x in range(m)]
    names = {r: i for i, r in enumerate(sorted(set(roots)))}
    return np.array([names[r] for r in roots], dtype="int32")


def ward_clusters(df: DataFrame, features: Sequence[str], k: int = 3, summaries: int = SUMMARIES, cluster: str = "cluster") -> DataFrame:
    """Add ``cluster`` (0 to k - 1) to the rows whose features are all known."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.dropna(subset=list(features)).withColumn("_x", x)
    width = len(features)
    spread = df.sparkSession.createDataFrame([], "cell int, label int")
    space = even_cuts(drawn_points(rows.select(F.col("_x").alias("x")), width)[0], summaries)
    placed = with_cells(rows, space, "_x", "_cell")
    sums = [F.sum(F.col("_x")[i]).alias(f"s{i}") for i in range(width)]
    found = placed.groupBy("_cell").agg(F.count("*").alias("n"), *sums).orderBy("_cell").collect()
    if found:
        sizes = np.array([r["n"] for r in found])
        means = np.array([[r[f"s{i}"] for i in range(width)] for r in found]) / sizes[:, None]
        labels = ward_labels(sizes, means, min(k, len(found)))
        spread = df.sparkSession.createDataFrame([(r["_cell"], int(c)) for r, c in zip(found, labels)], "cell int, label int")
    # A row per summary, of which there are few.
    return placed.join(F.broadcast(spread), F.col("_cell") == F.col("cell")).withColumn(cluster, F.col("label")).drop("_x", "_cell", "cell", "label")
