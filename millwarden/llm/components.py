"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millwarden.session import cut_lineage, drop_stage


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, up) with up < node or equal, to (node, root): every pointer jumps until none moves."""
    stage = hooks
    while True:
        over = hooks.select(F.col("node").alias("up"), F.col("up").alias("further"))
        jumped = cut_lineage(hooks.join(over, "up", "left").select("node", F.coalesce("further", "up").alias("up"), (F.col("further") != F.col("up")).alias("moved")))
        drop_stage(stage)
        stage, hooks = jumped, jumped.select("node", "up")
        if jumped.filter("moved").isEmpty():
            return hooks.withColumnRenamed("up", "root")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of any ordered type to (node, root): root is the least node of the component.

    A round hooks each node to its least neighbour, follows the hooks to their roots and keeps the edges between roots.
    Neighbours are only ever reduced to a minimum, so a node with very many is no burden.  Rounds run until no edge is left.
    """
    edges = edges_here = cut_lineage(edges.select("a", "b").filter("a != b").distinct())
    found: DataFrame | None = None
    found_here: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hooks = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("up"))
        roots = _roots(cut_lineage(hooks))
        if found is None:
            found = roots
        else:
            onward = roots.select(F.col("node").alias("root"), F.col("root").alias("onward"))
            found = found.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root"))
        for end in ("a", "b"):
            edges = edges.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end)
        old_edges, old_found = edges_here, found_here
        edges = edges_here = cut_lineage(edges.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a != b").distinct())
        found = found_here = cut_lineage(found)
        for old in (old_edges, old_found):
            if old is not None:
                drop_stage(old)
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
