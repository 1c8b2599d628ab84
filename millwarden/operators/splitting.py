"""Stratified and grouped splits that keep rows where they are.

Rows are ordered by md5(seed, key).  The hash that sits at a wanted rank is found
by counting hash prefixes, level by level; the split itself is then a comparison
with a few constants, with no shuffle and no per-stratum task.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATA_LIMIT = 1000


def seeded_hash(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))


def _any(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def hash_cuts(
    df: DataFrame, stratum: str, key: str, shares: Sequence[Decimal], seed: int = 42, listed: int = 100_000
) -> dict[object, list[tuple[str, str] | None]]:
    """For each stratum, the (hash, key) of row number floor(share·n) in hash order."""
    rows = df.select(F.col(stratum).alias("s"), F.col(key).cast("string").alias("k"), seeded_hash(key, seed).alias("h"))
    depth = 3
    counted = rows.groupBy("s", F.substring("h", 1, depth).alias("p")).count().limit(STRATA_LIMIT * 4096 + 1).collect()
    buckets: dict[object, dict[str, int]] = {}
    for row in counted:
        buckets.setdefault(row["s"], {})[row["p"]] = row["count"]
    if len(buckets) > STRATA_LIMIT:
        raise ValueError(f"{stratum} has more than {STRATA_LIMIT} strata")
    cuts: dict[object, list[tuple[str, str] | None]] = {s: [None] * len(shares) for s in buckets}
    open_cuts: dict[tuple[object, int], tuple[str, int, int]] = {}

    def descend(at: tuple[object, int], rank: int, inner: dict[str, int]) -> None:
        for prefix in sorted(inner):
            if rank <= inner[prefix]:
                open_cuts[at] = (prefix, rank, inner[prefix])
                return
            rank -= inner[prefix]

    for s, inner in buckets.items():
        n = sum(inner.values())
        for i, share in enumerate(shares):
            rank = int(share * n)
            if rank > 0:
                descend((s, i), rank, inner)
    while open_cuts:
        spans = {f"{s}|{prefix}" for (s, _), (prefix, _, _) in open_cuts.items()}
        # One hash per row, whatever the number of open prefixes.
        place = F.concat(F.coalesce(F.col("s").cast("string"), F.lit("None")), F.lit("|"), F.substring("h", 1, depth))
        inside = place.isin(sorted(spans))
        if sum(size for _, _, size in open_cuts.values()) <= listed or depth >= 30:
            found = sorted((r["h"], r["k"], r["s"]) for r in rows.filter(inside).collect())
            for (s, i), (prefix, rank, _) in open_cuts.items():
                members = [(h, k) for h, k, group in found if group == s and h.startswith(prefix)]
                cuts[s][i] = members[rank - 1]
            break
        depth += 3
        counted = rows.filter(inside).groupBy("s", F.substring("h", 1, depth).alias("p")).count().collect()
        waiting, open_cuts = dict(open_cuts), {}
        for (s, i), (prefix, rank, _) in waiting.items():
            descend((s, i), rank, {r["p"]: r["count"] for r in counted if r["s"] == s and r["p"].startswith(prefix)})
    return cuts


def _at_or_before(key: str, cut: tuple[str, str] | None, hashed: Column) -> Column:
    if cut is None:
        return F.lit(False)
    return (hashed < cut[0]) | ((hashed == cut[0]) & (F.col(key).cast("string") <= cut[1]))


def stratified_split(df: DataFrame, stratum: str, key: str, train: str = "0.8", seed: int = 42) -> DataFrame:
    """Add ``part``: the first ``train`` share of each stratum, in hash order, is 'train'."""
    cuts = hash_cuts(df, stratum, key, [Decimal(train)], seed)
    chosen = _any([F.col(stratum).eqNullSafe(F.lit(s)) & _at_or_before(key, c[0], seeded_hash(key, seed)) for s, c in cuts.items()])
    return df.withColumn("part", F.when(chosen, "train").otherwise("test"))


def stratified_folds(df: DataFrame, stratum: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..folds-1; class counts of any two folds differ by at most one."""
    shares = [Decimal(i) / folds for i in range(1, folds)]
    cuts = hash_cuts(df, stratum, key, shares, seed)
    fold = F.lit(folds - 1)
    for s, marks in cuts.items():
        chain = F.lit(folds - 1)
        for i in range(folds - 2, -1, -1):
            chain = F.when(_at_or_before(key, marks[i], F.col("_h")), i).otherwise(chain)
        fold = F.when(F.col(stratum).eqNullSafe(F.lit(s)), chain).otherwise(fold)
    return df.withColumn("_h", seeded_hash(key, seed)).withColumn("fold", fold).drop("_h")


def group_split(df: DataFrame, group: str, held_out: str = "0.2", seed: int = 42) -> DataFrame:
    """Add ``part``: all rows of a group go the same way; ``held_out`` of the groups validate."""
    units = df.select(group).distinct().withColumn("_all", F.lit(0))
    cut = hash_cuts(units, "_all", group, [Decimal(held_out)], seed).get(0, [None])[0]
    return df.withColumn("part", F.when(_at_or_before(group, cut, seeded_hash(group, seed)), "validation").otherwise("train"))


def sample_rows(df: DataFrame, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Repeatable sample of min(n, rows) rows: a distributed top-n by hash."""
    return df.orderBy(seeded_hash(key, seed), F.col(key)).limit(n)
