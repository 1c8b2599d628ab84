"""Ranks and running totals over whole tables, without a one-task window.

A window with no partition key moves every row into one task, and a window
keyed by a hot group moves that group into one.  Here the order key is cut into
ranges at sketched quantiles; each range is ordered on its own, and a small
table of range totals supplies the offsets.  The sketch decides only how even
the ranges are, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 128


def range_bounds(df: DataFrame, key: str, ranges: int = RANGES) -> list[float]:
    """Distinct approximate quantiles of ``key``: at most ``ranges - 1`` numbers."""
    return sorted(set(df.agg(_sketch(key, ranges)).first()[0] or []))


def _sketch(key: str, ranges: int) -> Column:
    return F.percentile_approx(F.col(key).cast("double"), [i / ranges for i in range(1, ranges)], 10 * ranges)


def with_range(df: DataFrame, key: str, bounds: Sequence[float]) -> DataFrame:
    """Add ``_range``, the index of the range ``key`` falls in; it rises with ``key``."""
    if not bounds:
        return df.withColumn("_range", F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="_key", outputCol="_place", handleInvalid="keep")
    placed = cutter.transform(df.withColumn("_key", F.col(key).cast("double")))
    return placed.withColumn("_range", F.col("_place").cast("int")).drop("_key", "_place")


def running_totals(
    df: DataFrame,
    key: str,
    sums: dict[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Add inclusive running sums along ``key`` (unique within ``by``).

    ``sums`` maps an input column to the name of its running sum.  Aggregate to
    one row per distinct key first: a value shared by a third of all rows is
    then one row here.
    """
    by = list(by)
    cut = with_range(df, key, range_bounds(df, key) if bounds is None else bounds)
    far_first = F.col("_range").desc() if descending else F.col("_range").asc()
    totals = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy(far_first).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    near_first = F.col(key).desc() if descending else F.col(key).asc()
    local = Window.partitionBy(*by, "_range").orderBy(near_first).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(offsets, [*by, "_range"])
    return joined.select(
        *df.columns, *[(F.sum(c).over(local) + F.col(f"_o_{c}")).alias(name) for c, name in sums.items()])


def grouped_positions(
    df: DataFrame, by: str, key: str, order: Sequence[str], name: str, ranges: int = RANGES
) -> DataFrame:
    """Add each row's 1-based position within ``by``, ordered by ``order``.

    ``key`` is a number that rises with ``order``.  A hot group is spread over
    the ranges of ``key``, so no task orders more than one range of it.
    """
    cut = with_range(df, key, range_bounds(df, key, ranges))
    counts = cut.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = Window.partitionBy(by, "_range").orderBy(*order)
    placed = cut.withColumn("_p", F.row_number().over(local)).join(offsets, [by, "_range"])
    return placed.select(*df.columns, (F.col("_p") + F.col("_o")).alias(name))


BROADCAST_VALUES = 200_000


def join_per_value(rows: DataFrame, values: DataFrame, key: str, count: str, total: int, share: int = 500, salts: int = 64) -> DataFrame:
    """Left join of ``rows`` to one row per distinct ``key``, safe for hot values.

    ``values`` carries how many rows hold each value.  Values held by more than
    1/``share`` of the ``total`` rows number fewer than ``share``; their rows are
    dealt over ``salts`` tasks, and their one ``values`` row is repeated to match.
    """
    extra = [c for c in values.columns if c not in (key, count)]
    hot = [r[0] for r in values.filter(F.col(count) > F.lit(total / share)).select(key).collect()]
    if not hot:
        return rows.join(values.select(key, *extra), key, "left")
    is_hot = F.col(key).isin(hot)
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0))
    spread = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = values.select(key, *extra, F.explode(spread).alias("_salt"))
    return dealt.join(repeated, [key, "_salt"], "left").drop("_salt")


def competition_ranks(df: DataFrame, names: dict[str, str], broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """Rank rows by each score (score column -> rank column), highest first.

    Equal scores share the least rank; a null score gets a null rank.  The ranks
    of distinct scores are broadcast only when their counted number is small.
    """
    out = df
    for score, name in names.items():
        counts = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_ties"))
        seen = counts.agg(F.count("*").alias("values"), F.sum("_ties").alias("rows"), _sketch(score, RANGES).alias("q")).first()
        totals = running_totals(counts, score, {"_ties": "_through"}, descending=True, bounds=sorted(set(seen["q"] or [])))
        ranks = totals.select(score, "_ties", (F.col("_through") - F.col("_ties") + 1).alias(name))
        if seen["values"] <= broadcast_values:
            out = out.join(F.broadcast(ranks.drop("_ties")), score, "left")
        else:
            out = join_per_value(out, ranks, score, "_ties", seen["rows"])
    return out
