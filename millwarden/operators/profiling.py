"""Data-quality profile and exploratory statistics of a table."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwarden.operators.quantiles import exact_quantiles

DECILES = tuple(i / 10 for i in range(11))


def per_key(values: dict, key: str | Column, kind: str = "double") -> Column:
    """Constant lookup of a small fitted table."""
    column = F.col(key) if isinstance(key, str) else key
    found = F.lit(None).cast(kind)
    for name, value in values.items():
        found = F.when(column == F.lit(name), F.lit(value).cast(kind)).otherwise(found)
    return found


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (row, column)."""
    parts = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(*keep, F.inline(F.array(*parts)))


def one_row_to_rows(aggregated: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Turn a one-row aggregate with a column per name into (name, value) rows."""
    return aggregated.select(F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns])))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def null_counts(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    listed = one_row_to_rows(counts, df.columns, "column", "nulls")
    total = counts.select(F.lit("total").alias("column"), sum((F.col(c) for c in df.columns), F.lit(0)).alias("nulls"))
    return listed.unionByName(total)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row; nulls compare as equal."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column."""
    if approximate:
        counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns])
        return one_row_to_rows(counts, df.columns, "column", "n_distinct")
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns]
    values = df.select(F.inline(F.array(*parts))).groupBy("column", "v").agg(F.lit(1).alias("one"))
    return values.groupBy("column").agg(F.count("v").alias("n_distinct"))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    # One row per class by now, so the unkeyed window is small.
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(column, "n", F.round(100.0 * F.col("n") / total, 6).alias("percent"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    at = {p: {c: quartiles[(c,)][p] for c in columns if (c,) in quartiles} for p in (0.25, 0.5, 0.75)}
    stats = long_form(df, columns).groupBy("feature").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("std"), F.round(F.min("value"), 6).alias("min"),
        F.round(F.max("value"), 6).alias("max"))
    return stats.withColumns({
        "q25": F.round(per_key(at[0.25], "feature"), 6), "q50": F.round(per_key(at[0.5], "feature"), 6),
        "q75": F.round(per_key(at[0.75], "feature"), 6)})


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    totals = df.agg(*[F.sum(f).alias(f) for f in flags])
    return one_row_to_rows(totals, flags, "failure_mode", "n").orderBy(F.desc("n"), "failure_mode")


def rate_by(df: DataFrame, group: str, flag: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(flag).alias("failures"), F.round(F.avg(flag), 6).alias("rate"),
        F.round(100.0 * F.avg(flag), 6).alias("percent"))


def quantile_bins(df: DataFrame, features: Sequence[str], flag: str, probs: Sequence[float] = DECILES) -> DataFrame:
    """Failure rate per quantile bin: right-closed, lowest value included, repeated edges dropped."""
    quantiles = exact_quantiles(df, features, probs)
    parts, lows, highs = [], F.lit(None).cast("double"), F.lit(None).cast("double")
    for feature in features:
        edges = sorted(set(quantiles[(feature,)].values()))
        value = F.col(feature).cast("double")
        bin_no = F.lit(max(1, len(edges) - 1))
        for i in range(len(edges) - 2, 0, -1):
            bin_no = F.when(value <= F.lit(edges[i]), i).otherwise(bin_no)
        parts.append(F.struct(F.lit(feature).alias("feature"), F.when(value.isNotNull(), bin_no).alias("bin")))
        here = F.col("feature") == feature
        lows = F.when(here, F.element_at(F.array(*map(F.lit, edges)), F.col("bin"))).otherwise(lows)
        highs = F.when(here, F.element_at(F.array(*map(F.lit, edges + edges[-1:])), F.col("bin") + 1)).otherwise(highs)
    long = df.select(flag, F.inline(F.array(*parts))).filter(F.col("bin").isNotNull())
    rates = long.groupBy("feature", "bin").agg(
        F.count("*").alias("n"), F.sum(flag).alias("failures"), F.round(F.avg(flag), 6).alias("rate"))
    return rates.withColumns({"low": F.round(lows, 6), "high": F.round(highs, 6)})


def _defined(value: Column) -> Column:
    return F.when(~F.isnan(value), F.round(value, 6))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair; a constant column correlates with nothing.

    One pass finds means and deviations, one adds up the standardised products of a batch as a matrix.
    """
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    live = [c for c in columns if row[f"s_{c}"]]
    z = df.select(*[((F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"])).alias(c) for c in live])
    width = len(live)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, 2 * width))
        for batch in batches:
            data = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns]) if batch.num_rows else np.zeros((0, width))
            known = ~np.isnan(data)
            data = np.where(known, data, 0.0)
            total += np.hstack([data.T @ data, known.T.astype("float64") @ known])
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    # A table of columns by columns: sums of products, then rows in which both are known.
    found = {} if not live else {r["i"]: r for r in z.mapInArrow(products, "i long, sums array<double>").groupBy("i").agg(
        *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(2 * width)]).collect()}
    rows = []
    for a in columns:
        for b in columns:
            value = None
            if a in live and b in live:
                i, j = live.index(a), live.index(b)
                both = found[i][f"s{width + j}"]
                value = found[i][f"s{j}"] / both if both else None
            rows.append((a, b, value))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double").withColumn("r", F.round("r", 6))


def target_association(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    row = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    cells = [F.struct(F.lit(f).alias("feature"), _defined(F.col(f)).alias("r")) for f in features]
    return row.select(F.inline(F.array(*cells))).withColumn("strength", F.abs("r")).orderBy(F.desc_nulls_last("strength"), "feature")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width counts between minimum and maximum; the last bin is closed; empty bins count zero."""
    ends = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    low, high = ends[0], ends[1]
    session = df.sparkSession
    if low is None:
        return session.createDataFrame([], "bin int, low double, high double, n bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = df.filter(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    frame = session.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin", F.round(F.lit(low) + F.col("bin") * F.lit(width), 6).alias("low"),
        F.round(F.lit(low) + (F.col("bin") + 1) * F.lit(width), 6).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Quartiles, whiskers and outlier count per group and feature."""
    quartiles = exact_quantiles(df, features, (0.25, 0.5, 0.75), by=[group])
    table = df.sparkSession.createDataFrame(
        [(g, f, q[0.25], q[0.5], q[0.75]) for (g, f), q in quartiles.items()],
        f"{group} {df.schema[group].dataType.simpleString()}, feature string, q1 double, median double, q3 double")
    spread = F.col("q3") - F.col("q1")
    inside = (F.col("value") >= F.col("q1") - 1.5 * spread) & (F.col("value") <= F.col("q3") + 1.5 * spread)
    # The quartile table has groups x features rows.
    joined = long_form(df, features, [group]).join(F.broadcast(table), [group, "feature"])
    return joined.groupBy(group, "feature").agg(
        *[F.round(F.first(c), 6).alias(c) for c in ("q1", "median", "q3")],
        F.round(F.min(F.when(inside, F.col("value"))), 6).alias("whisker_low"),
        F.round(F.max(F.when(inside, F.col("value"))), 6).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


#: Terms of the expansion around a cell, whose half width is a quarter of the bandwidth: a row's kernel is off by at most
#: (1/4)^TERMS / sqrt(TERMS!), under 1e-11.  Cells further than REACH bandwidths add under 1e-14 a row.
TERMS, REACH = 12, 8.25


def density_curve(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott's bandwidth, by truncated Gauss sums.

    Rows fall into cells of half a bandwidth; a cell's powers of the distance from its centre, summed by Spark, stand for its rows.
    There are about 2·n^(1/5) cells per deviation of the range.
    """
    value = F.col(column).cast("double")
    stats = df.agg(F.min(value), F.max(value), F.stddev_samp(value), F.count(value)).first()
    low, high, spread, n = stats[0], stats[1], float(stats[2] or 0.0), stats[3]
    session = df.sparkSession
    if n < 2 or spread == 0.0:
        return session.createDataFrame([], "point int, x double, density double")
    bandwidth = spread * n ** (-1 / 5)
    width = bandwidth / 2
    cell = F.floor((value - F.lit(low)) / F.lit(width))
    away = (value - (F.lit(low) + (cell + 0.5) * F.lit(width))) / F.lit(bandwidth)
    powers = df.filter(value.isNotNull()).groupBy(cell.alias("cell")).agg(*[F.sum(F.pow(away, F.lit(float(k)))).alias(f"p{k}") for k in range(TERMS)])
    table = np.array([list(r) for r in powers.orderBy("cell").collect()], dtype="float64")
    centres, moments = low + (table[:, 0] + 0.5) * width, table[:, 1:] / [math.factorial(k) for k in range(TERMS)]
    out = []
    for point in range(points):
        x = low + point * ((high - low) / (points - 1))
        u = (x - centres) / bandwidth
        near = np.abs(u) <= REACH
        u = u[near]
        # exp(-(u - d)^2 / 2) is exp(-u^2 / 2) times the sum of He_k(u) d^k / k!.
        before, hermite, total = np.zeros(len(u)), np.ones(len(u)), np.zeros(len(u))
        for k in range(TERMS):
            total += hermite * moments[near, k]
            before, hermite = hermite, u * hermite - k * before
        out.append((point, round(x, 6), float((np.exp(-0.5 * u * u) * total).sum() / (n * bandwidth * math.sqrt(2 * math.pi)))))
    return session.createDataFrame(out, "point int, x double, density double").withColumn("density", F.round("density", 6))


def trajectory_profile(series: DataFrame, labels: DataFrame, unit: str = "unit_id", cycle: str = "cycle", rul: str = "rul") -> DataFrame:
    """Units, rows, extremes of unit length, and label statistics, as one row."""
    lengths = series.groupBy(unit).agg(F.max(cycle).alias("last"), F.count("*").alias("n"))
    left = lengths.agg(F.count("*").alias("units"), F.sum("n").alias("n_rows"), F.min("last").alias("min_last_cycle"),
                       F.max("last").alias("max_last_cycle"))
    right = labels.agg(F.count(rul).alias("labels"), F.min(rul).alias("min_rul"), F.max(rul).alias("max_rul"),
                       F.round(F.avg(rul), 6).alias("mean_rul"))
    names = [*left.columns, *right.columns]
    return left.unionByName(right, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


def corpus_profile(chunks: DataFrame, groups: Sequence[str], document: str) -> DataFrame:
    """Documents and chunks per value of each grouping column, and in total."""
    parts = [F.struct(F.lit(g).alias("dimension"), F.coalesce(F.col(g).cast("string"), F.lit("none")).alias("value")) for g in groups]
    parts.append(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")))
    per_document = chunks.groupBy(document, *groups).agg(F.count("*").alias("chunks"))
    long = per_document.select("chunks", F.inline(F.array(*parts)))
    return long.groupBy("dimension", "value").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))


