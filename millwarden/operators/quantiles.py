"""Exact quantiles with bounded memory.

Spark's ``percentile`` keeps a map of all distinct values per group in one task, which a continuous column at scale overflows.
Doubles are read as whole numbers of the same order.  A bracket is a span of them that holds wanted ranks; a pass over the rows
counts, in each open bracket, the rows of equally wide bins with the least and greatest of each bin.  A rank is settled once its
bin holds one value; few rows in all are listed; else the bin is the next bracket.  Every pass narrows a bracket by the number of
bins, so a few passes do at any size, however heavy a value is.  Only counts of bins and those few rows reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Key = tuple  # (group values..., column)

#: Bins that a pass counts, over all brackets; rows of all brackets from which on they are listed.
ACCURACY, LISTED = 1 << 16, 100_000


@dataclass
class _Bracket:
    """The span of ordered numbers that holds the open ``ranks`` of ``key``, with the rows below it and in it."""

    key: Key
    group: int
    column: int
    ranks: list[int]
    low: int
    high: int
    below: int
    rows: int


def _value(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _double(ordered: int) -> float:
    bits = np.array([ordered], dtype=np.int64)
    return float(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64)[0])


def _counts(rows: DataFrame, brackets: list[_Bracket], bins: int) -> pa.Table:
    """(bracket, bin, n, low, high): the rows in each bin of each bracket, with the ends of their values; with no bins a row for each value."""
    used = sorted({b.column for b in brackets})
    spans: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
    for k, b in enumerate(brackets):
        spans.setdefault((b.group, used.index(b.column)), []).append((b.low, b.high, k, (b.high - b.low) // bins + 1 if bins else 1))
    spans = {at: tuple(np.array(c, dtype=t) for c, t in zip(zip(*sorted(found)), (np.int64, np.int64, np.int64, np.uint64))) for at, found in spans.items()}
    lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(brackets) * bins
        n, low, high = np.zeros(size, dtype=np.int64), np.full(size, highest), np.full(size, lowest)
        for batch in batches:
            group = batch.column(len(used)).to_numpy()
            for (of, column), (lows, highs, names, widths) in spans.items():
                values = batch.column(column).to_numpy(zero_copy_only=False)
                values = _ordered(values[(group == of) & ~np.isnan(values)])
                at = np.maximum(np.searchsorted(lows, values, side="right") - 1, 0)
                inside = (values >= lows[at]) & (values <= highs[at])
                at, values = at[inside], values[inside]
                if not len(values):
                    continue
                if not bins:
                    code, count = np.unique(np.stack([names[at], values]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (code[0], code[1], count, code[1], code[1])], ["bracket", "bin", "n", "low", "high"])
                    continue
                code = names[at] * bins + ((values - lows[at]).view(np.uint64) // widths[at]).astype(np.int64)
                n += np.bincount(code, minlength=size)
                np.minimum.at(low, code, values)
                np.maximum.at(high, code, values)
        seen = np.flatnonzero(n)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (seen // bins, seen % bins, n[seen], low[seen], high[seen])], ["bracket", "bin", "n", "low", "high"])

    found = rows.select(*[f"_{i}" for i in used], "_group").mapInArrow(run, "bracket long, bin long, n long, low long, high long").groupBy("bracket", "bin").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return found.toArrow().sort_by([("bracket", "ascending"), ("low", "ascending")])


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    listed: int = LISTED,
) -> dict[Key, dict[float, float | None]]:
    """Linearly interpolated quantiles per group and column.

    Returns ``{(group..., column): {prob: value}}``: the result is the driver's, so ``by`` must have few groups.  ``accuracy`` is the
    number of bins of a pass, ``listed`` that of the rows in all open brackets from which on they are listed at once.
    """
    columns, by = list(columns), list(by)
    first = [F.struct(F.count(_value(c)).alias("n"), F.min(_value(c)).alias("low"), F.max(_value(c)).alias("high")).alias(f"_{i}") for i, c in enumerate(columns)]
    sizes: dict[Key, int] = {}
    values: dict[Key, dict[int, float]] = {}
    brackets: list[_Bracket] = []
    groups: list[tuple] = []
    for row in df.groupBy(*by).agg(*first).collect():
        groups.append(tuple(row[b] for b in by))
        for i, column in enumerate(columns):
            cell, key = row[f"_{i}"], (*groups[-1], column)
            if cell["n"]:
                ranks = sorted({r for p in probs for r in _ranks(cell["n"], p)[:2]})
                low, high = _ordered(np.array([cell["low"], cell["high"]], dtype=np.float64)).tolist()
                sizes[key], values[key] = cell["n"], {}
                brackets.append(_Bracket(key, len(groups) - 1, i, ranks, low, high, 0, cell["n"]))
    rows = _with_groups(df, by, groups).select(*[_value(c).alias(f"_{i}") for i, c in enumerate(columns)], "_group")
    while brackets:
        bins = 0 if sum(b.rows for b in brackets) <= listed else max(2, accuracy // len(brackets))
        table = _counts(rows, brackets, bins)
        name, n, low, high = (table.column(c).to_numpy() for c in ("bracket", "n", "low", "high"))
        left: list[_Bracket] = []
        for k, b in enumerate(brackets):
            own = slice(*np.searchsorted(name, [k, k + 1]))
            ends = np.cumsum(n[own]) + b.below
            places: dict[int, list[int]] = {}
            for rank in b.ranks:
                places.setdefault(int(np.searchsorted(ends, rank, side="right")), []).append(rank)
            for place, ranks in places.items():
                one, other, count = (int(c[own][place]) for c in (low, high, n))
                if one == other:
                    values[b.key].update(dict.fromkeys(ranks, _double(one)))
                else:
                    left.append(_Bracket(b.key, b.group, b.column, ranks, one, other, int(ends[place]) - count, count))
        brackets = left
    result: dict[Key, dict[float, float | None]] = {}
    for key, n in sizes.items():
        result[key] = {}
        for p in probs:
            low, high, part = _ranks(n, p)
            result[key][p] = values[key][low] + (values[key][high] - values[key][low]) * part
    return result


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    place = p * (n - 1)
    low = min(math.floor(place + 1e-9), n - 1)
    return low, min(low + (1 if place - low > 1e-9 else 0), n - 1), max(0.0, place - low)


def _with_groups(df: DataFrame, by: list[str], groups: list[tuple]) -> DataFrame:
    """``df`` with the number of each row's group."""
    if not by:
        return df.withColumn("_group", F.lit(0))
    kinds = ", ".join([*(f"_by_{i} {df.schema[b].dataType.simpleString()}" for i, b in enumerate(by)), "_group int"])
    table = df.sparkSession.createDataFrame([(*group, k) for k, group in enumerate(groups)], kinds)
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & df[b].eqNullSafe(table[f"_by_{i}"])
    # Few groups.
    return df.join(F.broadcast(table), same)
