"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-pairs.

Features are 32-bit hashes of lower-cased words, of neighbouring words and of words one apart; a document has a feature or
not.  Training sees a bounded sample of labelled rows: at most about SAMPLE of each class, chosen by hash of the key.  The
sample is dealt to shards of about SHARD rows; in every round each shard runs FTRL-proximal a few times over its rows from
the common state, and the states of all shards are averaged per coordinate, one that a shard has not seen counting as it was
(parameter mixing).  Rates are per coordinate and the L1 term leaves few weights other than zero, so the model is small: it is
broadcast and looked up by binary search behind a bitmap.

FOLDS more models learn in the same tasks, each from all folds of the sample but one; their margins on the fold left out, with each
class weighed by 1 over its rate, give the slope and offset that turn margins into probabilities of the labels at their own ratio.

Defined results: an empty or null text has no features and gets the score of the bias alone; labels that are null, and
repeated labels of a key (the largest counts), are handled; a labelled key without a document is ignored; without any labelled
row every weight is zero and the score is .25; an empty table gives no rows.  A repeated key is trained on and scored row by row.
Columns of the input are carried through ``score``; its own column takes a name that is free.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from millwarden.llm.common import fresh_name
from millwarden.session import cut_lineage

#: Labelled rows of each class that training sees at most (about: a hash decides), rows of a shard, rounds, passes of a shard in a round.
SAMPLE, SHARD, ROUNDS, PASSES = 12_000, 3_000, 2, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.01
FOLDS = 4
#: A feature is learned from that many documents of a shard on.
SEEN = 2
HELD = 100_000
_WORD = re.compile(r"\w+")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
BITMAP = 1 << 22


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _index(mixed: np.ndarray) -> np.ndarray:
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[3]
    return (mixed >> np.uint64(32)).astype(np.uint32)


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashed features of a whole text, repeated ones included."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    parts = [_index(h * _ODD[0])]
    for step, odd in ((1, _ODD[1]), (2, _ODD[2])):
        if len(h) > step:
            parts.append(_index(h[:-step] * odd + h[step:] * _ODD[4]))
    return np.concatenate(parts)


@dataclass
class State:
    """FTRL state of the coordinates in ``index`` (sorted): z and n, and those of the bias."""

    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    z: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: tuple[float, float] = (0.0, 0.0)

    def looked_up(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.index):
            return np.zeros(len(index)), np.zeros(len(index))
        at = np.minimum(np.searchsorted(self.index, index), len(self.index) - 1)
        same = self.index[at] == index
        return np.where(same, self.z[at], 0.0), np.where(same, self.n[at], 0.0)


def weights(z: np.ndarray, n: np.ndarray, l1: float = L1) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(rows: list[tuple[np.ndarray, int]], start: State, passes: int = 1) -> State:
    """Passes of FTRL-proximal over (distinct features, label) rows."""
    every, seen = np.unique(np.concatenate([f for f, _ in rows]), return_counts=True) if rows else (np.zeros(0, np.uint32), np.zeros(0))
    index = every[seen >= SEEN]
    z, n = start.looked_up(index)
    bias = np.array(start.bias)
    places = []
    for found, label in rows:
        at = np.searchsorted(index, found)
        at, found = at[at < len(index)], found[at < len(index)]
        places.append((at[index[at] == found], label))
    for at, label in (row for _ in range(passes) for row in places):
        zi, ni = z[at], n[at]
        w = weights(zi, ni)
        b = -bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - label
        rate = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
        z[at], n[at] = zi + g - rate * w, ni + g * g
        bias[0] += g - (np.sqrt(bias[1] + g * g) - np.sqrt(bias[1])) / ALPHA * b
        bias[1] += g * g
    return State(index, z, n, (float(bias[0]), float(bias[1])))


@dataclass(frozen=True)
class Model:
    """Sorted feature indices with their weights, the bias, and the slope and offset of the calibration."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self):
        bitmap = np.zeros(BITMAP, dtype=bool)
        bitmap[self.index & np.uint32(BITMAP - 1)] = True

        def margin(found: np.ndarray) -> float:
            found = np.unique(found[bitmap[found & np.uint32(BITMAP - 1)]])
            at = np.searchsorted(self.index, found)
            at = at[at < len(self.index)]
            return self.bias + (float(self.weight[at[np.isin(self.index[at], found)]].sum()) if len(at) else 0.0)

        return margin

    def scorer(self):
        margin = self.margins()
        return lambda found: float(1 / (1 + np.exp(-np.clip(self.slope * margin(found) + self.offset, -35, 35))))


def calibration(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighed logistic regression on the margin, by Newton's method (Platt 1999); none for a single class.

    The targets are drawn in by Laplace's rule, so that classes told apart without error have a finite slope.
    """
    if len(np.unique(label)) < 2:
        return 1.0, 0.0
    n = np.array([weight[label == y].sum() for y in (0, 1)])
    target = np.where(label == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x, at = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        slope = x.T @ (weight * (p - target))
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        # A long step is cut, so that no start is too far.
        at = at - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return (float(at[0]), float(at[1])) if np.isfinite(at).all() and at[0] > 0 else (1.0, 0.0)


def held_out(key: Column) -> Column:
    """The fifth of the keys that training leaves out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE,
        rounds: int = ROUNDS, passes: int = PASSES) -> Model:
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~held_out(F.col("key")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # A hash of the key keeps about ``sample`` rows of a class: its size is bounded, so it may be broadcast.
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / float(1 << 20)
    rates = {y: min(1.0, sample / max(1, counts.get(y, 0))) for y in (0, 1)}
    share = F.when(F.col("label") == 1, rates[1]).otherwise(rates[0])
    chosen = known.filter(place < share).groupBy("key").agg(F.max("label").alias("label"))
    shards = max(1, -(-sum(min(sample, n) for n in counts.values()) // SHARD))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [np.unique(features(t.as_py(), hashes)).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[1:]], ["features", "label", "place", "shard", "fold"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")
    rows = rows.select("text", "label", F.xxhash64("key", F.lit(1)).alias("place"), F.pmod(F.xxhash64("key", F.lit(2)), F.lit(shards)).cast("int").alias("shard"),
                       F.pmod(F.xxhash64("key", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = cut_lineage(rows.mapInArrow(featured, "features binary, label int, place long, shard int, fold int"))
    # Model k leaves out fold k; the last one none.
    states = [State() for _ in range(FOLDS + 1)]
    for _ in range(rounds):
        common = spark.sparkContext.broadcast(states)

        def one_pass(table: pa.Table) -> pa.Table:
            own, parts = table.sort_by("place"), []
            fold = own.column("fold").to_numpy()
            data = [(np.frombuffer(f.as_buffer(), dtype=np.uint32), y.as_py()) for f, y in zip(own.column("features"), own.column("label"))]
            for k, start in enumerate(common.value):
                new = train([row for row, f in zip(data, fold) if f != k], start, passes)
                told = (np.abs(new.z) > L1 / 4) | np.isin(new.index, start.index)  # the rest is as good as unseen
                index = np.append(new.index[told].astype(np.int64), -1)
                parts.append(pa.table({"model": np.full(len(index), k, "int32"), "feature": index, "z": np.append(new.z[told], new.bias[0]), "n": np.append(new.n[told], new.bias[1])}))
            return pa.concat_tables(parts)

        passed = rows.groupBy("shard").applyInArrow(one_pass, "model int, feature long, z double, n double")
        mixed = passed.groupBy("model", "feature").agg(F.sum("z").alias("z"), F.sum("n").alias("n"), F.count("*").alias("told")).toArrow().sort_by([("model", "ascending"), ("feature", "ascending")])
        of, index, z, n, told = (mixed.column(c).to_numpy() for c in ("model", "feature", "z", "n", "told"))
        states = [_mixed(state, index[of == m], z[of == m], n[of == m], told[of == m], shards) for m, state in enumerate(states)]
    models = [_model(state) for state in states]
    final = models.pop()
    if not counts:
        return Model(final.index, final.weight, float(np.log(1 / 3)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = [m.margins() for m in models]
        for batch in batches:
            found = [margins[h.as_py()](np.frombuffer(f.as_buffer(), dtype=np.uint32)) for f, h in zip(batch.column(0), batch.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], ["margin", "label"])

    # As many rows as the sample has, which is bounded.
    seen = rows.select("features", "label", "fold").mapInArrow(judged, "margin double, label int").toArrow().sort_by([("margin", "ascending"), ("label", "ascending")])
    label_of = seen.column("label").to_numpy()
    slope, offset = calibration(seen.column("margin").to_numpy(), label_of, np.where(label_of == 1, 1 / rates[1], 1 / rates[0]))
    return Model(final.index, final.weight, final.bias, slope, offset)


def _mixed(start: State, index: np.ndarray, z: np.ndarray, n: np.ndarray, told: np.ndarray, shards: int) -> State:
    """Mean over all shards; where one told nothing of a coordinate it is as at the start."""
    own = index >= 0
    z0, n0 = start.looked_up(index[own].astype(np.uint32))
    rest = shards - told[own]
    bias = start.bias
    if (~own).any():
        silent = shards - told[~own][0]
        bias = ((float(z[~own][0]) + silent * start.bias[0]) / shards, (float(n[~own][0]) + silent * start.bias[1]) / shards)
    return State(index[own].astype(np.uint32), (z[own] + rest * z0) / shards, (n[own] + rest * n0) / shards, bias)


def _model(state: State) -> Model:
    w = weights(state.z, state.n)
    return Model(state.index[w != 0], w[w != 0], float(-state.bias[0] / ((BETA + np.sqrt(state.bias[1])) / ALPHA)))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score in 0 to 1, in column ``name`` or the first free variant of it."""
    name, shared = fresh_name(docs, name), docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, of = WordHashes(), shared.value.scorer()
        for batch in batches:
            # A text that is a string already travels once, in its row.
            texts = batch.column(0).field(place) if place is not None else batch.column(1)
            scores = pa.array([of(features(t.as_py(), hashes)) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["row", "score"])

    place = docs.columns.index(text) if text in docs.columns and docs.schema[text].dataType.typeName() == "string" else None
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row) if place is not None else docs.select(row, F.col(text).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(scored, f"row {kind}, score double").select("row.*", F.col("score").alias(name))
