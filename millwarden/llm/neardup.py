"""Near duplicates by an LSH forest over MinHash signatures.

Equal texts (after lower-casing A-Z, words alone) are one node from the start.  A node's signature has ``TREES * DEPTH``
MinHash values; every tree orders the nodes by its own DEPTH of them.  Nodes that share a tree's first FLOOR values are a
region.  In a region the nodes are sorted by the rest of their values, so that those next to one another have the longest
common prefix: a region of up to REACH + 1 nodes is compared whole, in a crowded one each node meets the neighbour with the
deepest common prefix.  Each node is also
paired with one pivot of its region, at first the one whose orders and regions are fullest over all trees, then the one with most links:
that finds the source of a group whose copies differ more from one another than from it.

Pairs are confirmed on the full shingle sets.  Then, as long as a round links anything, regions that still hold two
components or more are searched again, between components only.  At the end what is still in different components of a crowded region
is compared whole, between all components but the largest and between them and it: blocks of nodes meet in tasks that count common
shingles exactly, and only links that join two components there leave a task, so its rows are never more than its nodes.  So the
recall is that of the regions, in crowded ones as in small ones: a pair at the similarity bound misses all regions with
probability (1 - .75^2)^16 = 2e-6; in small regions the signature test before the exact one drops it with 1e-7.  The last step costs
the square of the nodes of a region that many components share (texts with common boilerplate) in multiplications, not in rows.
Against a join of all shingle sets, sf0.1 has every component and every set size right.

Defined results: a text without words (or null) is linked with nothing; repeated rows are copies of one another; rows that
share a key but not the text are nodes of their own, in the component of either's links; null keys get a null component unless
their component has a key; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from millwarden.llm.common import SPACES, fresh_name
from millwarden.llm.components import components
from millwarden.session import cut_lineage, drop_stage

SHINGLE, SIMILAR = 5, 75
TREES, DEPTH, FLOOR = 16, 8, 2
#: Neighbours after a node in the order of a small region, and the share of equal signature values under which a pair is dropped.
REACH, ALIKE = 3, 0.55
SALTS = 16
#: Nodes and shingles of a block of a crowded region; two blocks meet in a task.  Sets up to which a shingle is counted pair by
#: pair, and columns of a product.
BLOCK, SHINGLES, FEW, COLUMNS = 1024, 1 << 19, 16, 1024
HELD = 100_000
#: Bits of the map that tells which rows' texts are wanted; it has 8 MB whatever the number of rows.
MAPPED, BUCKET = 1 << 26, 1 << 15

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(1 << 32, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_in(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes split and lower only at ASCII, as asked for."""
    return (text or b"").lower().split()


def shingle_set(words: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of the whole sequence if it is shorter than one."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - size + 1)
    s = np.full(n, min(len(h), size), dtype=np.uint64)
    for k in range(min(len(h), size)):
        s = s * _BASE + h[k : k + n]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        values = shingles[at : at + 1024, None] * _FACTORS
        values += _TERMS
        np.minimum(least, values.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _node(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        nodes, counts, signatures = [], [], []
        for value in batch.column(1):
            words = words_in(value.as_py())
            shingles = shingle_set(words, hashes)
            nodes.append(_node(words) if words else None)
            counts.append(len(shingles))
            signatures.append(signature(shingles).tobytes() if words else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())],
                                         ["key", "row", "node", "n_shingles", "signature"])


def _body(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.col(text).cast("string").cast("binary")
    return docs.select(F.col(key).cast("long").alias("key"), body.alias("body"), F.xxhash64(body).alias("row"))


def _shared_regions(nodes: DataFrame) -> DataFrame:
    """(tree, region, rest, node, n_shingles, members, pivot) for regions of two nodes and more."""
    def of_tree(t: int) -> tuple:
        start = 4 * DEPTH * t + 1
        return (F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("signature", start, 4 * FLOOR)).alias("region"),
                F.substring("signature", start + 4 * FLOOR, 4 * (DEPTH - FLOOR)).alias("rest"))

    placed = nodes.select("node", "n_shingles", F.explode(F.array(*(F.struct(*of_tree(t)) for t in range(TREES)))).alias("at")).select("node", "n_shingles", "at.*")
    regions = placed.groupBy("region").agg(F.count("*").alias("members")).filter("members > 1")
    shared = cut_lineage(_salted_join(placed, regions, ["region"]))
    # The source of a group has the group's commonest values, so over all trees most nodes share its whole order and its regions.
    orders = shared.groupBy("region", "rest").agg(F.count("*").alias("alike"))
    scored = _salted_join(shared.select("region", "rest", "node", "members"), orders, ["region", "rest"])
    scores = scored.groupBy("node").agg(F.struct(F.sum("alike").alias("alike"), F.sum("members").alias("members")).alias("score"))
    best = shared.select("region", "node").join(scores, "node").groupBy("region").agg(F.max(F.struct("score", "node")).alias("top"))
    return cut_lineage(_salted_join(shared, best.select("region", F.col("top.node").alias("pivot")), ["region"]))


def _salted_join(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Join with a table of one row per key, whose rows are copied so that a hot key's rows go to many tasks."""
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(few, [*on, "salt"]).drop("salt")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region and rest to pairs of each node with the last ones of other groups before it."""
    region, recent = None, OrderedDict()
    for batch in batches:
        pairs = []
        for r, node, n, group, members in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if r != region:
                region, recent = r, OrderedDict()
            for other_group, (other, m) in recent.items():
                if other_group != group and 100 * min(n, m) >= SIMILAR * max(n, m):
                    pairs.append((node, other))
            recent.pop(group, None)
            recent[group] = (node, n)
            while len(recent) > (REACH if members <= REACH + 1 else 1):
                recent.popitem(last=False)
        a, b = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _candidates(shared: DataFrame) -> DataFrame:
    """Distinct pairs a < b out of rows (region, members, rest, node, n_shingles, grp, pivot, pivot_grp)."""
    def whole(column: str):
        # Rows of a small region have equal range keys, so no border of partitions cuts it.
        return F.when(F.col("members") > REACH + 1, F.col(column))

    ordered = shared.select("region", "node", "n_shingles", "grp", "members", "rest").repartitionByRange("region", whole("rest"), whole("node")).sortWithinPartitions("region", "rest", "node")
    beside = ordered.select("region", "node", "n_shingles", "grp", "members").mapInArrow(_neighbours, "a binary, b binary")
    pivots = shared.filter("grp != pivot_grp").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    return beside.union(pivots).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows to one table for each value of the first three columns."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
        for at, to in zip([0, *cuts], [*cuts, batch.num_rows]):
            if held and tuple(keys[:, at]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[:, at])
            held.append(batch.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held)


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered ``left`` with those numbered ``right``.

    Shingles of many sets go through a product of 0/1 matrices, those of few are counted pair by pair.
    """
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    spot_left, spot_right = np.full(len(sets), -1), np.full(len(sets), -1)
    spot_left[left], spot_right[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(code, kind="stable")
    order = order[times[code[order]] > 1]
    code, of = code[order], of[order]
    few = times[code] <= FEW
    rare, owner = code[few], of[few]
    for step in range(1, FEW):
        if len(rare) <= step:
            break
        near = rare[step:] == rare[:-step]
        x, y = owner[:-step][near], owner[step:][near]
        for one, other in ((x, y), (y, x)):
            a, b = spot_left[one], spot_right[other]
            ok = (a >= 0) & (b >= 0)
            out += np.bincount(a[ok] * len(right) + b[ok], minlength=out.size).reshape(out.shape)
    _, many = np.unique(code[~few], return_inverse=True)
    owner = of[~few]
    for at in range(0, int(many.max()) + 1 if len(many) else 0, COLUMNS):
        some = (many >= at) & (many < at + COLUMNS)
        table = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        table[owner[some], many[some] - at] = 1
        out += table[left] @ table[right].T
    return out


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region and pair of blocks to the links between components, as many as join two of them."""
    for run in _runs(batches):
        first, second = run.column("first")[0].as_py(), run.column("second")[0].as_py()
        block = run.column("block").to_numpy()
        group = run.column("grp").combine_chunks().dictionary_encode().indices.to_numpy()
        if not (group != group[0]).any():
            continue
        node = run.column("node").to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in run.column("shingles").to_pylist()]
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        n = np.array([len(x) for x in sets])
        common = common_counts(sets, left, right)
        linked = (100 * common >= SIMILAR * (n[left, None] + n[right] - common)) & (group[left, None] != group[right])
        up = {}

        def root(g: int) -> int:
            while up.get(g, g) != g:
                up[g] = up.get(up[g], up[g])
                g = up[g]
            return g

        pairs = []
        for x, y in zip(*(k.tolist() for k in np.nonzero(linked))):
            x, y = left[x], right[y]
            one, other = root(group[x]), root(group[y])
            if one != other:
                up[one] = other
                pairs.append((min(node[x], node[y]), max(node[x], node[y])))
        if pairs:
            a, b = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _crowded_links(shared: DataFrame, sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """Links between components of a crowded region, enough to join all that have any.

    A region's largest component and its other nodes are dealt to blocks of about BLOCK nodes or SHINGLES shingles.  Blocks of the
    others meet all blocks, those of the largest component not one another.
    """
    rows = shared.filter(F.col("members") > REACH + 1).select("region", "node", "n_shingles").join(grouped, "node", "left")
    rows = cut_lineage(rows.select("region", "node", "n_shingles", F.coalesce("root", "node").alias("grp")))
    sizes = rows.groupBy("region", "grp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    blocks = lambda n, weight: F.ceil(F.greatest(n / BLOCK, weight / SHINGLES)).cast("int")
    regions = sizes.groupBy("region").agg(F.count("*").alias("groups"), F.max(F.struct("n", "weight", "grp")).alias("base"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    regions = regions.filter("groups > 1").select("region", F.col("base.grp").alias("base"), blocks(F.col("base.n"), F.col("base.weight")).alias("base_blocks"),
                                                  blocks(F.col("n") - F.col("base.n"), F.col("weight") - F.col("base.weight")).alias("other_blocks"))
    rows = _salted_join(rows, regions, ["region"])
    in_base = F.col("grp") == F.col("base")
    spot = F.xxhash64("node", F.lit(1))
    block = F.when(in_base, F.pmod(spot, "base_blocks")).otherwise(F.col("base_blocks") + F.pmod(spot, "other_blocks")).cast("int")
    all_blocks = F.sequence(F.lit(0), F.col("base_blocks") + F.col("other_blocks") - 1)
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.when(in_base, F.filter(all_blocks, lambda b: b >= F.col("base_blocks"))).otherwise(all_blocks)))
    dealt = rows.select("region", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "node", "grp")
    dealt = dealt.join(sets, "node").select("region", "first", "second", "block", "node", "grp", "shingles")
    return dealt.repartition("region", "first", "second").sortWithinPartitions("region", "first", "second", "node").mapInArrow(_apart, "a binary, b binary")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u4").reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((left == right).mean(axis=1) >= ALIKE))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = []
        for body, node in zip(batch.column(0), batch.column(1)):
            words = words_in(body.as_py())
            if _node(words) == node.as_py():
                found.append((node.as_py(), shingle_set(words, hashes).tobytes()))
        nodes, sets = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        right = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            right.append(100 * common >= SIMILAR * (len(x) + len(y) - common))
        yield batch.select([0, 1]).filter(pa.array(right, pa.bool_()))


def _wanted_bits(wanted: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash in ``column``, by its last bits."""
    spot = F.pmod(F.col(column), F.lit(MAPPED))
    parts = wanted.groupBy(F.floor(spot / BUCKET).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(spot, F.lit(BUCKET))).alias("bits"))
    out = np.zeros((MAPPED // BUCKET, BUCKET // 8), dtype=np.uint8)
    # At most MAPPED / BUCKET rows of BUCKET / 8 bytes.
    for r in parts.collect():
        out[r["bucket"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def _maybe_wanted(rows: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """The rows whose hash has its bit set: all that are wanted, and few others."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def known(hashes: pa.Array) -> pa.Array:
        spot = hashes.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(MAPPED - 1)
        return pa.array((shared.value[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool))

    return rows.filter(known(F.col(column)))


def _sets_of(nodes: DataFrame, shared: DataFrame, body: DataFrame) -> DataFrame:
    """node, shingles of every node that shares a region, from the row that stands for it."""
    wanted = cut_lineage(shared.select("node").distinct().join(nodes.select("node", "at"), "node"))
    body = _maybe_wanted(body, "row", _wanted_bits(wanted, "at.row"))
    same = body["key"].eqNullSafe(wanted["at.key"]) & (body["row"] == wanted["at.row"])
    sets = cut_lineage(body.join(wanted, same).select("body", "node").mapInArrow(_sets, "node binary, shingles binary").dropDuplicates(["node"]))
    drop_stage(wanted)
    return sets


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar."""
    def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(table.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")), end)
        return pairs.select("a", "b", f"{column}_a", f"{column}_b")

    likely = cut_lineage(with_both(pairs, nodes, "signature").mapInArrow(_alike, "a binary, b binary"))
    found = cut_lineage(with_both(likely, sets, "shingles").mapInArrow(_confirmed, "a binary, b binary"))
    drop_stage(likely)
    return found


def _components(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, row, node, n_shingles) and nodes (node, ``at``: the row that stands for it, root), both written."""
    body = _body(docs, key, text)
    signed = cut_lineage(body.mapInArrow(_signed, "key long, row long, node binary, n_shingles long, signature binary"))
    nodes = cut_lineage(signed.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.col("key").isNull().alias("last"), "key", "row")).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))
    rows = cut_lineage(signed.drop("signature"))
    drop_stage(signed)
    shared = _shared_regions(nodes)
    sets = _sets_of(nodes, shared, body)
    tested = cut_lineage(_candidates(shared.select("*", F.col("node").alias("grp"), F.col("pivot").alias("pivot_grp"))))
    links = new = _links(tested, nodes, sets)
    grouped = components(links)
    while not new.isEmpty():
        # Regions with more than one component, between them only; the pivot is the node with most links.
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
        known = grouped.join(ends, "node", "left")
        placed = shared.select("region", "members", "rest", "node", "n_shingles").join(known, "node", "left").select(
            "region", "members", "rest", "node", "n_shingles", F.coalesce("root", "node").alias("grp"), F.coalesce("degree", F.lit(0)).alias("degree"))
        placed = cut_lineage(placed)
        active = placed.groupBy("region").agg(F.min("grp").alias("low"), F.max("grp").alias("high"),
                                              F.max(F.struct("degree", "node", "grp")).alias("top")).filter("low != high")
        active = active.select("region", F.col("top.node").alias("pivot"), F.col("top.grp").alias("pivot_grp"))
        pairs = cut_lineage(_candidates(_salted_join(placed, active, ["region"])).join(tested, ["a", "b"], "left_anti"))
        drop_stage(placed)
        new = _links(pairs, nodes, sets)
        if not new.isEmpty():
            tested, links = tested.union(pairs), links.union(new)
            grouped = components(links)
    # What is in different components of a crowded region by now is compared whole.
    new = cut_lineage(_crowded_links(shared, sets, grouped))
    for done in (shared, sets):
        drop_stage(done)
    if not new.isEmpty():
        grouped = components(links.union(new))
    named = cut_lineage(nodes.select("node", "at").join(grouped, "node", "left").select("node", "at", F.coalesce("root", "node").alias("root")))
    drop_stage(nodes)
    return rows, named


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_shingles``, ``component_id`` (least key of the component), ``kept`` (the key is that one)."""
    rows, named = _components(docs, key, text)
    least = named.groupBy("root").agg(F.min("at.key").alias("component"))
    done = rows.join(named.join(least, "root").select("node", "component"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component"))
    return done.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without words, and one row of each component: that of the least key, null ones last, then by hash of the text."""
    rows, named = _components(docs, key, text)
    chosen = named.groupBy("root").agg(F.min("at").alias("at")).select("at.key", "at.row")
    same = rows["key"].eqNullSafe(chosen["key"]) & (rows["row"] == chosen["row"])
    times = cut_lineage(rows.join(chosen, same, "left_semi").groupBy("key", "row").agg(F.count("*").alias("times")))
    own_row, own_times, own_key, hashed = (fresh_name(docs, c) for c in ("_row", "_times", "_key", "_hash"))
    body = F.col(text).cast("string").cast("binary")
    empty = F.btrim(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(SPACES)) == ""
    marked = docs.withColumn(own_row, F.xxhash64(body))
    chosen = times.select(F.col("key").alias(own_key), F.col("row").alias(hashed), F.col("times").alias(own_times))
    found = marked.filter(~empty).join(chosen, F.col(key).cast("long").eqNullSafe(F.col(own_key)) & (F.col(own_row) == F.col(hashed)))
    found = found.select(*marked.columns, own_times)
    # Only rows that are repeated are shuffled to take one of them.
    once = found.filter(F.col(own_times) == 1).unionByName(found.filter(F.col(own_times) > 1).dropDuplicates([key, own_row]))
    return once.select(*docs.columns).unionByName(docs.filter(empty))
