"""Shards by extendible hashing: a bucket over its byte limit splits on another bit of the hash, no other does.

A row's address is the bits of the md5 of its key; rows of equal keys are told apart by the md5 of key and text, equal rows by
a number of their own.  A round counts the bytes of all prefixes STEP bits longer than those still open, closes each prefix
that fits and whose parent did not, and goes on with the rows of the prefixes that are still too large.  The directory is the
list of closed prefixes.  Rows never move; only sums per prefix are shuffled.

Defined results: a null key or text counts as an empty one; a single row over the limit is a shard of its own; an empty table
has no shards; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millwarden.session import cut_lineage

LIMIT, STEP, WORD = 64 << 20, 12, 60
#: Directory rows up to which a round's lookup table is broadcast.
BROADCAST_ROWS = 100_000


def _bits(value: Column) -> Column:
    """The first 60 bits of the md5 of a string."""
    return F.lpad(F.conv(F.substring(F.md5(value), 1, WORD // 4), 16, 2), WORD, "0")


def _address(bits: int) -> Column:
    """The first ``bits`` bits of a row's address."""
    level, rest = divmod(bits, WORD)
    name, far = F.coalesce(F.col("key").cast("string"), F.lit("")), F.concat_ws("|", "text_hash", F.lit(""))
    parts = [_bits(name), _bits(F.concat(name, F.lit("|"), far))] + [_bits(F.concat(F.col("number").cast("string"), F.lit(f"|{k}"))) for k in range(max(0, level - 1))]
    return F.substring(F.concat(*parts[: level + (rest > 0)]), 1, bits)


def assign_shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text", step: int = STEP) -> DataFrame:
    """Per row: key, ``n_bytes``, ``shard`` (its prefix of hash bits), ``shard_bytes`` and ``shard_rows``."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.octet_length(whole).cast("long").alias("n_bytes"), F.md5(whole).alias("text_hash"))
    rows = cut_lineage(rows)
    rows = cut_lineage(rows.withColumn("number", F.monotonically_increasing_id()))
    done, depth = None, 0
    while True:
        ahead = depth + step
        placed = rows.withColumn("leaf", _address(ahead))
        leaves = placed.groupBy("leaf").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        # Of every prefix between the depth of the open ones and that of the leaves.
        nodes = leaves.select("leaf", "bytes", "n", F.explode(F.sequence(F.lit(depth), F.lit(ahead))).alias("d"))
        sizes = nodes.groupBy(F.expr("substring(leaf, 1, d)").alias("prefix"), "d").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        fits = (F.col("bytes") <= limit) | (F.col("n") == 1)
        paths = nodes.select("leaf", F.expr("substring(leaf, 1, d)").alias("prefix"), "d").join(sizes.drop("d"), "prefix")
        lookup = cut_lineage(paths.groupBy("leaf").agg(F.min(F.when(fits, F.struct("d", "prefix", "bytes", "n"))).alias("found")))
        small = lookup.count() <= BROADCAST_ROWS
        found = placed.join(F.broadcast(lookup) if small else lookup, "leaf")
        closed = found.filter("found IS NOT NULL").select("key", "n_bytes", F.col("found.prefix").alias("shard"), F.col("found.bytes").alias("shard_bytes"),
                                                         F.col("found.n").alias("shard_rows"))
        done = closed if done is None else done.union(closed)
        if lookup.filter("found IS NULL").isEmpty():
            return done.withColumnRenamed("key", key)
        rows, depth = cut_lineage(found.filter("found IS NULL").select("key", "n_bytes", "text_hash", "number")), ahead


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the rows of ``docs`` (keys unique, or it is an error) below ``folder``, a directory per shard; returns the directory table.

    The directory of the one shard of a small table is ``_shard=root``, as its prefix is empty.
    """
    if not docs.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    assigned = cut_lineage(assign_shards(docs, limit, key, text).select(F.col(key).alias("_key"), "shard", "shard_bytes", "shard_rows"))
    name = F.when(F.col("shard") == "", "root").otherwise(F.concat(F.lit("b"), "shard"))
    placed = docs.join(assigned.select("_key", name.alias("_shard")), docs[key].eqNullSafe(F.col("_key"))).drop("_key")
    placed.repartition("_shard").write.partitionBy("_shard").parquet(folder)
    return assigned.groupBy("shard").agg(F.first("shard_bytes").alias("shard_bytes"), F.first("shard_rows").alias("shard_rows"))


def oracle(limit: int = LIMIT) -> str:
    """DuckDB SQL over ``documents``, whose keys are distinct."""
    return f"""
WITH rows AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
  lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {WORD // 4}) AS BIGINT)), {WORD}, '0') AS bits FROM documents),
nodes AS (SELECT substr(bits, 1, d) AS prefix, sum(n_bytes) AS bytes, count(*) AS n FROM rows, range(0, {WORD + 1}) AS r(d) GROUP BY 1),
fitting AS (SELECT doc_id, n_bytes, bytes, n, prefix, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS k FROM rows, range(0, {WORD + 1}) AS r(d)
  JOIN nodes ON prefix = substr(bits, 1, d) WHERE bytes <= {limit} OR n = 1)
SELECT doc_id, n_bytes, prefix AS shard, CAST(bytes AS BIGINT) AS shard_bytes, CAST(n AS BIGINT) AS shard_rows FROM fitting WHERE k = 1"""
