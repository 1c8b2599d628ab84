"""Token ids in binary files: fixed-size blocks, transposed into planes, each plane compressed, with a chunk index.

A file holds a range of documents in key order.  Its ids, documents end to end, are cut into blocks of ``block`` ids.  A block
is transposed: plane k has byte k (or bit k) of every id; planes above the block's largest id are left out, each other is
compressed by zstandard.  The index at the end has, per block, its offset, its ids and the bytes of its planes, and per
document its key and its ids.  Any block can be read alone.

    magic | planes of block 0 | planes of block 1 | ... | index (JSON, zstandard) | index bytes (uint64) | magic

Files go to the folder that driver and executors share; a file appears whole or not at all, so a lost task is run again
without harm.  Defined results: a null text is an empty one, a document of the end id alone; null keys come first; repeated
keys are ordered by the hash of their texts; an empty table makes no files and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from millwarden.llm.common import file_system, whole_file
from millwarden.llm.encoding import encoded
from millwarden.session import cut_lineage, scratch_path

MAGIC = b"IDPLANE1"
BLOCK, LEVEL = 1 << 16, 3


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Byte or bit planes of ids, up to the highest that is not all zero."""
    top = int(ids.max()) if len(ids) else 0
    if kind == "byte":
        rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [rows[:, k].tobytes() for k in range((top.bit_length() + 7) // 8)]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(top.bit_length())]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    ids = np.zeros(n, dtype="<u4")
    for k, plane in enumerate(planes):
        if kind == "byte":
            ids.view(np.uint8).reshape(-1, 4)[:, k] = np.frombuffer(plane, dtype=np.uint8)
        else:
            ids |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n).astype("<u4") << np.uint32(k)
    return ids


class PlaneWriter:
    """Streams documents into an open file; holds one block and the index."""

    def __init__(self, out, kind: str, block: int, level: int):
        self.out, self.kind, self.block, self.pack = out, kind, block, zstandard.ZstdCompressor(level=level).compress
        self.index = {"kind": kind, "block": block, "blocks": [], "keys": [], "lengths": []}
        self.waiting, self.held, self.at = [], 0, len(MAGIC)
        out.write(MAGIC)

    def add(self, key, ids: np.ndarray) -> None:
        self.index["keys"].append(key)
        self.index["lengths"].append(len(ids))
        while len(ids):
            part, ids = ids[: self.block - self.held], ids[self.block - self.held :]
            self.waiting.append(part)
            self.held += len(part)
            if self.held == self.block:
                self._flush()

    def _flush(self) -> None:
        if self.held:
            planes = [self.pack(p) for p in to_planes(np.concatenate(self.waiting), self.kind)]
            self.index["blocks"].append([self.at, self.held, [len(p) for p in planes]])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
            self.waiting, self.held = [], 0

    def close(self) -> None:
        self._flush()
        index = self.pack(json.dumps(self.index).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


def read_index(file) -> dict:
    size = file.size()
    file.seek(size - 16)
    tail = file.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a plane file, or not whole")
    n = int.from_bytes(tail[:8], "little")
    file.seek(size - 16 - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(file.read(n)))


def read_block(file, index: dict, k: int) -> np.ndarray:
    """Ids of block ``k`` alone."""
    at, n, sizes = index["blocks"][k]
    file.seek(at)
    return from_planes([zstandard.ZstdDecompressor().decompress(file.read(s)) for s in sizes], n, index["kind"])


def read_documents(file) -> Iterator[tuple[object, int, list[np.ndarray]]]:
    """(key, ids before it in the file, its ids in parts), in order; one block is held at a time."""
    index = read_index(file)
    k, rest, before = 0, np.zeros(0, dtype="<u4"), 0
    for key, length in zip(index["keys"], index["lengths"]):
        parts, wanted = [], length
        while wanted:
            if not len(rest):
                rest, k = read_block(file, index, k), k + 1
            parts.append(rest[:wanted])
            rest, wanted = rest[wanted:], wanted - len(parts[-1])
        yield key, before, parts
        before += length


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, key: str = "doc_id", text: str = "text",
              kind: str = "byte", block: int = BLOCK, level: int = LEVEL) -> DataFrame:
    """Write the ids of all documents in key order; returns the manifest, a row per file: file, first, docs, tokens."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k.as_py(), h.as_py(), t.as_py()) for batch in batches for k, h, t in zip(*batch.columns))
        opening = next(rows, None)
        if opening is None:
            return
        task = TaskContext.get()
        name, docs_here, tokens = f"ids-{task.partitionId():06d}.bpl", 0, 0
        with whole_file(folder, name, task.taskAttemptId()) as out:
            writer = PlaneWriter(out, kind, block, level)
            for key_, _, found in encoded(tokenizer, chain([opening], rows)):
                ids = np.append(found, np.uint32(end_id))
                writer.add(key_, ids)
                docs_here, tokens = docs_here + 1, tokens + len(ids)
            writer.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "first": [opening[0]], "first_hash": [opening[1]], "docs": [docs_here], "tokens": [tokens]})

    body = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).cast("string").alias("text"))
    ordered = body.repartitionByRange("key", "hash").sortWithinPartitions("key", "hash")
    manifest = ordered.mapInArrow(write, "file string, first long, first_hash long, docs long, tokens long")
    return cut_lineage(manifest.withColumn("folder", F.lit(folder)))


def read_ids(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read the files back: per document its key, ids before it over all files, number of ids and their crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name, base in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = file_system(folder)
                found = []
                with system.open_input_file(f"{at}/{name}") as file:
                    for key_, before, parts in read_documents(file):
                        crc, n = 0, 0
                        for p in parts:
                            crc, n = zlib.crc32(np.ascontiguousarray(p), crc), n + len(p)
                        found.append((key_, base + before, n, crc))
                        if len(found) == 50_000:
                            yield _rows(found)
                            found = []
                yield _rows(found)

    # One row per file; the running total needs them in order, in one task, and nothing of the data.
    before = Window.orderBy("first", "first_hash", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("folder", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, f"{key} long, start long, n_tokens long, ids_crc32 long")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])
