"""Packing in document order: cuts by dynamic programming, padding against cut penalties.

Documents are dealt out by ranges of their key, so each task has a stretch of the ordered stream.  Over blocks of that stream
the cuts between sequences are chosen among document ends (free), sentence ends and, where neither comes for a while, places
between words.  A sequence of L tokens costs the padding to ``length`` (none at a power of two); a cut costs its penalty.  With
positions p and costs c, a cut at j costs pen[j] + length - p[j] + min(c[i] + p[i]) over the i within reach: a monotone queue
gives the minimum, so the work is linear in the number of candidates.  Every block leaves its last sequence open to the next.

A sequence that would be padded by more than cutting it into powers of two costs is cut so: that is how a stretch ends.

Defined results: a null text is an empty one, the end id alone; null keys come first; repeated keys are ordered by the hash of
their texts and stay separate documents; an empty table gives no rows; other columns are not read.  Sequence ids are unique
but not consecutive: (task << 32) + number in the task.  A retried task makes the same rows, as its rows come in a fixed order.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millwarden.llm.encoding import encoded

LENGTH = 2048
#: Tokens that a cut inside a document is worth: at a sentence's end, elsewhere.
SENTENCE, INSIDE = 4, 32
#: Candidates lie at least APART and at most GAP tokens from one another (document ends are always candidates).
APART, GAP = 8, 64
BLOCK = 1 << 18
POWERS = (256, 512, 1024)
ROWS = 20_000


def padding(n: int, length: int = LENGTH) -> int:
    return 0 if n & (n - 1) == 0 else length - n


def candidates(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions where a sequence may end, and their penalties; ``ends`` are document ends, ``stops`` flags sentence-final ids."""
    sentence = np.flatnonzero(stops[ids]) + 1
    spread = np.concatenate([np.arange(s + GAP, e, GAP) for s, e in zip(np.concatenate([[0], sentence]), np.concatenate([sentence, [len(ids)]])) if e - s > GAP] or [[]])
    places = np.concatenate([ends, sentence, spread]).astype(np.int64)
    worth = np.concatenate([np.zeros(len(ends)), np.full(len(sentence), SENTENCE), np.full(len(spread), INSIDE)]).astype(np.int64)
    order = np.lexsort((worth, places))
    places, worth = places[order], worth[order]
    single = np.concatenate([[True], places[1:] != places[:-1]])
    places, worth = places[single].tolist(), worth[single].tolist()
    kept, pen, last = [0], [0], 0
    for p, w in zip(places, worth):
        if w == 0 or p - last >= APART:
            kept.append(p)
            pen.append(w)
            last = p
    if kept[-1] != len(ids):
        kept.append(len(ids))
        pen.append(INSIDE)
    return kept, pen


def best_cuts(places: list[int], pen: list[int], length: int = LENGTH) -> list[int]:
    """Cut positions of least total cost from places[0] to places[-1]; neighbours are at most ``length`` apart."""
    n, cost, back = len(places), [0] * len(places), [0] * len(places)
    worth, at = list(places), {places[0]: 0}
    queue = deque([0])
    for j in range(1, n):
        p = places[j]
        while p - places[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        best = worth[i] + length - p
        for power in POWERS:
            k = at.get(p - power)
            if k is not None and cost[k] < best:
                i, best = k, cost[k]
        cost[j], back[j], at[p] = best + pen[j], i, j
        w = worth[j] = cost[j] + p
        while queue and worth[queue[-1]] >= w:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


def in_powers(n: int, length: int = LENGTH) -> list[int]:
    """``n`` whole, or as powers of two if their cuts cost less than its padding."""
    if padding(n, length) <= INSIDE * (n.bit_count() - 1):
        return [n]
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_stream(documents: Iterator[tuple[object, np.ndarray]], stops: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> Iterator[tuple]:
    """Pieces (key, start, length, ids, document's ids, sequence, offset) of documents in order; a block is held at a time."""
    waiting, held, sequence = [], 0, 0  # waiting: (key, ids, first id not yet packed)

    def packed(last: bool) -> Iterator[tuple]:
        nonlocal waiting, held, sequence
        ids = np.concatenate([d[1][d[2] :] for d in waiting])
        ends = np.cumsum([len(d[1]) - d[2] for d in waiting])
        cuts = best_cuts(*candidates(ids, ends, stops), length)
        runs, start = [], 0
        for cut in cuts if last else cuts[:-1]:
            runs += in_powers(cut - start, length)
            start = cut
        if not last and not runs:
            return
        docs = deque(waiting)
        for run in runs:
            offset = 0
            while offset < run:
                key, whole, at = docs.popleft()
                n = min(len(whole) - at, run - offset)
                yield key, at, n, whole[at : at + n], len(whole), sequence, offset
                offset += n
                if at + n < len(whole):
                    docs.appendleft((key, whole, at + n))
            sequence += 1
        waiting, held = list(docs), len(ids) - sum(runs)

    for key, ids in documents:
        waiting.append((key, ids, 0))
        held += len(ids)
        if held >= block:
            yield from packed(last=False)
    if held:
        yield from packed(last=True)


def sentence_stops(tokenizer: str, size: int = 1 << 16) -> np.ndarray:
    """Flags of the ids that end a sentence: tokens whose text ends in a stop."""
    from tokenizers import Tokenizer

    flags = np.zeros(size, dtype=bool)
    for token, k in Tokenizer.from_file(tokenizer).get_vocab().items():
        flags[k] = token.removesuffix("</w>").endswith((".", "!", "?"))
    return flags


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids`` themselves if asked for)."""
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops, task = sentence_stops(tokenizer), TaskContext.get().partitionId()
        whole_texts = ((k.as_py(), t.as_py()) for batch in batches for k, t in zip(batch.column(0), batch.column(1)))
        documents = ((k, np.append(ids, np.uint32(end_id))) for k, ids in encoded(tokenizer, whole_texts))
        found = []
        for key_, start, n, ids, whole, sequence, offset in pack_stream(documents, stops, length):
            row = (key_, start, n, zlib.crc32(np.ascontiguousarray(ids)), whole, (task << 32) + sequence, offset)
            found.append((*row, ids.tolist()) if with_ids else row)
            if len(found) == ROWS:
                yield rows(found)
                found = []
        if found:
            yield rows(found)

    body = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ordered = body.repartitionByRange(F.col("key"), F.xxhash64("text")).sortWithinPartitions(F.col("key"), F.xxhash64("text"))
    fields = ", ".join(f"`{n}` long" for n in names[:7]) + ", ids array<int>" * with_ids
    return ordered.select("key", "text").mapInArrow(packed, fields)
