"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Texts are cut into lanes of about LANE characters at safe spaces, where tokens of both vocabularies end.  A batch of lanes is
merged in lockstep: one state vector holds for every lane the current token of A and of B and where they end.  A step emits
the link of each lane's two tokens, marks a cut where both end, and advances A, B or both; finished lanes are compacted away.
A document's lanes stand one after another, so its tokens, links and groups do too.

The links' counts over all documents come from the distinct pairs of each document, added up by Spark.  Up to PAIRS pairs (12
bytes each) their table is broadcast; beyond it pairs are joined by salted shuffles, with the same result.

Defined results: a text that is null or empty, or whose tokens of either vocabulary do not spell a space and the text (the piece
vocabulary may change characters), has no tokens; repeated rows and keys count row by row; ties all count as best; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millwarden.llm.common import in_bytes
from millwarden.llm.encoding import PieceTable, segments
from millwarden.session import cut_lineage

LANE, BATCH_BYTES, HELD = 1 << 10, 1 << 21, 200_000
PAIRS, SALTS = 4_000_000, 16
#: Ids of either vocabulary are under this, so that a pair is one long.
IDS = 1 << 31


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write the 256 bytes: printable bytes as themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    rest = (b for b in range(256) if b not in set(printable))
    return letters | {chr(256 + n): b for n, b in enumerate(rest)}


class Spelled:
    """A vocabulary: encodes lanes, and spells its tokens as bytes end to end (``blob``, ``starts``, ``sizes``)."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.call: Callable = lambda batch: model.encode(batch, num_threads=1)
            self.space, self.table = "", None  # the model adds the space
            spell = [self._piece(model, k) for k in range(model.get_piece_size())]
        else:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            model.encode_special_tokens = True
            self.call = lambda batch: [e.ids for e in model.encode_batch_fast(batch, add_special_tokens=False)]
            self.space = " "
            # Pieces are encoded once while they are held; the table takes the strings of special tokens for these, so their lanes go alone.
            self.table = PieceTable(path, HELD)
            self.special = re.compile("|".join(re.escape(t.content) for t in model.get_added_tokens_decoder().values()) or "(?!)")
            letters = byte_letters()
            spell = [self._letters(model.id_to_token(k), letters) for k in range(model.get_vocab_size())]
        self.blob = np.frombuffer(b"".join(spell), dtype=np.uint8)
        self.sizes = np.array([len(s) for s in spell], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _piece(model, k: int) -> bytes:
        piece = model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()

    @staticmethod
    def _letters(token: str | None, letters: dict[str, int]) -> bytes:
        token = token or ""
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def ids(self, lanes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lanes end to end, and the number of each lane."""
        if self.table is not None:
            alone = [k for k, x in enumerate(lanes) if self.special.search(x)]
            found = self.table.values([("" if self.special.search(x) else x, False) for x in lanes])
            for k, ids in zip(alone, self.call([self.space + lanes[k] for k in alone])):
                found[k] = np.array(ids, dtype="<u4").tobytes()
            return np.frombuffer(b"".join(found), dtype="<u4").astype(np.int64), np.array([len(x) // 4 for x in found], dtype=np.int64)
        found = self.call(lanes)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(counts.sum())), counts

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, end to end."""
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        return self.blob[np.repeat(self.starts[ids] - before, sizes) + np.arange(int(sizes.sum()))]


def lockstep(sizes_a: np.ndarray, counts_a: np.ndarray, sizes_b: np.ndarray, counts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge all lanes at once: links (token of A, token of B, in order, lane by lane), and per token of A and of B whether a cut follows.

    Both sides of a lane have the same number of bytes, and no token is empty.
    """
    first_a, first_b = np.cumsum(counts_a) - counts_a, np.cumsum(counts_b) - counts_b
    # A lane has fewer links than tokens, so its links go to the places of its tokens.
    places = int(counts_a.sum() + counts_b.sum())
    link_a, link_b = np.full(places, -1, dtype=np.int64), np.empty(places, dtype=np.int64)
    cut_a, cut_b = np.zeros(len(sizes_a), dtype=bool), np.zeros(len(sizes_b), dtype=bool)
    lane = np.flatnonzero(counts_a > 0)
    at_a, at_b, out = first_a[lane], first_b[lane], first_a[lane] + first_b[lane]
    stop = at_a + counts_a[lane]
    # The bytes by which A's token reaches further than B's.
    ahead = sizes_a[at_a] - sizes_b[at_b]
    while len(out):
        link_a[out], link_b[out] = at_a, at_b
        out += 1
        cut = ahead == 0
        cut_a[at_a[cut]] = True
        cut_b[at_b[cut]] = True
        on_a, on_b = ahead <= 0, ahead >= 0
        at_a += on_a
        at_b += on_b
        going = at_a < stop
        if not going.all():
            at_a, at_b, out, stop, ahead, on_a, on_b = (x[going] for x in (at_a, at_b, out, stop, ahead, on_a, on_b))
        ahead += np.where(on_a, sizes_a[at_a], 0)
        ahead -= np.where(on_b, sizes_b[at_b], 0)
    made = link_a >= 0
    return link_a[made], link_b[made], cut_a, cut_b


class Aligner:
    """Aligns batches of documents; its tables are made once in a task."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Spelled(path_a), Spelled(path_b)
        # A token as written: of A before another or before B's, of B before another or before the next group.
        self.written = np.array([f"{k}{end}".encode() for n, ends in ((len(self.a.sizes), ",|"), (len(self.b.sizes), ",;")) for end in ends for k in range(n)], dtype=object)

    def documents(self, texts: list[str]) -> list[tuple]:
        """Per text: n_a, n_b, n_groups, n_links, digest of the groups, distinct pairs, how often each is linked."""
        lanes, lane_of = [], []
        for k, text in enumerate(texts):
            if text:
                for part, _ in segments(text, LANE):
                    lanes.append(part)
                    lane_of.append(k)
        empty = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not lanes:
            return [empty] * len(texts)
        of = np.array(lane_of)
        (ids_a, counts_a), (ids_b, counts_b) = self.a.ids(lanes), self.b.ids(lanes)
        good = self._faithful(lanes, of, len(texts), (ids_a, counts_a), (ids_b, counts_b))
        keep = good[of]
        ids_a, ids_b = ids_a[np.repeat(keep, counts_a)], ids_b[np.repeat(keep, counts_b)]
        counts_a, counts_b, of = counts_a[keep], counts_b[keep], of[keep]
        link_a, link_b, cut_a, cut_b = lockstep(self.a.sizes[ids_a], counts_a, self.b.sizes[ids_b], counts_b)
        written = self._written(ids_a, cut_a, ids_b, cut_b)
        per_document = lambda per_lane: np.bincount(of, weights=per_lane, minlength=len(texts)).astype(np.int64)
        n_a, n_b = per_document(counts_a), per_document(counts_b)
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        n_groups = np.bincount(doc_a, weights=cut_a, minlength=len(texts)).astype(np.int64)
        doc_link = doc_a[link_a]
        n_links = np.bincount(doc_link, minlength=len(texts))
        pair = ids_a[link_a] * IDS + ids_b[link_b]
        order = np.lexsort((pair, doc_link))
        pair, doc_link = pair[order], doc_link[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc_link[1:] != doc_link[:-1])])) if len(pair) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(pair)))
        bounds = np.searchsorted(doc_link[new], np.arange(len(texts) + 1))
        ends = np.cumsum(n_a + n_b)
        out = []
        for k in range(len(texts)):
            if not n_a[k]:
                out.append(empty)
                continue
            groups = b"".join(written[ends[k] - n_a[k] - n_b[k] : ends[k]].tolist())[:-1]
            some = slice(bounds[k], bounds[k + 1])
            out.append((int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(groups).hexdigest(), pair[new[some]], times[some]))
        return out

    def _faithful(self, lanes: list[str], of: np.ndarray, n: int, *sides: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Texts whose tokens on both sides spell a space and the text: lane by lane, each with the space before it."""
        body = [f" {x}".encode() for x in lanes]
        want, sizes = np.frombuffer(b"".join(body), dtype=np.uint8), np.array([len(x) for x in body])
        good = np.ones(n, dtype=bool)
        for side, (ids, counts) in zip((self.a, self.b), sides):
            ends = np.concatenate([[0], np.cumsum(side.sizes[ids])])
            at = np.concatenate([[0], np.cumsum(counts)])
            fits = np.diff(ends[at]) == sizes
            good[of[~fits]] = False
            got = side.spelled(ids)
            if fits.all():
                wrong = np.flatnonzero(got != want)
                good[of[np.searchsorted(np.cumsum(sizes), wrong, side="right")]] = False
                continue
            start = np.cumsum(sizes) - sizes
            for k in np.flatnonzero(fits):
                if (got[ends[at[k]] : ends[at[k + 1]]] != want[start[k] : start[k] + sizes[k]]).any():
                    good[of[k]] = False
        return good

    def _written(self, ids_a: np.ndarray, cut_a: np.ndarray, ids_b: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
        """Tokens as written, group by group, A's before B's."""
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        n_a, n_b = (np.cumsum(np.bincount(g)) for g in (group_a, group_b)) if len(ids_a) else (np.zeros(1, int),) * 2
        codes = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        before_b = np.concatenate([[0], n_b])
        codes[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + cut_a * len(self.a.sizes)
        codes[np.arange(len(ids_b)) + n_a[group_b]] = 2 * len(self.a.sizes) + ids_b + cut_b * len(self.b.sizes)
        return self.written[codes]


_FIELDS = "key {}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row: ``key``, ``row`` (its own number), n_a, n_b, n_groups, n_links, groups_sha256, and its distinct ``pairs`` with how often each is linked."""

    def align_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(tokenizer_a, tokenizer_b), TaskContext.get().partitionId() << 40
        rows = ((k, (t.as_py() or "")) for batch in batches for k, t in zip(*batch.columns))
        for run in in_bytes(rows, lambda r: len(r[1]) + 64, batch_bytes):
            done = list(zip(*aligner.documents([t for _, t in run])))
            keys = pa.array([k.as_py() for k, _ in run], kind)
            arrays = [keys, pa.array(range(number, number + len(run)), pa.int64()), *(pa.array(c, pa.int64()) for c in done[:4]), pa.array(done[4], pa.string()), *map(_lists, done[5:])]
            number += len(run)
            yield pa.RecordBatch.from_arrays(arrays, names)

    body = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    field = body.schema["key"].dataType
    kind, fields = to_arrow_type(field), _FIELDS.format(field.simpleString())
    names = [f.split()[0] for f in fields.split(", ")]
    return body.mapInArrow(align_all, fields)


def _lists(values: tuple[np.ndarray, ...]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, ``count`` (links over all documents) and ``best``: no pair of the same token of B has more."""
    counts = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    counts = cut_lineage(counts.withColumn("b", F.col("pair") % IDS))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES, most_pairs: int = PAIRS) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, ``n_best`` and ``count_sum`` (of its links' counts over all documents), groups_sha256."""
    rows = cut_lineage(aligned(docs, tokenizer_a, tokenizer_b, key, text, batch_bytes))
    counts = cut_lineage(pair_counts(rows))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    if counts.count() <= most_pairs:
        judged = links.join(F.broadcast(counts), "pair")
    else:
        # A pair may be in every document: its links go to many tasks.
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = links.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
    sums = judged.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    done = rows.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return done.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
