"""Token counts: lengths only leave the Arrow tasks.

A task cuts long texts at safe places, gathers the parts into batches of about equal bytes, encodes each batch and adds up
the lengths.  No text is shuffled: tasks follow the scan, whose splits are even in bytes.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); repeated rows and ids are counted row by row; an
empty table gives no rows; columns other than the key and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millwarden.llm.common import in_bytes
from millwarden.llm.encoding import Vocabulary, segments

BATCH_BYTES = 1 << 20


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row: key, ``n_bytes`` (UTF-8), ``n_tokens`` and whether they are more than ``limit``."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tokenizer)
        for batch in batches:
            whole, totals = batch.column(1), [0] * batch.num_rows
            parts = ((row, part, first) for row in range(batch.num_rows) for part, first in segments(whole[row].as_py() or ""))
            for run in in_bytes(parts, lambda x: len(x[1]), batch_bytes):
                inner = [part if first else vocabulary.space + part for _, part, first in run]
                for (row, *_), ids in zip(run, vocabulary.call(inner)):
                    totals[row] += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals, pa.int64())], ["key", "n_bytes", "n_tokens"])

    body = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    body = body.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = body.schema["key"].dataType.simpleString()
    counted = body.mapInArrow(lengths, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
