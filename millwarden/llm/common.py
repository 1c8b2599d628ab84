"""What several operators share: words, files in the shared folder, rows out of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

#: The white space that ends a word.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """Words of a text; none for a null or empty one."""
    trimmed = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh_name(df: DataFrame, wish: str) -> str:
    """``wish``, or the first variant of it that ``df`` has no column for (names compare without case)."""
    taken, name, k = {c.lower() for c in df.columns}, wish, 1
    while name.lower() in taken:
        name, k = f"{wish}_{k}", k + 1
    return name


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


@contextmanager
def whole_file(uri: str, name: str, attempt: int) -> Iterator[pa.NativeFile]:
    """Output stream of a draft of this attempt, moved to ``name`` when done: a retried or speculative task leaves one whole file."""
    system, folder = file_system(uri)
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{attempt}"
    with system.open_output_stream(draft, compression=None) as out:
        yield out
    system.move(draft, f"{folder}/{name}")


def in_bytes(items: Iterator[tuple], size: Callable[[tuple], int], limit: int) -> Iterator[list[tuple]]:
    """Runs of items of about ``limit`` bytes; a larger item is a run of its own."""
    run, held = [], 0
    for item in items:
        n = size(item)
        if run and held + n > limit:
            yield run
            run, held = [], 0
        run.append(item)
        held += n
    if run:
        yield run
