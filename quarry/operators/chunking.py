"""Recursive character splitting into overlapping chunks.

The contract: a text is cut at the coarsest separator it has (paragraph, line, blank, then anywhere); a
separator stays at the head of the piece after it; pieces longer than ``size`` are cut by
the next separators; neighbouring pieces are joined while they fit, and a chunk begins with
the pieces of its predecessor that fit ``overlap``.  Chunks are stripped and never empty.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")
#: Characters and rows of chunks that a Python worker hands on at once.
BATCH_CHARS, BATCH_ROWS = 4 << 20, 10_000


def pieces(text: str, separator: str) -> Iterator[str]:
    if not separator:
        yield from text
        return
    start, at = 0, text.find(separator)
    while at >= 0:
        if at > start:
            yield text[start:at]
        start, at = at, text.find(separator, at + len(separator))
    if start < len(text):
        yield text[start:]


def joined(parts: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Consecutive parts as chunks of at most ``size`` characters."""
    held: deque[str] = deque()
    length = 0
    for part in parts:
        if held and length + len(part) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.popleft())
        held.append(part)
        length += len(part)
    if held:
        yield "".join(held)


def cuts(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """The chunks of a text before they are stripped, one after the other: no list of its pieces is held."""
    k = next(k for k, s in enumerate(separators) if s in text)
    for small, run in groupby(pieces(text, separators[k]), lambda p: len(p) <= size):
        if small:
            yield from joined(run, size, overlap)
            continue
        for piece in run:
            yield from cuts(piece, size, overlap, separators[k + 1 :]) if separators[k + 1 :] else [piece]


def stripped(chunks: Iterable[str]) -> Iterator[str]:
    return (c for c in (c.strip() for c in chunks) if c)


def split(text: str, size: int = 800, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of a text."""
    return list(stripped(cuts(text, size, overlap, separators)))


def chunked(documents: DataFrame, size: int = 800, overlap: int = 100, text_col: str = "text") -> DataFrame:
    """``documents`` with ``chunk_no`` (from 0) and the chunk in place of the text; blank and null texts have no chunk.

    Rows are independent, so nothing is shuffled.  A worker holds the Arrow batch it was given, one text and ``BATCH_CHARS`` of
    chunks, and never repeats the whole text for each of its chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    names = documents.columns
    at = names.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)

    def batch_of(source: pa.RecordBatch, row: list[int], number: list[int], text: list[str]) -> pa.RecordBatch:
        rows = pa.array(row, pa.int64())
        columns = [pa.array(text, pa.string()) if k == at else source.column(k).take(rows) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(number, pa.int32())], [*names, "chunk_no"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, text, held = [], [], [], 0
            for k, value in enumerate(batch.column(at)):
                for n, chunk in enumerate(stripped(cuts(value.as_py() or "", size, overlap))):
                    row.append(k)
                    number.append(n)
                    text.append(chunk)
                    held += len(chunk)
                    if held >= BATCH_CHARS or len(row) >= BATCH_ROWS:
                        yield batch_of(batch, row, number, text)
                        row, number, text, held = [], [], [], 0
            if row:
                yield batch_of(batch, row, number, text)

    return documents.mapInArrow(cut, f"{fields}, chunk_no int")


def with_ids(chunks: DataFrame) -> DataFrame:
    """Chunks with a ``chunk_id`` that hangs on where they are from and not on how Spark dealt them."""
    return chunks.withColumn("chunk_id", F.xxhash64("source", "page", "chunk_no", "text"))
