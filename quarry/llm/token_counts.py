"""Token counts: pieces counted once per distinct pre-token, summed per document.

In this vocabulary no piece joins a character to a following word mark, so a text's pieces
are the pieces of its space-led pre-tokens, one after the other.  Each worker counts the
pieces of a pre-token once and keeps the count, not the ids; the documents' pre-token
frequencies (dictionary codes of an Arrow chunk) are joined to those counts and summed.

A corpus-wide join by pre-token would shuffle a row for nearly every word of the corpus
(about 9 bytes for each 6 bytes of text), which is why the join stays inside the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, texts

MARK = "▁"
#: Pre-tokens a worker remembers before it starts afresh; bounds memory, not results.
REMEMBERED = 400_000


class PieceCounter:
    """Counts of pieces for whole texts by way of their distinct pre-tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the vocabulary has pieces across a word mark; pre-tokens can't be counted alone")
        self.known: dict[str, int] = {}

    def pretokens(self, words: list[str]) -> np.ndarray:
        """Pieces of each word with one word mark before it."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [w for w in words if w not in known]
        known.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def one(self, text: str) -> int:
        """Pieces of a text that has runs of spaces or spaces at an end."""
        if MARK in text:  # stands for a space, so cuts at spaces would part runs
            return len(self.model.encode(text))
        if not text:
            return 0
        keys, run, total = [], 0, 0
        for word in text.split(" "):
            if word:
                keys.append(" " * run + word)
                run = 0
            else:
                run += 1
        if run == 1:
            total += len(self.model.encode(MARK)) - 1 or 1
        elif run:
            keys.append(" " * (run - 1))
        return total + int(self.pretokens(keys).sum())

    def count(self, column: pa.Array) -> np.ndarray:
        """Pieces of each text."""
        words = pc.split_pattern(column, " ")
        starts = words.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        coded = pc.dictionary_encode(words.flatten())
        distinct = coded.dictionary.to_pylist()
        counts = self.pretokens(distinct)
        codes = coded.indices.to_numpy()
        sums = np.concatenate([[0], np.cumsum(counts[codes])])
        out = sums[starts[1:]] - sums[starts[:-1]]
        odd = np.array([not w or MARK in w for w in distinct], bool)
        if odd.any():
            marks = np.concatenate([[0], np.cumsum(odd[codes])])
            for k in np.flatnonzero(marks[starts[1:]] > marks[starts[:-1]]):
                out[k] = self.one(column[int(k)].as_py())
        return out


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    A null text counts as empty: 0 bytes, 0 tokens.  Rows are kept as they are: a null id stays null
    and repeated rows stay repeated.  Other columns, whatever their names, are not read.
    """
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path)
        for batch in chunks(batches, "text"):
            column = texts(batch, "text")
            n = counter.count(column)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pc.binary_length(column).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names
            )

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
