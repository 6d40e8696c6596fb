"""Word shingles of many texts, and rows numbered by their place in the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, slices, small_batches, with_rows
from .words import ALNUM, Words, window_hash

WIDTH = 5


def numbered(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """(rid, doc_id, text), rid as by with_rows() or, if given, from row_col."""
    small_batches(docs.sparkSession)
    columns = [F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    if row_col:
        return docs.select(F.col(f"`{row_col}`").alias("rid"), *columns)
    return with_rows(docs.select(*columns), "rid").select("rid", "doc_id", "text")


def sequences(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, Words, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(first row, words, hashes of the shingles of each text in order, bytes, offsets) of slices of a column.

    A shingle is `width` words; a text of fewer, but not none, has one shingle of them all.
    """
    for i, j in slices(column):
        data, offsets = flat(column.slice(i, j - i))
        w = Words(data, offsets, ALNUM)
        every = window_hash(w.hash, width)
        out = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            out.append(every[a : b - width + 1] if b - a >= width else window_hash(w.hash[a:b], b - a) if b > a else every[:0])
        yield i, w, out, data, offsets
